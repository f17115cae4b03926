"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset, a local session uses a temporary folder and any other
    the warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[")
        root = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/repopulse-{name}-{uuid.uuid4().hex}"


#: Rows of a file, where their number is known.
_ROWS = 500_000


def store(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: later steps start from the
    stored table, whatever executor is lost. Where ``df`` is known to have ``most`` rows
    at most, its last step takes a task and a file for each half million of them: a local file
    system starts three processes for each file."""
    path = shared_folder(df.sparkSession, name)
    (df if most is None else df.coalesce(1 + most // _ROWS)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns``; the operators never see clashing names of others."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df.select(*columns)
