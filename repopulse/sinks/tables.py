"""Result tables and their CSV forms.

Nothing is gathered into one file: a table is a directory of part files. Writes
to one partition stay spread over tasks (``rebalance`` splits what is too large).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repopulse import vocabulary as V
from repopulse.functions.instants import iso_week
from repopulse.operators.reconcile import without_raw


def counted_write(df: DataFrame, save: Callable[[DataFrame], None]) -> int:
    """Write ``df`` by ``save`` and return how many rows were written, counted on their way."""
    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get.get("rows", 0)


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, int]:
    """Each table under its name, in ``fmt`` (Parquet or JSON lines); the rows of each."""

    def save(name: str) -> Callable[[DataFrame], None]:
        return lambda df: df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")

    return {name: counted_write(table, save(name)) for name, table in tables.items()}


def _replace_unless_empty(df: DataFrame, path: str, save: Callable[[DataFrame, str], None]) -> int:
    """Write beside ``path`` and take its place, in one pass; a table without rows leaves
    what was there as it was."""
    incoming = f"{path.rstrip('/')}.incoming-{uuid.uuid4().hex}"
    rows = counted_write(df, lambda counted: save(counted, incoming))
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(incoming), jvm.Path(path.rstrip("/"))
    files = source.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    if not rows:
        files.delete(source, True)
        return 0
    files.delete(target, True)
    if not files.rename(source, target):
        raise OSError(f"{incoming} cannot be moved to {path}")
    return rows


def with_document_keys(records: DataFrame) -> DataFrame:
    """The records under the keys of a result document, raw node included.

    Written as JSON lines this is the ``repositorios`` list of a document, one
    record per line instead of one file for all.
    """
    keys = {**V.DOCUMENT_KEYS, "raw": V.RAW_KEY}
    return records.select(*[F.col(c).alias(keys.get(c, c)) for c in records.columns])


def with_week(records: DataFrame, reference_at: datetime | Column) -> DataFrame:
    """Add the ISO year and week of the collection.

    One reference instant for all rows gives two literals; a date column is
    taken row by row.
    """
    if isinstance(reference_at, Column):
        return records.withColumns(iso_week(reference_at))
    year, week = iso_year_week(reference_at)
    return records.withColumns({"iso_year": F.lit(year), "iso_week": F.lit(week)})


def iso_year_week(reference_at: datetime) -> tuple[int, int]:
    """ISO year and week of an instant in UTC; a naive one is taken as UTC."""
    if reference_at.tzinfo is not None:
        reference_at = reference_at.astimezone(timezone.utc)
    return tuple(reference_at.isocalendar()[:2])


def write_snapshot(records: DataFrame, path: str, reference_at: datetime, fmt: str = "parquet") -> None:
    """The tabular records of one collection as the snapshot of its ISO week.

    A second run in the same week replaces that week only.
    """
    weekly = with_week(without_raw(records), reference_at)
    if fmt == "csv":
        weekly = as_csv_text(weekly, keep=("iso_year", "iso_week"))
    (
        weekly.hint("rebalance")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(_CSV_OPTIONS if fmt == "csv" else {}))
        .partitionBy("iso_year", "iso_week")
        .format(fmt)
        .save(path)
    )


def snapshot_name(reference_at: datetime) -> str:
    """Name of a week's snapshot."""
    year, week = iso_year_week(reference_at)
    return f"{V.SNAPSHOT_PREFIX}_{year}-W{week:02d}"


_CSV_OPTIONS = {"header": "true", "nullValue": "", "emptyValue": "", "encoding": "UTF-8"}


def plain_number(value: Column) -> Column:
    """A double with at most 4 decimals as text without exponent."""
    return F.call_function("format_number", value, F.lit("0.0###"))


def as_csv_text(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Booleans as ``True``/``False``, instants as ISO text in UTC."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name not in keep and isinstance(field.dataType, T.BooleanType):
            column = F.initcap(column.cast("string"))
        elif field.name not in keep and isinstance(field.dataType, T.TimestampType):
            column = F.concat(column.cast("timestamp_ntz").cast("string"), F.lit("+00:00"))
            column = F.replace(column, F.lit(" "), F.lit("T"))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _save_csv(df: DataFrame, path: str) -> None:
    df.write.options(**_CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; missing cells are empty. No rows is an error."""
    if not _replace_unless_empty(as_csv_text(without_raw(df)), path, _save_csv):
        raise ValueError("there are no rows to export as CSV")


def consolidated_columns(
    name: Column, age_years: Column, merged_prs: Column, releases: Column,
    stale_days: Column, language: Column, ratio: Column,
) -> list[Column]:
    """The seven columns of the consolidated table under their headers."""
    h = V.CONSOLIDATED_HEADERS
    return [
        name.alias(h["repo_key"]),
        age_years.alias(h["age_years"]),
        merged_prs.alias(h["merged_prs"]),
        releases.alias(h["releases"]),
        stale_days.alias(h["stale_days"]),
        F.coalesce(language, F.lit(V.NO_LANGUAGE)).alias(h["language"]),
        F.coalesce(plain_number(ratio), F.lit(V.NOT_AVAILABLE)).alias(h["closed_ratio"]),
    ]


def consolidated(records: DataFrame) -> DataFrame:
    """Consolidated table of typed records.

    A count column the table lacks counts as 0; a null in one it has stays null.
    """

    def count(column: str) -> Column:
        return F.col(column) if column in records.columns else F.lit(0).cast("long")

    return records.select(
        *consolidated_columns(
            F.col("repo_key"), F.col("age_years"), count("merged_prs"), count("releases"),
            F.col("stale_days"), F.col("language"), F.col("closed_ratio"),
        )
    )


def write_consolidated(table: DataFrame, path: str) -> bool:
    """Write the consolidated table; nothing is written for no rows."""
    return _replace_unless_empty(table, path, _save_csv) > 0


def metric_table(ranked: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``rank, repository, stars`` and the metric columns, renamed for the table."""
    named = [F.col(source).alias(name) for source, name in columns.items()]
    return ranked.select("rank", F.col("repo_key").alias("repository"), "stars", *named)


def write_metric_table(ranked: DataFrame, columns: Mapping[str, str], path: str) -> None:
    """:func:`metric_table` as CSV."""
    write_csv(metric_table(ranked, columns), path)
