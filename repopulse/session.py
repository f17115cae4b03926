"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Settings that matter for results or for skewed input. Sizes (partitions,
#: memory) belong to the cluster and are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Recording the Python call site of every column costs more than planning.
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "repopulse", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; ``settings`` override them.

    ``master`` is only given in tests and local runs: on a cluster the launcher
    sets it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: below ``spark.checkpoint.dir``, or
    in the warehouse where that is not set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/repopulse-{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster for stream checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: name a shared folder or pass one explicitly")
    return root.rstrip("/")
