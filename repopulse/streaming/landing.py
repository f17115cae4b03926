"""The collection loop over pages as a bounded file stream.

A collection takes page after page until there are no more. Here newly landed
page files are picked up once each, their nodes are appended to a table and the
run ends; the next run continues where this one stopped, also after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from repopulse.session import checkpoint_root
from repopulse.sources.pages import explode_nodes, parse_pages


def page_stream(spark: SparkSession, path: str) -> DataFrame:
    """Page files under ``path`` as a stream of ``page, raw``."""
    lines = spark.readStream.format("text").option("wholetext", "true").load(path)
    return parse_pages(lines)


def land_nodes(
    spark: SparkSession, pages_path: str, nodes_path: str, checkpoint: str | None = None, name: str = "land_nodes"
) -> StreamingQuery:
    """Append the nodes of all new pages to ``nodes_path`` and stop.

    The checkpoint defaults to a folder under the one the cluster names in
    ``spark.checkpoint.dir``.
    """
    location = checkpoint or f"{checkpoint_root(spark)}/{name}"
    return (
        explode_nodes(page_stream(spark, pages_path))
        .writeStream.queryName(name)
        .format("parquet")
        .option("path", nodes_path)
        .option("checkpointLocation", location)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
