"""Landed result pages: one JSON document per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse.functions.presence import integer_at, is_empty_node, is_empty_text, object_key
from repopulse.operators.ranking import check_limit


def read_pages(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """``page, raw``: pages as variants, named so that their names sort in reading order.

    Pages are small (a page holds 100 nodes at most), so a file per page is a
    row. Pages landed as JSON lines are split like any text; a line is named by
    its file, the block it lies in and its place there.
    """
    lines = spark.read.text(path, wholetext=not one_per_line)
    if not one_per_line:
        return parse_pages(lines)
    place = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    name = F.concat_ws(
        "#", F.col("_metadata.file_path"), *[F.lpad(part.cast("string"), 19, "0") for part in place]
    )
    return lines.select(name.alias("page"), F.parse_json("value").alias("raw"))


def parse_pages(lines: DataFrame) -> DataFrame:
    """Whole-file rows (``value``) of a text source, batch or stream, to ``page, raw``."""
    return lines.select(F.col("_metadata.file_path").alias("page"), F.parse_json("value").alias("raw"))


def _search(page: Column) -> Column:
    # Pages come with or without the envelope of the service.
    return F.coalesce(object_key(page, "data.search"), object_key(page, "search"))


def explode_nodes(pages: DataFrame) -> DataFrame:
    """``page, pos, raw``: every non-empty node of every page with its place.

    ``pos`` counts the entries of the page, so ``(page, pos)`` is the order in
    which the service returned the nodes.
    """
    nodes = F.try_variant_get(_search(F.col("raw")), "$.nodes", "array<variant>")
    return (
        pages.select("page", F.posexplode(nodes).alias("pos", "node"))
        .where(~is_empty_node(F.col("node")))
        .select("page", "pos", F.col("node").alias("raw"))
    )


def nodes_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Nodes from a table with one JSON node per row: ``keep..., raw``."""
    return df.where(~is_empty_text(F.col(text))).select(*keep, F.parse_json(F.col(text)).alias("raw"))


def take_nodes(nodes: DataFrame, n: int, maximum: int | None = None) -> DataFrame:
    """The first ``n`` nodes in page order; a ``maximum`` limits ``n`` as a search does."""
    check_limit(n, maximum)
    return nodes.orderBy("page", "pos").limit(n)


def total_available(pages: DataFrame) -> DataFrame:
    """One row: the count announced by the first page that has one, and the pages read."""
    counted = pages.select("page", integer_at(_search(F.col("raw")), "repositoryCount").alias("announced"))
    return counted.agg(
        F.min_by("announced", F.when(F.col("announced").isNotNull(), F.col("page"))).alias("total_available"),
        F.count(F.lit(1)).alias("pages"),
    )
