"""Ordering, limits and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repopulse.functions.text import lookup_key
from repopulse.session import shared_folder


def top_k(df: DataFrame, k: int, by: str = "stars", tie_break: str = "repo_key", maximum: int | None = None) -> DataFrame:
    """The first ``k`` rows by ``by`` descending (fewer if there are fewer).

    A ``maximum`` turns larger numbers away, as a remote search does."""
    check_limit(k, maximum)
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie_break)).limit(k)


def check_limit(k: int, maximum: int | None = None) -> None:
    """Raise unless ``k`` is a whole number from 1 to ``maximum``."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1 or (maximum is not None and k > maximum):
        raise ValueError(f"a limit has to be between 1 and {'any number' if maximum is None else maximum}, not {k}")


def top_k_ranked(df: DataFrame, k: int, by: str = "stars", tie_break: str = "repo_key", maximum: int | None = None) -> DataFrame:
    """As :func:`top_k` with a 1-based ``rank``; the window sees ``k`` rows at most.

    For a ``k`` that grows with the data take :func:`ranked_rows` and compare ``rank``."""
    order = Window.orderBy(F.col(by).desc_nulls_last(), F.col(tie_break))
    return top_k(df, k, by, tie_break, maximum).withColumn("rank", F.row_number().over(order))


#: What monotonically increasing ids leave for the row's place in its partition.
_PLACE_BITS = 33


def ranked_rows(df: DataFrame, order: Sequence[Column], name: str = "rank", folder: str | None = None) -> DataFrame:
    """All rows with their 1-based place in ``order``, without bringing them together.

    The rows are dealt out by ranges of the order, sorted there and written once to
    ``folder`` (default: a new one in the shared folder), each with its place in its
    range. A range's base is the sum of the ranges before it: a row for each range is
    all that is added up in one place. Since ranges are cut from a sample, the
    written table is what both counts and ranks are read from. Rows that ``order``
    does not tell apart get different ranks in an unspecified order.
    """
    spark, path = df.sparkSession, folder or shared_folder(df.sparkSession, "ranks")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("_range", F.shiftright("_place", _PLACE_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    # A row for each range: as many as there are shuffle partitions at most.
    placed = stored.join(F.broadcast(bases), "_range")
    rank = F.col("_base") + F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return placed.select(*df.columns, rank.alias(name))


def rank_dimension(names: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """``lang_key, rank``: unique caseless names; the last position of a name wins."""
    return names.groupBy(lookup_key(F.col(name)).alias("lang_key")).agg(F.max(position).alias("rank"))


#: Bits of a position that one level of the order check takes off, and how often.
_LEVEL_BITS, _LEVELS = 16, 4


def order_violations(df: DataFrame, position: str, value: str) -> DataFrame:
    """One row: how many neighbours break the descending order of ``value``.

    Neighbours are compared inside buckets of 65,536 positions, in parallel. A bucket
    goes on as one row with its first and last value, and buckets of buckets are
    compared in the same way, until no bit of the position is left: no window sees
    more than 65,536 different places, however many rows there are.
    """
    rows = df.select(
        F.col(position).cast("long").alias("place"),
        F.col(value).alias("first_value"),
        F.col(value).alias("last_value"),
        F.lit(1).cast("long").alias("rows"),
        F.lit(0).cast("long").alias("failed"),
    )
    for _ in range(_LEVELS):
        rows = rows.withColumn("bucket", F.shiftright("place", _LEVEL_BITS))
        before = F.lag("last_value").over(Window.partitionBy("bucket").orderBy("place"))
        rows = (
            rows.withColumn("breaks", F.when(F.col("first_value") > before, 1).otherwise(0))
            .groupBy("bucket")
            .agg(
                F.min_by("first_value", "place").alias("first_value"),
                F.max_by("last_value", "place").alias("last_value"),
                F.sum("rows").alias("rows"),
                F.sum(F.col("failed") + F.col("breaks")).alias("failed"),
            )
            .withColumnRenamed("bucket", "place")
        )
    # Positions below zero and others: two rows at most.
    before = F.lag("last_value").over(Window.orderBy("place"))
    ends = rows.withColumn("breaks", F.when(F.col("first_value") > before, 1).otherwise(0))
    return ends.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("checked"), F.coalesce(F.sum(F.col("failed") + F.col("breaks")), F.lit(0)).alias("failed")
    )
