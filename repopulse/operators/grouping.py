"""Statistics per group, per value band and of the largest groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repopulse.functions.bands import Band, assign_band, band_table
from repopulse.functions.text import fold
from repopulse.operators.distribution import describe
from repopulse.operators.ranking import ranked_rows

#: Metrics divided by language.
GROUPED_METRICS = ("merged_prs", "releases", "stale_days")


def stats_by_group(
    df: DataFrame,
    group: str,
    metrics: Mapping[str, Column | str],
    digits: int = 4,
    scale: int | None = None,
) -> DataFrame:
    """Long form: ``group, n, metric, with_value, mean, median, min, max``.

    ``n`` counts all rows of the group; the statistics ignore nulls per metric.
    """
    stats = describe(df, [group], metrics, digits=digits, scale=scale)
    return stats.select(
        group, F.col("rows").alias("n"), "metric", F.col("n").alias("with_value"), "mean", "median", "min", "max"
    )


def in_report_order(stats: DataFrame, group: str) -> DataFrame:
    """Largest group first, ties by name without regard to case."""
    return stats.orderBy(F.desc("n"), fold(F.col(group)), group, "metric")


def with_report_rank(stats: DataFrame, group: str, metrics: int = len(GROUPED_METRICS)) -> DataFrame:
    """The report's order as a column ``report_rank``, so that it survives storage.

    Every group has a row for each of its ``metrics``, so its place is that of its rows
    divided by their number. The rows are written once and ranked by ranges
    (:func:`~repopulse.operators.ranking.ranked_rows`), however many groups there are."""
    order = [F.desc("n"), fold(F.col(group)).asc_nulls_first(), F.col(group).asc_nulls_first(), F.col("metric")]
    ranked = ranked_rows(stats, order, "report_rank")
    return ranked.withColumn("report_rank", F.floor((F.col("report_rank") - 1) / metrics) + 1)


def banded_stats(
    df: DataFrame,
    banded_by: Column,
    value: Column,
    bands: Sequence[Band],
    digits: int = 4,
    scale: int | None = None,
) -> DataFrame:
    """``band_no, band, n, mean, median`` over complete pairs; empty bands stay.

    Both columns have to be present in a row for it to count.
    """
    pairs = {"": (banded_by, value, bands)}
    return banded_pairs(df, pairs, digits, scale).drop("pair")


def banded_pairs(
    df: DataFrame,
    pairs: Mapping[str, tuple[Column, Column, Sequence[Band]]],
    digits: int = 4,
    scale: int | None = None,
) -> DataFrame:
    """:func:`banded_stats` of several pairs in one pass: ``pair`` and its columns."""
    # Incomplete rows get no band instead of being filtered: a pushed-down filter
    # would evaluate both columns twice.
    typed = df.select(
        *[x.cast("double").alias(f"by_{i}") for i, (x, _, _) in enumerate(pairs.values())],
        *[y.cast("double").alias(f"value_{i}") for i, (_, y, _) in enumerate(pairs.values())],
    )
    rows = []
    for i, (name, (_, _, bands)) in enumerate(pairs.items()):
        both = F.col(f"by_{i}").isNotNull() & F.col(f"value_{i}").isNotNull()
        band = assign_band(F.when(both, F.col(f"by_{i}")), bands)
        rows.append(F.struct(F.lit(name).alias("pair"), band.alias("band_no"), F.when(both, F.col(f"value_{i}")).alias("value")))
    numbered = typed.select(F.inline(F.array(*rows)))
    stats = describe(numbered, ["pair", "band_no"], {"value": "value"}, digits=digits, scale=scale)
    # Null-safe, so that no not-null filter on the band is pushed down to where
    # it would evaluate the banded column again.
    found = stats.select(F.col("pair").alias("found_pair"), F.col("band_no").alias("found_no"), "n", "mean", "median")
    tables = [band_table(df.sparkSession, bands).select(F.lit(name).alias("pair"), "band_no", "band") for name, (_, _, bands) in pairs.items()]
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    same = F.col("pair").eqNullSafe(F.col("found_pair")) & F.col("band_no").eqNullSafe(F.col("found_no"))
    return every.join(found, same, "left").select(
        "pair", "band_no", "band", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean", "median"
    )


def top_groups(
    df: DataFrame,
    group: str,
    value: str,
    required: Sequence[str],
    position: str,
    k: int = 5,
    digits: int = 4,
    scale: int | None = None,
) -> DataFrame:
    """The ``k`` largest groups with count, median and maximum of ``value``.

    Only rows with a group and all ``required`` values count. Groups of equal
    size keep the order in which they first appear (by ``position``). The ``k``
    winners are chosen by a plain count; only their rows are then described.
    """
    # Completeness is a column, not a filter: a pushed-down filter would evaluate
    # every required column twice.
    complete = _all_present(required)
    flagged = df.where(F.col(group).isNotNull()).select(
        group,
        F.col(position).alias("position"),
        complete.alias("complete"),
        F.when(complete, F.col(value)).alias("value"),
    )
    # A group is opened by its first row, complete or not.
    sizes = flagged.groupBy(group).agg(
        F.min("position").alias("first_seen"), F.count_if("complete").alias("complete_rows")
    )
    winners = sizes.where(F.col("complete_rows") > 0).orderBy(F.desc("complete_rows"), "first_seen").limit(k)
    # k rows at most: the broadcast is bounded by the parameter.
    chosen = flagged.join(F.broadcast(winners.select(group)), group, "left_semi")
    stats = describe(chosen, [group], {"value": "value"}, digits=digits, scale=scale)
    return (
        winners.join(stats.select(group, "n", "median", "max"), group)
        .select(group, "n", "median", "max", "first_seen")
        .orderBy(F.desc("n"), "first_seen")
    )


def _all_present(names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNotNull()
    return condition
