"""Summaries over a whole collection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.functions.rounding import half_even
from repopulse.functions.text import fold
from repopulse.operators.distribution import describe
from repopulse.operators.metrics import issues_flag

#: Rounding of each metric's summary; values carry at most as many decimals.
SUMMARY_DIGITS = {
    "age_days": 2,
    "age_years": 2,
    "stale_days": 2,
    "closed_ratio": 4,
    "merged_prs": 4,
    "releases": 4,
    "merged_prs_api": 4,
    "releases_api": 4,
}


def summarise(
    df: DataFrame,
    metrics: Mapping[str, Column | str],
    digits: int | Mapping[str, int] = 4,
    scale: int | None = None,
) -> DataFrame:
    """``metric, total, with_value, without_value, mean, median, min, max``."""
    return describe(df, [], metrics, digits=digits, scale=scale).select(
        "metric",
        F.col("rows").alias("total"),
        F.col("n").alias("with_value"),
        (F.col("rows") - F.col("n")).alias("without_value"),
        "mean",
        "median",
        "min",
        "max",
    )


def metric_summary(records: DataFrame) -> DataFrame:
    """Summary of every metric present, each with its own rounding."""
    present = [m for m in SUMMARY_DIGITS if m in records.columns]
    source = records
    requested = issues_flag(records)
    if "closed_ratio" in present and requested is not None:
        source = records.withColumn("closed_ratio", F.when(requested, F.col("closed_ratio")))
    return summarise(source, {m: m for m in present}, digits={m: SUMMARY_DIGITS[m] for m in present}, scale=4)


def status_histogram(df: DataFrame, status: Column | str, metric: str | None = None) -> DataFrame:
    """``status, n``; rows without a status count as unknown."""
    status = F.col(status) if isinstance(status, str) else status
    counts = df.groupBy(F.coalesce(status, F.lit(V.STATUS_UNKNOWN)).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts if metric is None else counts.select(F.lit(metric).alias("metric"), "status", "n")


def status_counts(df: DataFrame, statuses: Mapping[str, Column | str]) -> DataFrame:
    """Status histograms of several metrics in one pass: ``metric, status, n``."""
    pairs = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(V.STATUS_UNKNOWN)).alias("status"),
        )
        for metric, s in statuses.items()
    ]
    return df.select(F.inline(F.array(*pairs))).groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"))


def reclassified_status(requested: Column, status: Column) -> Column:
    """Status after checking the raw node: fields never requested are missing."""
    return F.when(~requested, F.lit(V.STATUS_MISSING)).otherwise(F.coalesce(status, F.lit(V.STATUS_UNKNOWN)))


def category_histogram(df: DataFrame, category: str) -> DataFrame:
    """``category, n`` by descending count, then name without regard to case."""
    return (
        df.groupBy(F.coalesce(F.col(category), F.lit(V.NO_LANGUAGE)).alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), fold(F.col("category")), "category")
    )


def top_categories(df: DataFrame, category: str, k: int = 10) -> DataFrame:
    """The first ``k`` rows of the ordered histogram."""
    return category_histogram(df, category).limit(k)


def popular_share(
    df: DataFrame,
    category: str = "language_category",
    has_language: str = "has_language",
    is_popular: str = "is_popular",
) -> DataFrame:
    """One row: totals with and without language, distinct languages, popular share.

    Grouping by category first keeps the distinct count exact and the shuffle as
    small as the number of categories.
    """
    per_category = df.groupBy(F.coalesce(F.col(category), F.lit(V.NO_LANGUAGE)).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(has_language)).alias("with_language"),
        F.count_if(F.col(is_popular)).alias("popular"),
    )
    total, popular = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("popular"), F.lit(0))
    with_language = F.coalesce(F.sum("with_language"), F.lit(0))
    counted = per_category.agg(
        total.alias("total"),
        with_language.alias("with_language"),
        (total - with_language).alias("without_language"),
        F.count_if(F.col("category") != V.NO_LANGUAGE).alias("distinct_languages"),
        popular.alias("popular"),
        F.try_divide(F.lit(100.0) * popular, total).alias("popular_percent"),
    )
    return counted.withColumn("popular_percent", half_even(F.col("popular_percent"), 2))


def ratio_quality(df: DataFrame, ratio: Column) -> DataFrame:
    """Valid, missing and out-of-range ratios, with min, max and median of the valid."""
    in_range = ratio.between(0.0, 1.0)
    source = df.select(
        ratio.alias("ratio"),
        F.when(in_range, ratio).alias("valid_ratio"),
        F.when(ratio.isNotNull() & ~in_range, 1).alias("inconsistent"),
    )
    stats = describe(source, [], {"valid_ratio": "valid_ratio", "inconsistent": "inconsistent"}, digits=4, scale=None)
    folded = stats.agg(
        *[
            F.max(F.when(F.col("metric") == "valid_ratio", F.col(c))).alias(name)
            for c, name in (("rows", "total"), ("n", "valid"), ("min", "min"), ("max", "max"), ("median", "median"))
        ],
        F.max(F.when(F.col("metric") == "inconsistent", F.col("n"))).alias("inconsistent"),
    )
    return folded.select(
        "total",
        "valid",
        (F.col("total") - F.col("valid") - F.col("inconsistent")).alias("missing"),
        "inconsistent",
        "min",
        "max",
        "median",
    )


def inconsistent_ratios(df: DataFrame, key: str, ratio: Column) -> DataFrame:
    """The rows whose ratio lies outside 0..1: ``key, ratio``."""
    return df.where(~ratio.between(0.0, 1.0)).select(F.col(key), ratio.alias("ratio"))

