"""Exact distribution statistics of many metrics per group.

The built-in exact ``median`` keeps every distinct value of a group in the
memory of one task. Here it is selected between splitters. A first aggregate
counts every group's rows and takes from a mergeable quantile summary
two values of the group that its middle ranks certainly lie between. Those of
groups of more than ``10 * accuracy`` rows, which are few, are broadcast, so that no
row is shuffled by its group. A second aggregate adds up the rows below, above and, by value,
between them; only those between are ranked: the distinct values among a thousandth
of a group's rows, or less with a larger ``accuracy``. Smaller groups are ranked whole.

The summary's ranks are off by ``rows / ACCURACY`` at most and the splitters lie four
times that apart from the middle, whatever the values and the partitions. Should
they ever miss it, the query fails instead of giving another value.

Values are ordered as Spark orders them: NaN counts as a value and is the
greatest, after infinity. A mean that includes either is NaN or infinite.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repopulse.functions.rounding import half_even

#: Rows over the largest error of a rank in the quantile summary, and how many such errors the splitters keep from the middle.
ACCURACY, _MARGIN = 10_000, 4
#: Rows over the accuracy from which on a group is split.
_LARGE = 10
#: Where a row lies: without a value, below the splitters, between them, above.
_NOWHERE, _BELOW, _BETWEEN, _ABOVE = range(4)


def _long_form(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column | str]) -> DataFrame:
    # inline keeps one scan and, unlike unpivot, the plan of a repeated use
    # compares equal, so its shuffle is reused instead of being run again.
    pairs = [
        F.struct(F.lit(name).alias("metric"), (F.col(m) if isinstance(m, str) else m).cast("double").alias("value"))
        for name, m in metrics.items()
    ]
    return df.select(*keys, F.inline(F.array(*pairs)))


def _splitters(value: Column, accuracy: int) -> Column:
    """Two values of a group that its middle ranks lie between, as an array."""
    # Infinity stands for NaN here: the order of the two does not matter for a splitter.
    ordered = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value)
    margin = min(_MARGIN / accuracy, 0.5)
    return F.percentile_approx(ordered, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), accuracy)


def _place(value: Column, low: Column, high: Column) -> Column:
    """Where a value lies; all values of a group without splitters lie between them."""
    between = low.isNull() | (value <= high) | (high == F.lit(float("inf")))
    return F.when(value.isNull(), _NOWHERE).when(value < low, _BELOW).when(between, _BETWEEN).otherwise(_ABOVE)


def describe(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Mapping[str, Column | str],
    digits: int | Mapping[str, int] = 4,
    scale: int | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Exact statistics per group and metric, in long form.

    Output: ``keys, metric, rows, n, mean, median, min, max`` where ``rows``
    counts all rows of the group and ``n`` those with a value. Mean and median
    are rounded to ``digits``, one number or one per metric. ``scale`` states how
    many decimals most values have at most: those are summed as integers, exactly
    and independently of the partitioning. Values with more decimals, or too
    large for that, are summed as doubles beside them; none is ever rounded.
    Without keys an empty input still gives one row per metric.

    There is one plan for any number of groups; building it starts no job. The
    input is evaluated twice from its last shuffle or table on; store it first where
    that is dear. ``accuracy`` changes how many rows are ranked, never the result.
    """
    keys = list(keys)
    group = [*keys, "metric"]
    long_form = _long_form(df, keys, metrics)
    stats = _group_stats(long_form, group, scale, accuracy)
    counted = _counted_between(long_form, stats, group, scale, _LARGE * accuracy)

    # Only what lies between the splitters reaches this window, a few rows of a large group for the rest, and small groups.
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("place", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({"end": F.sum("valued").over(upto), "n": F.sum("valued").over(whole)})
    ranked = ranked.withColumn("start", F.col("end") - F.col("valued"))
    ranks = {"low_value": F.floor((F.col("n") + 1) / 2), "high_value": F.floor(F.col("n") / 2) + 1}
    # A row of another place has no value: where the splitters missed the middle, its null is an error below.
    middle = {name: F.max(F.when((F.col("start") < rank) & (rank <= F.col("end")), F.col("value"))) for name, rank in ranks.items()}
    finished = ranked.groupBy(*group).agg(
        F.sum("placed").alias("rows"),
        F.sum("valued").alias("n"),
        *[F.sum(name).alias(name) for name in _addends(F.col("value"), scale)],
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        *[m.alias(name) for name, m in middle.items()],
    )
    finished = finished.select(*group, "rows", "n", F.try_divide(_total(scale), "n").alias("mean"), _median().alias("median"), "min", "max")
    if not keys:
        every = _metric_table(df, metrics).join(finished, "metric", "left")
        finished = every.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("rows", "n")})
    return finished.withColumns({c: _rounded(F.col(c), digits) for c in ("mean", "median")})


def _sums(value: Column, scale: int | None) -> list[Column]:
    """Counts, sums and ends of ``value``, which add up over parts of a group."""
    sums = [F.sum(part).alias(name) for name, part in _addends(value, scale).items()]
    return [F.count("value").alias("valued"), *sums, F.min("value").alias("min"), F.max("value").alias("max")]


def _group_stats(long_form: DataFrame, group: Sequence[str], scale: int | None, accuracy: int) -> DataFrame:
    """A row for each group: its number of rows, its sums and the splitters ``low`` and ``high``.
    Columns that are not read cost nothing."""
    value = F.col("value")
    stats = long_form.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows"), *_sums(value, scale), _splitters(value, accuracy).alias("splitters"))
    ends = {"low": F.element_at("splitters", 1), "high": F.element_at("splitters", 2)}
    return stats.withColumns(ends).drop("splitters")


def _counted_between(long_form: DataFrame, stats: DataFrame, group: Sequence[str], scale: int | None = None, large: int = 0) -> DataFrame:
    """``group, place, value`` with counts, sums and ends: a row each for what has no value, lies
    below and above the splitters, and a row for each value between. Groups of ``large`` rows or fewer have no splitters."""
    split = stats.where(F.col("group_rows") > large).select(*[F.col(c).alias(f"_{c}") for c in group], "low", "high")
    # The hint matters: a join by shuffle sends all rows of a group to one task.
    placed = long_form.join(F.broadcast(split), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], "left")
    placed = placed.withColumn("place", _place(F.col("value"), F.col("low"), F.col("high")))
    by_value = F.when(F.col("place") == _BETWEEN, F.col("value"))
    grouped = placed.select(*group, "place", by_value.alias("at"), "value").groupBy(*group, "place", "at")
    return grouped.agg(F.count(F.lit(1)).alias("placed"), *_sums(F.col("value"), scale)).withColumnRenamed("at", "value")


def _median() -> Column:
    # Half of each first, or the sum of two large values is infinite; halves of tiny ones are not exact.
    low, high = F.col("low_value"), F.col("high_value")
    large = F.greatest(F.abs(low), F.abs(high)) > F.lit(1e300)
    missed = (F.col("n") > 0) & (low.isNull() | high.isNull())
    return (
        F.when(missed, F.raise_error(F.lit("the middle of a group lies outside of its splitters")).cast("double"))
        .when(low == high, low)
        .when(large, low / 2.0 + high / 2.0)
        .otherwise((low + high) / 2.0)
    )


#: Values of a known scale are added up as integers in two parts, so that the
#: parts of 10^12 rows still fit. Larger ones than these are not.
_PART, _LARGEST = 1_000_000, 1e12


def _addends(value: Column, scale: int | None) -> dict[str, Column]:
    if scale is None:
        return {"sum": value}
    shift = F.lit(10.0**scale)
    fits = (F.abs(value) < F.lit(_LARGEST / 10.0**scale)) & (F.rint(value * shift) / shift == value)
    units = F.when(fits, F.rint(value * shift)).otherwise(F.lit(0.0)).cast("long")
    return {
        "sum_high": F.call_function("div", units, F.lit(_PART)),
        "sum_low": units % F.lit(_PART),
        "sum_rest": F.when(~fits, value),
    }


def _total(scale: int | None) -> Column:
    if scale is None:
        return F.col("sum")
    units = F.col("sum_high").cast("decimal(25,0)") * F.lit(_PART) + F.col("sum_low").cast("decimal(25,0)")
    return units.cast("double") / F.lit(10.0**scale) + F.coalesce("sum_rest", F.lit(0.0))


def _rounded(value: Column, digits: int | Mapping[str, int]) -> Column:
    if isinstance(digits, int):
        return half_even(value, digits)
    result = F.lit(None).cast("double")
    for places in sorted(set(digits.values())):
        names = [name for name, d in digits.items() if d == places]
        result = F.when(F.col("metric").isin(names), half_even(value, places)).otherwise(result)
    return result


def _metric_table(df: DataFrame, metrics: Mapping[str, Column | str]) -> DataFrame:
    names = F.array(*[F.lit(name) for name in metrics])
    return df.sparkSession.range(1).select(F.explode(names).alias("metric"))


def describe_approximately(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Mapping[str, Column | str],
    digits: int = 4,
    accuracy: int = 10000,
) -> DataFrame:
    """Opt-in single aggregate with a sketched median (an element of the data)."""
    return (
        _long_form(df, keys, metrics)
        .groupBy(*keys, "metric")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("value").alias("n"),
            half_even(F.avg("value"), digits).alias("mean"),
            half_even(F.percentile_approx("value", 0.5, accuracy), digits).alias("median"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
