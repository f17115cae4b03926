"""Partial summaries that are stored with a snapshot and merged later.

A state is one row for each snapshot, group and metric, whatever the number of records
behind it. A new snapshot adds its own rows; summaries over all snapshots are merged from
states, so records of earlier ones are not read again. Counts, means, extremes and correlations are
those of the records themselves; numbers of distinct values are estimates by sketches
(:func:`~repopulse.operators.summary.popular_share` counts exactly). Medians do not
merge and are taken from the records (:mod:`repopulse.operators.distribution`).

``by`` are the columns that tell snapshots and groups apart when states are made, and those
that remain when they are merged: merging by fewer columns adds up over the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repopulse.functions.rounding import half_even

#: Binary logarithm of a sketch's registers: a standard error of about 1.04 / sqrt(2^12), 1.6 %.
REGISTERS = 12


def _per_name(counted: DataFrame, by: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    """One struct column for each name to one row for each name."""
    rows = F.array(*[F.struct(F.lit(name).alias(label), F.col(f"`{name}`.*")) for name in names])
    return counted.select(*by, F.inline(rows))


def metric_states(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Column | str]) -> DataFrame:
    """``by, metric, rows, n, total, low, high``: nulls are rows but not values."""
    columns = {name: (F.col(c) if isinstance(c, str) else c).cast("double") for name, c in metrics.items()}
    measures = [
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("low"), F.max(c).alias("high")
        ).alias(name)
        for name, c in columns.items()
    ]
    return _per_name(df.groupBy(*by).agg(*measures), by, list(columns), "metric")


def merged_metrics(states: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """``by, metric, total, with_value, without_value, mean, min, max`` of all records behind the states."""
    merged = states.groupBy(*by, "metric").agg(
        F.sum("rows").alias("total"), F.sum("n").alias("with_value"), F.sum("total").alias("_sum"), F.min("low").alias("min"), F.max("high").alias("max")
    )
    mean = half_even(F.try_divide(F.col("_sum"), F.col("with_value")), digits)
    return merged.select(
        *by, "metric", "total", "with_value", (F.col("total") - F.col("with_value")).alias("without_value"), mean.alias("mean"), "min", "max"
    )


def pair_states(df: DataFrame, by: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``by, pair, rows, n, mean_x, mean_y, square_x, square_y, product`` and extremes.

    The last are sums of squared deviations, and of their products, from the state's own means."""
    measures = []
    for name, (left, right) in pairs.items():
        both = F.col(left).isNotNull() & F.col(right).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (left, right))
        n = F.count(x)
        measures.append(
            F.struct(
                F.count(F.lit(1)).alias("rows"), n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
                (F.var_pop(x) * n).alias("square_x"), (F.var_pop(y) * n).alias("square_y"), (F.covar_pop(x, y) * n).alias("product"),
                F.min(x).alias("low_x"), F.max(x).alias("high_x"), F.min(y).alias("low_y"), F.max(y).alias("high_y"),
            ).alias(name)
        )
    return _per_name(df.groupBy(*by).agg(*measures), by, list(pairs), "pair")


def merged_correlations(states: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """``by, pair, total, pairs_used, pairs_dropped, coefficient`` of all records behind the states.

    Deviations are moved to the merged means first, so large values do not cancel. The
    coefficient is null for fewer than two pairs or a side without variance."""
    group = Window.partitionBy(*by, "pair")
    n = F.sum("n").over(group)
    centred = states.withColumns(
        {f"d{s}": F.col(f"mean_{s}") - F.sum(F.col(f"mean_{s}") * F.col("n")).over(group) / F.nullif(n, F.lit(0)) for s in "xy"}
    )
    square = {s: F.sum(F.col(f"square_{s}") + F.col("n") * F.col(f"d{s}") * F.col(f"d{s}")) for s in "xy"}
    product = F.sum(F.col("product") + F.col("n") * F.col("dx") * F.col("dy"))
    varied = [F.min(f"low_{s}") < F.max(f"high_{s}") for s in "xy"]
    ratio = F.try_divide(product, F.sqrt(square["x"]) * F.sqrt(square["y"]))
    merged = centred.groupBy(*by, "pair").agg(
        F.sum("rows").alias("total"), F.sum("n").alias("pairs_used"), F.when((F.sum("n") >= 2) & varied[0] & varied[1], ratio).alias("coefficient")
    )
    dropped = (F.col("total") - F.col("pairs_used")).alias("pairs_dropped")
    return merged.select(*by, "pair", "total", "pairs_used", dropped, half_even(F.col("coefficient"), digits).alias("coefficient"))


def distinct_states(df: DataFrame, by: Sequence[str], columns: Sequence[str], registers: int = REGISTERS) -> DataFrame:
    """``by, column_name, sketch``: HyperLogLog sketches of the columns' values; nulls are no value."""
    sketches = [F.struct(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(registers)).alias("sketch")).alias(c) for c in columns]
    return _per_name(df.groupBy(*by).agg(*sketches), by, columns, "column_name")


def merged_distinct(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, column_name, distinct_values``: the estimated number of distinct values in all records."""
    return states.groupBy(*by, "column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
