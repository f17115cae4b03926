"""Correlation of two metrics, with its reading and the account of pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repopulse.functions.bands import strength_label
from repopulse.functions.rounding import half_even


def complete_pairs(df: DataFrame, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows in which both metrics are present, as doubles ``x, y``."""
    return df.select(*keep, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: population correlation over complete pairs, not rounded.

    Undefined (null) for fewer than two pairs or a constant side. The constant
    case is recognised by equal extremes, which no rounding can blur.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    defined = (F.count(px) >= 2) & (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    ratio = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.when(defined, ratio)


def correlate_pairs(df: DataFrame, pairs: Mapping[str, tuple[str, str]], digits: int = 4) -> DataFrame:
    """Several correlations in one aggregate, one row per pair.

    Output: ``pair, total, pairs_used, pairs_dropped, coefficient, strength``.
    """
    columns = sorted({name for pair in pairs.values() for name in pair})
    typed = df.select(*[F.col(name).cast("double").alias(name) for name in columns])
    measures = []
    for x, y in pairs.values():
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        measures.append(
            F.struct(
                F.count(F.lit(1)).alias("total"),
                F.count_if(both).alias("pairs_used"),
                F.count_if(~both).alias("pairs_dropped"),
                pearson(F.col(x), F.col(y)).alias("coefficient"),
            )
        )
    counted = typed.agg(*[m.alias(name) for name, m in zip(pairs, measures)])
    rows = F.array(*[F.struct(F.lit(name).alias("pair"), F.col(f"`{name}`.*")) for name in pairs])
    return (
        counted.select(F.inline(rows))
        .withColumn("coefficient", half_even(F.col("coefficient"), digits))
        .withColumn("strength", strength_label(F.col("coefficient")))
    )


def correlate(df: DataFrame, x: str, y: str, digits: int = 4) -> DataFrame:
    """One row: total, pairs used and dropped, coefficient and its reading."""
    return correlate_pairs(df, {"pair": (x, y)}, digits).drop("pair")
