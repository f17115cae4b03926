"""Value bands and the reading of a correlation coefficient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse import vocabulary as V

Band = tuple[float, "float | None", str]


def assign_band(value: Column, bands: Sequence[Band]) -> Column:
    """1-based band number. Values below every band fall into the last one."""
    number = F.lit(len(bands))
    for index in reversed(range(len(bands) - 1)):
        lower, upper, _ = bands[index]
        inside = (value >= F.lit(float(lower))) & (value < F.lit(float(upper)))
        number = F.when(inside, F.lit(index + 1)).otherwise(number)
    return F.when(value.isNotNull(), number)


def band_label(number: Column, bands: Sequence[Band]) -> Column:
    """Label of a band number; no number, no label.

    Spelled as a CASE: ``element_at`` with a null index gives the last element
    of a constant array instead of null.
    """
    label = F.lit(None).cast("string")
    for index, (_, _, text) in enumerate(bands, start=1):
        label = F.when(number == index, F.lit(text)).otherwise(label)
    return label


def band_table(spark: SparkSession, bands: Sequence[Band]) -> DataFrame:
    """All bands in order, for zero-filling: ``band_no, band``."""
    rows = F.array(
        *[
            F.struct(F.lit(index).alias("band_no"), F.lit(label).alias("band"))
            for index, (_, _, label) in enumerate(bands, start=1)
        ]
    )
    return spark.range(1).select(F.inline(rows))


def strength_label(coefficient: Column) -> Column:
    """Words for a rounded coefficient: strength by magnitude, then sign."""
    magnitude = F.abs(coefficient)
    strength = F.lit(V.STRENGTHS[-1][1])
    for limit, label in reversed(V.STRENGTHS[:-1]):
        strength = F.when(magnitude < F.lit(limit), F.lit(label)).otherwise(strength)
    sign = F.when(coefficient > 0, F.lit(V.SIGN_POSITIVE)).otherwise(F.lit(V.SIGN_NEGATIVE))
    return (
        F.when(coefficient.isNull(), F.lit(V.STRENGTH_UNDEFINED))
        .when(coefficient == 0, F.lit(V.STRENGTH_ZERO))
        .otherwise(F.concat_ws(" ", strength, sign))
    )
