"""Rounding that agrees with IEEE half-even rounding of the exact binary value.

``round`` and ``bround`` work on the decimal text of a double, so 2.675 goes to
2.68 although the stored value lies below the tie. Away from a tie the nearest
multiple is unambiguous and plain arithmetic gives it; only values next to a tie
take the slower formatting path, which looks at the exact binary value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this the scaled value has too few fraction bits for the tie test.
_ARITHMETIC_LIMIT = 1e9
_TIE_MARGIN = 1e-3


def half_even(value: Column, digits: int) -> Column:
    """``value`` rounded to ``digits`` decimals, ties of the binary value to even.

    The argument occurs several times in the result: pass a column of the input,
    not a long expression.
    """
    scale = 10.0**digits
    value = value.cast("double")
    size = F.abs(value * F.lit(scale))
    by_hand = (size >= F.lit(_ARITHMETIC_LIMIT)) | (
        F.abs(size - F.floor(size).cast("double") - F.lit(0.5)) < F.lit(_TIE_MARGIN)
    )

    # Below one unit the formatter drops the binary remainder, so compare with
    # the double closest to half a unit instead.
    half_unit = 0.5 / scale
    half_goes_up = round(half_unit, digits) > 0
    rounds_up = F.abs(value) >= F.lit(half_unit) if half_goes_up else F.abs(value) > F.lit(half_unit)
    tiny = F.signum(value) * F.when(rounds_up, F.lit(1.0 / scale)).otherwise(F.lit(0.0))

    pattern = "0." + "0" * digits if digits else "0"
    exact = F.call_function("format_number", value, F.lit(pattern)).try_cast("double")
    careful = F.when(size < F.lit(1.0), tiny).otherwise(exact)
    endless = F.isnan(value) | (size == F.lit(float("inf")))
    return F.when(endless, value).when(by_hand, careful).otherwise(F.rint(value * F.lit(scale)) / F.lit(scale))
