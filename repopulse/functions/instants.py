"""ISO-8601 instants and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.functions.text import strip

# Extended ISO-8601 only. Anything else Spark's cast would take (a bare year, a
# named zone) is refused here; compact forms count as unreadable.
_DATE = r"(?!0000)\d{4}-\d{2}-\d{2}"
_TIME = r"[T ]\d{2}:\d{2}:\d{2}([.]\d{1,9})?"
_ZONE = r"(Z|[+-]\d{2}:?\d{2})"
_DATE_ONLY = rf"^{_DATE}Z?$"
_LOCAL = rf"^{_DATE}{_TIME}$"
_ZONED = rf"^{_DATE}{_TIME}{_ZONE}$"
_MINUTES = rf"^{_DATE}[T ]\d{{2}}:\d{{2}}{_ZONE}?$"


def parse_instant(text: Column) -> Column:
    """Instant for an ISO-8601 text; no zone means UTC; null when unreadable.

    The zone is made explicit before the cast, so the result does not depend on
    the time zone of the session.
    """
    trimmed = strip(text)
    explicit = (
        F.when(trimmed.rlike(_ZONED), trimmed)
        .when(trimmed.rlike(_LOCAL), F.concat(trimmed, F.lit("Z")))
        .when(
            trimmed.rlike(_MINUTES),
            F.concat(
                F.substring(trimmed, 1, 16), F.lit(":00"),
                F.when(F.length(trimmed) > 16, F.substring(trimmed, 17, 6)).otherwise(F.lit("Z")),
            ),
        )
        .when(trimmed.rlike(_DATE_ONLY), F.concat(F.substring(trimmed, 1, 10), F.lit("T00:00:00Z")))
    )
    return explicit.try_cast("timestamp")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` with microseconds as fraction."""
    return (F.unix_micros(end) - F.unix_micros(start)).cast("double") / F.lit(1e6)


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour days, floored (calendar days would differ)."""
    return F.floor(elapsed_seconds(start, end) / F.lit(V.SECONDS_PER_DAY)).cast("long")


def iso_week(instant: Column) -> dict[str, Column]:
    """ISO year and week, the partition columns of a snapshot."""
    return {
        "iso_year": F.extract(F.lit("YEAROFWEEK"), instant).cast("int"),
        "iso_week": F.weekofyear(instant).cast("int"),
    }
