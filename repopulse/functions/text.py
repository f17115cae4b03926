"""Text helpers: Unicode-aware trimming and caseless keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the characters that count as white space --------------------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` only knows spaces)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def has_text(text: Column) -> Column:
    """True when there is at least one visible character; null text gives false."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def fold(text: Column) -> Column:
    """Caseless form used for ordering names."""
    return F.lower(text)


def lookup_key(text: Column) -> Column:
    """Trimmed caseless form used for dimension lookups."""
    return fold(strip(text))
