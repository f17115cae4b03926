"""Column expressions shared by the operators. All are built-in functions."""

from repopulse.functions.bands import assign_band, band_table, strength_label
from repopulse.functions.instants import elapsed_seconds, iso_week, parse_instant, whole_days
from repopulse.functions.presence import count_at, has_key, object_key, text_at
from repopulse.functions.rounding import half_even
from repopulse.functions.text import fold, has_text, lookup_key, strip

__all__ = [
    "assign_band",
    "band_table",
    "count_at",
    "elapsed_seconds",
    "fold",
    "half_even",
    "has_key",
    "has_text",
    "iso_week",
    "lookup_key",
    "object_key",
    "parse_instant",
    "strength_label",
    "strip",
    "text_at",
    "whole_days",
]
