"""Reading raw nodes kept as VARIANT.

A key that was not requested and a key that came back null mean different
things, which a typed struct cannot express. On a variant the first gives SQL
NULL and the second a variant null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_key(raw: Column, path: str) -> Column:
    """The value under ``path`` as variant: SQL NULL when the key is absent."""
    return F.try_variant_get(raw, f"$.{path}", "variant")


def has_key(raw: Column, key: str) -> Column:
    """True when the key is present, also with a null value."""
    return object_key(raw, key).isNotNull()


def fields_of(raw: Column, names: Iterable[str]) -> Column:
    """The named top-level fields as a struct of variants, in one walk over the node.

    A field is SQL NULL where its key is absent and a variant null where it came back
    null; anything but an object has no fields. Put the struct in a column of its own,
    so that it is extracted once for all that is read from it.
    """
    return F.try_variant_get(raw, "$", f"struct<{','.join(f'`{n}`:variant' for n in dict.fromkeys(names))}>")


def text_at(raw: Column, path: str) -> Column:
    """Scalar under a nested path as text; a null anywhere on the way gives null."""
    return F.try_variant_get(raw, f"$.{path}", "string")


def string_at(raw: Column, path: str) -> Column:
    """As :func:`text_at`, but only if the value really is a string."""
    return F.when(F.schema_of_variant(object_key(raw, path)) == "STRING", text_at(raw, path))


def integer_at(raw: Column, path: str) -> Column:
    """Integer under a path; any other kind of value gives null."""
    is_integer = F.schema_of_variant(object_key(raw, path)) == "BIGINT"
    return F.when(is_integer, F.try_variant_get(raw, f"$.{path}", "bigint"))


def integer_of(value: Column) -> Column:
    """The integer that a variant is; any other kind of value gives null."""
    return F.when(F.schema_of_variant(value) == "BIGINT", value.try_cast("bigint"))


def text_of(value: Column) -> Column:
    """A scalar variant as text."""
    return F.try_variant_get(value, "$", "string")


def number_at(raw: Column, path: str) -> Column:
    """Number under a path as double; text and booleans give null."""
    kind = F.schema_of_variant(object_key(raw, path))
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(raw, f"$.{path}", "double"))


def count_of(value: Column) -> Column:
    """Presence-aware count of a ``{totalCount}`` object taken from its node.

    Absent: null. Present but null, empty or not an integer: 0.
    """
    return F.when(value.isNotNull(), F.coalesce(integer_at(value, "totalCount"), F.lit(0).cast("long")))


def count_at(raw: Column, key: str) -> Column:
    """As :func:`count_of`, for a single field; read several by :func:`fields_of`."""
    return count_of(object_key(raw, key))


def is_empty_node(raw: Column) -> Column:
    """True for a missing, null or empty node given as variant."""
    # Counting the keys of an object is cheaper than writing it out; anything but an object has none and is not empty.
    keys = F.size(F.try_variant_get(raw, "$", "map<string,variant>"))
    return F.coalesce(F.is_variant_null(raw), F.lit(True)) | F.coalesce(keys == 0, F.lit(False))


def is_empty_text(node: Column) -> Column:
    """The same for a node still in text form."""
    return F.coalesce(node.rlike(r"^\s*(null|[{]\s*[}])?\s*$"), F.lit(True))
