"""Data-quality rules.

A rule is a pair of columns: which rows it looks at and which of them fail. All
rules of a table are counted in one aggregate, so the table is read once, and
the result has one row per rule: ``rule, checked, failed``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.functions.instants import parse_instant
from repopulse.functions.text import has_text
from repopulse.operators.metrics import METRICS, derive_metrics, instant_literal

#: rule name -> (applies, fails)
Rules = Mapping[str, tuple[Column, Column]]


def _counters(rules: Rules) -> list[Column]:
    counters = []
    for name, (applies, fails) in rules.items():
        failing = F.coalesce(applies, F.lit(False)) & F.coalesce(fails, F.lit(False))
        counters.append(F.count_if(applies).alias(f"checked:{name}"))
        counters.append(F.count_if(failing).alias(f"failed:{name}"))
    return counters


def _as_rows(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"`checked:{name}`").alias("checked"),
            F.col(f"`failed:{name}`").alias("failed"),
        )
        for name in names
    ]
    return counted.select(F.inline(F.array(*rows)))


def check(df: DataFrame, rules: Rules) -> DataFrame:
    """Count all rules in one pass over ``df``."""
    return _as_rows(df.agg(*_counters(rules)), list(rules))


def row_count(df: DataFrame, expected: int | Column) -> DataFrame:
    """The number of rows equals the expected one."""
    expected = expected if isinstance(expected, Column) else F.lit(expected)
    counted = df.agg(F.count(F.lit(1)).alias("checked"))
    return counted.select(
        F.lit("row_count").alias("rule"),
        "checked",
        F.when(F.col("checked") == expected, 0).otherwise(1).cast("long").alias("failed"),
    )


def key_rules(df: DataFrame, key: str) -> DataFrame:
    """Key present, visible and unique. One shuffle of pre-aggregated keys."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce(F.sum("rows"), F.lit(0))

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    counted = per_key.agg(
        rows.alias("checked:key_present"),
        rows_where(F.col(key).isNull()).alias("failed:key_present"),
        rows.alias("checked:key_not_blank"),
        rows_where(F.col(key).isNotNull() & ~has_text(F.col(key).cast("string"))).alias("failed:key_not_blank"),
        rows.alias("checked:key_unique"),
        (rows - F.count(F.lit(1))).alias("failed:key_unique"),
    )
    return _as_rows(counted, ["key_present", "key_not_blank", "key_unique"])


def non_negative(*columns: str) -> Rules:
    """Values that have to be present and at least zero."""
    return {
        f"{c}_non_negative": (F.lit(True), F.col(c).isNull() | (F.col(c) < 0)) for c in columns
    }


def negative_alerts(*columns: str) -> Rules:
    """Values that may be missing but not negative; reported, not fatal."""
    return {f"{c}_negative": (F.col(c).isNotNull(), F.col(c) < 0) for c in columns}


def negative_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The rows behind :func:`negative_alerts`: ``key, metric, value``."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    named = F.coalesce(F.col(key).cast("string"), F.lit(V.UNNAMED)).alias(key)
    return df.select(named, F.inline(F.array(*pairs))).where(F.col("value") < 0)


def in_unit_interval(column: str) -> Rules:
    """A ratio lies between 0 and 1."""
    return {f"{column}_in_unit_interval": (F.col(column).isNotNull(), ~F.col(column).between(0.0, 1.0))}


def instant_readable(column: str) -> Rules:
    """The text is an instant."""
    return {f"{column}_readable": (F.lit(True), parse_instant(F.col(column)).isNull())}


def staleness_status_rules(status: str = "stale_status", days: str = "stale_days") -> Rules:
    """Status is a known one and agrees with the value."""
    allowed = (V.STATUS_OK, V.STATUS_NO_PUSH, V.STATUS_INVALID_DATE, V.STATUS_FUTURE_DATE)
    valueless = F.col(status).isin(V.STATUS_NO_PUSH, V.STATUS_INVALID_DATE)
    return {
        "status_known": (F.lit(True), ~F.coalesce(F.col(status).isin(*allowed), F.lit(False))),
        "no_value_without_date": (valueless, F.col(days).isNotNull()),
        "value_with_date": (~valueless, F.col(days).isNull() | (F.col(days) < 0)),
        "future_is_zero": (F.col(status) == V.STATUS_FUTURE_DATE, ~F.col(days).eqNullSafe(F.lit(0.0))),
    }


def category_rules(language: str = "language", category: str = "language_category") -> Rules:
    """The category is the language, or the placeholder when there is none."""
    return {
        "category_without_language": (
            F.col(language).isNull(), ~F.col(category).eqNullSafe(F.lit(V.NO_LANGUAGE)),
        ),
        "language_not_blank": (F.col(language).isNotNull(), ~has_text(F.col(language))),
        "category_with_language": (F.col(language).isNotNull(), ~F.col(category).eqNullSafe(F.col(language))),
    }


def presence_rules(in_a: str = "in_a", in_b: str = "in_b") -> Rules:
    """Every row is in both collections."""
    return {"in_a": (F.lit(True), ~F.col(in_a)), "in_b": (F.lit(True), ~F.col(in_b))}


def equals(stored: str, recomputed: Column | str) -> tuple[Column, Column]:
    """Rule: the stored value is the recomputed one (null equals null)."""
    recomputed = F.col(recomputed) if isinstance(recomputed, str) else recomputed
    return F.lit(True), ~F.col(stored).eqNullSafe(recomputed)


def recompute_rules(records: DataFrame, reference_at: datetime, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Stored metrics against a fresh computation from the kept raw node.

    Narrow: both sides are columns of the same row, so nothing is joined.
    """
    stored = {c: f"stored_{c}" for name in metrics for c in METRICS[name].columns if c in records.columns}
    renamed = records.select("raw", *[F.col(c).alias(s) for c, s in stored.items()])
    both = derive_metrics(renamed, instant_literal(reference_at), metrics, keep=list(stored.values()))
    return check(both, {f"{c}_recomputed": equals(s, c) for c, s in stored.items()})


def difference(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a stored summary that a recomputation does not give, and the reverse."""
    columns = stored.columns
    missing = stored.exceptAll(recomputed.select(*columns)).withColumn("only_in", F.lit("stored"))
    return missing.unionByName(recomputed.select(*columns).exceptAll(stored).withColumn("only_in", F.lit("recomputed")))


def cells(table: str, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A summary cell by cell: ``table_name, key, column_name, value``.

    ``key`` is a JSON list of the row's key values (nulls stay null), ``value`` the cell as text.
    A key that occurs again has the number of the occurrence behind it, so that repeated rows
    do not hide each other."""
    values = [c for c in summary.columns if c not in keys]
    texts = [F.col(c).cast("string") for c in values]
    key = F.to_json(F.array(*[F.col(k).cast("string") for k in keys])) if keys else F.lit("[]")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_values"))
    rows = summary.select(key.alias("_key"), F.array(*texts).alias("_values")).withColumn("_turn", turn)
    named = F.when(F.col("_turn") > 1, F.concat("_key", F.lit("#"), F.col("_turn"))).otherwise(F.col("_key"))
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in values]).alias("column_name"), F.col("_values").alias("value"))
    return rows.select(F.lit(table).alias("table_name"), named.alias("key"), F.inline(pairs).alias("column_name", "value"))


def differing_cells(summaries: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """Every cell in which a stored summary is not the recomputed one.

    ``summaries`` gives for each name the stored table, the recomputed one and the key columns.
    Both are compared as values of the recomputed table's types, null equal to null, by one
    full outer join over all tables. ``table_name, key, column_name, difference, stored,
    fresh``; ``difference`` is ``value``, or says on which side the row or column is missing.
    """

    def union(parts: list[DataFrame], value: str) -> DataFrame:
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result.withColumnRenamed("value", value).withColumn(f"_{value}", F.lit(True))

    old, new = [], []
    for name, (stored, fresh, keys) in summaries.items():
        types = dict(fresh.dtypes)
        typed = stored.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in stored.columns])
        old.append(cells(name, typed, keys))
        new.append(cells(name, fresh, keys))
    both = union(old, "stored").join(union(new, "fresh"), ["table_name", "key", "column_name"], "full_outer")
    kind = (
        F.when(F.col("_stored").isNull(), F.lit("missing_in_stored"))
        .when(F.col("_fresh").isNull(), F.lit("missing_in_fresh"))
        .when(~F.col("stored").eqNullSafe(F.col("fresh")), F.lit("value"))
    )
    found = both.withColumn("difference", kind).where(F.col("difference").isNotNull())
    return found.select("table_name", "key", "column_name", "difference", "stored", "fresh")


def conserved(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Parts against their whole, for several divisions of ``df`` at once.

    A rule is which rows it divides and the part each of them falls into; a row whose part is
    null is in none. All divisions are grouping sets of one aggregate, so ``df`` is evaluated
    once, and each row is counted with its part before anything is shuffled. ``rule, checked``
    (the whole), ``failed`` (how many rows the parts miss)."""
    n = len(rules)
    ins, parts = [f"in_{i}" for i in range(n)], [f"part_{i}" for i in range(n)]
    typed = df.select(
        *[F.coalesce(applies, F.lit(False)).alias(c) for c, (applies, _) in zip(ins, rules.values())],
        *[F.when(applies, part.cast("string")).alias(c) for c, (applies, part) in zip(parts, rules.values())],
    )
    counted = typed.groupingSets([[F.col(p)] for p in parts] + [[]], *[F.col(p) for p in parts]).agg(
        F.grouping_id().alias("level"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in ins]
    )
    everything = 2**n - 1
    totals = []
    for i, name in enumerate(rules):
        own = (F.col("level") == everything - 2 ** (n - 1 - i)) & F.col(parts[i]).isNotNull()
        totals.append(F.coalesce(F.max(F.when(F.col("level") == everything, F.col(f"n_in_{i}"))), F.lit(0)).alias(f"checked:{name}"))
        totals.append(F.coalesce(F.sum(F.when(own, F.col(f"n_in_{i}"))), F.lit(0)).alias(f"parts:{name}"))
    summed = counted.agg(*totals)
    failed = {f"failed:{name}": F.abs(F.col(f"`checked:{name}`") - F.col(f"`parts:{name}`")) for name in rules}
    return _as_rows(summed.withColumns(failed), list(rules))


def conservation(name: str, parts: DataFrame, part: str, whole: DataFrame, total: str) -> DataFrame:
    """The parts add up to the whole (both reduced to one row first)."""
    none = F.lit(None).cast("long")
    summed = parts.agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("parts")).select("parts", none.alias("whole"))
    single = whole.agg(F.max(total).cast("long").alias("whole")).select(none.alias("parts"), "whole")
    both = summed.unionByName(single).agg(F.max("parts").alias("parts"), F.coalesce(F.max("whole"), F.lit(0)).alias("whole"))
    return both.select(
        F.lit(name).alias("rule"),
        F.col("whole").alias("checked"),
        F.abs(F.col("whole") - F.col("parts")).alias("failed"),
    )


def requested_returned(df: DataFrame, requested: int) -> DataFrame:
    """One row: requested and returned counts and whether enough came back."""
    return df.agg(F.count(F.lit(1)).alias("returned")).select(
        F.lit(requested).cast("long").alias("requested"),
        "returned",
        (F.col("returned") >= requested).alias("complete"),
    )
