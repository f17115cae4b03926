"""Reconciling two independent collections of the same repositories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.operators.distribution import describe

#: Columns taken from collection A, and those kept beside B's under a suffix.
FROM_A = (
    "url", "stale_days", "stale_status", "language", "language_category", "issues_total", "closed_ratio",
)
BESIDE_A = {"age_years": "age_years_api", "merged_prs_api": "merged_prs_api", "releases_api": "releases_api"}
#: Columns taken from collection B.
FROM_B = ("age_whole_days", "age_years", "merged_prs", "releases")
#: Columns of A that fall back to B where A has no such row.
FALLBACK = {"stars": "stars"}


def dedup_last(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: the values of the last record, the position of the first.

    A plain aggregate, so copies are combined before the shuffle and a key that
    holds a large share of the rows costs no more than any other. Null is a key
    like any other.
    """
    others = [c for c in df.columns if c not in (key, position)]
    return _last_per(df, [key], position, others).select(key, position, *others)


def _last_per(df: DataFrame, keys: Sequence[str], position: str, others: Sequence[str]) -> DataFrame:
    first_place = F.min(position).alias(position)
    if not others:
        return df.groupBy(*keys).agg(first_place)
    latest = F.max_by(F.struct(*others), position).alias("_last")
    return df.groupBy(*keys).agg(latest, first_place).select(*keys, position, "_last.*")


def reconcile(
    a: DataFrame,
    b: DataFrame,
    key: str = "repo_key",
    position: str = "pos",
    from_a: Sequence[str] = FROM_A,
    beside_a: Mapping[str, str] = BESIDE_A,
    from_b: Sequence[str] = FROM_B,
    fallback: Mapping[str, str] = FALLBACK,
) -> DataFrame:
    """Full outer join of the deduplicated collections with presence flags.

    ``fallback`` columns come from A wherever A has the row, even when the value
    is null, and from B only where the row is missing in A. The positions
    ``pos_a, pos_b`` carry the output order (see :func:`in_first_seen_order`).
    Null is a key like any other: keys are compared as text with a null flag,
    plain equality on both. Deduplication groups by the same two columns, so it
    leaves both sides partitioned and sorted for the join, which adds no shuffle
    and meets each key once.
    """

    def side(df: DataFrame, mark: str, wanted: Sequence[str]) -> DataFrame:
        columns = [c for c in dict.fromkeys(wanted) if c in df.columns]
        keyed = df.select(
            F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_text"),
            F.col(key).isNull().alias("_null"),
            F.col(key).alias("_key"),
            position,
            *columns,
        )
        unique = _last_per(keyed, ["_text", "_null"], position, ["_key", *columns])
        return unique.select(
            F.col("_text").alias(f"_text_{mark}"),
            F.col("_null").alias(f"_null_{mark}"),
            F.col("_key").alias(f"_key_{mark}"),
            F.col(position).alias(f"pos_{mark}"),
            F.lit(True).alias(f"_in_{mark}"),
            *[F.col(c).alias(f"_{mark}_{c}") for c in columns],
        )

    left = side(a, "a", [*from_a, *beside_a, *fallback])
    right = side(b, "b", [*from_b, *fallback.values()])
    same_key = (F.col("_text_a") == F.col("_text_b")) & (F.col("_null_a") == F.col("_null_b"))
    joined = left.join(right, same_key, "full_outer")
    in_a, in_b = F.col("_in_a").isNotNull(), F.col("_in_b").isNotNull()

    columns = [
        F.when(in_a, F.col("_key_a")).otherwise(F.col("_key_b")).alias(key),
        in_a.alias("in_a"),
        in_b.alias("in_b"),
    ]
    columns += [F.col(f"_a_{c}").alias(c) for c in from_a if f"_a_{c}" in left.columns]
    columns += [
        F.when(in_a, F.col(f"_a_{mine}")).otherwise(F.col(f"_b_{theirs}")).alias(mine)
        for mine, theirs in fallback.items()
    ]
    columns += [F.col(f"_a_{c}").alias(name) for c, name in beside_a.items() if f"_a_{c}" in left.columns]
    columns += [F.col(f"_b_{c}").alias(c) for c in from_b if f"_b_{c}" in right.columns]
    return joined.select(*columns, "pos_a", "pos_b")


def in_first_seen_order(reconciled: DataFrame) -> DataFrame:
    """A's rows in A's order, then the rows only B has in B's order."""
    return reconciled.orderBy(F.col("pos_a").asc_nulls_last(), F.col("pos_b").asc_nulls_last())


def key_union(a: DataFrame, b: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys of both sides with the place of first appearance: ``key, source, pos``."""
    both = a.select(key, F.lit(1).alias("source"), F.col(position).alias("pos")).unionByName(
        b.select(key, F.lit(2).alias("source"), F.col(position).alias("pos"))
    )
    first = both.groupBy(key).agg(
        F.min("source").alias("source"),
        F.min(F.when(F.col("source") == 1, F.col("pos"))).alias("_pos_a"),
        F.min(F.when(F.col("source") == 2, F.col("pos"))).alias("_pos_b"),
    )
    return first.select(key, "source", F.coalesce("_pos_a", "_pos_b").alias("pos"))


def match_counts(reconciled: DataFrame) -> DataFrame:
    """One row: keys in A, in B, in both and in the union."""
    return reconciled.agg(
        F.count_if("in_a").alias("n_a"),
        F.count_if("in_b").alias("n_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"),
        F.count(F.lit(1)).alias("n_union"),
    )


def divergence_counts(reconciled: DataFrame, a_value: str = "releases_api", b_value: str = "releases") -> DataFrame:
    """One row: rows checked, B's value missing, B's value different from A's."""
    return reconciled.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col(b_value).isNull()).alias("missing_in_b"),
        F.count_if(F.col(b_value).isNotNull() & ~F.col(a_value).eqNullSafe(F.col(b_value))).alias("divergent"),
    )


def reconcile_summary(
    reconciled: DataFrame, metrics: Sequence[str] = ("age_years", "merged_prs", "releases")
) -> DataFrame:
    """``metric, n, mean, median, min, max`` of B's values, 2 decimals."""
    stats = describe(reconciled, [], {m: m for m in metrics}, digits=2, scale=2)
    return stats.select("metric", "n", "mean", "median", "min", "max")


def union_of_columns(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns in first-seen order, missing cells null."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def without_raw(records: DataFrame) -> DataFrame:
    """The tabular part of a record: everything but the raw node."""
    return records.drop("raw", V.RAW_KEY)
