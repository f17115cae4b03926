"""Correlation, ranking, reconciliation and data-quality rules."""

from __future__ import annotations

import random
import statistics

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.operators import correlation, quality, ranking, reconcile


def pairs_frame(spark, pairs):
    return spark.createDataFrame(pairs, "x double, y double")


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.4)], 1.0),
        ([(1, 0.4), (2, 0.3), (3, 0.2), (4, 0.1)], -1.0),
        ([(0.1, 1), (0.1, 2), (0.1, 3)], None),
        ([(1, 1)], None),
        ([], None),
        ([(1, None), (None, 2), (3, 3)], None),
    ],
)
def test_correlation_cases(spark, pairs, expected):
    df = pairs_frame(spark, [tuple(None if v is None else float(v) for v in p) for p in pairs])
    row = correlation.correlate(df, "x", "y").first()
    assert row["coefficient"] == expected
    if expected is None:
        assert row["strength"] == V.STRENGTH_UNDEFINED


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_correlation_of_random_pairs_with_gaps(spark, partitions):
    rng = random.Random(5)
    pairs = [(rng.random() * 10, rng.random()) for _ in range(500)]
    pairs = [(x, x * 0.1 + y) for x, y in pairs] + [(None, 1.0), (2.0, None), (None, None)]
    row = correlation.correlate(pairs_frame(spark, pairs).repartition(partitions), "x", "y").first()
    complete = [p for p in pairs if None not in p]
    expected = round(statistics.correlation([p[0] for p in complete], [p[1] for p in complete]), 4)
    assert (row["total"], row["pairs_used"], row["pairs_dropped"]) == (503, 500, 3)
    assert row["coefficient"] == expected


def test_top_k_limits_and_ties(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", None)], "repo_key string, stars long")
    assert [r["repo_key"] for r in ranking.top_k(df, 3).collect()] == ["c", "a", "b"]
    assert ranking.top_k(df, 1000).count() == 4
    assert ranking.top_k(df, 1001).count() == 4
    for bad in (0, 1001, 1.5, True):
        with pytest.raises(ValueError):
            ranking.top_k(df, bad, maximum=1000)
    assert [(r["rank"], r["repo_key"]) for r in ranking.top_k_ranked(df, 2).orderBy("rank").collect()] == [(1, "c"), (2, "a")]


def test_rank_dimension_last_position_wins(spark):
    df = spark.createDataFrame([("Go", 1), (" go\t", 4), ("C#", 2)], "name string, position long")
    assert {r["lang_key"]: r["rank"] for r in ranking.rank_dimension(df).collect()} == {"go": 4, "c#": 2}


@pytest.mark.parametrize("spread", [1, 30_000, 1 << 17, 1 << 50])
def test_order_violations_across_buckets(spark, spread):
    rng = random.Random(1)
    values = sorted((rng.randint(0, 50) for _ in range(40)), reverse=True)
    values[10], values[30] = 1000, 900
    df = spark.createDataFrame([((i - 5) * spread, v) for i, v in enumerate(values)], "pos long, stars long")
    expected = sum(b > a for a, b in zip(values, values[1:]))
    row = ranking.order_violations(df.repartition(5), "pos", "stars").first()
    assert (row["checked"], row["failed"]) == (40, expected)
    assert tuple(ranking.order_violations(df.limit(0), "pos", "stars").first()) == (0, 0)


SIDE_A = [
    ("x", 0, 10, 1.0, None), ("y", 1, None, 2.0, 7), ("x", 2, 11, 1.5, 8), (None, 3, 5, 0.5, 9),
]
SIDE_B = [("z", 0, 70, 4.0, 1), ("y", 1, 71, 3.0, 2), ("x", 2, 72, 5.0, 8), (None, 4, 1, 1.0, 1)]


def sides(spark):
    a = spark.createDataFrame(SIDE_A, "repo_key string, pos long, stars long, stale_days double, releases_api long")
    b = spark.createDataFrame(SIDE_B, "repo_key string, pos long, stars long, age_years double, releases long")
    return a, b


def test_dedup_keeps_first_place_and_last_values(spark):
    a, _ = sides(spark)
    got = {r["repo_key"]: r.asDict() for r in reconcile.dedup_last(a, "repo_key", "pos").collect()}
    assert got["x"] == {"repo_key": "x", "pos": 0, "stars": 11, "stale_days": 1.5, "releases_api": 8}
    assert set(got) == {"x", "y", None}


def test_reconcile_flags_precedence_and_order(spark):
    merged = reconcile.reconcile(*sides(spark))
    ordered = [r.asDict() for r in reconcile.in_first_seen_order(merged).collect()]
    assert [r["repo_key"] for r in ordered] == ["x", "y", None, "z"]
    assert [(r["in_a"], r["in_b"]) for r in ordered] == [(True, True), (True, True), (True, True), (False, True)]
    # A's missing stars stay missing; B's are used only where A has no row.
    assert [r["stars"] for r in ordered] == [11, None, 5, 70]
    assert [r["age_years"] for r in ordered] == [5.0, 3.0, 1.0, 4.0]
    assert [r["releases"] for r in ordered] == [8, 2, 1, 1]
    counts = reconcile.match_counts(merged).first().asDict()
    assert counts == {"n_a": 3, "n_b": 4, "n_both": 3, "n_union": 4}
    assert reconcile.divergence_counts(merged).first().asDict() == {"checked": 4, "missing_in_b": 0, "divergent": 3}
    stats = {r["metric"]: r for r in rows_of(reconcile.reconcile_summary(merged, ["age_years", "releases"]))}
    assert (stats["age_years"]["mean"], stats["age_years"]["median"]) == (3.25, 3.5)
    assert (stats["releases"]["n"], stats["releases"]["max"]) == (4, 8.0)


def test_reconcile_shuffles_each_side_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = reconcile.reconcile(*sides(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2


def test_key_union_order(spark):
    a, b = sides(spark)
    got = reconcile.key_union(a, b, "repo_key", "pos").orderBy("source", "pos").collect()
    assert [(r["repo_key"], r["source"], r["pos"]) for r in got] == [("x", 1, 0), ("y", 1, 1), (None, 1, 3), ("z", 2, 0)]


def test_union_of_columns_keeps_first_seen_order(spark):
    a, b = spark.createDataFrame([(1, 2)], "p int, q int"), spark.createDataFrame([(3, 4)], "q int, r int")
    both = reconcile.union_of_columns(a, b)
    assert both.columns == ["p", "q", "r"]
    assert rows_of(both, "q") == [{"p": 1, "q": 2, "r": None}, {"p": None, "q": 3, "r": 4}]


def as_map(df):
    return {r["rule"]: (r["checked"], r["failed"]) for r in df.collect()}


def test_key_rules(spark):
    df = spark.createDataFrame([("a",), ("a",), (" ",), (None,), (None,), ("b",)], "k string")
    assert as_map(quality.key_rules(df, "k")) == {"key_present": (6, 2), "key_not_blank": (6, 1), "key_unique": (6, 2)}
    assert as_map(quality.key_rules(df.limit(0), "k"))["key_unique"] == (0, 0)


def test_value_rules_in_one_pass(spark):
    df = spark.createDataFrame([(1, 0.5), (-1, 1.5), (None, None)], "n long, r double")
    rules = {**quality.non_negative("n"), **quality.negative_alerts("n"), **quality.in_unit_interval("r")}
    checked = quality.check(df, rules)
    assert as_map(checked) == {"n_non_negative": (3, 2), "n_negative": (2, 1), "r_in_unit_interval": (2, 1)}
    listed = quality.negative_rows(df.withColumn("k", F.lit(None).cast("string")), "k", ["n", "r"])
    assert [tuple(r) for r in listed.collect()] == [("Desconhecido", "n", -1.0)]
    assert as_map(quality.row_count(df, 3)) == {"row_count": (3, 0)}
    assert as_map(quality.row_count(df, 1000)) == {"row_count": (3, 1)}


def test_status_and_category_rules(spark):
    rows = [
        ("ok", 1.0, "Go", "Go"), ("ok", None, "Go", "go"), ("sem_push", 1.0, None, "Go"), ("data_futura", 0.0, None, V.NO_LANGUAGE),
        ("data_futura", 2.0, " ", " "), ("?", 3.0, "C", None), (None, None, "C", "C"), ("data_invalida", None, "C", "C"),
    ]
    df = spark.createDataFrame(rows, "stale_status string, stale_days double, language string, language_category string")
    assert as_map(quality.check(df, quality.staleness_status_rules())) == {
        "status_known": (8, 2), "no_value_without_date": (2, 1), "value_with_date": (5, 1), "future_is_zero": (2, 1),
    }
    assert as_map(quality.check(df, quality.category_rules())) == {
        "category_without_language": (2, 1), "language_not_blank": (6, 1), "category_with_language": (6, 2),
    }


def test_difference_and_conservation(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    fresh = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    got = sorted((r["k"], r["n"], r["only_in"]) for r in quality.difference(stored, fresh).collect())
    assert got == [("b", 2, "stored"), ("b", 3, "recomputed")]
    assert quality.difference(stored, stored).isEmpty()
    total = spark.createDataFrame([(3,)], "t long")
    assert as_map(quality.conservation("sum", stored, "n", total, "t")) == {"sum": (3, 0)}
    assert as_map(quality.conservation("sum", fresh, "n", total, "t")) == {"sum": (3, 1)}
    assert as_map(quality.conservation("none", stored.limit(0), "n", total.limit(0), "t")) == {"none": (0, 0)}


def test_differing_cells_name_the_cell(spark):
    fresh = spark.createDataFrame([("a", 1, 0.5), (None, 2, None), ("b", 3, float("nan"))], "k string, n long, v double")
    stored = spark.createDataFrame([("a", "1", 0.5, 7), (None, "2", 1.0, 7), ("c", "3", None, 7)], "k string, n string, v double, more int")
    found = quality.differing_cells({"t": (stored, fresh, ["k"]), "same": (fresh, fresh, ["k"]), "whole": (fresh.agg(F.max("n").alias("n")), fresh.agg(F.min("n").alias("n")), [])})
    got = {(r["table_name"], r["key"], r["column_name"]): (r["difference"], r["stored"], r["fresh"]) for r in found.collect()}
    assert got == {
        ("t", '["a"]', "more"): ("missing_in_fresh", "7", None),
        ("t", "[null]", "more"): ("missing_in_fresh", "7", None),
        ("t", "[null]", "v"): ("value", "1.0", None),
        ("t", '["b"]', "n"): ("missing_in_stored", None, "3"),
        ("t", '["b"]', "v"): ("missing_in_stored", None, "NaN"),
        ("t", '["c"]', "n"): ("missing_in_fresh", "3", None),
        ("t", '["c"]', "v"): ("missing_in_fresh", None, None),
        ("t", '["c"]', "more"): ("missing_in_fresh", "7", None),
        ("whole", "[]", "n"): ("value", "3", "1"),
    }
    twice = fresh.where("n = 1").unionAll(fresh.where("n = 1"))
    lost = quality.differing_cells({"t": (fresh.where("n = 1"), twice, ["k"])}).collect()
    assert sorted((r["key"], r["column_name"], r["difference"]) for r in lost) == [('["a"]#2', "n", "missing_in_stored"), ('["a"]#2', "v", "missing_in_stored")]


def test_conserved_counts_rows_without_a_part(spark):
    df = spark.createDataFrame([("a", 1, True), (None, 2, True), ("b", None, None), ("b", 4, False)], "g string, n int, w boolean")
    rules = {"groups": (F.lit(True), F.col("g")), "some": (F.col("w"), F.col("g")), "none": (F.col("n") > 9, F.col("g")), "all": (F.lit(True), F.lit(1))}
    assert as_map(quality.conserved(df, rules)) == {"groups": (4, 1), "some": (2, 1), "none": (0, 0), "all": (4, 0)}
    assert as_map(quality.conserved(df.limit(0), rules)) == dict.fromkeys(rules, (0, 0))
    scans = quality.conserved(df, rules)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans == 1


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_ranked_rows_have_every_place_once(spark, coalesce):
    df = spark.range(5000).selectExpr("id", "cast(if(id % 3 = 0, 1, id % 11) as double) as v", "if(id % 5 = 0, null, id) as t", "1 as _x").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        found = ranking.ranked_rows(df, [F.desc("v"), F.col("t").asc_nulls_last(), F.col("id")], "place")
        assert found.columns == ["id", "v", "t", "_x", "place"]
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plain = sorted(rows, key=lambda r: (-r["v"], r["t"] is None, r["t"] or 0, r["id"]))
    assert [r["place"] for r in plain] == list(range(1, 5001))
    assert ranking.ranked_rows(df.limit(0), [F.col("id")]).count() == 0
