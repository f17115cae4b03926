from __future__ import annotations

import math
import random
import statistics

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.operators import distribution, grouping, summary
from repopulse.operators.distribution import describe, describe_approximately


def brute(values, digits):
    present = [v for v in values if v is not None]
    if not present:
        return (len(values), 0, None, None, None, None)
    return (
        len(values), len(present), round(statistics.fmean(present), digits), round(statistics.median(present), digits),
        min(present), max(present),
    )


def make_rows(seed, n=3000):
    rng = random.Random(seed)
    groups = [None, "a", "b", "hot", "hot", "hot", "hot"]
    rows = []
    for i in range(n):
        group = rng.choice(groups)
        value = rng.choice([None, rng.randint(-500, 500) / 100, rng.randint(0, 10**7) / 100, 0.0, round(rng.random(), 4)])
        rows.append((group, value, rng.randint(0, 20)))
    return rows + [("empty", None, 1), ("one", 2.5, 3), ("two", 1.0, 4), ("two", 2.0, 5)]


@pytest.mark.parametrize("partitions", [1, 13])
def test_describe_matches_brute_force(spark, partitions):
    rows = make_rows(7)
    df = spark.createDataFrame(rows, "g string, v double, w long").repartition(partitions)
    got = {(r["g"], r["metric"]): tuple(r[c] for c in ("rows", "n", "mean", "median", "min", "max"))
           for r in rows_of(describe(df, ["g"], {"v": "v", "w": "w"}, scale=4))}
    expected = {}
    for g in {r[0] for r in rows}:
        for i, metric in ((1, "v"), (2, "w")):
            expected[(g, metric)] = brute([r[i] for r in rows if r[0] == g], 4)
    assert got == expected


def test_describe_without_keys_and_mixed_digits(spark):
    rows = make_rows(3)
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {r["metric"]: tuple(r[c] for c in ("rows", "n", "mean", "median", "min", "max"))
           for r in rows_of(describe(df, [], {"v": "v", "w": "w"}, digits={"v": 2, "w": 4}))}
    assert got == {"v": brute([r[1] for r in rows], 2), "w": brute([r[2] for r in rows], 4)}


def test_describe_empty_null_and_unscaled(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert rows_of(describe(df, ["g"], {"v": "v"})) == []
    (row,) = rows_of(describe(df, [], {"v": "v"}))
    assert (row["rows"], row["n"], row["mean"], row["median"]) == (0, 0, None, None)
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    (row,) = rows_of(describe(nulls, [], {"v": "v"}))
    assert (row["rows"], row["n"], row["median"], row["min"]) == (2, 0, None, None)
    wide = spark.createDataFrame([(1e300,), (-1e300,), (3.0,)], "v double")
    (row,) = rows_of(describe(wide, [], {"v": "v"}, scale=None))
    assert (row["median"], row["min"], row["max"]) == (3.0, -1e300, 1e300)


def test_sum_is_exact_and_groups_are_counted(spark):
    rows = [("a", 0.1)] * 10 + [("b", -0.1)] * 3 + [(None, 12345678.9012)] * 2
    df = spark.createDataFrame(rows, "g string, v double")
    for scale in (None, 4, 1):
        got = {r["g"]: r["mean"] for r in rows_of(describe(df, ["g"], {"v": "v"}, scale=scale))}
        assert got == {"a": 0.1, "b": -0.1, None: 12345678.9012}
    stats = grouping.stats_by_group(df, "g", {"v": "v"})
    assert {r["g"]: r["n"] for r in rows_of(stats)} == {"a": 10, "b": 3, None: 2}


def test_no_value_is_rounded_by_its_scale(spark):
    for values in ([0.00006, 0.00006, 0.0], [2e15, 1.0], [1e300, 2.5]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for scale in (None, 4):
            (row,) = rows_of(describe(df, [], {"v": "v"}, digits=4, scale=scale))
            assert (row["mean"], row["median"]) == (round(statistics.fmean(values), 4), round(statistics.median(values), 4))


def test_nan_is_the_greatest_and_infinity_has_a_place(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, nan, -5.0)], "v double")
    for scale in (None, 4):
        (row,) = rows_of(describe(df, [], {"v": "v"}, scale=scale))
        assert (row["n"], row["median"], row["min"]) == (5, 2.0, -5.0) and math.isnan(row["mean"]) and math.isnan(row["max"])
    df = spark.createDataFrame([(v,) for v in (inf, 1.0, inf, -inf, 7.0, inf)], "v double")
    (row,) = rows_of(describe(df.where("v > 0"), [], {"v": "v"}))
    assert (row["mean"], row["median"], row["min"], row["max"]) == (inf, inf, 1.0, inf)
    (row,) = rows_of(describe(df.where("v < 5"), [], {"v": "v"}))
    assert (row["median"], row["min"], row["max"]) == (-inf, -inf, 1.0)


@pytest.mark.parametrize(
    "value",
    ["1.7e15 + id * 1000003", "1e-4 + id * 1e-9", "id * 1e-300", "if(id < 3000, 5.0 + id * 1e-12, id)", "1e18 + id * 128", "id % 3", "-1.7e15 - id"],
)
def test_values_in_a_narrow_band_are_split(spark, value):
    df = spark.range(4000).select(F.lit("g").alias("g"), F.expr(f"cast({value} as double)").alias("v"))
    values = [r["v"] for r in df.collect()]
    digits = 12 if max(values) < 1e3 else 4
    (row,) = rows_of(describe(df, ["g"], {"v": "v"}, digits=digits))
    assert row["median"] == round(statistics.median(values), digits)
    # What is ranked: little, however the values crowd.
    for accuracy in (100, 10_000):
        long_form = df.select("g", F.lit("v").alias("metric"), F.col("v").alias("value"))
        stats = distribution._group_stats(long_form, ["g", "metric"], None, accuracy)
        counted = distribution._counted_between(long_form, stats, ["g", "metric"])
        assert counted.count() <= 1 + max(10, 12 * 4000 // accuracy)


@pytest.mark.parametrize("order", ["v desc", "hash(v)"])
@pytest.mark.parametrize("n", [1, 2, 3, 10, 21, 20_000])
def test_splitters_never_miss(spark, order, n):
    df = spark.range(n).selectExpr("cast(id * 3 % 1009 as double) as v", "id % 2 as g").orderBy(F.expr(order)).repartitionByRange(11, "v")
    values = sorted(float(i * 3 % 1009) for i in range(n))
    for accuracy in (10, 50):
        (row,) = rows_of(describe(df, [], {"v": "v"}, accuracy=accuracy))
        assert row["median"] == round(statistics.median(values), 4)


def test_no_row_is_shuffled_by_its_group(spark):
    """Nothing but a hint makes this join a broadcast: adaptive execution gives up one of few groups in many partitions."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        df = spark.range(20_000).selectExpr("cast(id % 4099 as double) as v", "if(id % 5 = 0, 1, null) as w")
        found = describe(df, [], {"v": "v", "w": "w"}, accuracy=100)
        rows = {r["metric"]: (r["n"], r["median"]) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set(setting, before)
    assert rows == {"v": (20_000, statistics.median(i % 4099 for i in range(20_000))), "w": (4_000, 1.0)}
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert not any("_metric" in line for line in joins)


@pytest.mark.parametrize("accuracy", [2, 10, 1000])
def test_large_and_small_groups_together(spark, accuracy):
    rows = make_rows(11)
    df = spark.createDataFrame(rows, "g string, v double, w long").repartition(7)
    got = {(r["g"], r["metric"]): tuple(r[c] for c in ("rows", "n", "mean", "median", "min", "max"))
           for r in rows_of(describe(df, ["g"], {"v": "v", "w": "w"}, scale=4, accuracy=accuracy))}
    expected = {(g, m): brute([r[i] for r in rows if r[0] == g], 4) for g in {r[0] for r in rows} for i, m in ((1, "v"), (2, "w"))}
    assert got == expected


def test_building_a_query_starts_no_job(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    grouping.stats_by_group(df, "g", {"v": "v"})
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_median_of_neighbouring_buckets(spark):
    df = spark.createDataFrame([(1.0,), (1000000.0,)], "v double")
    assert rows_of(describe(df, [], {"v": "v"}))[0]["median"] == 500000.5


def test_approximate_median_is_an_element(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    (row,) = rows_of(describe_approximately(df, [], {"v": "v"}))
    assert row["median"] in (2.0, 3.0) and row["mean"] == 4.0


def test_ratio_summary(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (None,)], "closed_ratio double")
    (row,) = rows_of(summary.summarise(df, {"closed_ratio": "closed_ratio"}))
    assert (row["total"], row["with_value"], row["without_value"], row["mean"], row["median"]) == (3, 2, 1, 0.5, 0.5)


def test_status_histogram_counts_unknown(spark):
    df = spark.createDataFrame([("ok",), ("ok",), (None,)], "s string")
    assert {r["status"]: r["n"] for r in rows_of(summary.status_histogram(df, "s"))} == {"ok": 2, "desconhecido": 1}
    both = rows_of(summary.status_counts(df, {"x": "s", "y": F.lit("ok")}), "metric", "status")
    assert [(r["metric"], r["status"], r["n"]) for r in both] == [("x", "desconhecido", 1), ("x", "ok", 2), ("y", "ok", 3)]


def test_category_histogram_order(spark):
    df = spark.createDataFrame([(c,) for c in ["go", "Go", "C", "b", "C", "A"]], "c string")
    got = [r["category"] for r in summary.category_histogram(df, "c").collect()]
    assert got[0] == "C" and got[1:3] == ["A", "b"] and set(got[3:]) == {"go", "Go"}
    assert summary.top_categories(df, "c", 2).count() == 2


def test_popular_share(spark):
    rows = [("Go", True, True), ("Go", True, True), ("X", True, False), (V.NO_LANGUAGE, False, False)]
    df = spark.createDataFrame(rows, "language_category string, has_language boolean, is_popular boolean")
    row = summary.popular_share(df).first().asDict()
    assert row == {"total": 4, "with_language": 3, "without_language": 1, "distinct_languages": 2, "popular": 2,
                   "popular_percent": 50.0}
    empty = summary.popular_share(df.limit(0)).first()
    assert (empty["total"], empty["popular_percent"]) == (0, None)


def test_grouping_order_and_statistics(spark):
    rows = [("Go", 5, 1, 3.0), ("Python", 10, 2, 4.0), ("Python", 30, 6, 8.0), (V.NO_LANGUAGE, 1, 0, None)]
    df = spark.createDataFrame(rows, "k string, merged_prs long, releases long, stale_days double")
    stats = grouping.stats_by_group(df, "k", {m: m for m in grouping.GROUPED_METRICS})
    ordered = [r.asDict() for r in grouping.in_report_order(stats, "k").collect()]
    assert [r["k"] for r in ordered][:4] == ["Python", "Python", "Python", "Go"]
    by = {(r["k"], r["metric"]): r for r in ordered}
    assert by[("Python", "merged_prs")]["mean"] == 20.0
    assert by[("Python", "releases")]["median"] == 4.0
    assert by[("Python", "stale_days")]["max"] == 8.0
    alone = by[(V.NO_LANGUAGE, "stale_days")]
    assert (alone["n"], alone["with_value"], alone["mean"]) == (1, 0, None)


def test_bands_fill_empty_ones(spark):
    ages = [(1.0, 0.2), (1.5, 0.4), (3.0, 0.5), (7.0, 0.6), (15.0, 0.9), (None, 0.1), (4.0, None)]
    df = spark.createDataFrame(ages, "a double, r double")
    got = rows_of(grouping.banded_stats(df, F.col("a"), F.col("r"), V.AGE_BANDS), "band_no")
    assert [r["n"] for r in got] == [2, 1, 1, 1] and got[0]["mean"] == 0.3
    releases = [(0, 5), (3, 10), (10, 20), (30, 30), (80, 40)]
    df = spark.createDataFrame(releases, "rel long, prs long")
    got = rows_of(grouping.banded_stats(df, F.col("rel"), F.col("prs"), V.RELEASE_BANDS), "band_no")
    assert [r["n"] for r in got] == [1, 2, 1, 1] and got[1]["mean"] == 15.0
    empty = rows_of(grouping.banded_stats(df.limit(0), F.col("rel"), F.col("prs"), V.RELEASE_BANDS), "band_no")
    assert [(r["n"], r["mean"], r["median"]) for r in empty] == [(0, None, None)] * 4


def test_top_groups_keep_first_seen_order_on_ties(spark):
    rows = [(0, "b", None), (1, "a", 3), (2, "a", 5), (3, "b", 1), (4, "b", 9), (5, "c", 2), (6, None, 7), (7, "d", None)]
    df = spark.createDataFrame(rows, "pos long, g string, v long")
    got = [(r["g"], r["n"], r["median"], r["max"]) for r in grouping.top_groups(df, "g", "v", ["v"], "pos", k=2).collect()]
    assert got == [("b", 2, 5.0, 9.0), ("a", 2, 4.0, 5.0)]


def test_ratio_quality(spark):
    df = spark.createDataFrame([(0.2,), (0.8,), (1.0,), (1.2,), (-0.1,), (None,)], "r double")
    row = summary.ratio_quality(df, F.col("r")).first().asDict()
    assert row == {"total": 6, "valid": 3, "missing": 1, "inconsistent": 2, "min": 0.2, "max": 1.0, "median": 0.8}
    listed = summary.inconsistent_ratios(df.withColumn("k", F.lit("x")), "k", F.col("r"))
    assert sorted(r["ratio"] for r in listed.collect()) == [-0.1, 1.2]
