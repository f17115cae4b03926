"""States of single snapshots, merged, against the records themselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from repopulse.operators import correlation, states


@pytest.fixture(scope="module")
def records(spark):
    # Large values beside a small spread; one week without any value, one with a single record.
    return spark.range(3000).selectExpr(
        "if(id = 2999, 9, if(id % 7 = 0, 7, id % 5)) as week", "if(id % 3 = 0, 'a', null) as kind",
        "if(id % 7 = 0, null, 1e9 + (id * 37) % 101) as x", "if(id % 11 = 0, null, 1e9 - (id * 37) % 101 + id % 2) as y", "id % 640 as who",
    )


def test_correlations_merge(records):
    merged = states.merged_correlations(states.pair_states(records, ["week"], {"xy": ("x", "y"), "xx": ("x", "x")}))
    whole = correlation.correlate_pairs(records, {"xy": ("x", "y"), "xx": ("x", "x")}).drop("strength")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.select(*merged.columns).collect()))
    flat = records.withColumn("x", F.lit(0.1))
    assert states.merged_correlations(states.pair_states(flat, ["week"], {"p": ("x", "y")})).first()["coefficient"] is None


def test_a_new_week_adds_its_own_states(spark, records, tmp_path):
    path = str(tmp_path / "states")
    for week in (0, 1, 7, 9):
        states.metric_states(records.where(f"week = {week}"), ["week", "kind"], {"x": "x"}).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    seen = records.where("week in (0, 1, 7, 9)")
    for by in ([], ["kind"], ["week", "kind"]):
        whole = seen.groupBy(*by).agg(
            F.lit("x").alias("metric"), F.count(F.lit(1)), F.count("x"), F.count_if(F.col("x").isNull()), F.round(F.avg("x"), 4), F.min("x"), F.max("x")
        )
        assert sorted(map(str, map(tuple, states.merged_metrics(stored, by).collect()))) == sorted(map(str, map(tuple, whole.collect())))


def test_sketches_unite(records):
    stored = states.distinct_states(records, ["week"], ["who", "kind"])
    merged = {r["column_name"]: r["distinct_values"] for r in states.merged_distinct(stored).collect()}
    # Four standard errors.
    assert abs(merged["who"] - 640) <= 640 * 0.065 and merged["kind"] == 1


def test_no_records(records):
    nothing = records.limit(0)
    assert states.merged_metrics(states.metric_states(nothing, ["week"], {"x": "x"})).count() == 0
    assert states.merged_correlations(states.pair_states(nothing, ["week"], {"p": ("x", "y")})).count() == 0
    assert states.merged_distinct(states.distinct_states(nothing, ["week"], ["who"])).count() == 0
