from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.functions import instants, presence, text
from repopulse.functions.bands import assign_band, band_label, band_table, strength_label
from repopulse.functions.rounding import half_even
from repopulse.operators.metrics import instant_literal


@pytest.mark.parametrize("digits", [0, 2, 4])
def test_half_even_agrees_with_binary_rounding(spark, digits):
    rng = random.Random(digits)
    values = [0.125, 1.005, 2.675, 2.665, -2.675, 0.5, 1.5, 2.5, 5e-05, -5e-05, 0.005, 0.0, 1e15 + 0.125, 123456789012.5]
    for _ in range(5000):
        values.append(rng.randint(-(10**9), 10**9) / 1000)
        values.append(rng.randint(-(10**6), 10**6) / 128)
        values.append(rng.random())
        values.append((rng.randint(0, 10**4) / 1e4 + rng.randint(0, 10**4) / 1e4) / 2)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", half_even(F.col("x"), digits).alias("r")).collect()
    wrong = [(x, r, round(x, digits)) for x, r in got if r != float(round(x, digits))]
    assert not wrong


def test_half_even_keeps_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(half_even(F.col("x"), 2)).first()[0] is None


INSTANTS = {
    "2026-08-11T14:03:52Z": datetime(2026, 8, 11, 14, 3, 52, tzinfo=timezone.utc),
    "  2026-08-11T14:03:52Z\n": datetime(2026, 8, 11, 14, 3, 52, tzinfo=timezone.utc),
    "2026-08-11T14:03:52": datetime(2026, 8, 11, 14, 3, 52, tzinfo=timezone.utc),
    "2026-08-11 14:03": datetime(2026, 8, 11, 14, 3, tzinfo=timezone.utc),
    "2026-08-11T14:03:52.613907+02:00": datetime(2026, 8, 11, 12, 3, 52, 613907, tzinfo=timezone.utc),
    "2026-08-11T14:03:52+0200": datetime(2026, 8, 11, 12, 3, 52, tzinfo=timezone.utc),
    "2026-08-11": datetime(2026, 8, 11, tzinfo=timezone.utc),
    "2026": None,
    "2026-08": None,
    "2026-13-01T00:00:00Z": None,
    "2026-08-11T25:00:00Z": None,
    "2026-08-11T14:03:52 Europe/Paris": None,
    "yesterday": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_parse_instant_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in INSTANTS], "t string")
        got = df.select("t", F.unix_micros(instants.parse_instant(F.col("t"))).alias("m")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    expected = {k: None if v is None else int(v.timestamp()) * 10**6 + v.microsecond for k, v in INSTANTS.items()}
    assert {r.t: r.m for r in got} == expected


def test_whole_days_are_elapsed_not_calendar(spark):
    cases = [
        ("2018-05-09T12:03:18Z", "2026-08-11T23:15:14.613907+00:00", 3016),
        ("2014-07-11T13:42:37Z", "2026-08-11T23:15:14.614291+00:00", 4414),
        ("2026-08-10T23:30:00Z", "2026-08-11T01:00:00Z", 0),
        ("2026-08-12T00:00:00Z", "2026-08-11T23:00:00Z", -1),
    ]
    df = spark.createDataFrame(cases, "a string, b string, days long")
    days = instants.whole_days(instants.parse_instant(F.col("a")), instants.parse_instant(F.col("b")))
    assert all(r[0] == r[1] for r in df.select(days, "days").collect())


def test_iso_week_belongs_to_the_iso_year(spark):
    df = spark.createDataFrame([("2026-08-17",), ("2026-08-19",), ("2026-08-23",), ("2027-01-01",)], "d string")
    got = df.select(*[c for c in instants.iso_week(F.to_date("d")).values()]).collect()
    assert [tuple(r) for r in got] == [(2026, 34), (2026, 34), (2026, 34), (2026, 53)]


def test_strip_knows_every_white_space(spark):
    samples = [" Go ", "\x1cGo\t", "  　 ", "C# ", ""]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select("t", text.strip(F.col("t")).alias("s"), text.has_text(F.col("t")).alias("h")).collect()
    assert [(r.s, r.h) for r in got] == [(s.strip(), bool(s.strip())) for s in samples]


def test_count_presence_table(spark):
    cases = {
        '{"issues":{"totalCount":5}}': 5,
        '{"issues":{"totalCount":0}}': 0,
        '{"issues":null}': 0,
        '{"issues":{}}': 0,
        '{"issues":{"totalCount":null}}': 0,
        '{"issues":{"totalCount":1.5}}': 0,
        '{"issues":{"totalCount":"12"}}': 0,
        '{"issues":[]}': 0,
        '{"other":1}': None,
        "{}": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", presence.count_at(F.parse_json("t"), "issues").alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_null_on_a_nested_path(spark):
    texts = ['{"a":{"b":{"c":"x"}}}', '{"a":{"b":null}}', '{"a":null}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(presence.text_at(F.parse_json("t"), "a.b.c")).collect()] == ["x", None, None, None]


def test_bands_and_fall_through(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.99, 2.0, 5.0, 9.99, 10.0, 50.0, -3.0, None)], "v double")
    got = [r[0] for r in df.select(assign_band(F.col("v"), V.AGE_BANDS)).collect()]
    assert got == [1, 1, 2, 3, 3, 4, 4, 4, None]
    labels = [r[0] for r in df.select(band_label(assign_band(F.col("v"), V.AGE_BANDS), V.AGE_BANDS)).collect()]
    assert labels[-2:] == ["Mais de 10 anos", None] and labels[0] == "Ate 2 anos"
    counts = spark.createDataFrame([(v,) for v in (0, 1, 10, 11, 50, 51)], "v long")
    assert [r[0] for r in counts.select(assign_band(F.col("v"), V.RELEASE_BANDS)).collect()] == [1, 2, 2, 3, 3, 4]
    assert [r["band"] for r in rows_of(band_table(spark, V.RELEASE_BANDS), "band_no")] == [b[2] for b in V.RELEASE_BANDS]


def test_strength_labels(spark):
    cases = {
        None: "indeterminada (pares insuficientes ou sem variancia)",
        0.0: "nula",
        0.1: "muito fraca positiva",
        -0.3: "fraca negativa",
        0.5: "moderada positiva",
        -0.7: "forte negativa",
        0.9: "muito forte positiva",
        0.2: "fraca positiva",
        -0.8: "muito forte negativa",
    }
    df = spark.createDataFrame([(k,) for k in cases], "r double")
    assert {r[0]: r[1] for r in df.select("r", strength_label(F.col("r"))).collect()} == cases


def test_instant_literal_takes_naive_as_utc(spark):
    moments = [datetime(2026, 8, 11, 23, 15, 14, 613907), datetime(1960, 1, 1, tzinfo=timezone.utc)]
    got = spark.range(1).select(*[F.unix_micros(instant_literal(m)) for m in moments]).first()
    assert got[0] == int(moments[0].replace(tzinfo=timezone.utc).timestamp()) * 10**6 + 613907
    assert got[1] == int(moments[1].timestamp()) * 10**6
