from __future__ import annotations

from datetime import datetime, timezone

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.operators import metrics as M
from repopulse.operators.summary import reclassified_status

REF = datetime(2026, 8, 11, 12, 0, 0, tzinfo=timezone.utc)
FULL = (
    '{"nameWithOwner":"a/b","url":"u","stargazerCount":7,"createdAt":"2020-08-11T00:00:00Z",'
    '"pushedAt":"2026-08-11T06:00:00Z","updatedAt":"2026-08-11T07:00:00Z",'
    '"defaultBranchRef":{"name":"main","target":{"committedDate":"2026-08-10T00:00:00Z"}},'
    '"primaryLanguage":{"name":"python"},"issues":{"totalCount":20},"issuesFechadas":{"totalCount":15},'
    '"pullRequestsAceitos":{"totalCount":42},"releases":{"totalCount":7}}'
)


def test_full_node(node_frame):
    (row,) = rows_of(M.profile(node_frame(FULL), REF).drop("raw"))
    days = (REF - datetime(2020, 8, 11, tzinfo=timezone.utc)).total_seconds() / 86400
    assert row["age_days"] == round(days, 2) and row["age_years"] == round(days / 365.25, 2)
    assert (row["age_status"], row["stale_status"], row["issues_status"]) == ("ok", "ok", "ok")
    assert (row["stale_days"], row["stale_hours"]) == (0.25, 6.0)
    assert row["last_commit_raw"] == "2026-08-10T00:00:00Z" and row["updated_at_raw"] == "2026-08-11T07:00:00Z"
    assert (row["language"], row["language_category"], row["has_language"]) == ("python", "python", True)
    assert (row["popularity_rank"], row["is_popular"], row["popularity_source"]) == (2, True, "GitHub Octoverse 2025")
    assert (row["issues_total"], row["issues_closed"], row["closed_ratio"]) == (20, 15, 0.75)
    assert (row["merged_prs"], row["merged_prs_api"], row["merged_prs_status"]) == (42, 42, "ok")
    assert (row["releases"], row["releases_api"], row["releases_status"]) == (7, 7, "ok")


def test_node_without_fields_is_missing_not_zero(node_frame):
    (row,) = rows_of(M.profile(node_frame('{"nameWithOwner":"a/b"}'), REF))
    assert (row["age_status"], row["stale_status"], row["issues_status"]) == ("sem_data_criacao", "sem_push", "dados_ausentes")
    assert row["merged_prs"] is None and row["releases"] is None and row["issues_total"] is None
    assert (row["merged_prs_status"], row["releases_status"]) == ("dados_ausentes", "dados_ausentes")
    assert (row["language"], row["language_category"], row["has_language"]) == (None, V.NO_LANGUAGE, False)
    assert (row["is_popular"], row["popularity_rank"]) == (False, None)


def test_dates_that_are_wrong_or_in_the_future(node_frame):
    texts = [
        '{"nameWithOwner":"bad","createdAt":"soon","pushedAt":""}',
        '{"nameWithOwner":"future","createdAt":"2026-08-12T12:00:00Z","pushedAt":"2026-08-12T12:00:00Z"}',
        '{"nameWithOwner":"null","createdAt":null,"pushedAt":null}',
        '{"nameWithOwner":"number","createdAt":20200101,"pushedAt":1}',
    ]
    got = {r["repo_key"]: r for r in rows_of(M.profile(node_frame(*texts), REF, ["age", "staleness"]))}
    assert (got["bad"]["age_status"], got["bad"]["stale_status"]) == ("data_invalida", "data_invalida")
    assert got["future"]["age_days"] == -1.0 and got["future"]["age_status"] == "ok"
    assert (got["future"]["stale_days"], got["future"]["stale_hours"]) == (0.0, 0.0)
    assert got["future"]["stale_status"] == "data_futura"
    assert (got["null"]["age_status"], got["null"]["stale_status"]) == ("sem_data_criacao", "sem_push")
    assert got["number"]["age_status"] == "data_invalida"


@pytest.mark.parametrize(
    "total, closed, expected",
    [
        (20, 15, (20, 15, 0.75, "ok")),
        (0, 0, (0, 0, None, "sem_issues")),
        (3, 0, (3, 0, 0.0, "ok")),
        (3, 1, (3, 1, 0.3333, "ok")),
        (None, 1, (None, None, None, "dados_ausentes")),
        (5, None, (None, None, None, "dados_ausentes")),
    ],
)
def test_closed_ratio(spark, total, closed, expected):
    df = spark.createDataFrame([(total, closed)], "issues_total long, issues_closed long")
    row = M.with_closed_ratio(df).select("issues_total", "issues_closed", "closed_ratio", "issues_status").first()
    assert tuple(row) == expected


def test_one_issue_field_missing(node_frame):
    (row,) = rows_of(M.profile(node_frame('{"issues":{"totalCount":4}}'), REF, ["issues"]))
    assert (row["issues_total"], row["issues_status"]) == (None, "dados_ausentes")


def test_blank_language_is_none_but_names_are_not_trimmed(node_frame):
    texts = [f'{{"primaryLanguage":{v}}}' for v in ('{"name":"  "}', '{"name":" Go "}', '{"name":3}', "null", '{"name":"c#"}')]
    got = rows_of(M.profile(node_frame(*texts), REF, ["language"]), "pos")
    assert [(r["language"], r["popularity_rank"]) for r in got] == [
        (None, None), (" Go ", 10), (None, None), (None, None), ("c#", 5),
    ]


def test_subset_gives_only_its_columns_and_full_schema_marks_the_rest(node_frame):
    only = M.profile(node_frame(FULL), REF, ["issues"])
    assert "age_days" not in only.columns and "merged_prs" not in only.columns
    (row,) = rows_of(M.profile(node_frame(FULL), REF, ["issues"], full_schema=True))
    assert row["closed_ratio"] == 0.75
    assert (row["merged_prs"], row["merged_prs_status"], row["age_status"]) == (None, "dados_ausentes", "sem_data_criacao")
    with pytest.raises(ValueError):
        M.profile(node_frame(FULL), REF, ["stars"])


def test_alternative_names_and_precedence(node_frame):
    texts = [
        '{"pullRequestsAceitos":{"totalCount":42},"releases":{"totalCount":7}}',
        '{"total_prs_aceitos":35,"pullRequestsAceitos":{"totalCount":42}}',
        '{"rq02_pull_requests_aceitos":12,"rq03_total_releases":3}',
        '{"total_prs_aceitos":"35","rq02_pull_requests_aceitos":12}',
        '{"nameWithOwner":"none"}',
    ]
    got = rows_of(M.profile(node_frame(*texts), REF, ["merged_prs", "releases"]), "pos")
    assert [(r["merged_prs"], r["releases"]) for r in got] == [(42, 7), (35, None), (12, 3), (12, None), (None, None)]


def test_stored_zero_is_not_trusted_beside_the_raw_node(node_frame):
    nodes = node_frame('{"nameWithOwner":"a"}', '{"releases":{"totalCount":4}}')
    records = nodes.select("pos", F.lit(0).cast("long").alias("merged_prs"), F.lit(0).cast("long").alias("releases"), "raw")
    got = rows_of(M.trusted_counts(records), "pos")
    assert [(r["merged_prs"], r["releases"]) for r in got] == [(None, None), (None, 4)]
    outside = records.withColumn(V.EXTERNAL_MERGED_PRS_KEY, F.lit(21).cast("long"))
    assert [r["merged_prs"] for r in rows_of(M.trusted_counts(outside), "pos")] == [21, 21]
    assert [r["merged_prs"] for r in rows_of(M.trusted_counts(records.drop("raw")), "pos")] == [0, 0]


def test_group_key_skips_empty_text(spark):
    df = spark.createDataFrame([("Go", "x"), ("", "C"), (None, ""), ("", None)], "a string, b string")
    got = [r[0] for r in df.select(M.group_key(F.col("a"), F.col("b"))).collect()]
    assert got == ["Go", "C", V.NO_LANGUAGE, V.NO_LANGUAGE]


def test_false_status_is_reclassified(node_frame):
    nodes = node_frame('{"nameWithOwner":"a"}', '{"issues":{"totalCount":0},"issuesFechadas":null}', '{"issues":null}')
    status = reclassified_status(M.issues_requested(F.col("raw")), F.lit("sem_issues"))
    assert [r[0] for r in nodes.orderBy("pos").select(status).collect()] == ["dados_ausentes", "sem_issues", "dados_ausentes"]


def test_whole_age_years_follow_whole_days(spark):
    df = spark.createDataFrame([("2018-05-09T12:03:18Z",), (None,)], "c string")
    ref = M.instant_literal(datetime(2026, 8, 11, 23, 15, 14, 613907, tzinfo=timezone.utc))
    got = M.with_whole_age(df, "c", ref).select("age_whole_days", "age_whole_years").collect()
    assert [tuple(r) for r in got] == [(3016, 8.26), (None, None)]
