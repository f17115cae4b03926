"""Sources, sinks, whole jobs and the landing stream."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.operators import metrics as M
from repopulse.operators import quality
from repopulse.plans import collect, consolidate, document_report, run_metadata, unify, validation_report
from repopulse.sinks import tables as sinks
from repopulse.sources import documents as docs
from repopulse.sources import pages as page_source
from repopulse.sources import ranking as ranking_source
from repopulse.sources import tables as csv_source
from repopulse.streaming import land_nodes

REF = datetime(2026, 8, 19, 12, tzinfo=timezone.utc)


def node(name, stars, **more):
    base = {
        "nameWithOwner": name, "url": f"https://example.org/{name}", "stargazerCount": stars,
        "createdAt": "2020-01-01T00:00:00Z", "pushedAt": "2026-08-18T12:00:00Z",
        "primaryLanguage": {"name": "Go"}, "issues": {"totalCount": 4}, "issuesFechadas": {"totalCount": 3},
        "pullRequestsAceitos": {"totalCount": 10}, "releases": {"totalCount": 2},
    }
    return {**base, **more}


def page(nodes, total=5, envelope=True):
    search = {"search": {"repositoryCount": total, "pageInfo": {"hasNextPage": False}, "nodes": nodes}}
    return {"data": search} if envelope else search


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "p1.json").write_text(json.dumps(page([node("a/1", 9), None, node("a/2", 8, issues=None)], 77)), "utf-8")
    (folder / "p2.json").write_text(json.dumps(page([{}, node("ação/3", 7, primaryLanguage=None)], 78, False)), "utf-8")
    (folder / "p3.json").write_text(json.dumps(page(None, 79)), "utf-8")
    return folder


def test_pages_to_nodes(spark, landed):
    pages = page_source.read_pages(spark, str(landed))
    nodes = page_source.explode_nodes(pages)
    got = nodes.orderBy("page", "pos").select("pos", F.try_variant_get("raw", "$.nameWithOwner", "string")).collect()
    assert [tuple(r) for r in got] == [(0, "a/1"), (2, "a/2"), (1, "ação/3")]
    assert tuple(page_source.total_available(pages).first()) == (77, 3)
    assert [r[0] for r in page_source.take_nodes(nodes, 2).select("pos").collect()] == [0, 2]
    for bad in (0, 1001, False):
        with pytest.raises(ValueError):
            page_source.take_nodes(nodes, bad, maximum=1000)


def test_pages_as_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(page([node(f"l/{i}", i)])) for i in range(3)), "utf-8")
    pages = page_source.read_pages(spark, str(tmp_path), one_per_line=True)
    nodes = page_source.explode_nodes(pages)
    name = F.try_variant_get("raw", "$.nameWithOwner", "string")
    assert [r[0] for r in nodes.orderBy("page", "pos").select(name).collect()] == ["l/0", "l/1", "l/2"]
    assert [r[0] for r in page_source.take_nodes(nodes, 2).select(name).collect()] == ["l/0", "l/1"]


def test_collect_writes_and_summarises(spark, landed, tmp_path):
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    result = collect(nodes, REF, output=str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out" / "repositories"))
    assert {r["repo_key"] for r in stored.collect()} == {"a/1", "a/2", "ação/3"}
    names = {"metric_summary", "status_counts", "language_counts", "popular_share", "group_summary", "correlations",
             "band_summary"}
    assert set(result.tables()) == names
    for name in names:
        assert spark.read.parquet(str(tmp_path / "out" / name)).count() > 0
    statuses = {(r["metric"], r["status"]): r["n"] for r in result.status_counts.collect()}
    assert statuses[("issues", "ok")] == 2 and statuses[("issues", "sem_issues")] == 1
    groups = {(r["language_group"], r["metric"]): r for r in result.group_summary.collect()}
    assert groups[("Go", "merged_prs")]["n"] == 2 and groups[(V.NO_LANGUAGE, "releases")]["median"] == 2.0
    checks = quality.recompute_rules(stored, REF)
    assert {r["failed"] for r in checks.collect()} == {0}


def test_records_as_json_lines_under_document_keys(spark, landed, tmp_path):
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    records = M.profile(nodes.select("raw"), REF)
    sinks.write_tables({"records": sinks.with_document_keys(records)}, str(tmp_path / "json"), "json")
    lines = [json.loads(t) for p in (tmp_path / "json" / "records").glob("*.json") for t in p.read_text("utf-8").splitlines()]
    by_name = {line["nome_completo"]: line for line in lines}
    assert set(by_name) == {"a/1", "a/2", "ação/3"}
    assert by_name["a/1"]["rq06_razao_fechadas_total"] == 0.75 and by_name["a/1"]["bruto"]["stargazerCount"] == 9
    assert by_name["a/2"]["rq06_status"] == "sem_issues" and by_name["a/2"]["bruto"]["issues"] is None


def test_single_metric_run(spark, landed):
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    result = collect(nodes, REF, metrics=["issues"])
    assert set(result.tables()) == {"metric_summary", "status_counts"}
    (row,) = rows_of(result.metric_summary)
    assert (row["metric"], row["total"], row["with_value"], row["mean"]) == ("closed_ratio", 3, 2, 0.75)
    pair = collect(nodes, REF, metrics=["age", "issues"])
    assert [r["pair"] for r in pair.correlations.collect()] == ["age_closed_ratio"]


def test_run_metadata(spark, landed):
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    row = run_metadata(nodes, REF, "stars", 1000, 77, ["age"]).first()
    assert (row["requested"], row["returned"], row["total_available"], row["complete"]) == (1000, 3, 77, False)
    assert [d["metric"] for d in row["definitions"]] == ["age"]


def test_unify(spark, landed):
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    a = M.profile(nodes.withColumn("pos", F.col("pos").cast("long")), REF)
    rows = [("a/1", 0, 90, 2422, 6.63, 11, 2), ("b/9", 1, 50, 10, 0.03, 1, None)]
    b = spark.createDataFrame(
        rows, "repo_key string, pos long, stars long, age_whole_days long, age_years double, merged_prs long, releases long"
    )
    for counts_from in ("a", "reconciled"):
        result = unify(a, b, counts_from)
        assert result.match_counts.first().asDict() == {"n_a": 3, "n_b": 2, "n_both": 1, "n_union": 4}
        assert result.divergences.first().asDict() == {"checked": 4, "missing_in_b": 3, "divergent": 0}
        assert {r["metric"] for r in result.collection.metric_summary.collect()} >= {"stale_days", "closed_ratio"}
    with pytest.raises(ValueError):
        unify(a, b, "b")


def test_snapshot_replaces_its_week_only(spark, tmp_path):
    path = str(tmp_path / "snap")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "repo_key string, stars long")
    two = spark.createDataFrame([("c", 3)], "repo_key string, stars long")
    sinks.write_snapshot(one, path, datetime(2026, 8, 12, tzinfo=timezone.utc))
    sinks.write_snapshot(one, path, REF)
    sinks.write_snapshot(two, path, datetime(2026, 8, 23, 23, tzinfo=timezone.utc))
    got = sorted((r["iso_week"], r["repo_key"]) for r in spark.read.parquet(path).collect())
    assert got == [(33, "a"), (33, "b"), (34, "c")]
    assert sinks.snapshot_name(REF) == "rq14_snapshot_semanal_2026-W34"
    assert sinks.snapshot_name(datetime(2027, 1, 1)) == "rq14_snapshot_semanal_2026-W53"


def test_csv_text(spark, tmp_path):
    df = spark.createDataFrame([("é,x", True, None), ("b", None, 2)], "k string, flag boolean, n long")
    path = str(tmp_path / "t")
    sinks.write_csv(df.withColumn("raw", F.parse_json(F.lit("{}"))), path)
    text = "".join(sorted(p.read_text("utf-8") for p in (tmp_path / "t").glob("part-*")))
    assert '"é,x",True,' in text and "b,,2" in text and "k,flag,n" in text and "raw" not in text
    with pytest.raises(ValueError):
        sinks.write_csv(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


DOCUMENT = {
    "metadados": {"coletado_em": "2026-08-19T12:00:00+00:00", "quantidade_solicitada": 4},
    "repositorios": [
        {"nome_completo": "a/1", "estrelas": 5, "rq01_idade_anos": 2.5, "rq02_pull_requests_aceitos": 7,
         "rq03_total_releases": None, "rq04_dias_desde_ultima_atualizacao": 0.5, "rq05_linguagem_primaria": "Go",
         "rq06_razao_fechadas_total": 0.0001, "bruto": {"nameWithOwner": "a/1"}},
        {"nome_completo": "a/2", "rq01_idade_anos": 3, "rq05_linguagem_primaria": None, "rq06_razao_fechadas_total": None},
        {"nome_completo": "a/3", "rq02_pull_requests_aceitos": 3, "rq03_total_releases": 4,
         "rq04_dias_desde_ultima_atualizacao": 1, "rq05_linguagem_primaria": "Go", "rq06_razao_fechadas_total": 1.0,
         "bruto": None},
        {"rq02_pull_requests_aceitos": 1},
    ],
    "resumo": {"rq06": {"com_issues": 2}},
}


@pytest.fixture
def document(tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(DOCUMENT, indent=2, ensure_ascii=False), "utf-8")
    return str(path)


def test_document_parts(spark, document):
    doc = docs.read_document(spark, document)
    assert docs.document_metadata(doc, "quantidade_solicitada").first()[0] == "4"
    assert [tuple(r) for r in docs.document_summary(doc, "rq06").collect()] == [("com_issues", "2")]
    records = docs.records_from_document(docs.document_records(doc)).orderBy("pos").collect()
    assert [r["repo_key"] for r in records] == ["a/1", "a/2", "a/3", None]
    assert [r["age_years"] for r in records] == [2.5, 3.0, None, None]
    assert [r["raw"] is None for r in records] == [False, True, True, True]


@pytest.mark.parametrize("block", [60, 400, 1 << 20])
def test_an_indented_document_is_split(spark, tmp_path, block):
    body = {**DOCUMENT, "repositorios": [{**r, "n": i, "x": ["    {", {"y": [{}]}]} for i in range(40) for r in DOCUMENT["repositorios"]], "lista": [{"a": 1}, {"b": "  \\n"}]}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text(json.dumps(body, indent=2, ensure_ascii=False), "utf-8")
    (tmp_path / "docs" / "b.json").write_text(json.dumps({**DOCUMENT, "repositorios": []}, indent=2), "utf-8")
    (tmp_path / "docs" / "c.json").write_text(json.dumps(DOCUMENT, indent=2).replace("\n", "\r\n"), "utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parts = docs.read_document_parts(spark, str(tmp_path / "docs"))
        split = sorted((r["pos"], str(r["record"])) for r in docs.records_of_parts(parts).collect())
        heads = docs.document_of_parts(parts)
        requested = [r[0] for r in docs.document_metadata(heads, "quantidade_solicitada").collect()]
        summary = [tuple(r) for r in docs.document_summary(heads, "rq06").collect()]
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    whole = docs.document_records(docs.read_document(spark, str(tmp_path / "docs")))
    assert split == sorted((r["pos"], str(r["record"])) for r in whole.collect())
    assert (requested, summary) == (["4"] * 3, [("com_issues", "2")] * 3)


def test_document_without_records(spark, tmp_path):
    (tmp_path / "d.json").write_text("{}", "utf-8")
    assert docs.document_records(docs.read_document(spark, str(tmp_path / "d.json"))).count() == 0


def test_consolidate_and_validate(spark, document, tmp_path):
    out = str(tmp_path / "csv")
    table = consolidate(spark, document, out)
    h = V.CONSOLIDATED_HEADERS
    assert table.columns == list(h.values())
    got = {r[h["repo_key"]]: tuple(r)[1:] for r in table.collect()}
    assert got["a/1"] == (2.5, 7, None, 0.5, "Go", "0.0001")
    assert got["a/2"] == (3.0, 0, 0, None, V.NO_LANGUAGE, "N/A")
    assert got["Desconhecido"] == (None, 1, 0, None, V.NO_LANGUAGE, "N/A")

    report = validation_report(csv_source.read_consolidated(spark, out), expected=4)
    assert report["row_count"].first()["failed"] == 0
    ratio = report["ratio"].first()
    assert (ratio["valid"], ratio["missing"], ratio["min"], ratio["max"]) == (2, 2, 0.0001, 1.0)
    assert tuple(report["languages"].first()) == (2, 1)
    direct = document_report(spark, document, expected=4)
    assert [tuple(r)[:4] for r in direct["top_languages"].collect()] == [tuple(r)[:4] for r in report["top_languages"].collect()]
    # a/1 has no release count, so only a/3 is complete.
    assert [tuple(r)[:4] for r in report["top_languages"].collect()] == [("Go", 1, 3.0, 3.0)]
    assert sinks.write_consolidated(table.limit(0), str(tmp_path / "none")) is False


def test_sentinels(spark):
    df = spark.createDataFrame([("0.5",), ("N/A",), ("",), (None,), ("half",), ("1e-1",)], "t string")
    got = [r[0] for r in df.select(csv_source.sentinel_number(F.col("t"))).collect()]
    assert got == [0.5, None, None, None, None, 0.1]


def test_metric_tables_round_trip(spark, tmp_path):
    rows = [(1, "a/1", 9, 153, 0), (2, "a/2", 8, 691, 4)]
    ranked = spark.createDataFrame(rows, "rank int, repo_key string, stars long, merged_prs long, releases long")
    sinks.write_metric_table(ranked, {"merged_prs": "total_prs_aceitos"}, str(tmp_path / "prs"))
    sinks.write_metric_table(ranked, {"releases": "total_releases"}, str(tmp_path / "rel"))
    prs = csv_source.read_merged_prs_table(spark, str(tmp_path / "prs"))
    releases = csv_source.read_releases_table(spark, str(tmp_path / "rel"))
    assert sorted(tuple(r) for r in prs.collect()) == [(1, "a/1", 9, 153), (2, "a/2", 8, 691)]
    assert sorted(tuple(r) for r in releases.collect()) == [(1, "a/1", 9, 0), (2, "a/2", 8, 4)]


def test_age_table_recomputes(spark, tmp_path):
    (tmp_path / "age.csv").write_text(
        "rank,repository,stars,created_at,collected_at,idade_dias,idade_anos\n"
        "1,o/one,538813,2018-05-09T12:03:18Z,2026-08-11T23:15:14.613907+00:00,3016,8.26\n"
        "2,o/two,494621,2014-07-11T13:42:37Z,2026-08-11T23:15:14.614291+00:00,4414,12.08\n", "utf-8",
    )
    table = csv_source.read_age_table(spark, str(tmp_path / "age.csv"))
    fresh = M.with_whole_age(
        table.withColumn("at", F.col("collected_at").cast("timestamp")), "created_at", F.col("at")
    )
    assert all(r["idade_dias"] == r["age_whole_days"] and r["idade_anos"] == r["age_whole_years"] for r in fresh.collect())


def test_ranking_document(spark, tmp_path):
    body = {"fonte": "Survey", "edicao": "2025", "linguagens": ["Go", "C#", " go "]}
    (tmp_path / "r.json").write_text(json.dumps(body), "utf-8")
    doc = ranking_source.read_ranking_document(spark, str(tmp_path / "r.json"))
    assert {r["lang_key"]: r["rank"] for r in ranking_source.ranking_from_document(doc).collect()} == {"go": 3, "c#": 2}
    assert doc.select(ranking_source.ranking_label()).first()[0] == "Survey 2025"
    (tmp_path / "e.json").write_text(json.dumps({"fonte": "Survey", "linguagens": []}), "utf-8")
    empty = ranking_source.read_ranking_document(spark, str(tmp_path / "e.json"))
    with pytest.raises(Exception, match="lists no language"):
        ranking_source.ranking_from_document(empty).collect()


def test_landing_stream_takes_each_page_once(spark, landed, tmp_path):
    nodes, checkpoint = str(tmp_path / "nodes"), str(tmp_path / "checkpoint")
    land_nodes(spark, str(landed), nodes, checkpoint).awaitTermination(120)
    assert spark.read.parquet(nodes).count() == 3
    (landed / "p4.json").write_text(json.dumps(page([node("new/1", 1)])), "utf-8")
    land_nodes(spark, str(landed), nodes, checkpoint).awaitTermination(120)
    stored = spark.read.parquet(nodes)
    assert stored.count() == 4
    assert M.profile(stored, REF, ["issues"]).where("closed_ratio = 0.75").count() == 3


def test_no_summary_of_a_stored_run_reads_a_node(spark, landed, tmp_path):
    out = str(tmp_path / "run")
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    plain, stored = collect(nodes, REF), collect(nodes, REF, output=out, criterion="stars", requested=5, available=77)
    for name, table in stored.tables().items():
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "raw#" not in plan, name
        table = table.drop("report_rank")
        assert sorted(map(str, table.collect())) == sorted(map(str, plain.tables()[name].collect())), name
    groups = sorted(spark.read.parquet(f"{out}/group_summary").collect(), key=lambda r: (r["report_rank"], r["metric"]))
    assert [(r["report_rank"], r["language_group"]) for r in groups[::3]] == [(1, "Go"), (2, V.NO_LANGUAGE)]
    about = spark.read.parquet(f"{out}/run_metadata").first()
    assert about.ranking is None
    assert {"group_summary", "age_closed_ratio", "prs_releases"} <= {d.metric for d in about.definitions}
    assert (about.criterion, about.requested, about.returned, about.total_available, about.complete) == ("stars", 5, 3, 77, False)


def test_a_stored_union_has_its_counts(spark, landed, tmp_path):
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    a = M.profile(nodes.withColumn("pos", F.col("pos").cast("long")), REF)
    rows = [("a/1", 0, 90, 2422, 6.63, 11, 2), ("b/9", 1, 50, 10, 0.03, 1, None)]
    b = spark.createDataFrame(
        rows, "repo_key string, pos long, stars long, age_whole_days long, age_years double, merged_prs long, releases long"
    )
    out = str(tmp_path / "union")
    merged = unify(a, b, counts_from="reconciled", output=out, criteria=("stars of a", "stars of b"))
    assert merged.match_counts.first().asDict() == {"n_a": 3, "n_b": 2, "n_both": 1, "n_union": 4}
    assert spark.read.parquet(f"{out}/reconciled").count() == 4
    about = spark.read.parquet(f"{out}/run_metadata").first()
    assert (about.criterion_a, about.counts_from, about.n_union) == ("stars of a", "reconciled", 4)


def jobs_of(spark, run):
    """How many jobs an action starts."""
    group = f"count-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id % 7 as g")
    assert sinks.write_tables({"a": df, "b": df.limit(0), "c": df.where("g = 3")}, str(tmp_path)) == {"a": 1000, "b": 0, "c": 143}
    # One scan and no shuffle: one job each, as without counting.
    assert jobs_of(spark, lambda: sinks.write_tables({"a": df}, str(tmp_path))) == 1
    assert jobs_of(spark, lambda: sinks.write_csv(df, str(tmp_path / "csv"))) == 1
    assert jobs_of(spark, lambda: sinks.write_consolidated(df, str(tmp_path / "all"))) == 1
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1000
    # Nothing to write leaves what is there.
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_csv(df.where("g > 9"), str(tmp_path / "csv"))
    assert sinks.write_consolidated(df.where("g > 9"), str(tmp_path / "all")) is False
    assert spark.read.csv(str(tmp_path / "all"), header=True).count() == spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1000
    sinks.write_csv(df.where("g = 1"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 143
    assert not [p for p in tmp_path.iterdir() if "incoming" in p.name]


def test_a_run_stores_what_its_ranking_says(spark, landed, tmp_path):
    body = {"fonte": "Survey", "edicao": "2025", "titulo": "T", "url": "https://example.org", "publicado_em": "2025-01-01",
            "acessado_em": "2026-01-01", "metrica": "m", "justificativa": "j", "linguagens": ["Go", "C#"]}
    (tmp_path / "r.json").write_text(json.dumps(body), "utf-8")
    document = ranking_source.read_ranking_document(spark, str(tmp_path / "r.json"))
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    out = str(tmp_path / "run")
    collect(nodes, REF, output=out, ranking_document=document)
    about = spark.read.parquet(f"{out}/run_metadata").first()
    assert (about.returned, about.complete, about.ranking_source) == (3, True, "Survey 2025")
    assert list(about.ranking.asDict().values()) == [*list(body.values())[:8], 2, ["Go", "C#"]]
    assert {r["popularity_rank"] for r in spark.read.parquet(f"{out}/repositories").collect()} == {1, None}


def test_a_union_reads_stored_records(spark, landed, tmp_path):
    nodes = page_source.explode_nodes(page_source.read_pages(spark, str(landed)))
    a = M.profile(nodes.withColumn("pos", F.col("pos").cast("long")), REF)
    b = spark.createDataFrame(
        [("a/1", 0, 90, 2422, 6.63, 11, 2)],
        "repo_key string, pos long, stars long, age_whole_days long, age_years double, merged_prs long, releases long",
    )
    lazy, stored = unify(a, b), unify(a, b, output=str(tmp_path / "u"))
    for name, table in stored.collection.tables().items():
        assert "raw#" not in table._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, table.collect())) == sorted(map(str, lazy.collection.tables()[name].collect())), name
