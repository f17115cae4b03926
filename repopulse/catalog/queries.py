"""Named queries: each operator on whole test tables. All return flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.catalog import subject as S
from repopulse.functions import instants
from repopulse.functions.bands import assign_band, band_label
from repopulse.functions.presence import count_of, fields_of, has_key, integer_at, text_at
from repopulse.functions.text import fold
from repopulse.operators import correlation, grouping, metrics, quality, ranking, reconcile, states, summary
from repopulse.plans.collect import CORRELATIONS, STATUSES, run_metadata, summarise_records
from repopulse.schemas import RELEASES_TABLE
from repopulse.sinks.tables import consolidated, metric_table, with_week
from repopulse.sources import documents as docs
from repopulse.sources import pages as page_source
from repopulse.sources import ranking as ranking_source
from repopulse.sources.tables import parse_metric_lines, quality_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _reference() -> Column:
    return metrics.instant_literal(S.REFERENCE_AT)


def _aged(df: DataFrame) -> DataFrame:
    return metrics.with_age(df, "created_raw", _reference())


def _stale(df: DataFrame) -> DataFrame:
    return metrics.with_staleness(df, "pushed_raw", _reference())


def _ratio(df: DataFrame) -> DataFrame:
    return metrics.with_closed_ratio(df)


def _language(df: DataFrame) -> DataFrame:
    return metrics.with_language(df, "language_raw")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full record without JSON: the same column groups over plain columns."""
    return _language(_ratio(_stale(_aged(S.typed(spark, sf_dir)))))


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank_dimension(
        S.table(spark, sf_dir, "customer").select(
            F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") + 1).alias("position")
        )
    )
    return metrics.profile(S.nodes(spark, sf_dir), S.REFERENCE_AT, ranking=ranked, ranking_source="segments 1")


# --- scalar metrics --------------------------------------------------------------


@query
def age_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aged(S.facts(spark, sf_dir)).select("repo_key", "age_days", "age_years")


@query
def age_whole_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = metrics.with_whole_age(S.facts(spark, sf_dir), "created_raw", _reference())
    return whole.select("repo_key", "age_whole_days", "age_whole_years")


@query
def age_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aged(S.facts(spark, sf_dir)).select("repo_key", F.col("created_raw").alias("created_at_raw"), "age_status")


@query
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(S.facts(spark, sf_dir)).select("repo_key", "stale_days", "stale_hours")


@query
def staleness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(S.facts(spark, sf_dir)).select(
        "repo_key", F.col("pushed_raw").alias("pushed_at_raw"), "stale_days", "stale_status"
    )


@query
def parse_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    plain = F.replace(F.col("o_orderdate").cast("string"), F.lit(" "), F.lit("T"))
    priority = F.col("o_orderpriority")
    written = (
        F.when(priority == "1-URGENT", F.concat(plain, F.lit("Z")))
        .when(priority == "2-HIGH", F.concat(plain, F.lit(".250+02:00")))
        .when(priority == "3-MEDIUM", F.concat(F.lit(" \t"), plain, F.lit("\n")))
        .when(priority == "4-NOT SPECIFIED", F.substring(plain, 1, 10))
        .otherwise(F.substring(plain, 1, 7))
    )
    parsed = instants.parse_instant(written)
    return orders.select(
        "o_orderkey", parsed.isNotNull().alias("readable"), F.unix_micros(parsed).alias("instant_micros")
    )


@query
def closed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratio(S.typed(spark, sf_dir)).select(
        "repo_key", "issues_total", "issues_closed", "closed_ratio", "issues_status"
    )


@query
def presence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("pullRequestsAceitos", "releases", "issues")
    walked = S.nodes(spark, sf_dir).select("pos", fields_of(F.col("raw"), names).alias("node"))
    counted = walked.select("pos", *[count_of(F.col("node")[n]).alias(n) for n in names])
    prs, releases = F.col("pullRequestsAceitos"), F.col("releases")
    return counted.select(
        "pos",
        prs.alias("merged_prs_api"),
        metrics.count_status(prs).alias("merged_prs_status"),
        releases.alias("releases_api"),
        metrics.count_status(releases).alias("releases_status"),
        "issues",
    )


@query
def presence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").select("event_type", F.parse_json("props").alias("raw"))
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_key(F.col("raw"), "k")).alias("with_k"),
        F.count_if(has_key(F.col("raw"), "z")).alias("with_z"),
        F.sum(integer_at(F.col("raw"), "k")).alias("sum_k"),
    )


@query
def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source.explode_nodes(S.pages(spark, sf_dir)).select(
        "page", "pos", text_at(F.col("raw"), "nameWithOwner").alias("repo_key"),
        integer_at(F.col("raw"), "stargazerCount").alias("stars"),
    )


@query
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return S.nodes(spark, sf_dir).select(
        text_at(raw, "nameWithOwner").alias("repo_key"),
        text_at(raw, "defaultBranchRef.target.committedDate").alias("last_commit_raw"),
        text_at(raw, "updatedAt").alias("updated_at_raw"),
    )


@query
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        metrics.first_present(
            F.when(status == "F", F.floor("o_totalprice").cast("long")),
            F.when(priority == "1-URGENT", F.col("o_custkey")),
            F.when(status == "O", F.col("o_orderkey")),
        ).alias("chosen"),
    )


@query
def provenance_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stored zeros are false where the node was kept, and all there is where not.
    records = S.nodes(spark, sf_dir).select(
        "pos",
        F.lit(0).cast("long").alias("merged_prs"),
        F.lit(0).cast("long").alias("releases"),
        F.when(F.col("nation") == 14, F.col("pos")).alias(V.EXTERNAL_MERGED_PRS_KEY),
        F.when(F.col("segment") != "FURNITURE", F.col("raw")).alias("raw"),
    )
    return metrics.trusted_counts(records).select("pos", "merged_prs", "releases")


@query
def language_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _language(S.documents(spark, sf_dir))
    key = metrics.group_key(
        F.when(F.col("has_language"), F.lit("")).otherwise(F.col("language_category")), F.col("language")
    )
    return named.select("doc_id", "language", "language_category", "has_language", key.alias("group_key"))


@query
def rank_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_dimension(S.ranking_names(spark, sf_dir))


def _popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranking.rank_dimension(S.ranking_names(spark, sf_dir))
    return metrics.with_popularity(_language(S.documents(spark, sf_dir)), ranked, "documents 1")


@query
def popularity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _popular(spark, sf_dir).select(
        "doc_id", "language", "is_popular", F.col("popularity_rank").cast("long").alias("popularity_rank"),
        "popularity_source",
    )


@query
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.category_histogram(_language(S.documents(spark, sf_dir)), "language_category")


@query
def top_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_categories(_language(S.documents(spark, sf_dir)), "language_category", 10)


@query
def popular_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.popular_share(_popular(spark, sf_dir))


# --- summaries -------------------------------------------------------------------


@query
def summary_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = _aged(S.facts(spark, sf_dir))
    return summary.summarise(aged, {"age_days": "age_days", "age_years": "age_years"}, digits=2, scale=2)


@query
def summary_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarise(_stale(S.facts(spark, sf_dir)), {"stale_days": "stale_days"}, digits=2, scale=2)


@query
def summary_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summarise(_ratio(S.typed(spark, sf_dir)), {"closed_ratio": "closed_ratio"}, digits=4, scale=4)


@query
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"merged_prs": "merged_prs", "releases": "releases"}
    return summary.summarise(S.typed(spark, sf_dir), counts, digits=4, scale=0)


@query
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All summaries of a collection in one pass, each with its own rounding."""
    return summary.metric_summary(_profiled(spark, sf_dir))


@query
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.status_counts(_profiled(spark, sf_dir), STATUSES)


@query
def status_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A stored status that is never right where the fields were not requested.
    requested = metrics.issues_requested(F.col("raw"))
    stored = F.when(F.col("segment") != "HOUSEHOLD", F.lit(V.STATUS_NO_ISSUES))
    return summary.status_histogram(S.nodes(spark, sf_dir), summary.reclassified_status(requested, stored))


@query
def stats_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: merged pull requests, releases and staleness by language."""
    return grouping.stats_by_group(
        _language(_stale(S.typed(spark, sf_dir))), "language_category", {m: m for m in grouping.GROUPED_METRICS},
        digits=4, scale=2,
    )


@query
def stats_by_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped statistics of a large table with three groups, each a third of it."""
    lines = S.table(spark, sf_dir, "lineitem")
    return grouping.stats_by_group(
        lines, "l_returnflag", {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"},
        digits=4, scale=2,
    )


@query
def stats_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in a narrow band (points in time) and far below one, with all their decimals."""
    lines = S.table(spark, sf_dir, "lineitem")
    shipped = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    stats = grouping.stats_by_group(lines, "l_returnflag", {"shipped": shipped, "discount": F.col("l_discount") / 1e4}, digits=9)
    # The sum of so many points in time is no exact double; the shares' mean has all its decimals.
    return stats.withColumn("mean", F.when(F.col("metric") == "discount", F.col("mean")))


@query
def stats_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with many groups, whose number is not known: values are shuffled."""
    lines = S.table(spark, sf_dir, "lineitem")
    return grouping.stats_by_group(lines, "l_partkey", {"quantity": "l_quantity", "price": "l_extendedprice"}, scale=2)


@query
def metric_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    only_issues = metrics.profile(S.nodes(spark, sf_dir), S.REFERENCE_AT, metrics=["issues"], full_schema=True)
    return only_issues.select(
        "repo_key", "issues_total", "closed_ratio", "issues_status", "age_days", "age_status", "stale_days",
        "stale_status", "language_category", "merged_prs", "merged_prs_status", "releases", "releases_status",
    )


@query
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _profiled(spark, sf_dir)
        .drop("raw", "reference_at", "segment", "nation")
        .withColumn("popularity_rank", F.col("popularity_rank").cast("long"))
    )


# --- bands and correlation --------------------------------------------------------


@query
def band_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = _aged(S.facts(spark, sf_dir)).withColumn("band_no", assign_band(F.col("age_years"), V.AGE_BANDS))
    return aged.select("repo_key", "age_years", band_label(F.col("band_no"), V.AGE_BANDS).alias("band"))


@query
def band_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = S.typed(spark, sf_dir).withColumn("band_no", assign_band(F.col("releases"), V.RELEASE_BANDS))
    return numbered.select("repo_key", "releases", band_label(F.col("band_no"), V.RELEASE_BANDS).alias("band"))


@query
def banded_age_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _ratio(_aged(S.typed(spark, sf_dir)))
    return grouping.banded_stats(records, F.col("age_years"), F.col("closed_ratio"), V.AGE_BANDS, scale=4)


@query
def banded_releases_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = S.typed(spark, sf_dir)
    return grouping.banded_stats(records, F.col("releases"), F.col("merged_prs"), V.RELEASE_BANDS, scale=0)


@query
def pair_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.complete_pairs(S.typed(spark, sf_dir), "merged_prs", "releases", keep=("repo_key",))


@query
def pair_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _ratio(_aged(S.typed(spark, sf_dir)))
    return correlation.correlate_pairs(records, {n: (c[0], c[1]) for n, c in CORRELATIONS.items()}).select(
        "pair", "total", "pairs_used", "pairs_dropped"
    )


@query
def corr_age_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.correlate(_ratio(_aged(S.typed(spark, sf_dir))), "age_years", "closed_ratio")


@query
def corr_prs_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.correlate(S.typed(spark, sf_dir), "merged_prs", "releases")


@query
def corr_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several pairs in one pass: strong, weak, undefined for want of variance."""
    lines = S.table(spark, sf_dir, "lineitem").withColumns(
        {"charge": F.col("l_extendedprice") * (1 - F.col("l_discount")), "constant": F.lit(0.1)}
    )
    pairs = {
        "price_charge": ("l_extendedprice", "charge"),
        "quantity_price": ("l_quantity", "l_extendedprice"),
        "quantity_tax": ("l_quantity", "l_tax"),
        "quantity_constant": ("l_quantity", "constant"),
    }
    return correlation.correlate_pairs(lines, pairs).select("pair", "coefficient", "strength")


# --- ordering --------------------------------------------------------------------


@query
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(S.facts(spark, sf_dir), 100).select("repo_key", "stars")


@query
def metric_table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a line of a metric table, and the lines read back as declared."""
    orders = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("int").alias("rank"),
        F.concat(F.lit('o, "'), "o_orderpriority", F.lit('"/'), F.col("o_custkey").cast("string")).alias("repo_key"),
        F.floor("o_totalprice").cast("long").alias("stars"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("releases"),
    )
    table = metric_table(orders, {"releases": "total_releases"})
    return parse_metric_lines(table.select(F.to_csv(F.struct("*")).alias("line")), "line", RELEASES_TABLE)


@query
def top_k_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    ranked = ranking.top_k_ranked(orders, 1000, by="o_totalprice", tie_break="o_orderkey")
    return ranked.withColumn("rank", F.col("rank").cast("long"))


@query
def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its place by price: no task sees more than its range."""
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.ranked_rows(orders, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group rows in the order of the report, as they are stored."""
    stats = stats_by_language(spark, sf_dir)
    return grouping.with_report_rank(stats, "language_category").select("language_category", "metric", "n", "report_rank")


@query
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _language(_stale(S.typed(spark, sf_dir)))
    return grouping.top_groups(
        records, "language", "merged_prs", ("merged_prs", "releases", "stale_days"), "pos", k=5, scale=0
    )


@query
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    return ranking.order_violations(orders, "o_orderkey", "o_totalprice")


# --- reconciliation --------------------------------------------------------------


def _collections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = S.sources(spark, sf_dir)
    counts = {"merged_prs": F.col("n_new"), "releases": F.col("n_returned")}
    a = a.withColumns({"issues_total": F.col("n_lines"), "issues_closed": F.col("n_returned")})
    a = metrics.with_staleness(metrics.with_age(a, "date_raw", _reference()), "date_raw", _reference())
    a = metrics.with_closed_ratio(metrics.with_language(a, "priority"))
    b = metrics.with_whole_age(b, "date_raw", _reference()).withColumnRenamed("age_whole_years", "age_years")
    return a.withColumns({f"{c}_api": value for c, value in counts.items()}), b.withColumns(counts)


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*_collections(spark, sf_dir))


@query
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props")
    return reconcile.dedup_last(events, "user_id", "event_id")


@query
def reconcile_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.in_first_seen_order(_reconciled(spark, sf_dir).select("repo_key", "in_a", "in_b", "pos_a", "pos_b"))


@query
def reconcile_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).drop("pos_a", "pos_b")


@query
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.match_counts(_reconciled(spark, sf_dir))


@query
def divergence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.divergence_counts(_reconciled(spark, sf_dir))


@query
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile_summary(_reconciled(spark, sf_dir))


@query
def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = S.sources(spark, sf_dir)
    return reconcile.key_union(a, b, "repo_key", "pos").withColumn("source", F.col("source").cast("long"))


@query
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    open_orders = orders.where(F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey")
    others = orders.where(F.col("o_orderstatus") != "O").select("o_orderkey", "o_totalprice")
    return reconcile.union_of_columns(open_orders, others)


@query
def flatten_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = metrics.profile(S.nodes(spark, sf_dir), S.REFERENCE_AT, metrics=["issues"])
    return reconcile.without_raw(issues).drop("segment", "nation")


# --- snapshots and consolidation ---------------------------------------------------


@query
def weekly_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read as UTC whatever the session zone is.
    stamped = S.table(spark, sf_dir, "events").select(
        "value", instants.parse_instant(S.iso_text(F.col("ts"))).alias("instant")
    )
    day = F.to_date(F.date_from_unix_date(F.floor(F.unix_micros("instant") / 86_400_000_000).cast("int")))
    weekly = with_week(stamped, day).groupBy("iso_year", "iso_week").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")
    )
    return weekly.select(
        F.col("iso_year").cast("long").alias("iso_year"), F.col("iso_week").cast("long").alias("iso_week"), "n", "max_value"
    )


def _events_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = S.table(spark, sf_dir, "events").withColumn("instant", instants.parse_instant(S.iso_text(F.col("ts"))))
    day = F.to_date(F.date_from_unix_date(F.floor(F.unix_micros("instant") / 86_400_000_000).cast("int")))
    return with_week(stamped, day)


@query
def merged_week_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all weeks by type of event, merged from one state a week."""
    weekly = _events_by_week(spark, sf_dir).withColumn("high", F.when(F.col("value") > 20, F.col("value")))
    stored = states.metric_states(weekly, ["iso_year", "iso_week", "event_type"], {"value": "value", "high": "high"})
    return states.merged_metrics(stored, ["event_type"])


@query
def merged_week_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations over all weeks, merged from one state a week."""
    weekly = _events_by_week(spark, sf_dir).withColumn("late", F.when(F.col("event_id") % 3 > 0, F.col("event_id") + 1e9))
    stored = states.pair_states(weekly, ["iso_year", "iso_week"], {"id_late": ("event_id", "late"), "value_user": ("value", "user_id")})
    return states.merged_correlations(stored)


@query
def merged_week_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and types over all weeks from stored sketches, held against exact counts."""
    weekly = _events_by_week(spark, sf_dir)
    merged = states.merged_distinct(states.distinct_states(weekly, ["iso_year", "iso_week"], ["user_id", "event_type"]))
    exact = weekly.agg(F.count_distinct("user_id").alias("user_id"), F.count_distinct("event_type").alias("event_type"))
    exact = exact.unpivot([], ["user_id", "event_type"], "column_name", "exact")
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= F.ceil(F.col("exact") * 0.08)
    return exact.join(merged, "column_name", "left").select("column_name", "exact", near.alias("sketch_is_near"))


@query
def consolidated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(_records(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of at most 100 records; null fields are left out."""
    keys = V.DOCUMENT_KEYS
    record = F.struct(
        *[
            F.col(c).alias(keys[c])
            for c in (
                "repo_key", "stars", "age_years", "age_status", "stale_days", "stale_status", "language",
                "language_category", "issues_total", "closed_ratio", "issues_status", "merged_prs", "releases",
            )
        ]
    )
    placed = _records(spark, sf_dir).select(
        F.floor(F.col("pos") / S.PAGE_ROWS).alias("page"), F.struct("pos", F.to_json(record).alias("text")).alias("entry")
    )
    joined = placed.groupBy("page").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["text"])).alias("records")
    )
    text = F.concat(F.lit('{"metadados":{},"repositorios":['), F.col("records"), F.lit("]}"))
    return joined.select("page", F.parse_json(text).alias("doc"))


@query
def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.records_from_document(docs.document_records(_documents(spark, sf_dir))).select(
        "repo_key", "stars", "age_years", "age_status", "stale_days", "stale_status", "language",
        "language_category", "issues_total", "closed_ratio", "issues_status", "merged_prs", "releases",
    )


@query
def consolidated_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent counts become 0 on the way from a document to the table."""
    return docs.consolidated_from_document(docs.document_records(_documents(spark, sf_dir)))


def _indented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indented document of all orders, as lines in blocks that cut records anywhere."""
    orders = S.table(spark, sf_dir, "orders")
    keys = V.DOCUMENT_KEYS
    records = orders.select(
        F.col("o_orderkey").alias("at"),
        F.array(
            F.lit("    {"),
            F.concat(F.lit(f'      "{keys["repo_key"]}": "o/'), F.col("o_orderkey").cast("string"), F.lit('",')),
            F.concat(F.lit(f'      "{keys["stars"]}": '), F.floor("o_totalprice").cast("string"), F.lit(",")),
            F.concat(F.lit(f'      "{keys["language"]}": "'), F.col("o_orderpriority"), F.lit('\\n    {"')),
            F.lit("    },"),
        ).alias("values"),
    )
    head = ["{", f'  "{V.DOCUMENT_METADATA}": {{', '    "quantidade_solicitada": 1000,', '    "ordens": [', "      {}", "    ]", "  },", f'  "{V.DOCUMENT_RECORDS}": [']
    first = orders.agg(F.lit(-1).cast("long").alias("at"), F.array(*[F.lit(x) for x in head]).alias("values"))
    counted = F.concat(F.lit('      "com_issues": '), F.count(F.lit(1)).cast("string"))
    tail = ["  ],", f'  "{V.DOCUMENT_SUMMARY}": {{', '    "rq06": {'], ["    }", "  }", "}"]
    last = orders.agg(F.max("o_orderkey").alias("at"), counted.alias("n")).select(
        (F.col("at") + 1).alias("at"), F.array(*[F.lit(x) for x in tail[0]], F.col("n"), *[F.lit(x) for x in tail[1]]).alias("values")
    )
    lines = first.unionByName(records).unionByName(last).select("at", F.posexplode("values").alias("i", "value"))
    place = F.col("at") * 16 + F.col("i")
    return lines.select(F.lit("orders.json").alias("file"), F.floor(place / 1000).alias("block"), place.alias("line"), "value")


@query
def document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of one large document that many tasks read."""
    records = docs.records_of_parts(docs.document_parts(_indented(spark, sf_dir))).drop("file")
    return docs.records_from_document(records).select(F.col("pos").cast("long").alias("pos"), "repo_key", "stars", "language")


@query
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and summary of the same document."""
    whole = docs.document_of_parts(docs.document_parts(_indented(spark, sf_dir)))
    told = docs.document_metadata(whole, "quantidade_solicitada").select(F.lit("metadata").alias("part"), F.lit("quantidade_solicitada").alias("name"), F.col("quantidade_solicitada").alias("value"))
    return told.unionByName(docs.document_summary(whole, "rq06").select(F.lit("summary").alias("part"), "name", "value"))


def _as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consolidated table as it is read back: text, with sentinels and junk.

    Each line item is a row; the return flag and the line number decide what the
    cells look like.
    """
    h, lines, flag = V.CONSOLIDATED_HEADERS, S.table(spark, sf_dir, "lineitem"), F.col("l_returnflag")
    return lines.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(h["repo_key"]),
        F.lit("1.0").alias(h["age_years"]),
        F.when(flag != "A", F.col("l_partkey").cast("string")).otherwise("").alias(h["merged_prs"]),
        F.when(F.col("l_linenumber") < 6, F.col("l_suppkey").cast("string")).otherwise("many").alias(h["releases"]),
        F.col("l_quantity").cast("string").alias(h["stale_days"]),
        F.when(flag == "R", F.lit(V.NO_LANGUAGE)).otherwise(F.col("l_linestatus")).alias(h["language"]),
        F.when(flag == "R", F.lit(V.NOT_AVAILABLE))
        .when(F.col("l_linenumber") == 1, F.lit("about half"))
        .otherwise((F.col("l_discount") * 15).cast("string"))
        .alias(h["closed_ratio"]),
    )


@query
def sentinel_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_columns(_as_text(spark, sf_dir)).select(
        "repo_key", "ratio", "merged_prs", "releases", "stale_days", "language"
    )


@query
def ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ratio_quality(quality_columns(_as_text(spark, sf_dir)), F.col("ratio"))


@query
def inconsistent_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.inconsistent_ratios(quality_columns(_as_text(spark, sf_dir)), "repo_key", F.col("ratio"))


@query
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested and returned rows with the total announced by the first page."""
    pages = S.pages(spark, sf_dir).select(F.lpad(F.col("page").cast("string"), 12, "0").alias("page"), "raw")
    announced = page_source.total_available(pages)
    returned = quality.requested_returned(page_source.explode_nodes(pages), V.MAX_RESULTS)
    both = returned.unionByName(announced, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("requested", "returned", "complete", "total_available", "pages")])


@query
def run_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    row = run_metadata(orders, S.REFERENCE_AT, "all orders", V.MAX_RESULTS, metrics=("age", "issues"))
    return row.select(
        F.unix_micros("collected_at").alias("collected_micros"), "criterion", "requested", "returned", "complete",
        F.size("definitions").cast("long").alias("n_definitions"),
    )


@query
def run_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored run says of each of its metrics, field by field."""
    row = run_metadata(S.table(spark, sf_dir, "orders"), S.REFERENCE_AT, "all orders", None, metrics=("age", "issues"))
    told = row.select("returned", F.inline("definitions"))
    return told.withColumn("fields", F.concat_ws(", ", "fields"))


@query
def ranking_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a ranking says of itself; the ranked names are the sources of documents."""
    named = S.table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"])
    document = named.where(F.col("source").isNotNull()).agg(
        F.lit("Documents").alias("fonte"), F.max("first").cast("string").alias("edicao"), F.lit("Sources by age").alias("titulo"),
        F.lit(None).cast("string").alias("url"), F.lit("2001-01-01").alias("publicado_em"), F.lit("2001-01-02").alias("acessado_em"),
        F.lit("first document").alias("metrica"), F.lit("one list for all").alias("justificativa"), listed.alias("linguagens"),
    )
    told = ranking_source.ranking_provenance(document)
    return told.withColumn("names", F.concat_ws(", ", "names"))


# --- data quality ----------------------------------------------------------------


@query
def dq_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_count(S.table(spark, sf_dir, "documents"), V.MAX_RESULTS)


@query
def dq_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_rules(S.documents(spark, sf_dir), "language_raw")


@query
def dq_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        **quality.non_negative("stars", "merged_prs", "releases"),
        **quality.negative_alerts("age_years", "stale_days"),
        **quality.in_unit_interval("closed_ratio"),
    }
    return quality.check(_records(spark, sf_dir), rules)


@query
def dq_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.negative_rows(_records(spark, sf_dir), "repo_key", ("age_years", "stale_days", "stars"))


@query
def dq_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {**quality.instant_readable("created_raw"), **quality.instant_readable("updated_raw")}
    return quality.check(S.facts(spark, sf_dir), rules)


@query
def dq_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stored values of one segment are broken on purpose so that rules fail.
    broken = F.col("segment") == "MACHINERY"
    stored = _stale(S.facts(spark, sf_dir)).withColumns(
        {
            "stale_days": F.when(broken & (F.col("stale_days") == 0.0), None).otherwise(F.col("stale_days")),
            "stale_status": F.when(broken & F.col("stale_days").isNull(), F.lit("?")).otherwise(F.col("stale_status")),
        }
    )
    return quality.check(stored, quality.staleness_status_rules())


@query
def dq_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _language(S.typed(spark, sf_dir)).withColumn(
        "language_category",
        F.when(F.col("segment") == "BUILDING", fold(F.col("language_category"))).otherwise(F.col("language_category")),
    )
    return quality.check(stored, quality.category_rules())


@query
def dq_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check(_reconciled(spark, sf_dir), quality.presence_rules())


@query
def dq_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = metrics.profile(S.nodes(spark, sf_dir), S.REFERENCE_AT, metrics=["age", "issues", "merged_prs"])
    stored = stored.withColumns(
        {
            "age_days": F.when(F.col("segment") == "HOUSEHOLD", F.col("age_days") + 1).otherwise(F.col("age_days")),
            "closed_ratio": F.coalesce("closed_ratio", F.lit(0.0)),
        }
    )
    return quality.recompute_rules(stored, S.REFERENCE_AT, ["age", "issues", "merged_prs"])


@query
def dq_summary_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored summary against the recomputed one: rows in one of them only."""
    orders = S.table(spark, sf_dir, "orders")
    stored = summary.status_histogram(orders, F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    fresh = summary.status_histogram(orders, "o_orderpriority")
    return quality.difference(stored, fresh)


@query
def dq_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).select("language_category", "age_years", "closed_ratio")
    used = F.col("age_years").isNotNull() & F.col("closed_ratio").isNotNull()
    return quality.conserved(
        records,
        {
            "groups_add_up": (F.lit(True), F.col("language_category")),
            "bands_add_up": (used, assign_band(F.col("age_years"), V.AGE_BANDS)),
            "pairs_add_up": (F.lit(True), used),
        },
    )


@query
def dq_parts_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three divisions of the order lines, two of which lose the large quantities."""
    lines = S.table(spark, sf_dir, "lineitem")
    few = F.when(F.col("l_quantity") < 40, F.floor(F.col("l_quantity") / 10))
    return quality.conserved(
        lines,
        {
            "flags_add_up": (F.lit(True), F.col("l_returnflag")),
            "bands_lose_large": (F.lit(True), few),
            "returned_bands_lose_large": (F.col("l_returnflag") == "R", few),
        },
    )


@query
def summary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored summaries of four kinds against recomputed ones, cell by cell. The stored ones are
    changed in known places: a group's row is gone, a median is null, a label and a maximum differ."""
    lines = S.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    groups = grouping.stats_by_group(lines, "l_returnflag", {"quantity": quantity}, scale=2)
    bands = grouping.banded_stats(lines, quantity, price, V.RELEASE_BANDS, scale=2)
    pairs = correlation.correlate_pairs(lines, {"quantity_price": ("l_quantity", "l_extendedprice")})
    whole = summary.summarise(lines, {"quantity": quantity}, scale=2)

    stored_groups = groups.where("l_returnflag <> 'A'").withColumn("n", F.col("n") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    stored_bands = bands.withColumn("median", F.when(F.col("band_no") != 3, F.col("median")))
    return quality.differing_cells(
        {
            "groups": (stored_groups, groups, ["l_returnflag", "metric"]),
            "bands": (stored_bands, bands, ["band_no"]),
            "correlations": (pairs.withColumn("strength", F.lit("?")), pairs, ["pair"]),
            "summary": (whole.withColumn("max", F.col("max") + 0.5), whole, ["metric"]),
        }
    )


@query
def collection_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band summary of the whole collection job, both correlations."""
    bands = summarise_records(_records(spark, sf_dir)).band_summary
    return bands.withColumn("band_no", F.col("band_no").cast("long"))
