"""Collect and profile: landed nodes to records, summaries and provenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.functions.bands import Band
from repopulse.operators.correlation import correlate_pairs
from repopulse.operators.grouping import GROUPED_METRICS, banded_pairs, stats_by_group, with_report_rank
from repopulse.operators.metrics import (
    METRICS,
    group_key,
    instant_literal,
    issues_flag,
    profile,
    trusted_counts,
    with_summary_columns,
)
from repopulse.operators.summary import (
    category_histogram,
    metric_summary,
    popular_share,
    reclassified_status,
    status_counts,
)
from repopulse.sinks.tables import write_tables
from repopulse.sources.ranking import PROVENANCE, ranking_from_document, ranking_provenance

STATUSES = {
    "age": "age_status",
    "staleness": "stale_status",
    "issues": "issues_status",
    "merged_prs": "merged_prs_status",
    "releases": "releases_status",
}
#: x, y, bands of x or y, banded column, described column
CORRELATIONS: dict[str, tuple[str, str, tuple[Band, ...], str, str]] = {
    "age_closed_ratio": ("age_years", "closed_ratio", V.AGE_BANDS, "age_years", "closed_ratio"),
    "prs_releases": ("merged_prs", "releases", V.RELEASE_BANDS, "releases", "merged_prs"),
}


#: Summaries over several metrics: needed metrics, question, formula, what is left out.
SUMMARY_DEFINITIONS: dict[str, tuple[tuple[str, ...], str, str, str]] = {
    "group_summary": (
        ("language", "merged_prs", "releases", "staleness"),
        "Do systems in more popular languages receive more contributions, releases and updates?",
        "count, mean, median, minimum and maximum per language; largest group first",
        "nulls are left out of a metric; no language is a group of its own",
    ),
    "age_closed_ratio": (
        ("age", "issues"), "Do older systems close a larger share of issues?",
        "Pearson coefficient over complete pairs, 4 decimals; share by age band", "pairs with a null are dropped and counted",
    ),
    "prs_releases": (
        ("merged_prs", "releases"), "Do systems with more contributions release more often?",
        "Pearson coefficient over complete pairs, 4 decimals; contributions by release band", "pairs with a null are dropped and counted",
    ),
}


@dataclass(frozen=True)
class Collection:
    """Records and their summaries, all lazy. Missing parts are ``None``."""

    records: DataFrame
    metric_summary: DataFrame
    status_counts: DataFrame
    language_counts: DataFrame | None
    popular_share: DataFrame | None
    group_summary: DataFrame | None
    correlations: DataFrame | None
    band_summary: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        found = {
            "metric_summary": self.metric_summary,
            "status_counts": self.status_counts,
            "language_counts": self.language_counts,
            "popular_share": self.popular_share,
            "group_summary": self.group_summary,
            "correlations": self.correlations,
            "band_summary": self.band_summary,
        }
        return {name: table for name, table in found.items() if table is not None}


def summarise_records(records: DataFrame) -> Collection:
    """All summaries the columns of ``records`` allow. Nothing runs yet."""
    have = set(records.columns)
    statuses = {name: F.col(column) for name, column in STATUSES.items() if column in have}
    requested = issues_flag(records)
    if "issues_status" in have and requested is not None:
        statuses["issues"] = reclassified_status(requested, F.col("issues_status"))

    languages = share = groups = None
    if "language_category" in have:
        languages = category_histogram(records, "language_category")
        if "is_popular" in have:
            share = popular_share(records)
        if set(GROUPED_METRICS) <= have:
            language = F.col("language") if "language" in have else F.lit(None).cast("string")
            keyed = trusted_counts(records).withColumn("language_group", group_key(F.col("language_category"), language))
            groups = stats_by_group(keyed, "language_group", {m: m for m in GROUPED_METRICS}, scale=4)

    pairs = {name: spec for name, spec in CORRELATIONS.items() if set(spec[:2]) <= have}
    correlations = correlate_pairs(records, {name: spec[:2] for name, spec in pairs.items()}) if pairs else None
    banded = {name: (F.col(by), F.col(described), limits) for name, (_, _, limits, by, described) in pairs.items()}
    bands = banded_pairs(records, banded, scale=4) if pairs else None
    return Collection(
        records, metric_summary(records), status_counts(records, statuses), languages, share, groups,
        correlations, bands,
    )


def collect(
    nodes: DataFrame,
    reference_at: datetime,
    metrics: Sequence[str] = tuple(METRICS),
    ranking: DataFrame | None = None,
    ranking_source: str = f"{V.RANKING_SOURCE} {V.RANKING_EDITION}",
    output: str | None = None,
    criterion: str = "all landed nodes",
    requested: int | None = None,
    available: int | None = None,
    ranking_document: DataFrame | None = None,
) -> Collection:
    """Profile the nodes and summarise them.

    A ``ranking_document`` takes the place of ``ranking`` and ``ranking_source``, and all
    that it says of itself is stored with the run.

    With ``output`` the records are written first and every summary reads the
    written table: the nodes are parsed once, and what summaries need of a node is
    stored beside it, so none of them reads the nodes again; losing an executor never
    repeats the parsing. ``run_metadata`` is written with them: the ``criterion`` of
    the run, how many records were ``requested`` (default: all) and ``available``.
    Rows are counted as they are written. Group summaries are stored in the order of the report.
    """
    ranked = None
    if ranking_document is not None:
        # One row; its list of names is what a run's ranking consists of.
        ranked = ranking_provenance(ranking_document).first()
        ranking, ranking_source = ranking_from_document(ranking_document), f"{ranked['source']} {ranked['edition']}".strip()
    records = profile(nodes, reference_at, metrics, ranking, ranking_source)
    if output is None:
        return summarise_records(records)
    written = write_tables({"repositories": with_summary_columns(records)}, output)["repositories"]
    stored = summarise_records(nodes.sparkSession.read.parquet(f"{output.rstrip('/')}/repositories"))
    if stored.group_summary is not None:
        stored = replace(stored, group_summary=with_report_rank(stored.group_summary, "language_group"))
    about = run_metadata(stored.records, reference_at, criterion, requested, available, metrics, returned=written)
    about = about.withColumns({"ranking_source": F.lit(ranking_source), "ranking": ranking_struct(ranked)})
    write_tables(stored.tables() | {"run_metadata": about}, output)
    return stored


def ranking_struct(row: Row | None) -> Column:
    """The provenance of a ranking as a struct of literals; a null one for the built-in ranking."""
    fields = {f.name: f.dataType.simpleString() for f in PROVENANCE}
    if row is None:
        return F.lit(None).cast(PROVENANCE)
    names = {"names": F.array(*[F.lit(n) for n in row["names"]])}
    return F.struct(*[names.get(f, F.lit(row[f])).cast(kind).alias(f) for f, kind in fields.items()])


def run_metadata(
    records: DataFrame,
    reference_at: datetime,
    criterion: str,
    requested: int | None,
    total_available: int | None = None,
    metrics: Sequence[str] = tuple(METRICS),
    returned: int | None = None,
) -> DataFrame:
    """One row of provenance: when, what, how many, and what each metric means.

    Rows are counted here unless ``returned`` says how many were written."""
    meanings = [(name, m.question, m.fields, m.formula, m.missing) for name, m in METRICS.items() if name in metrics]
    for name, (needed, question, formula, missing) in SUMMARY_DEFINITIONS.items():
        if set(needed) <= set(metrics):
            meanings.append((name, question, tuple(f for n in needed for f in METRICS[n].fields), formula, missing))
    definitions = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(question).alias("question"),
                F.array(*[F.lit(f) for f in fields]).alias("fields"),
                F.lit(formula).alias("formula"),
                F.lit(missing).alias("missing"),
            )
            for name, question, fields, formula, missing in meanings
        ]
    )
    if returned is None:
        counted = records.agg(F.count(F.lit(1)).alias("returned"))
    else:
        counted = records.sparkSession.range(1).select(F.lit(returned).cast("long").alias("returned"))
    return counted.select(
        instant_literal(reference_at).alias("collected_at"),
        F.lit(criterion).alias("criterion"),
        F.lit(V.MAX_PAGE_ROWS).alias("page_limit"),
        F.lit(requested).cast("long").alias("requested"),
        "returned",
        F.lit(total_available).cast("long").alias("total_available"),
        (F.col("returned") >= (F.col("returned") if requested is None else F.lit(requested))).alias("complete"),
        definitions.alias("definitions"),
    )
