"""Per-repository metrics: from a raw node to a flat record.

Each metric is one column group. ``profile`` reads the fields of the chosen
groups once and derives the groups in narrow steps, so the whole record is one
stage and groups that nobody reads are pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.functions.instants import elapsed_seconds, parse_instant, whole_days
from repopulse.functions.presence import count_of, fields_of, has_key, integer_of, object_key, string_at, text_at, text_of
from repopulse.functions.rounding import half_even
from repopulse.functions.text import has_text, lookup_key

Columns = dict[str, Column]


def instant_literal(moment: datetime) -> Column:
    """One reference instant for all rows; a naive one is taken as UTC."""
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    micros = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


# --- metrics over plain columns --------------------------------------------------
# A metric is derived in a few steps, each a dict of columns that refers to the
# step before, so that no long expression is repeated. Temporary columns start
# with an underscore. Steps of several metrics share one projection.

Steps = tuple[Columns, ...]


def apply_steps(df: DataFrame, *metrics: Steps) -> DataFrame:
    """Run the steps of several metrics side by side; temporary columns stay."""
    for level in range(max(len(steps) for steps in metrics)):
        columns: Columns = {}
        for steps in metrics:
            if level < len(steps):
                columns.update(steps[level])
        df = df.withColumns(columns)
    return df


def _derived(df: DataFrame, steps: Steps, *added: str) -> DataFrame:
    """Run one metric and keep the columns of ``df`` and those ``added``."""
    kept = [c for c in df.columns if c not in added]
    return apply_steps(df, steps).select(*kept, *added)


def age_steps(created_raw: str, reference_at: Column) -> Steps:
    return (
        {"_created": parse_instant(F.col(created_raw))},
        {"_age": elapsed_seconds(F.col("_created"), reference_at) / F.lit(V.SECONDS_PER_DAY)},
        {
            "age_days": half_even(F.col("_age"), 2),
            "age_years": half_even(F.col("_age") / F.lit(V.DAYS_PER_YEAR), 2),
            "age_status": F.when(F.col(created_raw).isNull(), F.lit(V.STATUS_NO_CREATION_DATE))
            .when(F.col("_created").isNull(), F.lit(V.STATUS_INVALID_DATE))
            .otherwise(F.lit(V.STATUS_OK)),
        },
    )


def with_age(df: DataFrame, created_raw: str, reference_at: Column) -> DataFrame:
    """Add ``age_days, age_years, age_status``. A future creation date stays negative."""
    return _derived(df, age_steps(created_raw, reference_at), "age_days", "age_years", "age_status")


def with_whole_age(df: DataFrame, created_raw: str, reference_at: Column) -> DataFrame:
    """Add the age in completed days and the years derived from the whole days."""
    steps = (
        {"_created": parse_instant(F.col(created_raw))},
        {"age_whole_days": whole_days(F.col("_created"), reference_at)},
        {"age_whole_years": half_even(F.col("age_whole_days").cast("double") / F.lit(V.DAYS_PER_YEAR), 2)},
    )
    return _derived(df, steps, "age_whole_days", "age_whole_years")


def staleness_steps(pushed_raw: str, reference_at: Column) -> Steps:
    return (
        {"_pushed": parse_instant(F.col(pushed_raw))},
        {"_idle": elapsed_seconds(F.col("_pushed"), reference_at)},
        {"_clamped": F.when(F.col("_idle") < 0, F.lit(0.0)).otherwise(F.col("_idle"))},
        {
            "stale_days": half_even(F.col("_clamped") / F.lit(V.SECONDS_PER_DAY), 2),
            "stale_hours": half_even(F.col("_clamped") / F.lit(V.SECONDS_PER_HOUR), 2),
            "stale_status": F.when(F.col(pushed_raw).isNull(), F.lit(V.STATUS_NO_PUSH))
            .when(F.col("_pushed").isNull(), F.lit(V.STATUS_INVALID_DATE))
            .when(F.col("_idle") < 0, F.lit(V.STATUS_FUTURE_DATE))
            .otherwise(F.lit(V.STATUS_OK)),
        },
    )


def with_staleness(df: DataFrame, pushed_raw: str, reference_at: Column) -> DataFrame:
    """Add ``stale_days, stale_hours, stale_status``; a later push counts as zero."""
    return _derived(df, staleness_steps(pushed_raw, reference_at), "stale_days", "stale_hours", "stale_status")


def closed_ratio_steps(total: str, closed: str) -> Steps:
    complete = F.col(total).isNotNull() & F.col(closed).isNotNull()
    return (
        {
            "_ratio": F.when(
                F.col(total) > 0, F.try_divide(F.col(closed).cast("double"), F.col(total).cast("double"))
            ),
            "issues_total": F.when(complete, F.col(total)),
            "issues_closed": F.when(complete, F.col(closed)),
        },
        {
            "closed_ratio": half_even(F.col("_ratio"), 4),
            "issues_status": F.when(F.col("issues_total").isNull(), F.lit(V.STATUS_MISSING))
            .when(F.col("issues_total") == 0, F.lit(V.STATUS_NO_ISSUES))
            .otherwise(F.lit(V.STATUS_OK)),
        },
    )


def with_closed_ratio(df: DataFrame, total: str = "issues_total", closed: str = "issues_closed") -> DataFrame:
    """Add ``closed_ratio`` (4 decimals) and ``issues_status``.

    No issues gives null, not zero. When one count is missing both are.
    """
    steps = closed_ratio_steps(total, closed)
    return _derived(df, steps, "issues_total", "issues_closed", "closed_ratio", "issues_status")


def language_steps(name: str) -> Steps:
    return (
        {"language": F.when(has_text(F.col(name)), F.col(name))},
        {
            "language_category": F.coalesce("language", F.lit(V.NO_LANGUAGE)),
            "has_language": F.col("language").isNotNull(),
        },
    )


def with_language(df: DataFrame, name: str) -> DataFrame:
    """Add the language as given (never trimmed; blank means none), a category
    that is never null, and a flag."""
    return _derived(df, language_steps(name), "language", "language_category", "has_language")


def count_status(count: Column) -> Column:
    """``ok`` for a counted metric, ``dados_ausentes`` for one never requested."""
    return F.when(count.isNull(), F.lit(V.STATUS_MISSING)).otherwise(F.lit(V.STATUS_OK))


def group_key(category: Column, language: Column) -> Column:
    """First of category and language that is not null or empty, else the placeholder."""
    return F.coalesce(F.nullif(category, F.lit("")), F.nullif(language, F.lit("")), F.lit(V.NO_LANGUAGE))


def first_present(*candidates: Column) -> Column:
    """First non-null among alternative names of one metric."""
    return F.coalesce(*candidates)


def with_provenance(has_raw: Column, external: Column, recounted: Column, own: Column, nested: Column) -> Column:
    """Trust order for a count.

    With the raw node at hand a stored value may be a false zero, so only an
    external value beats the recount from the node. Without it the stored value
    and then the nested count are used.
    """
    return F.when(has_raw, F.coalesce(external, recounted)).otherwise(F.coalesce(external, own, nested))


# --- popularity: a left join with a dimension ---------------------------------


def with_popularity(df: DataFrame, ranking: DataFrame, source: str, language: str = "language") -> DataFrame:
    """Add ``is_popular, popularity_rank, popularity_source``.

    ``ranking`` has ``lang_key, rank`` with unique keys. No broadcast is forced:
    a ranking read from a file or stated as literals is small by its statistics
    and is broadcast by the planner; a large one is joined by shuffle, where the
    skew handling may split a frequent language.
    """
    dimension = ranking.select(F.col("lang_key").alias("_lang_key"), F.col("rank").cast("int").alias("popularity_rank"))
    joined = df.join(dimension, lookup_key(F.col(language)) == F.col("_lang_key"), "left").drop("_lang_key")
    return joined.withColumns(
        {"is_popular": F.col("popularity_rank").isNotNull(), "popularity_source": F.lit(source)}
    )


# --- metrics of a raw node --------------------------------------------------------


#: A top-level field of a node by its name, as variant.
Field = Callable[[str], Column]


@dataclass(frozen=True)
class Metric:
    """One metric: what to read from the node, what to derive, what it means."""

    read: Callable[[Field], Columns]
    derive: Callable[[Column], Steps]
    columns: tuple[str, ...]
    question: str
    fields: tuple[str, ...]
    formula: str
    missing: str


def merged_prs_in(field: Field) -> Column:
    """Merged pull requests under any of their names in a node."""
    names = V.EXTERNAL_MERGED_PRS_KEY, V.DOCUMENT_KEYS["merged_prs"]
    return first_present(*[integer_of(field(n)) for n in names], count_of(field("pullRequestsAceitos")))


def releases_in(field: Field) -> Column:
    """Releases under any of their names in a node."""
    names = V.EXTERNAL_RELEASES_KEY, V.DOCUMENT_KEYS["releases"]
    return first_present(*[integer_of(field(n)) for n in names], count_of(field("releases")))


METRICS: dict[str, Metric] = {
    "age": Metric(
        lambda field: {"created_at_raw": text_of(field("createdAt"))},
        lambda reference: age_steps("created_at_raw", reference),
        ("created_at_raw", "age_days", "age_years", "age_status"),
        "Are popular systems mature?",
        ("createdAt",),
        "(reference - createdAt) / 86400 days; / 365.25 years; 2 decimals",
        "null: sem_data_criacao; unreadable: data_invalida; row kept, left out of statistics",
    ),
    "staleness": Metric(
        lambda field: {
            "pushed_at_raw": text_of(field("pushedAt")),
            "updated_at_raw": text_of(field("updatedAt")),
            "last_commit_raw": text_at(field("defaultBranchRef"), "target.committedDate"),
        },
        lambda reference: (*staleness_steps("pushed_at_raw", reference), {"reference_at": reference}),
        (
            "reference_at", "pushed_at_raw", "stale_days", "stale_hours", "stale_status",
            "updated_at_raw", "last_commit_raw",
        ),
        "Are popular systems updated often?",
        ("pushedAt", "updatedAt", "defaultBranchRef.target.committedDate"),
        "(reference - pushedAt) / 86400 days; / 3600 hours; 2 decimals",
        "null: sem_push; unreadable: data_invalida; later than reference: 0.0 and data_futura",
    ),
    "language": Metric(
        lambda field: {"_name": string_at(field("primaryLanguage"), "name")},
        lambda _: language_steps("_name"),
        ("language", "language_category", "has_language"),
        "Are popular systems written in popular languages?",
        ("primaryLanguage.name",),
        "name as given; rank by caseless trimmed lookup",
        "null or blank: placeholder category, row kept as a group of its own",
    ),
    "issues": Metric(
        lambda field: {"_issues": count_of(field("issues")), "_closed": count_of(field("issuesFechadas"))},
        lambda _: closed_ratio_steps("_issues", "_closed"),
        ("issues_total", "issues_closed", "closed_ratio", "issues_status"),
        "What share of issues is closed?",
        ("issues.totalCount", "issuesFechadas.totalCount"),
        "closed / total, 4 decimals",
        "total 0: null and sem_issues; not requested: null and dados_ausentes",
    ),
    "merged_prs": Metric(
        lambda field: {"merged_prs": merged_prs_in(field), "merged_prs_api": count_of(field("pullRequestsAceitos"))},
        lambda _: ({"merged_prs_status": count_status(F.col("merged_prs_api"))},),
        ("merged_prs", "merged_prs_api", "merged_prs_status"),
        "Do popular systems receive outside contributions?",
        ("pullRequestsAceitos.totalCount",),
        "number of merged pull requests",
        "not requested: null and dados_ausentes, never zero",
    ),
    "releases": Metric(
        lambda field: {"releases": releases_in(field), "releases_api": count_of(field("releases"))},
        lambda _: ({"releases_status": count_status(F.col("releases_api"))},),
        ("releases", "releases_api", "releases_status"),
        "Do popular systems release often?",
        ("releases.totalCount",),
        "number of releases",
        "not requested: null and dados_ausentes, never zero",
    ),
}


def derive_metrics(
    nodes: DataFrame,
    reference: Column,
    metrics: Sequence[str],
    absent: Sequence[str] = (),
    keep: Sequence[str] = (),
    identity: Callable[[Field], Columns] | None = None,
) -> DataFrame:
    """``keep``, the columns of ``identity`` and ``metrics`` read from ``raw``, and ``raw``.

    The node is walked once: its fields become a struct, and every column is read
    from that. Metrics in ``absent`` are computed as for a node without their fields.
    """
    asked: list[str] = []

    def field(name: str) -> Column:
        asked.append(name)
        return F.col("_node")[name]

    def nothing(name: str) -> Column:
        return F.lit(None).cast("variant")

    wanted = [name for name in METRICS if name in metrics or name in absent]
    named = identity(field) if identity else {}
    read: Columns = dict(named)
    for name in wanted:
        read.update(METRICS[name].read(field if name in metrics else nothing))
    df = nodes.select(*keep, "raw", *([fields_of(F.col("raw"), asked).alias("_node")] if asked else []))
    df = df.select(*keep, "raw", *[c.alias(n) for n, c in read.items()])
    df = apply_steps(df, *[METRICS[name].derive(reference) for name in wanted])
    return df.select(*keep, *named, *[c for name in wanted for c in METRICS[name].columns], "raw")


def _identity(field: Field) -> Columns:
    return {"repo_key": text_of(field("nameWithOwner")), "url": text_of(field("url")), "stars": integer_of(field("stargazerCount"))}


def profile(
    nodes: DataFrame,
    reference_at: datetime,
    metrics: Sequence[str] = tuple(METRICS),
    ranking: DataFrame | None = None,
    ranking_source: str = f"{V.RANKING_SOURCE} {V.RANKING_EDITION}",
    full_schema: bool = False,
) -> DataFrame:
    """Records from ``nodes`` (a variant column ``raw``); other columns are kept.

    ``metrics`` selects the column groups of a run. With ``full_schema`` the
    groups left out are present too, computed as for a node without the field:
    null with the status for missing data, never zero.
    """
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    absent = [name for name in METRICS if name not in metrics] if full_schema else []
    others = [c for c in nodes.columns if c not in ("raw", "repo_key", "url", "stars")]
    records = derive_metrics(nodes, instant_literal(reference_at), metrics, absent, keep=others, identity=_identity)
    if "language" in records.columns:
        records = with_popularity(records, default_ranking(nodes) if ranking is None else ranking, ranking_source)
    return records


def default_ranking(df: DataFrame) -> DataFrame:
    """The built-in ranking as a literal dimension: ``lang_key, rank``."""
    names = F.array(*[F.lit(name) for name in V.RANKED_LANGUAGES])
    return (
        df.sparkSession.range(1)
        .select(F.posexplode(names).alias("pos", "name"))
        .select(lookup_key(F.col("name")).alias("lang_key"), (F.col("pos") + 1).alias("rank"))
    )


def issues_requested(raw: Column) -> Column:
    """False when a raw node is at hand but lacks one of the issue fields."""
    return raw.isNull() | (has_key(raw, "issues") & has_key(raw, "issuesFechadas"))


#: What summaries need of the raw node, as columns of a stored table.
ISSUES_REQUESTED, TRUSTED = "issues_requested", {"merged_prs": "trusted_merged_prs", "releases": "trusted_releases"}


def with_summary_columns(records: DataFrame) -> DataFrame:
    """Add what summaries need of the raw node, so that they don't read it again."""
    have = set(records.columns)
    if "issues_status" in have and "raw" in have:
        records = records.withColumn(ISSUES_REQUESTED, issues_requested(F.col("raw")))
    if set(TRUSTED) <= have:
        records = records.withColumns(dict(zip(TRUSTED.values(), _trusted(records), strict=True)))
    return records


def issues_flag(records: DataFrame) -> Column | None:
    """Whether the issue fields were requested: a stored column, or read from the node; ``None`` without either."""
    if ISSUES_REQUESTED in records.columns:
        return F.col(ISSUES_REQUESTED)
    return issues_requested(F.col("raw")) if "raw" in records.columns else None


def trusted_counts(records: DataFrame) -> DataFrame:
    """Replace ``merged_prs`` and ``releases`` by the trusted ones.

    External counts, if any, are columns ``total_prs_aceitos``/``total_releases``.
    """
    if set(TRUSTED.values()) <= set(records.columns):
        return records.withColumns({name: F.col(stored) for name, stored in TRUSTED.items()})
    return records.withColumns(dict(zip(TRUSTED, _trusted(records), strict=True)))


def _trusted(records: DataFrame) -> list[Column]:
    def external(name: str) -> Column:
        return F.col(name).cast("long") if name in records.columns else F.lit(None).cast("long")

    raw = F.col("raw") if "raw" in records.columns else F.lit(None).cast("variant")
    none = F.lit(None).cast("long")
    sources = (("merged_prs", V.EXTERNAL_MERGED_PRS_KEY, "pullRequestsAceitos"), ("releases", V.EXTERNAL_RELEASES_KEY, "releases"))
    return [with_provenance(raw.isNotNull(), external(key), count_of(object_key(raw, field)), F.col(name), none) for name, key, field in sources]
