"""The same questions as plain SQL for DuckDB, written against the tables only.

The SQL knows nothing of JSON nodes or of the package: it states what each case
has to give, from the relational columns. Doubles are rounded by formatting,
which rounds the exact binary value half to even; sums are taken over decimals.
"""

from __future__ import annotations

# --- rounding and statistics as SQL text -----------------------------------------


def _round(value: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"


def _mean(x: str, digits: int, scale: int = 4) -> str:
    total = f"CAST(sum(CAST({x} AS DECIMAL(38,{scale}))) AS DOUBLE)"
    return f"CASE WHEN count({x}) > 0 THEN {_round(f'{total} / count({x})', digits)} END"


def _median(x: str, digits: int) -> str:
    values = f"list_sort(list(CAST({x} AS DOUBLE)) FILTER (WHERE {x} IS NOT NULL))"
    low, high = f"{values}[(count({x}) + 1) // 2]", f"{values}[count({x}) // 2 + 1]"
    return f"CASE WHEN count({x}) > 0 THEN {_round(f'({low} + {high}) / 2', digits)} END"


def _stats(x: str, digits: int, scale: int = 4) -> str:
    return (
        f"{_mean(x, digits, scale)} AS mean, {_median(x, digits)} AS median, "
        f"CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max"
    )


def _summary(metric: str, digits: int, table: str) -> str:
    return (
        f"SELECT '{metric}' AS metric, count(*) AS total, count({metric}) AS with_value, "
        f"count(*) - count({metric}) AS without_value, {_stats(metric, digits)} FROM {table}"
    )


def _grouped(group: str, metric: str, table: str, digits: int = 4, scale: int = 4, name: str | None = None) -> str:
    return (
        f"SELECT {group}, count(*) AS n, '{name or metric}' AS metric, count({metric}) AS with_value, "
        f"{_stats(metric, digits, scale)} FROM {table} GROUP BY {group}"
    )


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _band(value: str, bands: tuple[tuple[float, float | None, str], ...]) -> str:
    whens = " ".join(
        f"WHEN {value} >= {low} AND {value} < {high} THEN {i}" for i, (low, high, _) in enumerate(bands[:-1], 1)
    )
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE {len(bands)} END"


def _corr(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (
        f"CASE WHEN count(*) FILTER ({both}) >= 2 AND min({x}) FILTER ({both}) < max({x}) FILTER ({both}) "
        f"AND min({y}) FILTER ({both}) < max({y}) FILTER ({both}) "
        f"THEN {_round(f'corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))', 4)} END"
    )


# The limits and labels of a coefficient's reading.
def _strength(r: str) -> str:
    return (
        f"CASE WHEN {r} IS NULL THEN 'indeterminada (pares insuficientes ou sem variancia)' "
        f"WHEN {r} = 0 THEN 'nula' ELSE "
        f"CASE WHEN abs({r}) < 0.2 THEN 'muito fraca' WHEN abs({r}) < 0.4 THEN 'fraca' "
        f"WHEN abs({r}) < 0.6 THEN 'moderada' WHEN abs({r}) < 0.8 THEN 'forte' ELSE 'muito forte' END "
        f"|| CASE WHEN {r} > 0 THEN ' positiva' ELSE ' negativa' END END"
    )


# --- fixed values: band limits and labels ------------------------------------------
_AGE = ((0, 2, "Ate 2 anos"), (2, 5, "2 a 5 anos"), (5, 10, "5 a 10 anos"), (10, None, "Mais de 10 anos"))
_RELEASES = (
    (0, 1, "Sem releases"), (1, 11, "1 a 10 releases"), (11, 51, "11 a 50 releases"), (51, None, "Mais de 50 releases"),
)
_NONE = "'Sem linguagem definida'"


def _label(number: str, bands: tuple[tuple[float, float | None, str], ...]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{b[2]}'" for i, b in enumerate(bands, 1)) + " END"


def _banded(by: str, value: str, bands: tuple[tuple[float, float | None, str], ...], table: str, pair: str = "") -> str:
    numbers = ", ".join(f"({i}, '{b[2]}')" for i, b in enumerate(bands, 1))
    prefix = f"'{pair}' AS pair, " if pair else ""
    return (
        f"SELECT {prefix}b.band_no, b.band, count(p.v) AS n, {_mean('p.v', 4)} AS mean, {_median('p.v', 4)} AS median "
        f"FROM (VALUES {numbers}) b(band_no, band) LEFT JOIN "
        f"(SELECT {_band(by, bands)} AS band_no, {value} AS v FROM {table} "
        f"WHERE {by} IS NOT NULL AND {value} IS NOT NULL) p ON p.band_no = b.band_no GROUP BY b.band_no, b.band"
    )


# --- the subject: one row per customer ---------------------------------------------

_REFERENCE_MICROS = "epoch_us(TIMESTAMP '2001-01-01 00:00:00')"


def _seconds(ts: str) -> str:
    return f"(({_REFERENCE_MICROS} - epoch_us({ts})) / 1e6)"


_ISO = "'%Y-%m-%dT%H:%M:%SZ'"

_SUBJECT = f"""
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned,
         count(*) FILTER (l_returnflag = 'N') AS n_new
  FROM lineitem GROUP BY l_orderkey),
per_customer AS (
  SELECT o_custkey, min(o_orderdate) FILTER (o_orderstatus = 'F') AS created,
         max(o_orderdate) FILTER (o_orderstatus = 'O') AS pushed, max(o_orderdate) AS updated,
         max(o_orderdate) FILTER (o_orderstatus = 'P') AS committed,
         count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent,
         count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS n_urgent_done,
         count(*) FILTER (o_orderstatus = 'O') AS n_open,
         CAST(coalesce(sum(n_returned), 0) AS BIGINT) AS n_returned
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY o_custkey),
facts AS (
  SELECT c_custkey AS pos, c_name AS repo_key, 'https://example.org/' || c_name AS url,
         CAST(floor(c_acctbal) AS BIGINT) AS stars, c_acctbal >= -800 AS has_node,
         c_mktsegment AS segment, n_nationkey AS nation, n_regionkey AS region,
         CASE WHEN c_acctbal >= 0 THEN created END AS created_ts,
         CASE WHEN c_acctbal < 0 THEN strftime(created, '%Y-%m') ELSE strftime(created, {_ISO}) END AS created_raw,
         CASE WHEN c_acctbal < 0 OR c_acctbal >= 500 THEN pushed END AS pushed_ts,
         CASE WHEN pushed IS NULL THEN NULL WHEN c_acctbal >= 0 AND c_acctbal < 500 THEN 'n/a'
              ELSE strftime(pushed, {_ISO}) END AS pushed_raw,
         strftime(updated, {_ISO}) AS updated_raw, strftime(committed, {_ISO}) AS commit_raw,
         coalesce(n_urgent, 0) AS n_urgent, coalesce(n_urgent_done, 0) AS n_urgent_done,
         coalesce(n_open, 0) AS n_open, coalesce(n_returned, 0) AS n_returned
  FROM customer LEFT JOIN per_customer ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
counted AS (
  SELECT *,
         CASE WHEN region = 0 THEN NULL WHEN nation = 7 THEN 0 ELSE n_urgent END AS issues_total,
         CASE WHEN region = 0 THEN NULL WHEN nation = 8 THEN 0 ELSE n_urgent_done END AS issues_closed,
         CASE WHEN region = 2 AND segment = 'BUILDING' THEN NULL ELSE n_open END AS merged_prs,
         CASE WHEN nation IN (11, 12, 13) THEN 0 ELSE n_returned END AS releases,
         CASE WHEN region = 4 OR nation = 3 THEN NULL ELSE segment END AS language
  FROM facts),
records AS (
  SELECT *,
         {_round(f"{_seconds('created_ts')} / 86400.0", 2)} AS age_days,
         {_round(f"({_seconds('created_ts')} / 86400.0) / 365.25", 2)} AS age_years,
         CASE WHEN created_raw IS NULL THEN 'sem_data_criacao' WHEN created_ts IS NULL THEN 'data_invalida'
              ELSE 'ok' END AS age_status,
         {_round(f"greatest({_seconds('pushed_ts')}, 0.0) / 86400.0", 2)} AS stale_days_raw,
         {_round(f"greatest({_seconds('pushed_ts')}, 0.0) / 3600.0", 2)} AS stale_hours_raw,
         CASE WHEN pushed_raw IS NULL THEN 'sem_push' WHEN pushed_ts IS NULL THEN 'data_invalida'
              WHEN {_seconds('pushed_ts')} < 0 THEN 'data_futura' ELSE 'ok' END AS stale_status,
         {_round('CASE WHEN issues_total > 0 THEN CAST(issues_closed AS DOUBLE) / issues_total END', 4)} AS closed_ratio,
         CASE WHEN issues_total IS NULL THEN 'dados_ausentes' WHEN issues_total = 0 THEN 'sem_issues'
              ELSE 'ok' END AS issues_status,
         coalesce(language, {_NONE}) AS language_category
  FROM counted),
subject AS (
  SELECT *, CASE WHEN pushed_ts IS NOT NULL THEN stale_days_raw END AS stale_days,
         CASE WHEN pushed_ts IS NOT NULL THEN stale_hours_raw END AS stale_hours
  FROM records),
nodes AS (SELECT * FROM subject WHERE has_node)
"""


def _with_subject(select: str, *more: str) -> str:
    return "WITH " + ", ".join([_SUBJECT.strip(), *more]) + " " + select


_DOCS = """
docs AS (
  SELECT doc_id, source,
         CASE WHEN lang = 'de' OR lang = 'es' THEN NULL ELSE source END AS language
  FROM documents)
"""
_RANKING = """
ranking AS (
  SELECT lower(source) AS lang_key, max(doc_id + 1) AS rank
  FROM documents WHERE source IS NOT NULL GROUP BY lower(source))
"""


def _with_docs(select: str) -> str:
    return f"WITH {_DOCS.strip()}, {_RANKING.strip()} {select}"


_COLLECTIONS = f"""
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned,
         count(*) FILTER (l_returnflag = 'N') AS n_new
  FROM lineitem GROUP BY l_orderkey),
rows_all AS (
  SELECT CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS repo_key, o_orderkey AS pos, o_orderstatus, o_orderdate AS ts, o_orderpriority AS priority,
         'https://example.org/order/' || CAST(o_orderkey AS VARCHAR) AS url,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(floor(o_totalprice) AS BIGINT) END AS stars,
         n_lines, n_returned, n_new
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
placed_a AS (
  SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY pos DESC) AS newest,
         min(pos) OVER (PARTITION BY repo_key) AS first_pos
  FROM rows_all WHERE o_orderstatus <> 'F'),
placed_b AS (
  SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY pos DESC) AS newest,
         min(pos) OVER (PARTITION BY repo_key) AS first_pos
  FROM rows_all WHERE o_orderstatus <> 'O'),
a AS (
  SELECT repo_key, first_pos AS pos_a, url, stars, priority AS language, priority AS language_category,
         n_lines AS issues_total, n_returned, n_new,
         {_round("greatest(" + _seconds('ts') + ", 0.0) / 86400.0", 2)} AS stale_days,
         CASE WHEN {_seconds('ts')} < 0 THEN 'data_futura' ELSE 'ok' END AS stale_status,
         {_round("CASE WHEN n_lines > 0 THEN CAST(n_returned AS DOUBLE) / n_lines END", 4)} AS closed_ratio,
         {_round("(" + _seconds('ts') + " / 86400.0) / 365.25", 2)} AS age_years_api
  FROM placed_a WHERE newest = 1),
b AS (
  SELECT repo_key, first_pos AS pos_b, stars, CAST(floor({_seconds('ts')} / 86400.0) AS BIGINT) AS age_whole_days,
         {_round("floor(" + _seconds('ts') + " / 86400.0) / 365.25", 2)} AS age_years,
         n_new AS merged_prs, n_returned AS releases
  FROM placed_b WHERE newest = 1),
merged AS (
  SELECT coalesce(a.repo_key, b.repo_key) AS repo_key, a.pos_a IS NOT NULL AS in_a, b.pos_b IS NOT NULL AS in_b,
         a.url, a.stale_days, a.stale_status, a.language, a.language_category, a.issues_total, a.closed_ratio,
         CASE WHEN a.pos_a IS NOT NULL THEN a.stars ELSE b.stars END AS stars,
         a.age_years_api, a.n_new AS merged_prs_api, a.n_returned AS releases_api,
         b.age_whole_days, b.age_years, b.merged_prs, b.releases, pos_a, pos_b
  FROM a FULL OUTER JOIN b ON a.repo_key IS NOT DISTINCT FROM b.repo_key)
"""


def _with_collections(select: str) -> str:
    return f"WITH {_COLLECTIONS.strip()} {select}"


_TEXT = """WITH text_table AS (
  SELECT l_orderkey || '/' || l_linenumber AS repo_key, CASE WHEN l_returnflag <> 'A' THEN l_partkey END AS merged_prs,
         CASE WHEN l_linenumber < 6 THEN l_suppkey END AS releases, l_quantity AS stale_days,
         CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS language,
         CASE WHEN l_returnflag <> 'R' AND l_linenumber <> 1 THEN l_discount * 15 END AS ratio
  FROM lineitem) """


def _rule(name: str, applies: str, fails: str, table: str) -> str:
    return (
        f"SELECT '{name}' AS rule, count(*) FILTER ({applies}) AS checked, "
        f"count(*) FILTER (({applies}) AND ({fails})) AS failed FROM {table}"
    )


def _status_counts(metric: str, column: str) -> str:
    return f"SELECT '{metric}' AS metric, {column} AS status, count(*) AS n FROM nodes GROUP BY {column}"


_PRS_STATUS = "CASE WHEN merged_prs IS NULL THEN 'dados_ausentes' ELSE 'ok' END"
_CHARGE = "l_extendedprice * (1 - l_discount)"


def oracle_sql() -> dict[str, str]:
    """SQL per query name; the columns carry the names the query gives them."""
    sql: dict[str, str] = {}

    # scalar metrics
    sql["age_fractional"] = _with_subject("SELECT repo_key, age_days, age_years FROM subject")
    sql["age_whole_days"] = _with_subject(
        f"SELECT repo_key, CAST(floor({_seconds('created_ts')} / 86400.0) AS BIGINT) AS age_whole_days, "
        f"{_round('floor(' + _seconds('created_ts') + ' / 86400.0) / 365.25', 2)} AS age_whole_years FROM subject"
    )
    sql["age_status"] = _with_subject("SELECT repo_key, created_raw AS created_at_raw, age_status FROM subject")
    sql["staleness"] = _with_subject("SELECT repo_key, stale_days, stale_hours FROM subject")
    sql["staleness_status"] = _with_subject(
        "SELECT repo_key, pushed_raw AS pushed_at_raw, stale_days, stale_status FROM subject"
    )
    sql["parse_instant"] = (
        "SELECT o_orderkey, o_orderpriority <> '5-LOW' AS readable, CASE o_orderpriority "
        "WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN epoch_us(o_orderdate) + 250000 - 7200000000 "
        "WHEN '4-NOT SPECIFIED' THEN epoch_us(date_trunc('day', o_orderdate)) ELSE epoch_us(o_orderdate) END "
        "AS instant_micros FROM orders"
    )
    sql["closed_ratio"] = _with_subject(
        "SELECT repo_key, issues_total, issues_closed, closed_ratio, issues_status FROM subject"
    )
    sql["presence_count"] = _with_subject(
        f"SELECT pos, merged_prs AS merged_prs_api, {_PRS_STATUS} AS merged_prs_status, releases AS releases_api, "
        "'ok' AS releases_status, issues_total AS issues FROM nodes"
    )
    sql["presence_events"] = (
        "SELECT event_type, count(*) AS n, count(*) FILTER (json_exists(props, '$.k')) AS with_k, "
        "count(*) FILTER (json_exists(props, '$.z')) AS with_z, "
        "CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY event_type"
    )
    sql["json_explode"] = _with_subject(
        "SELECT pos // 100 AS page, pos % 100 AS pos, repo_key, stars FROM nodes"
    )
    sql["json_path"] = _with_subject(
        "SELECT repo_key, commit_raw AS last_commit_raw, updated_raw AS updated_at_raw FROM nodes"
    )
    sql["first_present"] = (
        "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END, "
        "CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END, "
        "CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS chosen FROM orders"
    )
    sql["provenance_override"] = _with_subject(
        "SELECT pos, CASE WHEN nation = 14 THEN pos WHEN segment = 'FURNITURE' THEN 0 ELSE merged_prs END AS merged_prs, "
        "CASE WHEN segment = 'FURNITURE' THEN 0 ELSE releases END AS releases FROM nodes"
    )

    # language
    sql["language_category"] = _with_docs(
        f"SELECT doc_id, language, coalesce(language, {_NONE}) AS language_category, language IS NOT NULL AS has_language, "
        f"coalesce(language, {_NONE}) AS group_key FROM docs"
    )
    sql["rank_dimension"] = _with_docs("SELECT lang_key, rank FROM ranking")
    popular = "docs LEFT JOIN ranking ON lower(language) = lang_key"
    sql["popularity_rank"] = _with_docs(
        "SELECT doc_id, language, rank IS NOT NULL AS is_popular, rank AS popularity_rank, "
        f"'documents 1' AS popularity_source FROM {popular}"
    )
    histogram = f"SELECT coalesce(language, {_NONE}) AS category, count(*) AS n FROM docs GROUP BY 1"
    sql["language_histogram"] = _with_docs(histogram)
    sql["top_languages"] = _with_docs(f"SELECT * FROM ({histogram}) ORDER BY n DESC, lower(category), category LIMIT 10")
    sql["popular_share"] = _with_docs(
        "SELECT count(*) AS total, count(language) AS with_language, count(*) - count(language) AS without_language, "
        "count(DISTINCT language) AS distinct_languages, count(rank) AS popular, "
        f"{_round('100.0 * count(rank) / count(*)', 2)} AS popular_percent FROM {popular}"
    )

    # summaries
    sql["summary_age"] = _with_subject(_union([_summary(m, 2, "subject") for m in ("age_days", "age_years")]))
    sql["summary_staleness"] = _with_subject(_summary("stale_days", 2, "subject"))
    sql["summary_ratio"] = _with_subject(_summary("closed_ratio", 4, "subject"))
    sql["summary_counts"] = _with_subject(_union([_summary(m, 4, "subject") for m in ("merged_prs", "releases")]))
    api = "api AS (SELECT *, merged_prs AS merged_prs_api, releases AS releases_api FROM nodes)"
    sql["metric_summary"] = _with_subject(
        _union(
            [_summary(m, 2, "api") for m in ("age_days", "age_years", "stale_days")]
            + [_summary(m, 4, "api") for m in ("closed_ratio", "merged_prs", "releases", "merged_prs_api", "releases_api")]
        ),
        api,
    )
    sql["status_histogram"] = _with_subject(
        _union(
            [
                _status_counts("age", "age_status"),
                _status_counts("staleness", "stale_status"),
                _status_counts("issues", "issues_status"),
                _status_counts("merged_prs", _PRS_STATUS),
                _status_counts("releases", "'ok'"),
            ]
        )
    )
    sql["status_reclassified"] = _with_subject(
        "SELECT CASE WHEN region = 0 THEN 'dados_ausentes' WHEN segment = 'HOUSEHOLD' THEN 'desconhecido' "
        "ELSE 'sem_issues' END AS status, count(*) AS n FROM nodes GROUP BY 1"
    )
    sql["stats_by_language"] = _with_subject(
        _union([_grouped("language_category", m, "subject") for m in ("merged_prs", "releases", "stale_days")])
    )
    sql["stats_by_returnflag"] = _union(
        [
            _grouped("l_returnflag", column, "lineitem", scale=2, name=name)
            for name, column in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"))
        ]
    )
    narrow = (("shipped", "CAST(epoch_us(l_shipdate) AS DOUBLE)"), ("discount", "(l_discount / 1e4)"))
    sql["stats_narrow"] = _union(
        [
            f"SELECT l_returnflag, count(*) AS n, '{name}' AS metric, count({x}) AS with_value, "
            f"{f'round(avg({x}), 9)' if name == 'discount' else 'CAST(NULL AS DOUBLE)'} AS mean, {_median(x, 9)} AS median, "
            f"min({x}) AS min, max({x}) AS max FROM lineitem GROUP BY l_returnflag"
            for name, x in narrow
        ]
    )
    sql["stats_by_part"] = _union(
        [
            _grouped("l_partkey", column, "lineitem", scale=2, name=name)
            for name, column in (("quantity", "l_quantity"), ("price", "l_extendedprice"))
        ]
    )
    sql["metric_subset"] = _with_subject(
        "SELECT repo_key, issues_total, closed_ratio, issues_status, CAST(NULL AS DOUBLE) AS age_days, "
        "'sem_data_criacao' AS age_status, CAST(NULL AS DOUBLE) AS stale_days, 'sem_push' AS stale_status, "
        f"{_NONE} AS language_category, CAST(NULL AS BIGINT) AS merged_prs, 'dados_ausentes' AS merged_prs_status, "
        "CAST(NULL AS BIGINT) AS releases, 'dados_ausentes' AS releases_status FROM nodes"
    )
    sql["profile"] = _with_subject(
        "SELECT pos, repo_key, url, stars, created_raw AS created_at_raw, age_days, age_years, age_status, "
        "pushed_raw AS pushed_at_raw, stale_days, stale_hours, stale_status, updated_raw AS updated_at_raw, "
        "commit_raw AS last_commit_raw, language, language_category, language IS NOT NULL AS has_language, "
        "issues_total, issues_closed, closed_ratio, issues_status, merged_prs, merged_prs AS merged_prs_api, "
        f"{_PRS_STATUS} AS merged_prs_status, releases, releases AS releases_api, 'ok' AS releases_status, "
        "rank IS NOT NULL AS is_popular, rank AS popularity_rank, 'segments 1' AS popularity_source "
        "FROM nodes LEFT JOIN ranked ON lower(language) = lang_key",
        "ranked AS (SELECT lower(c_mktsegment) AS lang_key, CAST(max(c_nationkey) + 1 AS BIGINT) AS rank "
        "FROM customer GROUP BY 1)",
    )

    # bands and correlation
    sql["band_age"] = _with_subject(
        f"SELECT repo_key, age_years, {_label('(' + _band('age_years', _AGE) + ')', _AGE)} AS band FROM subject"
    )
    sql["band_count"] = _with_subject(
        f"SELECT repo_key, releases, {_label('(' + _band('releases', _RELEASES) + ')', _RELEASES)} AS band FROM subject"
    )
    sql["banded_age_ratio"] = _with_subject(_banded("age_years", "closed_ratio", _AGE, "subject"))
    sql["banded_releases_prs"] = _with_subject(_banded("releases", "merged_prs", _RELEASES, "subject"))
    sql["collection_bands"] = _with_subject(
        _union(
            [
                _banded("age_years", "closed_ratio", _AGE, "subject", "age_closed_ratio"),
                _banded("releases", "merged_prs", _RELEASES, "subject", "prs_releases"),
            ]
        )
    )
    sql["pair_complete"] = _with_subject(
        "SELECT repo_key, CAST(merged_prs AS DOUBLE) AS x, CAST(releases AS DOUBLE) AS y FROM counted "
        "WHERE merged_prs IS NOT NULL AND releases IS NOT NULL"
    )
    used = "count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"

    def accounted(x: str, y: str) -> str:
        n = used.format(x=x, y=y)
        return f"count(*) AS total, {n} AS pairs_used, count(*) - {n} AS pairs_dropped"

    sql["pair_accounting"] = _with_subject(
        f"SELECT 'age_closed_ratio' AS pair, {accounted('age_years', 'closed_ratio')} FROM subject UNION ALL "
        f"SELECT 'prs_releases' AS pair, {accounted('merged_prs', 'releases')} FROM subject"
    )

    def correlated(x: str, y: str) -> str:
        return (
            f"SELECT *, {_strength('coefficient')} AS strength FROM "
            f"(SELECT {accounted(x, y)}, {_corr(x, y)} AS coefficient FROM subject)"
        )

    sql["corr_age_ratio"] = _with_subject(correlated("age_years", "closed_ratio"))
    sql["corr_prs_releases"] = _with_subject(correlated("merged_prs", "releases"))
    pairs = {
        "price_charge": ("l_extendedprice", f"({_CHARGE})"),
        "quantity_price": ("l_quantity", "l_extendedprice"),
        "quantity_tax": ("l_quantity", "l_tax"),
    }
    coefficients = [f"SELECT '{n}' AS pair, {_corr(x, y)} AS coefficient FROM lineitem" for n, (x, y) in pairs.items()]
    coefficients.append("SELECT 'quantity_constant' AS pair, CAST(NULL AS DOUBLE) AS coefficient")
    sql["corr_strength"] = f"SELECT *, {_strength('coefficient')} AS strength FROM ({_union(coefficients)})"

    # ordering
    sql["top_k"] = _with_subject("SELECT repo_key, stars FROM facts ORDER BY stars DESC, repo_key LIMIT 100")
    sql["metric_table_csv"] = (
        "SELECT CAST(o_orderkey AS INTEGER) AS rank, 'o, \"' || o_orderpriority || '\"/' || o_custkey AS repository, "
        "CAST(floor(o_totalprice) AS BIGINT) AS stars, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS total_releases FROM orders"
    )
    sql["top_k_ranked"] = (
        "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank "
        "FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000"
    )
    sql["document_split"] = (
        "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, 'o/' || o_orderkey AS repo_key, CAST(floor(o_totalprice) AS BIGINT) AS stars, "
        "o_orderpriority || chr(10) || '    {' AS language FROM orders"
    )
    sql["document_sections"] = (
        "SELECT 'metadata' AS part, 'quantidade_solicitada' AS name, '1000' AS value UNION ALL "
        "SELECT 'summary', 'com_issues', CAST(count(*) AS VARCHAR) FROM orders"
    )
    sql["rank_all"] = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"
    sql["report_order"] = (
        "SELECT language_category, metric, n, dense_rank() OVER (ORDER BY n DESC, lower(language_category), language_category) AS report_rank "
        f"FROM ({sql['stats_by_language']})"
    )
    complete = "merged_prs IS NOT NULL AND releases IS NOT NULL AND stale_days IS NOT NULL"
    sql["top_groups"] = _with_subject(
        f"SELECT language, count(*) FILTER ({complete}) AS n, "
        f"{_median(f'(CASE WHEN {complete} THEN merged_prs END)', 4)} AS median, "
        f"CAST(max(CASE WHEN {complete} THEN merged_prs END) AS DOUBLE) AS max, min(pos) AS first_seen "
        f"FROM subject WHERE language IS NOT NULL GROUP BY language HAVING count(*) FILTER ({complete}) > 0 "
        "ORDER BY n DESC, first_seen LIMIT 5"
    )
    sql["order_violations"] = (
        "SELECT count(*) AS checked, count(*) FILTER (o_totalprice > previous) AS failed FROM "
        "(SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS previous FROM orders)"
    )

    # reconciliation
    sql["dedup_last_wins"] = (
        "SELECT user_id, first_id AS event_id, event_type, value, props FROM (SELECT *, "
        "min(event_id) OVER (PARTITION BY user_id) AS first_id, "
        "row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS newest FROM events) WHERE newest = 1"
    )
    sql["reconcile_full_outer"] = _with_collections("SELECT repo_key, in_a, in_b, pos_a, pos_b FROM merged")
    sql["reconcile_precedence"] = _with_collections("SELECT * EXCLUDE (pos_a, pos_b) FROM merged")
    sql["match_counts"] = _with_collections(
        "SELECT count(*) FILTER (in_a) AS n_a, count(*) FILTER (in_b) AS n_b, "
        "count(*) FILTER (in_a AND in_b) AS n_both, count(*) AS n_union FROM merged"
    )
    sql["divergence_counts"] = _with_collections(
        "SELECT count(*) AS checked, count(*) FILTER (releases IS NULL) AS missing_in_b, "
        "count(*) FILTER (releases IS NOT NULL AND releases_api IS DISTINCT FROM releases) AS divergent FROM merged"
    )
    sql["reconcile_summary"] = _with_collections(
        _union(
            [
                f"SELECT '{m}' AS metric, count({m}) AS n, {_stats(m, 2, 2)} FROM merged"
                for m in ("age_years", "merged_prs", "releases")
            ]
        )
    )
    sql["key_union"] = _with_collections(
        "SELECT repo_key, CASE WHEN in_a THEN 1 ELSE 2 END AS source, coalesce(pos_a, pos_b) AS pos FROM merged"
    )
    sql["union_missing_columns"] = (
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS o_custkey, "
        "CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS o_totalprice FROM orders"
    )
    sql["flatten_drop"] = _with_subject(
        "SELECT pos, repo_key, url, stars, issues_total, issues_closed, closed_ratio, issues_status FROM nodes"
    )

    # snapshots and consolidation
    sql["weekly_snapshot_counts"] = (
        "SELECT isoyear(ts) AS iso_year, weekofyear(ts) AS iso_week, count(*) AS n, max(value) AS max_value "
        "FROM events GROUP BY 1, 2"
    )

    def merged(metric: str, value: str) -> str:
        mean = f"CASE WHEN count({value}) > 0 THEN {_round(f'avg({value})', 4)} END"
        return (
            f"SELECT event_type, '{metric}' AS metric, count(*) AS total, count({value}) AS with_value, count(*) - count({value}) AS without_value, "
            f"{mean} AS mean, min({value}) AS min, max({value}) AS max FROM events GROUP BY 1"
        )

    sql["merged_week_metrics"] = _union([merged("value", "value"), merged("high", "CASE WHEN value > 20 THEN value END")])
    late = "CASE WHEN event_id % 3 > 0 THEN event_id + 1e9 END"
    sql["merged_week_correlations"] = _union(
        [
            f"SELECT '{name}' AS pair, count(*) AS total, count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS pairs_used, "
            f"count(*) FILTER ({x} IS NULL OR {y} IS NULL) AS pairs_dropped, {_corr(x, y)} AS coefficient FROM events"
            for name, x, y in (("id_late", "event_id", late), ("value_user", "value", "user_id"))
        ]
    )
    sql["merged_week_distinct"] = _union(
        [f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, TRUE AS sketch_is_near FROM events" for c in ("user_id", "event_type")]
    )

    def consolidated(prs: str) -> str:
        return (
            f'SELECT repo_key AS "Repositorio", age_years AS "RQ01_Idade_Anos", {prs} AS "RQ02_PRs_Aceitas", '
            'releases AS "RQ03_Total_Releases", stale_days AS "RQ04_Dias_Ultima_Atualizacao", '
            'language_category AS "RQ05_Linguagem_Primaria", '
            "coalesce(CAST(closed_ratio AS VARCHAR), 'N/A') AS \"RQ06_Razao_Issues_Fechadas\" FROM subject"
        )

    sql["consolidated_table"] = _with_subject(consolidated("merged_prs"))
    sql["consolidated_document"] = _with_subject(consolidated("coalesce(merged_prs, 0)"))
    sql["document_records"] = _with_subject(
        "SELECT repo_key, stars, age_years, age_status, stale_days, stale_status, language, language_category, "
        "issues_total, closed_ratio, issues_status, merged_prs, releases FROM subject"
    )
    sql["sentinel_cast"] = _TEXT + "SELECT repo_key, ratio, merged_prs, releases, stale_days, language FROM text_table"
    valid = "(CASE WHEN ratio BETWEEN 0 AND 1 THEN ratio END)"
    sql["ratio_quality"] = (
        f"{_TEXT} SELECT count(*) AS total, count({valid}) AS valid, count(*) FILTER (ratio IS NULL) AS missing, "
        f"count(*) FILTER (ratio < 0 OR ratio > 1) AS inconsistent, min({valid}) AS min, max({valid}) AS max, "
        f"{_median(valid, 4)} AS median FROM text_table"
    )
    sql["inconsistent_ratios"] = _TEXT + "SELECT repo_key, ratio FROM text_table WHERE ratio < 0 OR ratio > 1"
    sql["run_counts"] = _with_subject(
        "SELECT CAST(1000 AS BIGINT) AS requested, count(*) FILTER (has_node) AS returned, "
        "count(*) FILTER (has_node) >= 1000 AS complete, CAST(1000 + min(pos // 100) AS BIGINT) AS total_available, "
        "count(DISTINCT pos // 100) AS pages FROM facts"
    )
    sql["run_provenance"] = (
        f"SELECT {_REFERENCE_MICROS} AS collected_micros, 'all orders' AS criterion, CAST(1000 AS BIGINT) AS requested, "
        "count(*) AS returned, count(*) >= 1000 AS complete, CAST(3 AS BIGINT) AS n_definitions FROM orders"
    )

    told = [
        ("age", "Are popular systems mature?", "createdAt", "(reference - createdAt) / 86400 days; / 365.25 years; 2 decimals",
         "null: sem_data_criacao; unreadable: data_invalida; row kept, left out of statistics"),
        ("issues", "What share of issues is closed?", "issues.totalCount, issuesFechadas.totalCount", "closed / total, 4 decimals",
         "total 0: null and sem_issues; not requested: null and dados_ausentes"),
        ("age_closed_ratio", "Do older systems close a larger share of issues?", "createdAt, issues.totalCount, issuesFechadas.totalCount",
         "Pearson coefficient over complete pairs, 4 decimals; share by age band", "pairs with a null are dropped and counted"),
    ]
    sql["run_definitions"] = _union(
        [
            f"SELECT count(*) AS returned, '{m}' AS metric, '{q}' AS question, '{f}' AS fields, '{x}' AS formula, '{n}' AS missing FROM orders"
            for m, q, f, x, n in told
        ]
    )
    sql["ranking_provenance"] = (
        "SELECT 'Documents' AS source, CAST(max(first) AS VARCHAR) AS edition, 'Sources by age' AS title, '' AS url, '2001-01-01' AS published_at, "
        "'2001-01-02' AS accessed_at, 'first document' AS metric, 'one list for all' AS reason, count(*) AS n_names, "
        "string_agg(source, ', ' ORDER BY first, source) AS names "
        "FROM (SELECT source, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY source)"
    )

    # data quality
    sql["dq_rows"] = (
        "SELECT 'row_count' AS rule, count(*) AS checked, CAST(CASE WHEN count(*) = 1000 THEN 0 ELSE 1 END AS BIGINT) "
        "AS failed FROM documents"
    )
    sql["dq_keys"] = (
        "WITH keyed AS (SELECT lang, CASE WHEN lang = 'de' THEN ' ' WHEN lang = 'es' THEN NULL ELSE source END AS k "
        "FROM documents) "
        "SELECT 'key_present' AS rule, count(*) AS checked, count(*) FILTER (k IS NULL) AS failed FROM keyed UNION ALL "
        "SELECT 'key_not_blank', count(*), count(*) FILTER (k = ' ') FROM keyed UNION ALL "
        "SELECT 'key_unique', count(*), count(*) - count(DISTINCT k) - max(CASE WHEN k IS NULL THEN 1 ELSE 0 END) FROM keyed"
    )
    sql["dq_ranges"] = _with_subject(
        _union(
            [_rule(f"{c}_non_negative", "TRUE", f"{c} IS NULL OR {c} < 0", "subject") for c in ("stars", "merged_prs", "releases")]
            + [_rule(f"{c}_negative", f"{c} IS NOT NULL", f"{c} < 0", "subject") for c in ("age_years", "stale_days")]
            + [
                _rule(
                    "closed_ratio_in_unit_interval", "closed_ratio IS NOT NULL",
                    "closed_ratio < 0 OR closed_ratio > 1", "subject",
                )
            ]
        )
    )
    sql["dq_negative_rows"] = _with_subject(
        _union(
            [
                f"SELECT repo_key, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM subject WHERE {c} < 0"
                for c in ("age_years", "stale_days", "stars")
            ]
        )
    )
    sql["dq_instants"] = _with_subject(
        _union(
            [
                _rule("created_raw_readable", "TRUE", "created_ts IS NULL", "facts"),
                _rule("updated_raw_readable", "TRUE", "updated_raw IS NULL", "facts"),
            ]
        )
    )
    stored_status = (
        "stored AS (SELECT CASE WHEN segment = 'MACHINERY' AND stale_days = 0 THEN NULL ELSE stale_days END AS days, "
        "CASE WHEN segment = 'MACHINERY' AND stale_days IS NULL THEN '?' ELSE stale_status END AS status FROM subject)"
    )
    dated = "status NOT IN ('sem_push', 'data_invalida')"
    sql["dq_status"] = _with_subject(
        _union(
            [
                _rule("status_known", "TRUE", "status NOT IN ('ok', 'sem_push', 'data_invalida', 'data_futura')", "stored"),
                _rule("no_value_without_date", f"NOT ({dated})", "days IS NOT NULL", "stored"),
                _rule("value_with_date", dated, "days IS NULL OR days < 0", "stored"),
                _rule("future_is_zero", "status = 'data_futura'", "days IS DISTINCT FROM 0", "stored"),
            ]
        ),
        stored_status,
    )
    stored_category = (
        "stored AS (SELECT language, CASE WHEN segment = 'BUILDING' THEN lower(language_category) "
        "ELSE language_category END AS category FROM subject)"
    )
    sql["dq_category"] = _with_subject(
        _union(
            [
                _rule("category_without_language", "language IS NULL", f"category <> {_NONE}", "stored"),
                _rule("language_not_blank", "language IS NOT NULL", "trim(language) = ''", "stored"),
                _rule("category_with_language", "language IS NOT NULL", "category <> language", "stored"),
            ]
        ),
        stored_category,
    )
    sql["dq_presence"] = _with_collections(
        _union([_rule("in_a", "TRUE", "NOT in_a", "merged"), _rule("in_b", "TRUE", "NOT in_b", "merged")])
    )
    fine = (
        "created_at_raw", "age_years", "age_status", "issues_total", "issues_closed", "issues_status", "merged_prs",
        "merged_prs_api", "merged_prs_status",
    )
    sql["dq_recompute"] = _with_subject(
        _union(
            [_rule(f"{c}_recomputed", "TRUE", "FALSE", "nodes") for c in fine]
            + [
                _rule("age_days_recomputed", "TRUE", "segment = 'HOUSEHOLD' AND age_days IS NOT NULL", "nodes"),
                _rule("closed_ratio_recomputed", "TRUE", "closed_ratio IS NULL", "nodes"),
            ]
        )
    )
    by_priority = "SELECT {status} AS status, count(*) AS n FROM orders GROUP BY 1"
    stored = by_priority.format(status="CASE WHEN o_orderpriority = '5-LOW' THEN 'desconhecido' ELSE o_orderpriority END")
    fresh = by_priority.format(status="o_orderpriority")
    sql["dq_summary_difference"] = (
        f"SELECT *, 'stored' AS only_in FROM (({stored}) EXCEPT ALL ({fresh})) UNION ALL "
        f"SELECT *, 'recomputed' AS only_in FROM (({fresh}) EXCEPT ALL ({stored}))"
    )
    n_pairs = used.format(x="age_years", y="closed_ratio")
    sql["dq_conservation"] = _with_subject(
        "SELECT 'groups_add_up' AS rule, count(*) AS checked, CAST(0 AS BIGINT) AS failed FROM subject UNION ALL "
        f"SELECT 'bands_add_up', {n_pairs}, 0 FROM subject UNION ALL SELECT 'pairs_add_up', count(*), 0 FROM subject"
    )
    sql["dq_parts_lost"] = (
        "SELECT 'flags_add_up' AS rule, count(*) AS checked, count(*) FILTER (l_returnflag IS NULL) AS failed FROM lineitem "
        "UNION ALL SELECT 'bands_lose_large', count(*), count(*) FILTER (l_quantity >= 40) FROM lineitem "
        "UNION ALL SELECT 'returned_bands_lose_large', count(*), count(*) FILTER (l_quantity >= 40) FROM lineitem "
        "WHERE l_returnflag = 'R'"
    )
    cell = "SELECT '{t}' AS table_name, {key} AS key, '{c}' AS column_name, '{kind}' AS difference, {old} AS stored, {new} AS fresh FROM {of}"
    group_key = "'[\"' || l_returnflag || '\",\"quantity\"]'"
    text = "CAST({} AS VARCHAR)".format
    gone = [
        cell.format(t="groups", key=group_key, c=c, kind="missing_in_stored", old="NULL", new=text(c), of="groups") + " WHERE l_returnflag = 'A'"
        for c in ("n", "with_value", "mean", "median", "min", "max")
    ]
    changed = [
        cell.format(t="groups", key=group_key, c="n", kind="value", old=text("n + 1"), new=text("n"), of="groups") + " WHERE l_returnflag = 'R'",
        cell.format(t="bands", key="'[\"3\"]'", c="median", kind="value", old="NULL", new=text("median"), of="bands")
        + " WHERE band_no = 3 AND median IS NOT NULL",
        cell.format(t="correlations", key="'[\"quantity_price\"]'", c="strength", kind="value", old="'?'", new=_strength("r"), of="pair"),
        cell.format(t="summary", key="'[\"quantity\"]'", c="max", kind="value", old=text("max + 0.5"), new=text("max"), of="whole"),
    ]
    sql["summary_cells"] = (
        f"WITH groups AS ({_grouped('l_returnflag', 'l_quantity', 'lineitem', scale=2)}), "
        f"bands AS ({_banded('l_quantity', 'l_extendedprice', _RELEASES, 'lineitem')}), "
        f"pair AS (SELECT {_corr('l_quantity', 'l_extendedprice')} AS r FROM lineitem), "
        f"whole AS ({_summary('l_quantity', 4, 'lineitem')}) " + _union(gone + changed)
    )
    return sql
