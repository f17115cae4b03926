"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


#: One row per repository, without the raw node.
RECORD = _struct(
    ("repo_key", _S), ("url", _S), ("stars", _L),
    ("created_at_raw", _S), ("age_days", _D), ("age_years", _D), ("age_status", _S),
    ("reference_at", T.TimestampType()),
    ("pushed_at_raw", _S), ("stale_days", _D), ("stale_hours", _D), ("stale_status", _S),
    ("updated_at_raw", _S), ("last_commit_raw", _S),
    ("language", _S), ("language_category", _S), ("has_language", _B),
    ("is_popular", _B), ("popularity_rank", _I), ("popularity_source", _S),
    ("issues_total", _L), ("issues_closed", _L), ("closed_ratio", _D), ("issues_status", _S),
    ("merged_prs", _L), ("releases", _L),
    ("merged_prs_api", _L), ("merged_prs_status", _S),
    ("releases_api", _L), ("releases_status", _S),
)

#: Metric tables kept as CSV, one per metric.
AGE_TABLE = _struct(
    ("rank", _I), ("repository", _S), ("stars", _L),
    ("created_at", _S), ("collected_at", _S), ("idade_dias", _L), ("idade_anos", _D),
)
MERGED_PRS_TABLE = _struct(("rank", _I), ("repository", _S), ("stars", _L), ("total_prs_aceitos", _L))
RELEASES_TABLE = _struct(("rank", _I), ("repository", _S), ("stars", _L), ("total_releases", _L))

#: Ranking document.
RANKING_DOCUMENT = T.StructType(
    [T.StructField(n, _S) for n in (
        "fonte", "edicao", "titulo", "url", "publicado_em", "acessado_em", "metrica", "justificativa", "observacao",
    )]
    + [T.StructField("linguagens", T.ArrayType(_S))]
)
