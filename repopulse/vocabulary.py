"""Literals that have to be exactly these for results to match.

Statuses, labels, band limits, field names and the language ranking are data,
not logic; everything else in the package is written around them.
"""

from __future__ import annotations

# --- fixed values: statuses -------------------------------------------------
STATUS_OK = "ok"
STATUS_NO_CREATION_DATE = "sem_data_criacao"
STATUS_NO_PUSH = "sem_push"
STATUS_INVALID_DATE = "data_invalida"
STATUS_FUTURE_DATE = "data_futura"
STATUS_NO_ISSUES = "sem_issues"
STATUS_MISSING = "dados_ausentes"
STATUS_UNKNOWN = "desconhecido"

# --- fixed values: labels ---------------------------------------------------
NO_LANGUAGE = "Sem linguagem definida"
NOT_AVAILABLE = "N/A"
UNNAMED = "Desconhecido"

# --- fixed values: units ----------------------------------------------------
SECONDS_PER_DAY = 86400.0
SECONDS_PER_HOUR = 3600.0
DAYS_PER_YEAR = 365.25

# --- fixed values: limits ---------------------------------------------------
MAX_RESULTS = 1000
MAX_PAGE_ROWS = 100

# --- fixed values: bands (lower bound, upper bound, label), upper exclusive --
AGE_BANDS = (
    (0, 2, "Ate 2 anos"),
    (2, 5, "2 a 5 anos"),
    (5, 10, "5 a 10 anos"),
    (10, None, "Mais de 10 anos"),
)
RELEASE_BANDS = (
    (0, 1, "Sem releases"),
    (1, 11, "1 a 10 releases"),
    (11, 51, "11 a 50 releases"),
    (51, None, "Mais de 50 releases"),
)

# --- fixed values: reading of a correlation coefficient ----------------------
STRENGTH_UNDEFINED = "indeterminada (pares insuficientes ou sem variancia)"
STRENGTH_ZERO = "nula"
STRENGTHS = (
    (0.2, "muito fraca"),
    (0.4, "fraca"),
    (0.6, "moderada"),
    (0.8, "forte"),
    (None, "muito forte"),
)
SIGN_POSITIVE = "positiva"
SIGN_NEGATIVE = "negativa"

# --- fixed values: popularity ranking of languages, rank = position ----------
RANKING_SOURCE = "GitHub Octoverse"
RANKING_EDITION = "2025"
RANKED_LANGUAGES = (
    "TypeScript",
    "Python",
    "JavaScript",
    "Java",
    "C#",
    "PHP",
    "Shell",
    "C++",
    "HCL",
    "Go",
)

# --- fixed values: key of each record column in a result document ------------
DOCUMENT_KEYS = {
    "repo_key": "nome_completo",
    "url": "url",
    "stars": "estrelas",
    "created_at_raw": "rq01_data_criacao",
    "age_days": "rq01_idade_dias",
    "age_years": "rq01_idade_anos",
    "age_status": "rq01_status",
    "pushed_at_raw": "rq04_data_ultima_atualizacao",
    "stale_days": "rq04_dias_desde_ultima_atualizacao",
    "stale_hours": "rq04_horas_desde_ultima_atualizacao",
    "stale_status": "rq04_status",
    "updated_at_raw": "rq04_comparativo_updated_at",
    "last_commit_raw": "rq04_comparativo_ultimo_commit_branch_padrao",
    "language": "rq05_linguagem_primaria",
    "language_category": "rq05_categoria_linguagem",
    "has_language": "rq05_possui_linguagem",
    "is_popular": "rq05_esta_entre_populares",
    "popularity_rank": "rq05_rank_popularidade",
    "popularity_source": "rq05_fonte_populares",
    "issues_total": "rq06_issues_total",
    "issues_closed": "rq06_issues_fechadas",
    "closed_ratio": "rq06_razao_fechadas_total",
    "issues_status": "rq06_status",
    "merged_prs": "rq02_pull_requests_aceitos",
    "releases": "rq03_total_releases",
    "merged_prs_api": "rq02_pull_requests_aceitos_graphql",
    "merged_prs_status": "rq02_status_graphql",
    "releases_api": "rq03_total_releases_graphql",
    "releases_status": "rq03_status_graphql",
    "age_years_api": "rq01_idade_anos_graphql",
    "in_a": "presente_na_busca_graphql",
    "in_b": "presente_na_busca_rest",
}
DOCUMENT_RECORDS = "repositorios"
DOCUMENT_METADATA = "metadados"
DOCUMENT_SUMMARY = "resumo"
RAW_KEY = "bruto"
EXTERNAL_MERGED_PRS_KEY = "total_prs_aceitos"
EXTERNAL_RELEASES_KEY = "total_releases"

# --- fixed values: headers of the consolidated table -------------------------
CONSOLIDATED_HEADERS = {
    "repo_key": "Repositorio",
    "age_years": "RQ01_Idade_Anos",
    "merged_prs": "RQ02_PRs_Aceitas",
    "releases": "RQ03_Total_Releases",
    "stale_days": "RQ04_Dias_Ultima_Atualizacao",
    "language": "RQ05_Linguagem_Primaria",
    "closed_ratio": "RQ06_Razao_Issues_Fechadas",
}
SNAPSHOT_PREFIX = "rq14_snapshot_semanal"
