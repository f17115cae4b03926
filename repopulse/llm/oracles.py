"""The queries as DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from repopulse.llm.secret_scan import ACCESS, ASSIGN, BARE, HEX


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _hits(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = _literal(pattern)
    return f"""select no, '{kind}' as kind, {rank} as rank, {least} as least, regexp_extract_all(text, {p}, 0) as hits,
        regexp_extract_all(text, {p}, {group}) as vals, string_split_regex(text, {p}) as gaps from t"""


OP9 = f"""
with t as (
    select row_number() over () as no, doc_id, coalesce(text, '') as text, source, lang from documents
), h as (
    {_hits("assign", 0, ASSIGN, 2, 6)} union all {_hits("access", 1, ACCESS, 0, 20)}
    union all {_hits("hex", 2, HEX, 0, 24)} union all {_hits("reuse", 3, BARE, 0, 16)}
), i as (
    select *, unnest(generate_series(1, len(hits))) as i from h where len(hits) > 0
), s as (
    select no, kind, rank, sha256(vals[i]) as secret,
        cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as start,
        length(hits[i]) as size
    from i where length(vals[i]) >= least
), b as (
    select * from s where kind <> 'reuse'
), c as (
    select * from b union all
    select * from s where kind = 'reuse' and not exists (
        select 1 from b where b.no = s.no and b.start < s.start + s.size and s.start < b.start + b.size)
), known as (
    select secret, count(distinct coalesce(source, '-')) as owners from c join t using (no)
    group by secret having count(*) filter (kind <> 'reuse') > 0
), j as (
    select c.*, kind || ':' || start || ':' || (start + size) as span, owners from c join known using (secret)
), g as (
    select no,
        count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        coalesce(string_agg(span, ',' order by start, rank) filter (kind <> 'reuse'), '') as base, string_agg(span, ',' order by start, rank) as spans,
        count(*) filter (owners < 3) as n_live, count(*) filter (owners >= 3) as n_examples
    from j group by no
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_examples, 0) as n_examples
from t left join g using (no)
"""

OP7 = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as query_id, b.vec_id, cast(list_inner_product(list_transform(a.q, lambda x: cast(x as double)), list_transform(b.q, lambda x: cast(x as double))) as bigint) as score
    from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 100 = 0
), r as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""

OP12 = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w as (
    select *, length('### ') + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(': ')
        + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + length('</turn>') + 1 as chars from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(chars) as bigint) as formatted_chars
from w group by conv_id
"""

ORACLE_SQL = {"op12_chat_format": OP12, "op7_threshold_search": OP7, "op9_secrets": OP9}
