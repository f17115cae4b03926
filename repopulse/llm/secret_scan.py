"""Secret scan with corpus-wide ownership of what it finds.

Candidates are found by pattern in every whole text. A candidate's value is then
looked up in the whole corpus: how many owners and repositories have it. A value
that many owners share is a widely copied example; one that belongs to an owner
looks live. Values that some text assigns to a secret are also found where they stand
without a keyword (kind ``reuse``). All of it is column expressions, joins and
aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repopulse.llm.storage import store


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The keywords and signs that make an assignment, and the kinds in their order.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(_either_case(w) for w in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: A value without a keyword; only those known from elsewhere are reported.
BARE = "[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "reuse")
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,secret:string>>"


def _spans(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """All matches, left to right and not overlapping, whose ``group`` has ``least``
    characters. A match starts where the texts before it, and the matches before
    it, end: splitting at the pattern gives the texts between."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(hits.alias("hit"), F.slice(between, 1, F.size(hits)).alias("gap"), values.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast(_SPAN).alias("found"))

    def step(done: Column, row: Column) -> Column:
        start = done["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        span = F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(row["value"], 256).alias("secret")
        )
        before = F.coalesce(done["found"], F.array().cast(_SPAN))
        found = F.when(F.length(row["value"]) >= least, F.concat(before, F.array(span))).otherwise(before)
        return F.struct(end.alias("at"), found.alias("found"))

    found = F.coalesce(F.aggregate(rows, empty, step)["found"], F.array().cast(_SPAN))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(
    docs: DataFrame, *, text_col: str = "text", owner: Column | None = None, repository: Column | None = None, widely: int = 3, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with what was found, one row per document.

    n_assign, n_access, n_hex: base spans by kind. base_sha256: hash of the base spans
    as ``kind:start:end`` by start, then kind, joined by commas. spans: all spans joined
    likewise. findings: every span with its value's owners, repositories and whether
    it is ``live``: fewer than ``widely`` owners have the value. Positions count code
    points and ends are exclusive.

    A null text is empty; a null owner or repository counts as one of its own; repeated
    rows are scanned one by one and belong to the same owner; columns of ``docs`` that
    are called like a made one are replaced; an empty table gives no rows.

    Owners of a value are counted after each task's own duplicates are gone, so a value
    in a third of all documents is a row per task; documents without a finding
    take no part in a shuffle.
    """
    made = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings")
    kept = [c for c in (keep or docs.columns) if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.struct(*kept).alias("row"), text.alias("text"), (none if owner is None else owner.cast("string")).alias("owner"),
        (none if repository is None else repository.cast("string")).alias("repository"),
    )
    base = F.array_sort(
        F.concat(_spans(F.col("text"), ASSIGN, "assign", 2, 6), _spans(F.col("text"), ACCESS, "access", 0, 20), _spans(F.col("text"), HEX, "hex", 0, 24))
    )
    rows = rows.select("row", "owner", "repository", base.alias("base"), _spans(F.col("text"), BARE, "reuse", 0, 16).alias("bare"))
    free = F.filter("bare", lambda b: ~F.exists("base", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    # Numbers are given once and stored: later steps join on them.
    rows = store(rows.select(F.monotonically_increasing_id().alias("no"), "row", "owner", "repository", "base", free.alias("bare")), "found")

    each = rows.select("no", "owner", "repository", F.explode(F.concat("base", "bare")).alias("span"))
    each = each.select("no", "owner", "repository", "span.*")
    homes = each.groupBy("secret", "owner", "repository").agg(F.count(F.when(F.col("kind") != "reuse", 1)).alias("assigned"))
    owners = homes.groupBy("secret", "owner").agg(F.count("*").alias("repositories"), F.sum("assigned").alias("assigned"))
    owned = owners.groupBy("secret").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("assigned").alias("assigned"))
    known = owned.where("assigned > 0").drop("assigned")
    judged = each.join(known, "secret").select("no", F.struct("start", "rank", "kind", "end", "owners", "repositories", (F.col("owners") < widely).alias("live")).alias("finding"))
    by_row = judged.groupBy("no").agg(F.array_sort(F.collect_list("finding")).alias("findings")).withColumnRenamed("no", "of")

    def result(part: DataFrame, findings: Column) -> DataFrame:
        count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
        return part.withColumn("findings", findings).select(
            "row.*", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
            F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"), "findings",
        )

    some = F.size("base") + F.size("bare") > 0
    kind = dict(by_row.dtypes)["findings"]
    empty = F.array().cast(kind)
    found = rows.where(some).join(by_row, F.col("no") == F.col("of"), "left")
    return result(rows.where(~some), empty).unionAll(result(found, F.coalesce("findings", empty)))


def redacted(text: Column, findings: Column, sign: str = "<secret>") -> Column:
    """``text`` with each live span of ``findings`` replaced; overlapping spans are replaced together."""
    live = F.filter(findings, lambda s: s["live"])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        before = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        new = span["start"] >= done["at"]
        return F.struct(F.when(new, F.concat(done["out"], before, F.lit(sign))).otherwise(done["out"]).alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    done = F.aggregate(live, start, step)
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(live) > 0, F.concat(done["out"], rest)).otherwise(text)
