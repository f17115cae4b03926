"""Repair of the turn structure of conversations by a suffix-shared automaton.

A conversation becomes a signature, one sign for each row: the initial of its role and
whether it has to go, is cut off, or is sound. Signatures that end alike share those
ends: sorted from their last sign, each distinct end is one node of an automaton whose
edges lead to the rest. A node knows, for every state of the role grammar
``(s?(ua)+)?``, the cost of the cheapest way to the end and its first edit; the
rest of the audit is the audit of another node, so it is shared and never copied.

Edits that compete at a node and state begin with different letters, so the least
audit of equal costs is the one with the least first letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repopulse.llm.storage import checked, store

#: White space, and the ends of sentences.
_SPACE, _END = " \t\n\x0b\x0c\r", ".!?"

#: Costs of edits, and of leaving a row in that is cut off.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3

#: States of the grammar: nothing yet, after system, after user, after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = (_START, _SYSTEM, _USER, _ASSISTANT)
_ACCEPTING = frozenset((_START, _ASSISTANT))
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
#: The one role that an insertion or a new role can have in a state, and where it leads.
_WANTED = {_START: ("user", _USER), _SYSTEM: ("user", _USER), _USER: ("assistant", _ASSISTANT), _ASSISTANT: ("user", _USER)}

#: Signs: a row that has to go; sound rows by initial; rows cut off in upper case. Other roles are x.
_GO = "-"
_LEGAL = frozenset(("su", "ua", "au"))


@dataclass(frozen=True, slots=True)
class Node:
    """An end that signatures share. ``cost`` and ``edit`` are by grammar state;
    ``edit`` is None where nothing is left to do, ``state`` is where it leads."""

    cost: tuple[int, ...]
    edit: tuple[str | None, ...]
    state: tuple[int, ...]
    rest: Node | None


_FAR = 1 << 60


def _closed(cost: list[int], edit: list[str | None], state: list[int], rest: Node | None) -> Node:
    """A node once insertions are weighed too. They stay at the node, and a
    cheapest way inserts three rows in a row at most."""
    for _ in range(3):
        for q in _STATES:
            to = _WANTED[q][1]
            if (cost[to] + INSERT, "I") < (cost[q], edit[q] or ""):
                cost[q], edit[q], state[q] = cost[to] + INSERT, "I", to
    return Node(tuple(cost), tuple(edit), tuple(state), rest)


def end_node() -> Node:
    return _closed([0 if q in _ACCEPTING else _FAR for q in _STATES], [None] * 4, list(_STATES), None)


def before(sign: str, rest: Node) -> Node:
    """The node of ``sign`` followed by ``rest``."""
    cost, edit, state = [], [], []
    extra = CUT_OFF if sign.isupper() else 0
    for q in _STATES:
        ways = [(rest.cost[q] + DELETE, "D", q)]
        if sign != _GO:
            to = _NEXT.get((q, sign.lower()))
            if to is not None:
                ways.append((rest.cost[to] + KEEP + extra, "K", to))
            to = _WANTED[q][1]
            ways.append((rest.cost[to] + REROLE + extra, "R", to))
        best = min(ways)
        cost.append(best[0])
        edit.append(best[1])
        state.append(best[2])
    return _closed(cost, edit, state, rest)


class SuffixAutomaton:
    """Nodes of signatures given in the order of their reversed signs. Only the
    path of the latest one is held: ends shared with later ones lie on it."""

    def __init__(self) -> None:
        self._path, self._signs, self.made = [end_node()], "", 0

    def node(self, reversed_signature: str) -> Node:
        shared = _common(self._signs, reversed_signature)
        del self._path[shared + 1 :]
        for sign in reversed_signature[shared:]:
            self._path.append(before(sign, self._path[-1]))
            self.made += 1
        self._signs = reversed_signature
        return self._path[-1]


def _common(x: str, y: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def audit_of(node: Node) -> str:
    """Edits of the cheapest way from the start."""
    out, q = [], _START
    while (edit := node.edit[q]) is not None:
        out.append(edit)
        q = node.state[q]
        if edit != "I":
            node = node.rest
    return "".join(out)


def faults(conversations: DataFrame) -> DataFrame:
    """Rows with ``fault``: blank, duplicate, truncated or null; the first that holds."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    said = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(said == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.right(said, F.lit(1)).isin(*_END), "truncated")
    return conversations.withColumn("copy", F.row_number().over(same)).withColumn("fault", fault)


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """All rows of a conversation in one task, which reads them one after another."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text", "copy")


def _sign(role: str, fault: str | None) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return _GO if fault in ("blank", "duplicate") else initial.upper() if fault else initial


_FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; what is held of one is a sign for each row."""
    held = None

    def done() -> dict:
        turns = 0 if held["first"] is None else held["last"] - held["first"] + 1 - held["turns"]
        return {"conv_id": held["conv_id"], "gaps": turns, **held["faults"], "illegal": held["illegal"], "signature": "".join(reversed(held["signs"]))}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is None or held["conv_id"] != row["conv_id"]:
                if held is not None:
                    out.append(done())
                held = {"conv_id": row["conv_id"], "first": None, "last": None, "turns": 0, "illegal": 0, "initial": None, "signs": []}
                held["faults"] = {"blank": 0, "duplicate": 0, "truncated": 0}
            if row["turn"] is not None:
                held["turns"] += row["turn"] != held["last"]
                held["last"] = row["turn"]
                held["first"] = row["turn"] if held["first"] is None else held["first"]
            if row["fault"]:
                held["faults"][row["fault"]] += 1
            initial = row["role"][:1]
            held["illegal"] += held["initial"] is not None and held["initial"] + initial not in _LEGAL
            held["initial"] = initial
            held["signs"].append(_sign(row["role"], row["fault"]))
        yield _batch(out, _FACTS + ", signature string")
    if held is not None:
        yield _batch([done()], _FACTS + ", signature string")


def _batch(rows: list[dict], columns: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in fields]))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton, latest, found = SuffixAutomaton(), None, None
    for batch in batches:
        costs, audits = [], []
        for signature in batch.column("signature").to_pylist():
            if signature != latest:
                node = automaton.node(signature)
                latest, found = signature, (node.cost[_START], audit_of(node))
            costs.append(found[0])
            audits.append(found[1])
        kept = [batch.column(c) for c in batch.schema.names if c != "signature"]
        names = [c for c in batch.schema.names if c != "signature"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*names, "cost", "audit"])


def plan_repairs(rows: DataFrame) -> DataFrame:
    """Rows of :func:`faults` to one row for each conversation: counts, ``cost`` and ``audit``.

    Signatures are dealt out by their reversed signs, so equal ends meet in one
    task and are solved once there; the conversation is part of the key, so a very
    common signature spreads over tasks.
    """
    signed = store(_in_order(rows).mapInArrow(_signatures, _FACTS + ", signature string"), "signatures")
    dealt = signed.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
    return store(dealt.mapInArrow(_solved, _FACTS + ", cost long, audit string"), "audits")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From each conversation's audit and then its rows in order: (conv_id, place,
    role, text, edit) of what is left, and (conv_id, None, ...) at its end."""
    audit, at, q, place, conv, started = "", 0, _START, 0, None, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, q, place
        while at < len(audit) and audit[at] == "I":
            role, q = _WANTED[q]
            yield conv, place, role, "", "I"
            at, place = at + 1, place + 1

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))
        for own, plan, role, text in zip(*columns, strict=True):
            if plan is not None:
                if started:
                    yield from inserted()
                    yield conv, None, None, None, None
                audit, at, q, place, conv, started = plan, 0, _START, 0, own, True
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role, q = _WANTED[q]
            else:
                q = _NEXT[q, role[:1]]
            yield conv, place, role, text, edit
            place += 1
    if started:
        yield from inserted()
        yield conv, None, None, None, None


_AT_ONCE = 2_000_000


def _turn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns, names, size = [[], [], [], [], []], ["conv_id", "place", "role", "text", "edit"], 0
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for row in _repaired(batches):
        if row[1] is None:
            continue
        for column, value in zip(columns, row, strict=True):
            column.append(value)
        size += 100 + len(row[3])
        if size > _AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            columns, size = [[], [], [], [], []], 0
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, out, digest = [], [], hashlib.sha256()
    for conv, place, role, text, _ in _repaired(batches):
        if place is None:
            ids.append(conv)
            out.append(digest.hexdigest())
            digest = hashlib.sha256()
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
                ids, out = [], []
        else:
            digest.update((("\n" if place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])


@dataclass(frozen=True)
class Repair:
    """``report``: a row for each conversation; ``turns``: what the repaired
    conversations say, by ``conv_id`` and ``place`` (from 0), with the ``edit`` that
    made each row; ``digests``: the SHA-256 of their ``role:text`` lines."""

    report: DataFrame
    turns: DataFrame
    digests: DataFrame


def repair_conversations(conversations: DataFrame) -> Repair:
    """Find the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; others are
    ignored. Rows are taken by turn, nulls first; rows of one turn by role, then text. A
    null role or text is one space; a role of another initial than s, u and a (an empty one
    too) has to be changed or deleted. Repeated rows are duplicates. Rows
    without a conversation make one of their own. No rows give no conversations.

    Of a conversation one task holds a sign for each row, never its texts; texts
    pass by one after another.
    """
    rows = checked(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    found = store(faults(rows), "faults")
    report = plan_repairs(found)
    plans = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], F.lit(0).alias("copy"), "audit")
    said = found.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "copy", F.lit(None).cast("string").alias("audit"))
    both = _in_order(plans.unionByName(said), "kind").select("conv_id", "audit", "role", "text")
    return Repair(
        report,
        both.mapInArrow(_turn_batches, "conv_id long, place long, role string, text string, edit string"),
        both.mapInArrow(_digests, "conv_id long, repaired_sha256 string"),
    )


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """A table's rows with planted faults, by crc32(``conv_id:turn``) modulo ``kinds``: 0 drops
    the row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes
    it the user's. Nulls are one space."""
    rows = checked(conversations, "conv_id", "turn", "role", "text")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text = F.coalesce("text", F.lit(" "))
    code = F.crc32(key.cast("binary")) % kinds
    marked = rows.withColumn("code", code).where("code <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(text, _END, "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    )
    return marked.drop("again")


def conversation_ids(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()


def with_every(ids: DataFrame, found: DataFrame, fill: dict[str, Column]) -> DataFrame:
    """``found`` for all ``ids``, filled up where a conversation has no rows left."""
    theirs = found.withColumnRenamed("conv_id", "found_id").withColumn("is_found", F.lit(True))
    joined = ids.join(theirs, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("conv_id", *[F.when(F.col("is_found"), F.col(c)).otherwise(v).alias(c) for c, v in fill.items()])
