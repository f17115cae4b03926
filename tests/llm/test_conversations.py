"""Chat formatting and conversation repair against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repopulse.llm import QUERIES
from repopulse.llm.chat_format import chat_digests, format_chats, read_turns, scatter
from repopulse.llm.conversation_repair import SuffixAutomaton, audit_of, damaged, repair_conversations

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
here = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting -----------------------------------------------------------------------------------------

PIECES = ("\\", "###", "### user: ", "</turn>", "</turn>\n", ":", "#", "<", "é", "\U0001f600", "a b", "\n", "")


@given(st.lists(st.integers(0, 40), max_size=12), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_scatter_copies_segments(lengths, seed):
    data = np.random.default_rng(seed).integers(0, 255, 200).astype(np.uint8)
    length = np.array(lengths, np.int64)
    start, to = np.arange(len(length)) * 3, np.cumsum(length) - length
    out = np.zeros(int(length.sum()), np.uint8)
    scatter(out, to, data, start, length)
    assert out.tobytes() == b"".join(data[s : s + n].tobytes() for s, n in zip(start.tolist(), lengths, strict=True))


def plain_digests(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        own = [x[2:] for x in sorted(turns, key=lambda x: x[:3])]
        said = "".join(t for r, t in own if r == "assistant")
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(said), sha(said))
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_digests(df).collect()}


def test_every_text_comes_back_and_the_mask_covers_the_assistant(spark):
    texts = ["".join(x) for x in product(PIECES, repeat=2)]
    roles = ("user", "assistant", "a: b", "\\", "### x", None)
    rows = [(i // 7, i % 7, roles[i % 6], t) for i, t in enumerate(texts)]
    rows += [(None, 0, "assistant", "no conversation"), (900, None, "user", None), (900, 1, "assistant", None), (901, 0, "assistant", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "TEXT").selectExpr("conv_id", "turn", "role", "TEXT as text", "1 as part", "'x' as loss", "2 as n_turns")
    for part_bytes in (8 << 20, 50):
        parts = format_chats(df, part_bytes=part_bytes)
        assert digests(parts) == plain_digests(rows)
        for r in parts.collect():
            turns = list(read_turns(r["text"]))
            assert r["n_turns"] == len(turns)
            assert len(r["loss"]) == sum(role == "assistant" for role, _ in turns)
            for span in r["loss"]:
                assert r["text"][: span["start"]].endswith("### assistant: ")
                assert r["text"][span["start"] + span["length"] :].startswith("</turn>\n")
    assert max(r["text"].count("</turn>\n### ") for r in format_chats(df, part_bytes=1).collect()) <= 1


def test_a_conversation_of_many_tasks_keeps_its_order(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(4000)] + [(6, 0, "user", "x"), (6, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = format_chats(df)
        assert digests(parts) == plain_digests(rows)
        assert parts.where("conv_id = 5").count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_chats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert format_chats(empty).count() == 0
    assert chat_digests(format_chats(empty)).count() == 0


# Conversation repair -----------------------------------------------------------------------------------


def plain_audit(rows):
    """Cheapest and then least audit by a search over (row, last initial, edits)."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out)
        if best.setdefault((i, last), (cost, audit)) < (cost, audit):
            continue
        for name in ("user", "assistant"):
            if name[0] in allowed[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, name[0], (*out, name + ":")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 * (fault == "truncated")
        if role[:1] and role[:1] in allowed[last]:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, role + ":" + text)))
        for name in ("user", "assistant"):
            if name[0] in allowed[last]:
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, name[0], (*out, name + ":" + text)))
    raise AssertionError


def plain_repair(rows):
    """Rows (turn, role, text) of one conversation to the contract's columns."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    turns = [t for known, t, _, _ in rows if known]
    seen, marked = set(), []
    for _, _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, repaired = plain_audit(marked)
    initials = [r[:1] for r, _, _ in marked]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": sha(repaired),
    }


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_all(rows, ids):
    by = {i: [] for i in ids}
    for conv, *row in rows:
        by[conv].append(tuple(row))
    return {conv: plain_repair(own) for conv, own in by.items()}


@given(st.lists(st.lists(st.sampled_from("-suaxSUAX"), max_size=7).map("".join), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_the_automaton_finds_the_cheapest_least_audit(signatures):
    automaton = SuffixAutomaton()
    for backwards in sorted(s[::-1] for s in signatures):
        node = automaton.node(backwards)
        rows = [("z" if x in "xX-" else x.lower(), "", "blank" if x == "-" else "truncated" if x.isupper() else None) for x in reversed(backwards)]
        cost, audit, _ = plain_audit(rows)
        assert (node.cost[0], audit_of(node)) == (cost, audit)
    # A node for each distinct end, and no more.
    assert automaton.made == len({s[i:] for s in signatures for i in range(len(s))})


def reports(repair):
    ends = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests.collect()}
    return {r["conv_id"]: {**{k: v for k, v in r.asDict().items() if k != "conv_id"}, "repaired_sha256": ends[r["conv_id"]]} for r in repair.report.collect()}


def test_repair_equals_a_search(spark):
    roles, texts = ("user", "assistant", "system", "tool", "", " "), ("Good.", "cut", " ", "Yes!\n", "Ends? \x0b", "é\U0001f600", "")
    rng = np.random.default_rng(3)
    rows = [(int(c), int(t), roles[rng.choice(6, p=[0.35, 0.35, 0.1, 0.1, 0.05, 0.05])], texts[rng.integers(7)]) for c in range(300) for t in np.cumsum(rng.integers(0, 3, rng.integers(1, 9)))]
    rows += [(None, 2, "user", "Hi."), (None, None, "assistant", "Oh."), (-1, None, "user", "A."), (-1, None, "user", "A.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cost", "'x' as audit", "2 as copy", "'y' as fault")
    repair = repair_conversations(df)
    assert reports(repair) == plain_all(rows, {r[0] for r in rows})
    said = {}
    for r in sorted(repair.turns.collect(), key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append(r)
    for own in said.values():
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))


def test_nulls_and_no_rows(spark):
    rows = [(1, 0, None, "Hi."), (1, 1, "assistant", None)]
    plain = plain_all([(1, 0, " ", "Hi."), (1, 1, "assistant", " ")], {1})
    assert reports(repair_conversations(spark.createDataFrame(rows, SCHEMA))) == plain
    empty = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert (empty.report.count(), empty.turns.count(), empty.digests.count()) == (0, 0, 0)


def test_a_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[(i // 3) % 2], f"Turn {i % 5000}.") for i in range(9000)] + [(2, 0, "user", "y" * 2_000_000)]
    repair = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    found = reports(repair)
    assert found == plain_all(rows, {1, 2})


def test_damage(spark):
    rows = [(c, t, r, x) for c in (*range(60), None) for t, r, x in ((0, "user", "A. b!"), (1, "assistant", None), (None, None, "c?"))]
    found = [tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, plain_damage(rows)))


@here
def test_the_query_equals_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in QUERIES["op13_conversation_repair"](spark, SF_DIR).collect()}
    assert found == plain_all(plain_damage(rows), {r[0] for r in rows})
