"""Spelling variants against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repopulse.llm import QUERIES, spelling
from repopulse.llm.spelling import Tile, count_words, filed, near_words, spelling_groups

SF_DIR = "/root/testdata/sf0.001"


def one_edit(a: str, b: str) -> bool:
    """By trying all edits of one code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    by, rows = {}, {}
    for w in counts:
        for i in range(len(w)):
            by.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
    near = {w: set() for w in counts}
    for own in by.values():
        for w in own:
            near[w].update(x for x in own if x != w)
    for w in counts:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        rows[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while rows[root] is not None:
            root = rows[root]
        out[w] = (n, len(near[w]), rows[w], None if rows[w] is None else counts[rows[w]], root)
    return out


def plain_counts(rows, one_in, least_length=6, least_n=5):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_n}


def groups(df, **options):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_groups(df, **options).collect()}


@given(st.lists(st.text("abé\U0001f600", min_size=1, max_size=7), min_size=2, max_size=40, unique=True))
@settings(max_examples=80, deadline=None)
def test_tiles_tell_single_edits(words):
    longer = max(map(len, words))
    words = [w for w in words if len(w) >= longer - 1]
    tiles, n = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    every = slice(0, len(words))
    found = sum(Tile(longer * spelling.SEGMENTS + s, tiles, words, n).near(every, Tile(longer * spelling.SEGMENTS + s, tiles, words, n), every).astype(int) for s in range(spelling.SEGMENTS))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert found[i, j] == (one_edit(a, b) and max(len(a), len(b)) == longer), (a, b)


def test_words_of_a_pair_meet_in_one_tile(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(400)})
    rows = filed(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    tiles = {}
    for r in rows:
        tiles.setdefault(r["word"], set()).add((r["kind"], r["tile"]))
    assert all(tiles[a] & tiles[b] for a in words for b in words if one_edit(a, b))


@pytest.mark.parametrize("piece", [4096, 7])
def test_groups_equal_all_pairs(spark, piece):
    # Few letters make tiles that hold much; with small pieces they span many of them.
    rng = np.random.default_rng(6)
    words = {"".join(rng.choice(list("abé"), rng.integers(6, 9))) for _ in range(1500)}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.zipf(1.4, len(words)) % 10_000 + 1, strict=False)}
    sent = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("*", "'x' as form", "1 as kind").repartition(5)
    found = groups(sent, piece=piece)
    assert found == plain_groups(counts)
    assert sum(v[2] is not None for v in found.values()) > 50
    assert any(v[4] != v[2] for v in found.values() if v[2])


def test_pieces_of_one_tile_meet(spark):
    # All words differ in one place: a single tile of the middle segment.
    words = [f"abc{chr(0x4E00 + i)}def" for i in range(9500)]
    found = near_words(spark.createDataFrame([(w, 1 + i) for i, w in enumerate(words)], "word string, n long")).collect()
    assert len(found) == len(words)
    assert {r["n_near"] for r in found} == {len(words) - 1}
    assert Counter(r["best"] for r in found) == {words[-1]: len(words) - 1, words[-2]: 1}


def test_odd_words(spark):
    rows = [(None, 3), ("", 4), ("a", 9), ("ab", 1), ("x" * 50_000, 6), ("x" * 49_999, 1), ("÷×", 1)]
    found = groups(spark.createDataFrame(rows, "word string, n long"))
    assert found[None] == (3, 0, None, None, None)
    assert found[""] == (4, 0, None, None, "")
    assert found["ab"] == (1, 1, "a", 9, "a")
    assert found["x" * 49_999] == (1, 1, "x" * 50_000, 6, "x" * 50_000)
    assert groups(spark.createDataFrame([], "word string, n long")) == {}


@given(st.text("ab .é", max_size=60), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_no_run_crosses_a_window(text, size):
    windows = list(spelling.windows(text, size))
    assert "".join(windows) == text
    assert [r for w in windows for r in spelling.RUNS.findall(w)] == spelling.RUNS.findall(text)


def test_counts(spark):
    texts = ["Hello HELLO hello worÉld Étés7x", None, "", "a" * 300 + " hellos", "hello " * 5000, "hello"]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(5, "hello"), (None, "foo ÿ" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1 as n")
    for one_in in (None, 2, 3):
        found = {r["word"]: r["n"] for r in count_words(df, one_in=one_in, least_length=1, least_n=1).collect()}
        assert found == {w: n for w, n in plain_counts(rows, one_in, 1, 1).items() if w}
    assert count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")
def test_the_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in QUERIES["op11_spelling"](spark, SF_DIR).collect()}
    assert found == plain_groups(plain_counts(rows, 199))


def test_few_words_are_few_files(spark, monkeypatch):
    """Whatever the number of partitions; pieces of tiles that run through several of them still meet."""
    files, stored = {}, spelling.store

    def store(df, name, *rest):
        table = stored(df, name, *rest)
        files[name] = len(table.inputFiles())
        return table

    monkeypatch.setattr(spelling, "store", store)
    counts = {f"wor{a}{b}{c}": 5 + 40 * (a == b == "x") for a in "dpqx" for b in "dpqx" for c in "dpqx"}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = groups(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(8), piece=3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert found == plain_groups(counts)
    assert {n: files[n] for n in ("tiles", "forms", "roots")} == {"tiles": 1, "forms": 1, "roots": 1}
