"""Near copies at a Jaccard similarity of shingles, against plain set comparison."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from repopulse.llm import near_copies as N
from repopulse.llm import subwords
from repopulse.llm.components import connected_components
from repopulse.llm.terms import Terms


def plain_components(texts: dict[int, str | None], words: int = 5, similarity: float = 0.8) -> dict[int, int]:
    def of(text: str | None) -> frozenset:
        parts = (text or "").lower().split()
        width = min(words, len(parts)) or 1
        return frozenset(tuple(parts[i : i + width]) for i in range(len(parts) - width + 1)) if parts else frozenset()

    sets = {i: of(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * max(1, len(sets[i] | sets[j]))):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def changed(rng, words: list[str], n: int) -> str:
    out = list(words)
    for at in rng.choice(len(words), n, replace=False).tolist():
        out[at] = f"new{rng.integers(10**6)}"
    return " ".join(out)


def result(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in N.near_copies(df).collect()}


def test_components_equal_plain_comparison(spark):
    rng = np.random.default_rng(3)
    texts: dict[int, str | None] = {}
    for group in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 250)]
        texts[len(texts)] = " ".join(words)
        for n in (1, 2, 4, 30)[: group % 5]:
            texts[len(texts)] = changed(rng, words, n)
    texts |= {9001: None, 9002: "", 9003: " \t", 9004: "one word", 9005: "ONE  word", 9006: texts[0], 9007: "word " * 3000}
    assert result(spark, texts) == plain_components(texts)


def test_hot_group_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(N, "_OF_A_TASK", 8)
    rng = np.random.default_rng(4)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    texts = {i: changed(rng, words, int(rng.integers(1, 4))) for i in range(200)} | {1000 + i: " ".join(f"x{y}" for y in rng.integers(0, 3000, 200)) for i in range(100)}
    got = result(spark, texts)
    assert {got[i] for i in range(200)} == {0}
    assert all(got[i] == i for i in range(1000, 1100))


@pytest.mark.parametrize(("n", "least"), [(5, 0.97), (10, 0.9)])
def test_recall_of_the_index(n, least):
    """Share of pairs that agree in a mask and lie within the radius; 450 words, of which n are new (similarity 0.9 and 0.8)."""
    rng, found, pairs = np.random.default_rng(5), 0, 150
    masks = np.array(N.masks(), np.int64)
    for _ in range(pairs):
        words = [f"w{x}" for x in rng.integers(0, 10**5, 450)]
        x = np.array([N.wide_fingerprint(N.shingles(t)) for t in (" ".join(words), changed(rng, words, n))], np.int64)
        differ = x[0] ^ x[1]
        found += bool(((differ & masks) == 0).all(1).any() and np.bitwise_count(differ.view(np.uint64)).sum() <= N.RADIUS)
    assert found / pairs >= least


def test_near_pairs_span_what_plain_comparison_links(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (40, 2)).astype(np.uint64)
    fps = np.repeat(base, 10, axis=0)
    fps[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    fps = fps[np.argsort(fps[:, 0])]
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1)
    for split in (None, 150):
        sets = N._Sets(400)
        for i, j in np.argwhere(apart <= N.RADIUS).tolist():
            if i < j and (split is None or i < split <= j):
                sets.join(i, j)
        got = N._Sets(400)
        for i, j, d in N.near_pairs(fps, split):
            assert apart[i, j] == d <= N.RADIUS
            assert got.join(i, j)
        assert [got.find(i) for i in range(400)] == [sets.find(i) for i in range(400)]


def test_pieces_of_one_pattern(monkeypatch):
    """Patterns over several batches and pieces lose no link."""
    import pyarrow as pa

    monkeypatch.setattr(N, "_PIECE", 16)
    rng = np.random.default_rng(7)
    hi = np.sort(rng.integers(0, 2**10, 70))
    rows = [np.zeros(70, np.int32), np.full(70, 5), np.arange(70), hi, np.zeros(70, np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["which", "pattern", "no", "hi", "lo"])
    out = pa.Table.from_batches(list(N._search(iter([batch.slice(0, 30), batch.slice(30)])))).to_pylist()
    pieces = [r["members"] for r in out if r["members"] is not None]
    assert len(pieces) == 5
    pairs = [(x, y) for i, x in enumerate(pieces) for y in pieces[i + 1 :]]
    across = pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["mx", "my"])
    out += [r for b in N._between(iter([across])) for r in b.to_pylist()]
    sets = N._Sets(70)
    for r in out:
        if r["a"] is not None:
            sets.join(r["a"], r["b"])
    assert len({sets.find(i) for i in range(70)}) == 1


def test_no_link_at_the_threshold_is_lost(spark):
    """Pairs at a similarity of 0.8 to 0.82, of which the index alone misses some."""
    rng = np.random.default_rng(8)
    texts: dict[int, str | None] = {}
    for _ in range(150):
        words = [f"w{x}" for x in rng.integers(0, 10**5, int(rng.integers(229, 250)))]
        texts[len(texts)] = " ".join(words)
        for _ in range(50):
            other = changed(rng, words, 5)
            a, b = (set(N.shingles(x).tolist()) for x in (texts[len(texts) - 1], other))
            if len(a & b) >= 0.8 * len(a | b):
                break
        texts[len(texts)] = other
    assert result(spark, texts) == plain_components(texts)


def test_prefixes_of_similar_sets_meet():
    """Whatever the order of the slots and however frequent a shared passage."""
    rng = np.random.default_rng(9)
    for size in (1, 2, 4, 5, 9, 40, 333):
        for _ in range(30):
            counts = rng.integers(0, 4, N.SLOTS).astype("<u4")
            x = np.unique(rng.integers(0, 2**63, size).astype("<u8"))
            gone = int(rng.integers(0, len(x) // 5 + 1))
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 9 + 1))).astype("<u8")]))
            both = len(np.intersect1d(x, y))
            if both >= 0.8 * (len(x) + len(y) - both):
                assert len(np.intersect1d(N.prefix(x, counts, 0.8), N.prefix(y, counts, 0.8)))


def test_later_stages_close_the_tokenizers_of_a_worker():
    for later in (lambda: list(N._prints(iter([]), 5)), Terms):
        subwords.subwords(public_tokenizers.path("word_bpe_49k.json"))
        later()
        assert not subwords._OPEN


def test_small_tables_of_components_are_one_file(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = connected_components(spark.createDataFrame([(i, i + 1) for i in range(0, 300, 2)], "a long, b long"))
        assert len(found.inputFiles()) == 1
        assert sorted(found.collect()) == [(i, i - i % 2) for i in range(300)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_links_between_groups_meet_the_links_inside_them(spark):
    """Chains in which the exact search adds a link to groups of several texts."""
    rng = np.random.default_rng(10)
    texts: dict[int, str | None] = {}
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**5, 240)]
        for _ in range(6):
            texts[1000 - len(texts)] = " ".join(words)
            words = changed(rng, words, int(rng.integers(1, 6))).split()
    assert result(spark, texts) == plain_components(texts)


def test_folded_parities_tell_a_family_below_the_similarity():
    """Never more odd parities than elements that differ; of variants at 0.76 to each other, enough to make no row."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.permutation(5000)[:150]]
    sets = [N.shingles(changed(rng, words, n)) for n in (0, 1, 2, 2, 2, 2, 2, 30)] + [N.shingles(None)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array([N.signature(x) for x in sets])], ["own", "sign"])
    folded = pa.Table.from_batches(list(N._folded(iter([batch]))))
    parities = np.stack([np.asarray(folded.column(1 + i)) for i in range(N.FOLDS)], axis=1).view(np.uint64)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            odd, apart = int(np.bitwise_count(parities[i] ^ parities[j]).sum()), len(np.setxor1d(x, y))
            assert odd <= apart
            assert (apart - odd) % 2 == 0
            if apart >= 39:
                assert odd > (1 - 0.8) / 1.8 * (len(x) + len(y))
