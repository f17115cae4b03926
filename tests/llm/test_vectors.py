"""Operators on vectors against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from repopulse.llm.threshold_search import Tile, top_inner_products
from repopulse.llm.vector_links import far_apart, link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, data string, score string, n long"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.12
    clump = base[100] + rng.normal(size=(80, 16)) * 0.02
    rows = [(i, [float(y) for y in x], i % 3) for i, x in enumerate(np.concatenate([base, near, clump]).astype(np.float32))]
    rows = [(i, x, 1 if i >= 360 else rows[i - 300][2] if i >= 300 else c) for i, x, c in rows]
    rows += [(500, rows[0][1], 0), (600, rows[0][1], 0), (600, rows[0][1], 0), (700, None, 0), (701, [0.0] * 16, 0), (702, [NAN] * 16, 0), (703, [INF] + [1.0] * 15, 0)]
    rows += [(704, [None] + [1.0] * 15, 0), (705, rows[0][1], None), (800, [1.0, 2.0], 0), (801, [], 0), (None, rows[0][1], 0)]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(4)


def usable(x):
    return x is not None and all(y is not None and math.isfinite(y) for y in x)


def test_links(vectors, spark, monkeypatch):
    rows = vectors.collect()
    ok = [i for i, r in enumerate(rows) if usable(r.embedding) and any(r.embedding) and r.label is not None]
    n, near = [0] * len(rows), {i: {i} for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i].embedding, float), np.array(rows[j].embedding, float)
            if i != j and rows[i].label == rows[j].label and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                n[i] += 1
                near[i].add(j)
    for _ in rows:
        near = {i: set().union(*(near[j] for j in own)) for i, own in near.items()}
    least = [min((rows[j].vec_id for j in near[i] if rows[j].vec_id is not None), default=None) for i in range(len(rows))]
    expected = sorted((str(r.vec_id), n[i], str(least[i]), r.vec_id == least[i]) for i, r in enumerate(rows))
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in link_vectors(vectors).collect())
    assert found == expected
    from repopulse.llm import vector_links

    monkeypatch.setattr(vector_links, "_BLOCK", 7)
    cut = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vector_links.link_vectors(vectors).collect())
    assert cut == expected


@pytest.mark.parametrize("size", [300, 1000, 2000])
def test_a_hot_group_keeps_all_links(spark, size):
    rng = np.random.default_rng(size)
    noise = rng.normal(size=(size, 64))
    noise[:, 0] = 0
    own = 0.2 * noise / np.linalg.norm(noise, axis=1, keepdims=True) + np.eye(64)[0]
    x = np.concatenate([own, rng.normal(size=(2 * size, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    expected = {i: k for i, k in enumerate((linked.sum(1) - 1).tolist())}
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in link_vectors(frame).collect()}
    assert sum(expected.values()) > 0.9 * size * size
    assert found == expected


def test_lists_verify_few_pairs_and_the_exact_way_finds_all(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(2000, 64))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    # Pairs just above the least cosine, the hardest to find.
    x = np.concatenate([base, 0.931 * base + np.sqrt(1 - 0.931**2) * other])
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in link_vectors(frame).collect()}
    assert sum(r.n_links for r in found.values()) >= 0.99 * len(x)
    assert all(r.n_links <= 1 and r.component_id in (r.vec_id, r.vec_id - 2000) for r in found.values())
    assert sum(r.n_compared for r in found.values()) < 0.1 * len(x) ** 2
    exact = link_vectors(frame, exact=True).collect()
    assert all(r.n_links == 1 and r.component_id == r.vec_id % 2000 for r in exact)


def test_pivots_are_far_apart():
    unit = np.array([[1, 0], [np.cos(0.1), np.sin(0.1)], [0, 1], [0, 1]], float)
    assert far_apart(unit, 0.3).tolist() == [[1, 0], [0, 1]]


def test_no_vectors(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert link_vectors(nothing).count() == 0 and top_inner_products(nothing).count() == 0


def test_search(vectors, monkeypatch):
    from repopulse.llm import threshold_search

    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in vectors.collect() if usable(r.embedding) and r.vec_id is not None]
    expected = set()
    for q, x in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(x))
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])}
    assert {tuple(r) for r in top_inner_products(vectors).collect()} == expected
    monkeypatch.setattr(threshold_search, "_TILE", 64)
    monkeypatch.setattr(threshold_search, "_QUERIES", 2)
    assert {tuple(r) for r in threshold_search.top_inner_products(vectors).collect()} == expected


def test_reading_stops_at_the_bound_and_ties_go_to_the_smaller_id():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-3, 4, size=(2000, 3))
    ids = rng.permutation(2000)
    tile = Tile(ids, vectors)
    for query in (np.array([1, 2, -1]), np.array([0, 0, 0]), np.array([0, 0, 5])):
        found, scores = tile.top(7, query, 10)
        plain = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != 7)[:10]
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == plain
