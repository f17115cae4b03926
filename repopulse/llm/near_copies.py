"""Near copies of texts at a stated Jaccard similarity of their word shingles: the
SimHash index in Gray order with a wider radius, every link verified, and an exact
search for the links between the groups that the index leaves apart.

A fingerprint has 128 bits, so that a radius wide enough for a similarity of 0.8 still
tells unrelated texts apart. Upper nodes are masked patterns, ``MASKS`` of them of
``MASK_BITS`` bits each: two texts meet if they agree in one. Below a pattern fingerprints
are sorted by Gray rank, runs of them are nodes that factor out the bits they share, and
pairs of nodes are left as a whole once their accumulated differences exceed the radius, or
once all of their members are linked already.

Two texts at a similarity of exactly 0.8 differ in 15 % of the bits, agree in a mask
with probability 0.05 and in one of 80 with 0.98; at 0.85 it is 0.999. Each link
that is kept has been verified by the shingles themselves; before, the parities of ``SIGN_BITS``
parts of both sets show that most others differ in too many.

What the index misses, and what an unverified link hides in it, is found by prefixes: two
sets of a similarity of ``s`` share one of the first ``(1 - s) * n + 1`` of their ``n`` shingles,
in whatever order all shingles are put. Rare ones come first, by counts of ``SLOTS`` hashed
slots, so that texts which share no more than a frequent passage do not meet. Texts that
meet and are not connected yet are verified like the others: no link is lost.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repopulse.llm.components import connected_components
from repopulse.llm.simhash import _Sets, gray_rank
from repopulse.llm.storage import checked, store
from repopulse.llm.subwords import forget

MASKS, MASK_BITS = 80, 18
#: Differing bits of 128 up to which two texts are candidates: three deviations above the mean at 0.8.
RADIUS = 32
#: Radii of a search inside a large node, from the nearest links on.
_STEPS = (6, 16, RADIUS)
_PIECE, _LEAF, _FAN = 16_384, 32, 8
_HASHES_AT_ONCE = 1 << 15
#: Links of one text that are verified by one task.
_OF_A_TASK = 4_096
#: Slots in which shingles are counted; counts of a row, few so that a batch of rows stays small.
SLOTS, _BLOCK = 1 << 18, 1 << 8
SIGN_BITS = 2_048
#: Words of 64 parities beside a row of the exact search.
FOLDS = 16


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of all word shingles; words as in ``simhash.fingerprint``."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in spans), "<u8", len(parts) - width + 1))


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two words of 64 bits, each bit the majority over ``hashes`` and over a mix of them."""
    ones = np.zeros((2, 64), np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        part = hashes[at : at + _HASHES_AT_ONCE]
        mixed = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).astype("<u8")
        for i, x in enumerate((part, mixed)):
            bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[i] += bits.sum(0, dtype=np.uint32)
    packed = np.packbits((2 * ones > len(hashes)).astype(np.uint8), axis=1, bitorder="little")
    return tuple(packed.view("<i8").ravel().tolist())


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def signature(hashes: np.ndarray) -> bytes:
    """How many ``hashes`` there are, and for each part of them whether their number is odd: two
    sets differ in as many elements as these bits differ, at least."""
    odd = np.bincount(((hashes >> np.uint64(32)) & np.uint64(SIGN_BITS - 1)).astype(np.int64), minlength=SIGN_BITS) & 1
    return np.int64(len(hashes)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


_FOLDED = ", ".join(["own long", *[f"f{i} long" for i in range(FOLDS)]])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parities of signatures in ``FOLDS`` words: parts are joined, so that sets still differ in as many elements at least."""
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, -1)
        words = np.bitwise_xor.reduce(signs[:, 1:].reshape(batch.num_rows, SIGN_BITS // 64 // FOLDS, FOLDS), axis=1)
        columns = [batch.column(0), *[pa.array(words[:, i]) for i in range(FOLDS)]]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FOLDED.split(", ")])


_PRINTS = "no long, hi long, lo long, shingled binary, sign binary, block int, counts binary"


def _prints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A row for each text; after them, in blocks, how many texts have a shingle in each slot."""
    forget()
    names = [x.split()[0] for x in _PRINTS.split(", ")]
    counts = np.zeros(SLOTS, "<u4")
    for batch in batches:
        hi, lo, keys, signs = [], [], [], []
        for x in batch.column(1):
            hashes = shingles(x.as_py(), words)
            counts[_slots(hashes)] += 1
            a, b = wide_fingerprint(hashes)
            hi.append(a)
            lo.append(b)
            keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            signs.append(signature(hashes))
        columns = [batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())]
        none = [pa.nulls(len(hi), pa.int32()), pa.nulls(len(hi), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns + none, names)
    blocks = [(i, x) for i, x in enumerate(counts.reshape(-1, _BLOCK)) if x.any()]
    none = [pa.nulls(len(blocks), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
    made = [pa.array([i for i, _ in blocks], pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())]
    yield pa.RecordBatch.from_arrays(none + made, names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(x.as_buffer(), "<u4")
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def slot_counts(prints: DataFrame) -> np.ndarray:
    """How many texts have a shingle in each slot, added up over the tasks: 1 MB, whatever the input."""
    blocks = prints.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_added, "block int, counts binary")
    counts = np.zeros((SLOTS // _BLOCK, _BLOCK), "<u4")
    for row in blocks.collect():
        counts[row["block"]] = np.frombuffer(row["counts"], "<u4")
    return counts.ravel()


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the sorted ``hashes``, rare slots first, of which another set of this similarity has one in its own."""
    # A shingle more rather than one less where the product is not exact.
    size = min(len(hashes), len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1)
    return hashes[np.argsort(counts[_slots(hashes)], kind="stable")[:size]]


def _posted(batches: Iterator[pa.RecordBatch], words: int, similarity: float, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(x.as_py(), words) for x in part.column(2)]
            firsts = [prefix(x, counts, similarity) for x in sets]
            lengths = np.array([len(x) for x in firsts], np.int64)
            columns = [
                np.concatenate([np.zeros(0, "<u8"), *firsts]).view(np.int64),
                *[np.repeat(np.asarray(part.column(i)), lengths) for i in (0, 1)],
                np.repeat(np.array([len(x) for x in sets], np.int32), lengths),
                np.concatenate([np.zeros(0, np.int32), *[np.arange(x, dtype=np.int32) for x in lengths]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shingle", "no", "root", "size", "place"])


def _sets_of(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A few megabytes at a time: a batch of very long texts never stands whole beside its hashes.
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            values = [shingles(x.as_py(), words).tobytes() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.binary())], ["no", "hashes"])


def masks() -> list[tuple[int, int]]:
    """Masks (hi, lo), dealt from shuffled positions so that each bit is in about as many."""
    deal = np.random.default_rng(20)
    positions = np.concatenate([deal.permutation(128)[:126].reshape(-1, MASK_BITS) for _ in range(-(-MASKS // 7))])[:MASKS]
    out = []
    for row in positions.tolist():
        mask = sum(1 << p for p in row)
        out.append(tuple(x - (1 << 64) if x >> 63 else x for x in (mask >> 64, mask & (2**64 - 1))))
    return out


class _Node:
    """Fingerprints [start, stop) of a Gray-sorted piece: the bits all share, under ``mask``."""

    __slots__ = ("children", "linked", "mask", "pattern", "start", "stop")

    def __init__(self, fps: np.ndarray, start: int, stop: int, children: list[_Node]) -> None:
        self.start, self.stop, self.children, self.linked = start, stop, children, False
        part = fps[start:stop]
        shared = ~(np.bitwise_or.reduce(part) ^ np.bitwise_and.reduce(part))
        self.mask = int(shared[0]) << 64 | int(shared[1])
        self.pattern = (int(part[0, 0]) << 64 | int(part[0, 1])) & self.mask

    def one_set(self, sets: _Sets) -> bool:
        """Whether all members are linked to each other; that never ends."""
        if not self.linked:
            if self.children:
                if not all([x.one_set(sets) for x in self.children]):
                    return False
                firsts = {sets.find(x.start) for x in self.children}
            else:
                firsts = {sets.find(i) for i in range(self.start, self.stop)}
            self.linked = len(firsts) == 1
        return self.linked


def _tree(fps: np.ndarray, start: int, stop: int) -> _Node:
    nodes = [_Node(fps, i, min(i + _LEAF, stop), []) for i in range(start, stop, _LEAF)]
    while len(nodes) > 1:
        groups = [nodes[i : i + _FAN] for i in range(0, len(nodes), _FAN)]
        nodes = [_Node(fps, g[0].start, g[-1].stop, g) for g in groups]
    return nodes[0]


def near_pairs(fps: np.ndarray, split: int | None = None) -> list[tuple[int, int, int]]:
    """Links (i, j, bits) of ``fps`` (n x 2 words), a spanning set from the nearest on: inside
    all of them, or between those before ``split`` and the others."""
    n = len(fps)
    sets, found = _Sets(n), []

    def compare(a: range, b: range, radius: int) -> None:
        bits = np.bitwise_count(fps[a.start : a.stop, None] ^ fps[None, b.start : b.stop]).sum(-1)
        near = np.argwhere(bits <= radius)
        apart = bits[near[:, 0], near[:, 1]]
        order = np.argsort(apart, kind="stable")
        for (i, j), d in zip(near[order].tolist(), apart[order].tolist(), strict=True):
            i, j = a.start + i, b.start + j
            if i < j and sets.join(i, j):
                found.append((i, j, d))

    if n <= _LEAF:
        compare(range(0, n if split is None else split), range(0 if split is None else split, n), RADIUS)
        return found
    left = _tree(fps, 0, n if split is None else split)
    right = left if split is None else _tree(fps, split, n)
    for radius in _STEPS:
        stack = [(left, right)]
        while stack:
            a, b = stack.pop()
            if b.stop <= a.start or ((a.pattern ^ b.pattern) & a.mask & b.mask).bit_count() > radius:
                continue
            if a.one_set(sets) and b.one_set(sets) and sets.find(a.start) == sets.find(b.start):
                continue
            if a is b and a.children:
                # Neighbours last on the stack: what lies together is linked first.
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i + 1 :]]
                stack += [(x, x) for x in a.children]
            elif a.children and (not b.children or a.stop - a.start >= b.stop - b.start):
                stack += [(x, b) for x in a.children]
            elif b.children:
                stack += [(a, x) for x in b.children]
            else:
                compare(range(a.start, a.stop), range(b.start, b.stop), radius)
    return found


_FOUND = "a long, b long, d int, which int, pattern long, piece int, members binary"


def _found(links: list[tuple[int, int, int]], pieces: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    rows = [(*x, None, None, None, None) for x in links] + [(None, None, None, *x) for x in pieces]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _named(rows: np.ndarray, split: int | None = None) -> list[tuple[int, int, int]]:
    """Links between ids: ``rows`` are (id, hi, lo)."""
    ids = rows[:, 0]
    links = near_pairs(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), split)
    return [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j])), d) for i, j, d in links]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (which, pattern, no, hi, lo) sorted by pattern: links inside pieces of a
    pattern, and the pieces of patterns that have several."""
    key: tuple[int, int] | None = None
    held, piece = np.zeros((0, 3), np.int64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        which, pattern, *rest = (np.asarray(batch.column(i)) for i in range(5))
        rows = np.stack(rest, axis=1)
        cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(pattern) != 0)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
        # Patterns of one text need no look, but the first and last may go on in other batches.
        look = np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(rows)))
        links: list[tuple[int, int, int]] = []
        pieces: list[tuple[int, int, int, bytes]] = []
        for at, to in zip(starts[look].tolist(), stops[look].tolist(), strict=True):
            own = (int(which[at]), int(pattern[at]))
            if own == key:
                held = np.concatenate([held, rows[at:to]])
            else:
                links += _named(held) if len(held) > 1 else []
                if piece:
                    pieces.append((*key, piece, held.tobytes()))
                key, held, piece = own, rows[at:to], 0
            while len(held) > _PIECE:
                links += _named(held[:_PIECE])
                pieces.append((*key, piece, held[:_PIECE].tobytes()))
                held, piece = held[_PIECE:], piece + 1
        held = held.copy()
        yield _found(links, pieces)
    if len(held) > 1 or piece:
        yield _found(_named(held) if len(held) > 1 else [], [(*key, piece, held.tobytes())] if piece else [])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two pieces of one pattern."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            left, right = (np.frombuffer(v.as_py(), np.int64).reshape(-1, 3) for v in (x, y))
            yield _found(_named(np.concatenate([left, right]), len(left)), [])


def candidate_links(distinct: DataFrame) -> DataFrame:
    """(a, b, d): links between rows of ``distinct`` (no, hi, lo) within ``RADIUS`` bits, a
    spanning set for each upper node."""
    patterns = [F.xxhash64(F.col("hi").bitwiseAND(F.lit(hi)), F.col("lo").bitwiseAND(F.lit(lo))) for hi, lo in masks()]
    filed = distinct.select(F.posexplode(F.array(*patterns)).alias("which", "pattern"), "no", "hi", "lo")
    dealt = filed.repartition("which", "pattern").sortWithinPartitions("which", "pattern", gray_rank(F.col("hi")))
    # Many tasks find little: rebalanced, it makes few files.
    found = store(dealt.mapInArrow(_search, _FOUND).hint("rebalance"), "searched")
    pieces = found.where("members is not null")
    x = pieces.select("which", "pattern", F.col("piece").alias("px"), F.col("members").alias("mx"))
    y = pieces.select("which", "pattern", F.col("piece").alias("py"), F.col("members").alias("my"))
    across = x.join(y, ["which", "pattern"]).where("px < py").select("mx", "my").mapInArrow(_between, _FOUND)
    links = found.where("a is not null").unionAll(across).where("a <> b")
    return links.groupBy("a", "b").agg(F.min("d").alias("d"))


def _not_too_far(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64).reshape(-1, 1 + SIGN_BITS // 64) for i in (2, 3))
        apart = np.bitwise_count((left[:, 1:] ^ right[:, 1:]).view(np.uint64)).sum(1, dtype=np.int64)
        good = apart <= (1 - similarity) / (1 + similarity) * (left[:, 0] + right[:, 0]) + 1e-6
        kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
        yield kept.filter(pa.array(good, pa.bool_()))


def _jaccard(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            left, right = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(left, right, assume_unique=True))
            good.append(both >= similarity * (len(left) + len(right) - both))
        kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
        yield kept.filter(pa.array(good, pa.bool_()))


def _with_sets(pairs: DataFrame, side: str, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``pairs``, which are the stored ``links``, with the shingles of ``side``. A text with very many links has its set
    repeated, so that its links are dealt over tasks."""
    hot = links.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > _OF_A_TASK)
    # Broadcast, a row for each ``_OF_A_TASK`` links at most: by shuffle, all pairs and sets would be sent once more.
    hot = F.broadcast(hot.select(F.col(side).alias("hot"), F.ceil(F.col("n") / _OF_A_TASK).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, F.col(side) == F.col("hot"), "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("hot", "parts")
    copies = sets.join(hot, F.col("no") == F.col("hot"), "left").select(
        F.col("no").alias(side), F.col("hashes").alias(f"hashes_{side}"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    )
    return dealt.join(copies, [side, "part"]).drop("part")


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return _with_sets(_with_sets(pairs.select("a", "b"), "a", sets, pairs), "b", sets, pairs).select("a", "b", "hashes_a", "hashes_b")


def verified(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The stored ``pairs`` (a, b) whose shingle sets are as similar; ``firsts`` (no, sign) and ``rows`` (no, text) have them all."""
    signs = firsts.select("no", F.col("sign").alias("hashes"))
    near = store(_both(pairs, signs).mapInArrow(lambda x: _not_too_far(x, similarity), "a long, b long"), "near")
    ends = near.select(F.explode(F.array("a", "b")).alias("no")).distinct()
    sets = rows.join(ends, "no", "left_semi").mapInArrow(lambda b: _sets_of(b, words), "no long, hashes binary").dropDuplicates(["no"])
    return _both(near, store(sets, "sets")).mapInArrow(lambda x: _jaccard(x, similarity), "a long, b long")


def pairs_apart(rooted: DataFrame, firsts: DataFrame, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of ``rooted`` (no, root, text) of different roots that may be as similar; ``firsts`` (no, sign) has them all."""
    posted = rooted.select("no", "root", "text").mapInArrow(
        lambda x: _posted(x, words, similarity, counts), "shingle long, no long, root long, size int, place int"
    )
    own = Window.partitionBy("shingle")
    apart = posted.withColumns({"least": F.min("root").over(own), "most": F.max("root").over(own)}).where("least < most")
    apart = store(apart.drop("least", "most"), "apart")
    ends = apart.select(F.col("no").alias("own")).distinct()
    folded = store(firsts.select(F.col("no").alias("own"), "sign").join(ends, "own", "left_semi").mapInArrow(_folded, _FOLDED), "folded")
    rows = apart.join(folded, F.col("no") == F.col("own"))
    names = ["no", "root", "size", "place", *[f"f{i}" for i in range(FOLDS)]]
    x, y = (rows.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "xy")
    # What both may share: as many as lie before the shingle in either, itself, and as many as lie behind it.
    behind = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    needed = similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - 1e-6
    sized = F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y") - 1e-6
    # Each odd parity is an element that only one has; as many are left at most beside the shared ones.
    odd = functools.reduce(operator.add, (F.bit_count(F.col(f"f{i}_x").bitwiseXOR(F.col(f"f{i}_y"))) for i in range(FOLDS)))
    few = odd <= F.col("size_x") + F.col("size_y") - 2 * needed
    enough = sized & (F.least("place_x", "place_y") + behind >= needed) & few
    met = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("no_x") < F.col("no_y")) & (F.col("root_x") != F.col("root_y")) & enough)
    # Up to where the prefix ends that ends first in the order, all that both share has been met.
    left = F.greatest(*[F.floor(similarity * F.col(c) + 1e-6) for c in ("size_x", "size_y")])
    met = met.groupBy(F.col("no_x").alias("a"), F.col("no_y").alias("b")).agg(F.count("*").alias("both"), F.first(needed - left).alias("least"))
    return met.where("both >= least").select("a", "b")


def near_copies(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, the smallest id reachable over
    links between texts whose sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more.

    A null text counts as empty; a text of fewer words is one shingle; texts of equal shingles
    are copies, those without a word included; ids are whole numbers and should be unique (rows that
    share one share its component); other columns are ignored; an empty table gives no rows.

    Copies are folded first. All candidate links of the index are verified, and then all pairs
    of texts that are not connected yet and whose prefixes meet. So no link between
    components is lost and none is kept unverified.
    """
    rows = checked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("no"), F.col(text_col).alias("text"))
    made = store(rows.mapInArrow(lambda b: _prints(b, words), _PRINTS), "prints")
    prints = made.where("block is null")
    least = prints.groupBy("shingled").agg(*[F.min(c).alias(c) for c in ("no", "hi", "lo", "sign")])
    distinct = store(least, "classes")
    firsts = distinct.where("no is not null")

    links = store(candidate_links(firsts.select("no", "hi", "lo")), "candidates")
    roots = connected_components(verified(links, firsts, rows, words, similarity))
    grouped = firsts.select("no").join(roots.withColumnRenamed("node", "no"), "no", "left").select("no", F.coalesce("root", "no").alias("root"))
    # Stored, so that its size is known: the texts are only shuffled where it is large.
    grouped = store(grouped, "grouped")
    apart = store(pairs_apart(rows.join(grouped, "no"), firsts, slot_counts(made), words, similarity), "pairs")
    if not apart.isEmpty():
        # Links between groups: their roots are the nodes.
        a, b = (grouped.select(F.col("no").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        across = verified(apart, firsts, rows, words, similarity).join(a, "a").join(b, "b")
        met = connected_components(across.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        joined = met.select(F.col("node").alias("root"), F.col("root").alias("least"))
        grouped = grouped.join(joined, "root", "left").select("no", F.coalesce("least", "root").alias("root"))
    rooted = distinct.join(grouped, "no", "left").select("shingled", F.coalesce("root", "no").alias("component_id"))
    return prints.select("no", "shingled").join(rooted, "shingled").select(F.col("no").alias("doc_id"), "component_id")
