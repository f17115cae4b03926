"""Near-duplicates by SimHash: a hierarchical index in Gray order.

Top of the hierarchy: the 64 bits are cut into ``most + 2`` blocks. Two fingerprints
that differ in at most ``most`` bits agree in two whole blocks at least, so an upper
node is a masked pattern: which two blocks, and their bits. Every distinct
fingerprint is filed under the pattern of each pair of blocks.

Below a pattern fingerprints are sorted by Gray rank, the place of their bits in
the reflected binary code, in which neighbours share long patterns. Runs of them
make nodes; a node factors out the bits that all of its members share, and nodes
make nodes again. A search goes down from pairs of nodes and adds up the
differences of shared bits: a pair of groups that already differs in more than
``most`` bits is left as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repopulse.llm.components import connected_components
from repopulse.llm.storage import checked, store

#: Fingerprints of one pattern that are searched in one piece; members of the lowest nodes, and nodes of a node.
_PIECE, _LEAF, _FAN = 16_384, 32, 8
_HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, each the majority of that bit in the XXH64 (seed 42) of all word
    shingles, repeats included.

    A-Z are lower-cased, words end at ASCII white space, a text of fewer words is one
    shingle, and without a word all bits are 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(parts))
    count = len(parts) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _HASHES_AT_ONCE):
        to = min(count, at + _HASHES_AT_ONCE)
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    bits = (2 * ones > count).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit pattern in the reflected binary code, as a long whose
    unsigned order is meant: the inverse of ``i ^ (i >> 1)``."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def block_masks(most: int) -> list[int]:
    """Masks over two of ``most + 2`` blocks of the 64 bits."""
    edges = np.linspace(0, 64, most + 3).round().astype(int).tolist()
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class _Node:
    """Fingerprints [start, stop) of a Gray-sorted piece: the bits all share, under ``mask``."""

    __slots__ = ("children", "mask", "pattern", "start", "stop")

    def __init__(self, fps: np.ndarray, start: int, stop: int, children: list[_Node]) -> None:
        self.start, self.stop, self.children = start, stop, children
        self.mask = int(~(np.bitwise_or.reduce(fps[start:stop]) ^ np.bitwise_and.reduce(fps[start:stop])))
        self.pattern = int(fps[start]) & self.mask


def _tree(fps: np.ndarray) -> _Node:
    nodes = [_Node(fps, i, min(i + _LEAF, len(fps)), []) for i in range(0, len(fps), _LEAF)]
    while len(nodes) > 1:
        groups = [nodes[i : i + _FAN] for i in range(0, len(nodes), _FAN)]
        nodes = [_Node(fps, g[0].start, g[-1].stop, g) for g in groups]
    return nodes[0]


class _Sets:
    """Union of positions: only links that join two sets are reported."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def _links(left: np.ndarray, right: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """A spanning set of the links inside ``left``, or between ``left`` and ``right``."""
    own = right is None
    other, base = (left, 0) if own else (right, len(left))
    sets, found = _Sets(base + len(other)), []
    root = _tree(left)
    stack = [(root, root if own else _tree(other))]
    while stack:
        a, b = stack.pop()
        if own and b.stop <= a.start:
            continue
        if ((a.pattern ^ b.pattern) & a.mask & b.mask).bit_count() > most:
            continue
        if a.children and (not b.children or a.stop - a.start >= b.stop - b.start):
            if own and a is b:
                stack += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
            else:
                stack += [(x, b) for x in a.children]
        elif b.children:
            stack += [(a, x) for x in b.children]
        else:
            near = np.bitwise_count(left[a.start : a.stop, None] ^ other[None, b.start : b.stop]) <= most
            for i, j in np.argwhere(near).tolist():
                i, j = a.start + i, b.start + j
                if (not own or i < j) and sets.join(i, base + j):
                    found.append((int(left[i]), int(other[j])))
    return found


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From sorted (which, pattern, fp): links inside pieces of one pattern, and
    the pieces of which the pattern may have more, at a task's ends or beyond
    ``_PIECE`` members."""
    names = ["which", "pattern", "a", "b", "shared", "mask", "fps"]

    def piece_row(key: tuple[int, int], fps: np.ndarray) -> tuple:
        node = _Node(fps, 0, len(fps), [])
        return (*key, None, None, _signed(node.pattern), _signed(node.mask), fps.tobytes())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    key, held, rows, first, several = None, np.zeros(0, np.uint64), [], True, False

    def close(last: bool) -> None:
        nonlocal first, several
        if key is None:
            return
        if len(held) > 1:
            rows.extend((None, None, _signed(a), _signed(b), None, None, None) for a, b in _links(held, None, most))
        if first or several or last:
            rows.append(piece_row(key, held))
        first = several = False

    for batch in batches:
        which, pattern, fps = (np.asarray(batch.column(i)) for i in range(3))
        fps = fps.view(np.uint64)
        if not len(fps):
            continue
        cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(pattern) != 0)) + 1
        edges = [0, *cuts.tolist(), len(fps)]
        for at, to in zip(edges, edges[1:], strict=False):
            own = (int(which[at]), int(pattern[at]))
            if own != key:
                close(False)
                key, held = own, fps[at:to]
            else:
                held = np.concatenate([held, fps[at:to]])
            while len(held) > _PIECE:
                rest, held = held[_PIECE:], held[:_PIECE]
                several = True
                close(False)
                held, several = rest, True
        yield out(rows)
        rows = []
    close(True)
    yield out(rows)


def _across(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links between two pieces of one pattern."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            found = _links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array([_signed(p[k]) for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def fingerprint_links(distinct: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct`` (fp) at ``most``
    or fewer differing bits, directly or over others. No two fingerprints of a row
    are compared that do not share an upper node."""
    masks = [_signed(m) for m in block_masks(most)]
    filed = distinct.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("which", "pattern"), "fp"
    ).select(F.col("which").cast("long").alias("which"), "pattern", "fp")
    # The top bit is turned, so that the signed order is the unsigned order of the rank.
    rank = gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(2**63)))
    sorted_ = filed.repartitionByRange("which", "pattern", rank).sortWithinPartitions("which", "pattern", rank)
    found = store(
        sorted_.mapInArrow(lambda b: _pieces(b, most), "which long, pattern long, a long, b long, shared long, mask long, fps binary"), "pieces"
    )
    pieces = found.where("fps is not null").withColumn("no", F.xxhash64("fps"))
    x = pieces.select("which", "pattern", *(F.col(c).alias(f"{c}_x") for c in ("shared", "mask", "fps", "no")))
    y = pieces.select("which", "pattern", *(F.col(c).alias(f"{c}_y") for c in ("shared", "mask", "fps", "no")))
    both = F.col("mask_x").bitwiseAND(F.col("mask_y"))
    pairs = x.join(y, ["which", "pattern"]).where(F.col("no_x") < F.col("no_y"))
    pairs = pairs.where(F.bit_count(F.col("shared_x").bitwiseXOR(F.col("shared_y")).bitwiseAND(both)) <= most)
    across = pairs.select("fps_x", "fps_y").mapInArrow(lambda b: _across(b, most), "a long, b long")
    return found.where("a is not null").select("a", "b").unionAll(across)


def near_duplicates(docs: DataFrame, *, words: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of whole texts are linked at ``most`` or fewer differing bits;
    component_id is the smallest document id reachable over links, the own one
    included. A null text counts as empty; texts without a word have fingerprint
    zero and are linked like any other; repeated rows all come back; a null id comes
    back with the component of its text, but never names one unless it is alone;
    other columns are ignored; an empty table gives no rows.

    Copies are folded into one row per fingerprint before anything is compared.
    """
    rows = checked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = store(rows.mapInArrow(lambda b: _fingerprints(b, words), "doc_id long, fp long"), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), most))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = store(joined, "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = joined.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
