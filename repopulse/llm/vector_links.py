"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the pivots (reference vectors) nearest to it. Inverted lists hold,
for each pivot, the vectors that it is near to; two vectors are candidates if they share
at least a given number of pivots, and candidates are verified by their cosine in double
precision.

Lists are short and no pair is looked at twice: with pivots ranked by how many vectors they
are near to, rarest first, two sets of k pivots that share s of them share one of their first
k - s + 1, so a vector is filed only under these, and a pair belongs to the list of the
rarest pivot that both have. A list is cut into blocks that are compared block by block.

The exact way (``exact=True``) compares all blocks of a label but those that the triangle
inequality proves too far apart from each other, by their angles to one pivot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.llm.components import connected_components
from repopulse.llm.storage import checked, store

#: Vectors that pivots are chosen from: about four times the root of their number, within these bounds; each vector's nearest pivots.
LEAST_PIVOTS, MOST_PIVOTS, NEAREST = 64, 2048, 12
#: Pivots that candidates have to share.
SHARED = 3
_BLOCK, _BLOCK_BYTES, _SHARE, _MOST_SHARES = 1024, 1 << 19, 16, 64
#: Radians that angles may be wrong by, as they are kept in single precision.
_SLACK = 1e-4


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def far_apart(sample: np.ndarray, angle: float) -> np.ndarray:
    """Those of ``sample`` (unit vectors, the first always) that are farther than
    ``angle`` from all chosen before: a dense group has few pivots, however many
    vectors it has."""
    chosen, open_ = [], np.ones(len(sample), bool)
    while open_.any():
        i = int(np.argmax(open_))
        chosen.append(i)
        open_ &= sample @ sample[i] < np.cos(min(angle, np.pi))
        open_[i] = False
    return sample[chosen]


def _cosines(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """With zeros for the dimensions that the shorter of both has not."""
    width = min(unit.shape[1], pivots.shape[1])
    return unit[:, :width] @ pivots[:, :width].T


def _described(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector with its nearest pivots; their bytes are in the order of their numbers."""
    for batch in batches:
        ids, n, label = (np.asarray(batch.column(i)) for i in range(3))
        groups: dict[int, list[int]] = {}
        values = batch.column(3).to_pylist()
        for i, x in enumerate(values):
            groups.setdefault(len(x), []).append(i)
        for dims, own in groups.items():
            raw = np.array([values[i] for i in own], float)
            unit = _unit(raw)
            near = np.argsort(-_cosines(unit, pivots), axis=1, kind="stable")[:, :NEAREST].astype(">u2")
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[own]), pa.array(np.full(len(own), dims, np.int32)), pa.array([x.tobytes() for x in near], pa.binary()),
                 pa.array(ids[own]), pa.array(n[own]), pa.array([x.tobytes() for x in raw.astype(kind)], pa.binary())],
                ["label", "dims", "near", "id", "n", "vec"],
            )


def _spanning(near: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """For each member its component's first one, if that is another."""
    first = np.arange(len(ids))
    while True:
        new = np.minimum(first, np.where(near, first[None, :], len(ids)).min(axis=1, initial=len(ids)))
        new = new[new]
        if (new == first).all():
            break
        first = new
    own = first != np.arange(len(ids))
    return ids[own].tolist(), ids[first[own]].tolist()


_BLOCKS = "label int, dims int, no long, ids binary, n binary, unit binary, low array<float>, high array<float>"
_LISTS = "label int, dims int, list int, near binary, id long, n long, vec binary"
_LISTED = "label int, dims int, list int, no long, ids binary, n binary, near binary, vec binary, common array<int>"
_OUT = "id long, links long, compared long, a long, b long"


def _filed(batches: Iterator[pa.RecordBatch], rank: np.ndarray, shared: int) -> Iterator[pa.RecordBatch]:
    """Each described vector once for each list it belongs to; ``near`` becomes ascending ranks."""
    for batch in batches:
        near = np.frombuffer(b"".join(batch["near"].to_pylist()), ">u2").reshape(batch.num_rows, -1)
        ranks = np.sort(rank[near], axis=1).astype(">u2")
        files = ranks.shape[1] - shared + 1
        step = max(1, _BLOCK_BYTES * 8 // (files * max(1, batch["vec"].nbytes // max(1, batch.num_rows))))
        for at in range(0, batch.num_rows, step):
            part, own = batch.slice(at, step), ranks[at : at + step]
            rows = pa.array(np.repeat(np.arange(len(own)), files))
            columns = [part[c].take(rows) for c in ("label", "dims")] + [pa.array(own[:, :files].ravel().astype(np.int32))]
            columns += [pa.array([x.tobytes() for x in own], pa.binary()).take(rows)] + [part[c].take(rows) for c in ("id", "n", "vec")]
            yield pa.RecordBatch.from_arrays(columns, ["label", "dims", "list", "near", "id", "n", "vec"])


def _listed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted lists cut into blocks; ``common`` are the rarer pivots that all of a block's members have."""
    names = [x.split()[0] for x in _LISTED.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 4 + [pa.list_(pa.int32())]
    key, held, size = None, [], 0

    def close() -> pa.RecordBatch:
        ids, n = (np.array([x[i] for x in held], np.int64).tobytes() for i in (0, 1))
        near = b"".join(x[2] for x in held)
        pivots, times = np.unique(np.frombuffer(near, ">u2"), return_counts=True)
        common = pivots[(times == len(held)) & (pivots < key[2])].tolist()
        row = (*key, held[0][0], ids, n, near, b"".join(x[3] for x in held), common)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("label", "dims", "list", "id", "n", "near", "vec")]
        for label, dims, pivot, *entry in zip(*columns, strict=True):
            if (label, dims, pivot) != key or len(held) == most or size >= _BLOCK_BYTES:
                if held:
                    yield close()
                key, held, size = (label, dims, pivot), [], 0
            held.append(entry)
            size += len(entry[3])
    if held:
        yield close()


def _within_lists(batches: Iterator[pa.RecordBatch], least: float, shared: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Two blocks of a list, or one with itself: shared pivots are counted, and the pairs of this
    list that share enough are verified."""
    for batch in batches:
        for row in batch.to_pylist():
            same = "no_y" not in row
            sides = []
            for s in ("x",) if same else ("x", "y"):
                ids, n = (np.frombuffer(row[f"{c}_{s}"], np.int64) for c in ("ids", "n"))
                near = np.frombuffer(row[f"near_{s}"], ">u2").reshape(len(ids), -1).astype(np.int64)
                unit = _unit(np.frombuffer(row[f"vec_{s}"], kind).reshape(len(ids), -1).astype(float))
                sides.append((ids, n, near, unit))
            (ids_x, n_x, near_x, x), (ids_y, n_y, near_y, y) = sides[0], sides[-1]
            both = np.intersect1d(near_x, near_y)
            hits = []
            for near in (near_x,) if same else (near_x, near_y):
                place = np.minimum(np.searchsorted(both, near), len(both) - 1)
                has = np.zeros((len(near), len(both)), np.float32)
                i, j = np.nonzero(both[place] == near)
                has[i, place[i, j]] = 1
                hits.append(has)
            first = int(np.searchsorted(both, row["list"]))
            candidates = hits[0][:, first:] @ hits[-1][:, first:].T >= shared
            if first:
                # A pair that shares a rarer pivot belongs to that one's list.
                candidates &= hits[0][:, :first] @ hits[-1][:, :first].T == 0
            if same:
                np.fill_diagonal(candidates, False)
            i, j = np.nonzero(candidates)
            if not len(i):
                continue
            linked = np.zeros(candidates.shape, bool)
            if 16 * len(i) < candidates.size:
                step = max(1, _BLOCK_BYTES // x.shape[1])
                close = [np.einsum("ij,ij->i", x[i[a : a + step]], y[j[a : a + step]]) >= least for a in range(0, len(i), step)]
                linked[i, j] = np.concatenate(close)
            else:
                linked = candidates & (x @ y.T >= least)
            yield _told(ids_x, n_x, ids_y, n_y, linked, (candidates.sum(1), candidates.sum(0)), same)


def _told(
    ids_x: np.ndarray, n_x: np.ndarray, ids_y: np.ndarray, n_y: np.ndarray, linked: np.ndarray, compared: tuple[np.ndarray, np.ndarray], same: bool
) -> pa.RecordBatch:
    """Counts of links and of compared vectors for each vector, and a spanning set of links."""
    if same:
        linked = linked | linked.T
        ids, links, tried, whole = ids_x, linked @ n_x, compared[0], linked
    else:
        ids, links, tried = np.concatenate([ids_x, ids_y]), np.concatenate([linked @ n_y, linked.T @ n_x]), np.concatenate(compared)
        whole = np.zeros((len(ids), len(ids)), bool)
        whole[: len(ids_x), len(ids_x) :] = linked
        whole |= whole.T
    linking = np.flatnonzero(links)
    # Vectors without a link have nothing to span.
    a, b = _spanning(whole[np.ix_(linking, linking)], ids[linking])
    some = tried > 0
    m, k = int(some.sum()), len(a)
    columns = [[*ids[some].tolist(), *[None] * k], [*links[some].tolist(), *[None] * k], [*tried[some].tolist(), *[None] * k], [*[None] * m, *a], [*[None] * m, *b]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "links", "compared", "a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, most: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Sorted descriptions cut into blocks of one label and number of dimensions; a
    block's number is its first id."""
    key, held = None, []

    def close() -> pa.RecordBatch:
        unit = _unit(np.frombuffer(b"".join(x[2] for x in held), kind).reshape(len(held), -1).astype(float))
        angles = np.arccos(np.clip(_cosines(unit, pivots), -1, 1)).astype(np.float32)
        row = (*key, held[0][0], *(np.array([x[i] for x in held], np.int64).tobytes() for i in (0, 1)), unit.tobytes(), angles.min(0), angles.max(0))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("label", "dims", "id", "n", "vec")]
        for label, dims, *entry in zip(*columns, strict=True):
            if (label, dims) != key or len(held) == min(most, max(1, _BLOCK_BYTES // (8 * dims))):
                if held:
                    yield close()
                key, held = (label, dims), []
            held.append(entry)
    if held:
        yield close()


def _across(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links between two blocks, or inside one: a count for each vector, and a spanning set."""
    for batch in batches:
        for row in batch.to_pylist():
            ids_x, n_x, ids_y, n_y = (np.frombuffer(row[c], np.int64) for c in ("ids_x", "n_x", "ids_y", "n_y"))
            x, y = (np.frombuffer(row[f"unit_{s}"], float).reshape(-1, row["dims"]) for s in "xy")
            same = row["no_x"] == row["no_y"]
            linked = x @ y.T >= least
            if same:
                np.fill_diagonal(linked, False)
            tried = np.full(len(ids_x), len(ids_y) - same), np.full(len(ids_y), len(ids_x) - same)
            yield _told(ids_x, n_x, ids_y, n_y, linked, tried, same)


def _by_lists(described: DataFrame, n_pivots: int, least: float, shared: int, kind: str) -> DataFrame:
    """Links among vectors that share at least ``shared`` pivots."""
    most, shared = _BLOCK, min(shared, NEAREST, n_pivots)
    # One row for each pivot, MOST_PIVOTS at most. Counts are over all vectors.
    pivots = F.transform(F.sequence(F.lit(1), F.octet_length("near"), F.lit(2)), lambda i: F.conv(F.hex(F.substring("near", i, F.lit(2))), 16, 10).cast("int"))
    times = np.zeros(n_pivots, np.int64)
    for r in described.select(F.explode(pivots).alias("p")).groupBy("p").count().collect():
        times[r["p"]] = r["count"]
    rank = np.empty(n_pivots, np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(n_pivots)
    key, order = ["label", "dims", "list"], ["label", "dims", "list", "near", "id"]
    filed = described.mapInArrow(lambda b: _filed(b, rank, shared), _LISTS)
    blocks = store(filed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _listed(b, most), _LISTED), "lists")
    side = lambda rows, s: rows.select(*key, *(F.col(c).alias(f"{c}_{s}") for c in ("no", "ids", "n", "near", "vec", "common")))
    compare = lambda rows: rows.mapInArrow(lambda b: _within_lists(b, least, shared, kind), _OUT)
    alone = side(blocks, "x").select("list", "no_x", "ids_x", "n_x", "near_x", "vec_x")
    # Only lists of several blocks are joined, and their blocks dealt out by shares.
    several = store(blocks.groupBy(*key).agg(F.count("*").alias("blocks")).where("blocks > 1"), "several")
    largest = several.agg(F.max("blocks")).first()[0] or 1
    shares = min(_MOST_SHARES, -(-largest // _SHARE))
    long = blocks.join(several.drop("blocks"), key, "left_semi")
    x = side(long, "x").withColumn("share", F.pmod(F.xxhash64("no_x"), F.lit(shares)).cast("int"))
    y = side(long, "y").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    pairs = x.join(y, [*key, "share"]).where((F.col("no_x") < F.col("no_y")) & ~F.arrays_overlap("common_x", "common_y"))
    pairs = pairs.select("list", *(f"{c}_{s}" for s in "xy" for c in ("no", "ids", "n", "near", "vec")))
    return store(compare(alone).unionAll(compare(pairs)), "shared")


def _by_bounds(described: DataFrame, pivots: np.ndarray, least: float, angle: float, kind: str) -> DataFrame:
    """Links among all vectors of a label, but for blocks that are proven too far apart."""
    most = _BLOCK
    order = ("label", "dims", "near", "id")
    blocks = store(described.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _blocks(b, pivots, most, kind), _BLOCKS), "blocks")
    key = ["label", "dims"]
    largest = blocks.groupBy(*key).count().agg(F.max("count")).first()[0] or 1
    shares = min(_MOST_SHARES, -(-largest // _SHARE))
    side = lambda s: blocks.select(*key, *(F.col(c).alias(f"{c}_{s}") for c in ("no", "ids", "n", "unit", "low", "high")))
    x = side("x").withColumn("share", F.pmod(F.xxhash64("no_x"), F.lit(shares)).cast("int"))
    y = side("y").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    apart = lambda low, high: F.exists(F.zip_with(low, high, lambda p, q: p - q), lambda d: d > F.lit(angle + _SLACK))
    pairs = x.join(y, [*key, "share"]).where((F.col("no_x") <= F.col("no_y")) & ~apart("low_x", "high_y") & ~apart("low_y", "high_x"))
    pairs = pairs.select("dims", *(f"{c}_{s}" for s in "xy" for c in ("no", "ids", "n", "unit")))
    return store(pairs.mapInArrow(lambda b: _across(b, least), _OUT), "across")


def link_vectors(vectors: DataFrame, *, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shared: int = SHARED, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector.

    Vectors of equal label are linked at a cosine of ``least`` or more. A null, zero or
    empty vector, one with null or non-finite components, and one without a label link
    with nothing; nor do vectors of different numbers of dimensions. Equal vectors
    are folded into one before anything is compared, and count as links of each other.
    A vector without an id is left out of ids of components but counts as a link.
    Other columns are ignored; an empty table gives no rows.

    Pairs that share ``shared`` of their ``NEAREST`` nearest pivots are verified, whatever
    their number; none is capped. Linked vectors nearly always do (the README lists recall);
    ``exact`` finds every link, comparing all blocks of a label that no pivot rules out.
    ``n_compared`` tells how many other different vectors a vector was verified against.

    The pivots are those of a sample of at most ``MOST_PIVOTS`` vectors, of smallest hash, that
    are farther apart than linked vectors: a dense group has few of its own. Every vector is
    filed. The blocks of a list are dealt out, so one with most vectors is many tasks. What
    leaves a task is a count for each vector and a spanning set of links, never all pairs.
    Where pivots tell nothing apart, the work grows with the square of a label's distinct vectors.
    """
    rows = checked(vectors, id_col, vector_col, label_col).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("int").alias("label")
    )
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    sound = F.coalesce(sound, F.lit(False))
    classes = rows.where(sound).groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = store(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(4 * classes.count() ** 0.5)))
    sample = [r["v"] for r in classes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(wanted).collect()]
    width = max(map(len, sample), default=1)
    pivots = _unit(np.array([x + [0.0] * (width - len(x)) for x in sample], float).reshape(len(sample), width)) if sample else np.ones((1, 1))
    angle = float(np.arccos(np.clip(least, -1, 1)))
    pivots = far_apart(pivots, angle)
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    described = store(
        classes.select("id", "n", "label", "v").mapInArrow(lambda b: _described(b, pivots, kind), "label int, dims int, near binary, id long, n long, vec binary"), "described"
    )
    both = _by_bounds(described, pivots, least, angle, kind) if exact else _by_lists(described, len(pivots), least, shared, kind)
    links = both.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"), F.sum("compared").alias("compared"))
    roots = connected_components(both.where("a is not null").select("a", "b")).withColumnRenamed("node", "id")
    joined = classes.join(links, "id", "left").join(roots, "id", "left")
    joined = store(joined.select("label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"), F.coalesce("compared", F.lit(0)).alias("n_compared")), "rooted")
    least_of = joined.groupBy("root").agg(F.min("least").alias("component"))
    known = joined.join(least_of, "root").select("label", "v", "n_links", "component", "n_compared")
    out = rows.where(sound).join(known, ["label", "v"]).select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"), "n_compared")
    rest = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_compared"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
