"""Exact top-k by inner product: Fagin's threshold algorithm.

Candidates are dealt into tiles. In a tile each dimension has a list of its
candidates sorted by component; for a query, the list of a dimension is read from
its large end if the query's component is positive, else from its small end. All
lists are read in step: every candidate met is scored in full, and the components
at the current depth bound the score of whatever was not met yet. Reading stops
once that bound cannot beat the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repopulse.llm.storage import checked, store

_TILE, _QUERIES, _FIRST_DEPTH = 8192, 4096, 64


class Tile:
    """Candidates with their sorted lists. Scores are exact: doubles hold them if they are below 2^53, else integers are used."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.falling = np.argsort(-self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self.largest = float(np.abs(self.vectors).max(initial=0))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates other than ``query_id``; ties by id."""
        m, d = self.vectors.shape
        exact = self.largest * float(np.abs(query).max(initial=0)) * max(1, d) < 2**53
        vectors, q = (self.vectors.astype(float), query.astype(float)) if exact else (self.vectors, query)
        lists = np.where((query >= 0)[:, None], self.falling, self.falling[:, ::-1])
        seen = self.ids == query_id
        best, scores, depth = np.zeros(0, np.int64), np.zeros(0, q.dtype), 0
        while depth < m:
            to = min(m, max(_FIRST_DEPTH, depth * 4))
            new = np.zeros(m, bool)
            new[lists[:, depth:to].ravel()] = True
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            best, scores = np.concatenate([best, at]), np.concatenate([scores, vectors[at] @ q])
            keep = np.lexsort((best, -scores))[:k]
            best, scores, depth = best[keep], scores[keep], to
            bound = (vectors[lists[:, depth - 1], np.arange(d)] * q).sum()
            # An equal score could still have a smaller id.
            if len(best) == k and bound < scores[-1] or seen.all():
                break
        return self.ids[best], scores.astype(np.int64)


def _quantised(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Usable rows as tiles' raw material: id, dimensions and integers as bytes."""
    for batch in batches:
        ids, dims, data = [], [], []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or x is None or None in x:
                continue
            v = np.array(x, float)
            if np.isfinite(v).all():
                ids.append(i)
                dims.append(len(v))
                data.append(np.floor(scale * v).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "dims", "data"])


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            d = row["dims"]
            ids = np.array([x["vec_id"] for x in row["candidates"]], np.int64)
            tile = Tile(ids, np.frombuffer(b"".join(x["data"] for x in row["candidates"]), "<i8").reshape(len(ids), d))
            out = []
            for x in row["queries"]:
                own, scores = tile.top(x["vec_id"], np.frombuffer(x["data"], "<i8"), k)
                out += [(x["vec_id"], i, s) for i, s in zip(own.tolist(), scores.tolist(), strict=True)]
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every id divisible by ``every``.

    Components x count as floor(scale * x). Vectors that are null, without an id, or
    hold null or non-finite components take no part; vectors of another number of
    dimensions are no candidates; rows with the query's own id are none either. Ties
    go to the smaller id; of repeated rows each is a candidate. A query with fewer
    candidates returns all; an empty table gives no rows. Scores have to fit into
    64 bits.

    Queries and candidates are dealt into tiles by hash. Each pair of tiles is one
    unit of work with at most k rows for each query, so no task sees more than two
    tiles at a time, whatever the number of rows.
    """
    rows = checked(vectors, id_col, vector_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = store(rows.mapInArrow(lambda b: _quantised(b, scale), "vec_id long, dims int, data binary"), "vectors")
    is_query = F.col("vec_id") % every == 0
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries")).first()
    tiles, blocks = max(1, -(-counted["n"] // _TILE)), max(1, -(-counted["queries"] // _QUERIES))
    # Equal rows spread as well: the tile follows the row's number in its task.
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(tiles))
    packed = F.collect_list(F.struct("vec_id", "data"))
    candidates = rows.withColumn("tile", dealt).groupBy("dims", "tile").agg(packed.alias("candidates"))
    queries = rows.where(is_query).distinct().groupBy("dims", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(packed.alias("queries"))
    left = candidates.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = queries.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    # The number of partitions is given, or adaptive execution would put several pairs into one task.
    pairs = left.join(right, ["dims", "tile", "block"]).repartition(tiles * blocks, "dims", "tile", "block")
    best = pairs.select("dims", "candidates", "queries").mapInArrow(lambda b: _searched(b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
