"""Connected components by contraction, on any number of edges.

Every round joins each node to its smallest neighbour, follows those pointers to
their ends and replaces nodes by them; edges inside a component vanish. All steps
are joins on the node and partial minima, so no neighbourhood is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.llm.storage import store


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of longs to (node, root), the smallest node reachable.

    Only nodes with an edge to another node are returned; loops, repeated edges
    and either direction are fine; an edge with a null end is left out; no edges
    give no rows.
    """
    edges = store(_distinct(edges.where("a is not null and b is not null")), "edges")
    roots: DataFrame | None = None
    nodes = 0
    while n := edges.count():
        pointers = _pointers(edges, 2 * n)
        if roots is None:
            roots, nodes = pointers, 2 * n
        else:
            roots = store(_followed(roots, "root", pointers), "roots", nodes)
        a = pointers.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = pointers.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = store(_distinct(moved), "edges", n)
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pointers(edges: DataFrame, nodes: int) -> DataFrame:
    """Each node, of which there are ``nodes`` at most, with the end of its chain of smallest neighbours.
    A node points to a smaller one or to itself, so a chain ends at a node that has no smaller
    neighbour."""
    ways = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("w")).select("w.*")
    pointers = store(ways.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")), "pointers", nodes)
    while True:
        nxt = store(_followed(pointers, "root", pointers), "pointers", nodes)
        moved = nxt.join(pointers.withColumnRenamed("root", "before"), "node").where("root <> before")
        if moved.isEmpty():
            return nxt
        pointers = nxt


def _followed(rows: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by where it points to."""
    to = pointers.select(F.col("node").alias(column), F.col("root").alias("to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("to", column)).select(*rows.columns)
