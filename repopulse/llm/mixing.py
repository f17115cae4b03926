"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, how often it is taken. Of all rates for which every
source reaches its target of words, those nearest to 1 in relative entropy, and not
above ``most``, are r = min(most, exp(lambda * size / scale)), one lambda for each
source. The convex dual is solved by Newton steps for all sources at once; a step is
one aggregate over the histogram of document sizes. Rates are then rounded into
whole copies, and what rounding adds or leaves goes on to the next smaller document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repopulse.llm.storage import store

WORD = r"[^\x20\x09-\x0D]+"
_MADE = ("size", "source_size", "target", "rate", "copies", "taken")
_STEPS, _NEAR, _ROWS_OF_BUCKET = 80, 1e-9, 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sources`` (source, source_size, docs) with ``target``.

    Sources by code point, null last, have the weights in turn and share all words.
    A target stops at ``most`` times its source; the excess goes to the others by
    weight. With sources sorted by where they stop, the stopped ones come first, so
    prefix sums give the level for each possible number of stopped sources; the
    smallest number whose level stops no further source is right. One row for each
    source: the windows are over those alone.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(named) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("stop") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(below), F.lit(0.0)))
    rows = rows.withColumn("sharing", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.col("left") / F.col("sharing"))
    rows = rows.withColumn("rank", F.row_number().over(order))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(everything)["level"]
    target = F.least(F.col("weight") * F.coalesce(found, F.lit(0.0)), F.col("stop"))
    return rows.withColumn("target", target).select("source", "source_size", "docs", "target")


def _newton(histogram: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``targets`` with ``scale`` and ``lam``; a null ``lam`` takes every document ``most`` times."""
    scales = histogram.groupBy("source").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("scale"))
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    state = targets.join(scales, targets["source"].eqNullSafe(scales["source"])).drop(scales["source"])
    state = state.withColumn("lam", F.when(full | (F.col("source_size") == 0), F.lit(None)).otherwise(F.lit(0.0)))
    state = state.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf")), "off": F.lit(1.0)})
    for _ in range(_STEPS):
        state = store(state, "dual")
        if state.where(F.col("lam").isNotNull() & (F.col("off") > _NEAR)).isEmpty():
            break
        rows = histogram.join(state.select(F.col("source").alias("of"), "lam", "scale"), F.col("source").eqNullSafe(F.col("of")))
        z = F.col("size") / F.col("scale")
        grown = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
        words = F.col("n") * F.col("size") * F.least(grown, F.lit(float(most)))
        slope = F.when(grown < most, F.col("n") * F.col("size") * z * grown).otherwise(0.0)
        # Decimals: the sums, and so the rates, don't depend on the order of rows.
        sums = rows.groupBy("of").agg(*[F.sum(x.cast("decimal(38,8)")).cast("double").alias(k) for k, x in (("words", words), ("slope", slope))])
        gap = F.col("words") - F.col("target")
        state = state.join(sums, F.col("source").eqNullSafe(F.col("of"))).withColumns(
            {"off": F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)), "low": F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))}
        )
        # A step beyond what is known of the solution is halved into it; without a bound it is kept short.
        step = F.when(F.col("slope") > 0, F.greatest(F.least(-gap / F.col("slope"), F.lit(4.0)), F.lit(-4.0))).otherwise(F.when(gap < 0, 4.0).otherwise(-4.0))
        new = F.col("lam") + step
        inside = (new > F.col("low")) & (new < F.col("high"))
        bounded = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
        lam = F.when(F.col("off") <= _NEAR, F.col("lam")).when(inside, new).when(bounded, (F.col("low") + F.col("high")) / 2).otherwise(F.col("lam") + F.signum(step) * 4)
        state = state.withColumn("lam", lam).select("source", "source_size", "docs", "target", "scale", "lam", "low", "high", "off")
    return state


def _rounded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Copies of rows sorted by bucket and falling size."""
    bucket, owed = None, 0.0
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        keys = zip(batch.column(at["source"]).to_pylist(), batch.column(at["bucket"]).to_pylist(), strict=True)
        copies = np.ones(batch.num_rows, np.int32)
        sizes, rates = (batch.column(at[c]).to_pylist() for c in ("size", "rate"))
        for i, (key, size, rate) in enumerate(zip(keys, sizes, rates, strict=True)):
            if key != bucket:
                bucket, owed = key, 0.0
            if size:
                owed += rate * size
                copies[i] = min(most, max(0, round(owed / size)))
                owed -= int(copies[i]) * size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies)], [*batch.schema.names, "copies"])


def mix_documents(
    docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with size, source_size, target,
    rate, copies and taken (copies times size), one row per document.

    A null text has size 0; a null source is a source of its own, the last; texts
    without words take nothing and count one copy; repeated rows are rounded one by
    one; an empty table gives no rows. Columns of ``docs`` that are called like a made
    one are replaced. Reruns agree: sums are decimals and rounding follows size, id
    and text hash.

    Rounding deals a source out by a hash of the document over buckets of about
    4,096 documents, so a source with a third of all rows is many small tasks.
    """
    kept = [c for c in (keep or docs.columns) if c not in _MADE]
    rows = docs.select(
        F.struct(*kept).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col) if keep is None else F.lit(0)).alias("hash"),
    )
    histogram = store(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    solved = _newton(histogram, store(source_targets(sources, weights, most), "targets"), float(most))
    of = solved.select(F.col("source").alias("of"), "source_size", "docs", "target", "scale", "lam")
    rate = F.when(F.col("lam").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.round("lam", 9) * F.col("size") / F.col("scale"), F.lit(50.0)))))
    buckets = F.ceil(F.col("docs") / _ROWS_OF_BUCKET)
    # A few sources beside all documents: the planner broadcasts them while they are small.
    rated = rows.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumns({"rate": rate, "bucket": F.pmod("hash", F.greatest(buckets, F.lit(1)))})
    rated = rated.select("row", "source", "size", "source_size", "target", "rate", "bucket", "id", "hash")
    dealt = rated.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("size").desc(), "id", "hash")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rated.schema) + ", copies int"
    out = dealt.mapInArrow(lambda b: _rounded(b, most), schema)
    return out.select("row.*", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
