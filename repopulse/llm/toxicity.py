"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>) over the terms i of
a document. The pairwise part, computed as half the square of the sum minus the
sum of squares, learns that an insult next to a group is worse than either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repopulse.llm.storage import checked, store
from repopulse.llm.terms import Terms, fitting_rows, id_bit, id_map, packed_terms, picked, placed_texts, ragged, sums, telling_bins

#: Labelled documents that weights are fitted on at most (those of smallest id hash); terms are counted over all.
FIT_ROWS = 20_000
_FACTORS, _EPOCHS, _BATCH, _RATE, _DECAY = 8, 15, 256, 0.1, 1e-5


@dataclass(frozen=True)
class FactorizationMachine:
    places: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of documents; their terms follow one another, ``counts`` of them each."""
        v = self.factors[flat]
        pairs = 0.5 * ((sums(v, counts) ** 2).sum(1) - sums((v * v).sum(1), counts))
        return self.bias + sums(self.linear[flat], counts) + pairs


def fit_machine(places: dict[int, int], rows: list[list[int]], toxic: np.ndarray, seed: int = 11) -> FactorizationMachine:
    """AdaGrad on the logistic loss, both classes weighing as they occur."""
    n = len(places)
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(n), rng.normal(0, 0.02, (n, _FACTORS))
    flat, counts = ragged(rows)
    rate = min(max((toxic.sum() + 0.5) / (len(toxic) + 1), 1e-4), 1 - 1e-4) if len(toxic) else 0.01
    bias = float(np.log(rate / (1 - rate)))
    g_bias, g_linear, g_factors = 1e-6, np.full(n, 1e-6), np.full((n, _FACTORS), 1e-6)
    for _ in range(_EPOCHS if len(rows) and n else 0):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // _BATCH)):
            (x, own), y = picked(flat, counts, at), toxic[at]
            d_bias, d_linear, d_factors = gradient(bias, linear, factors, x, own, y)
            d_linear += _DECAY * linear
            d_factors += _DECAY * factors
            g_linear += d_linear**2
            g_factors += d_factors**2
            g_bias += d_bias**2
            linear -= _RATE * d_linear / np.sqrt(g_linear)
            factors -= 0.5 * _RATE * d_factors / np.sqrt(g_factors)
            bias -= _RATE * d_bias / np.sqrt(g_bias)
    return FactorizationMachine(places, bias, linear, factors)


def gradient(
    bias: float, linear: np.ndarray, factors: np.ndarray, flat: np.ndarray, counts: np.ndarray, toxic: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Of the mean logistic loss of documents by bias, linear weights and factors."""
    v = factors[flat]
    total = sums(v, counts)
    m = bias + sums(linear[flat], counts) + 0.5 * ((total**2).sum(1) - sums((v * v).sum(1), counts))
    e = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - toxic) / len(toxic)
    d_v = np.repeat(e, counts)[:, None] * (np.repeat(total, counts, axis=0) - v)
    by_term = [np.bincount(flat, d_v[:, k], len(linear)) for k in range(factors.shape[1])]
    return e.sum(), np.bincount(flat, np.repeat(e, counts), len(linear)), np.stack(by_term, 1)


def train(labelled: DataFrame, counted: DataFrame | None = None) -> FactorizationMachine:
    """Fit on ``labelled`` (text, toxic). Rows without a label are left out; without
    any labelled row the machine says the same for every text. Terms are chosen by
    all rows of ``counted`` (bins, toxic; from ``labelled_terms``) if ``labelled`` is a
    sample."""
    graded = labelled.where(F.col("toxic").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("grade"))
    whole = graded if counted is None else counted.where(F.col("toxic").isNotNull()).select("bins", F.col("toxic").cast("int").alias("grade"))
    places = telling_bins(whole, least_z=5.0)
    rows, toxic = fitting_rows(graded, places, most=FIT_ROWS)
    return fit_machine(places, rows, np.minimum(toxic, 1).astype(float))


def _scored(batches: Iterator[pa.RecordBatch], machine: FactorizationMachine, at: int) -> Iterator[pa.RecordBatch]:
    terms = Terms(machine.places)
    for batch in batches:
        m = np.concatenate([np.zeros(0), *[machine.margins(*own) for own in placed_texts(terms, batch.column(at))]])
        score = pa.array(1 / (1 + np.exp(-np.clip(m, -40, 40))))
        yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])


def score_documents(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with ``score_col`` from 0 to 1, higher for toxic.

    A null text is scored as an empty one; repeated rows get equal scores; a column
    that is already called ``score_col`` is replaced. The machine, 72 bytes a
    term and so 19 MB at most, goes to the tasks with the code.
    """
    kept = docs.drop(score_col)
    at = kept.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double"
    return kept.mapInArrow(lambda b: _scored(b, machine, at), schema).withColumnRenamed("score", score_col)


def learning_rows(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_ROWS
) -> DataFrame:
    """Texts and labels of at most ``most`` labelled ids outside the held-out third
    (``held_out``), read once and stored; the ids are those of smallest hash.

    Of several labels for one id the largest counts; null ids and labels are left out.
    The ids are chosen before any text is read; they are broadcast, 16 bytes each, so
    texts are never shuffled.
    """
    known = _known(labels, id_col, label_col).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = checked(docs, id_col, text_col)
    rows = texts.join(F.broadcast(known), texts[id_col] == known["id"]).select(F.col(text_col).alias("text"), F.col("label").alias(label_col))
    return store(rows, "learning")


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    rows = checked(labels, id_col, label_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))


def labelled_terms(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Packed bins and labels of all labelled ids outside the held-out third; labels
    count as in ``learning_rows``. Two bytes a term are joined, never texts.

    Texts that a map of the labelled ids (two megabytes at any size) shows to have no label
    are left out before their terms are made; the join decides on the rest. It is
    a merge join at any size, so a larger table brings no other plan.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = store(_known(labels, id_col, label_col).select(F.col("id").cast(kind).alias("id"), "label"), "known")
    wanted = id_map(known.select("id"))
    texts = checked(docs, id_col, text_col).where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    bins = texts.select(id_col, text_col, id_bit(F.col(id_col)).alias("bit")).mapInArrow(lambda b: packed_terms(b, wanted), f"id {kind}, bins binary")
    return bins.join(known.hint("merge"), "id").select("bins", F.col("label").alias(label_col))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 modulo 3. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
