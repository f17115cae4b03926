"""Quality: cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - x.w): one weight for each hashed term, shared by all
grades, and ordered thresholds t_0 < t_1 < ... The expected grade and the
probability of reaching a wanted grade follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.llm.terms import Terms, fitting_rows, picked, placed_texts, ragged, sums, telling_bins

#: Rated documents the model is fitted on at most (those of smallest text hash); terms are counted over all.
FIT_ROWS = 20_000
_EPOCHS, _BATCH, _RATE, _DECAY = 15, 256, 0.1, 1e-5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class OrdinalModel:
    places: dict[int, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def exceeding(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the top grade; the terms of documents follow one
        another, ``counts`` of them each."""
        return _sigmoid(sums(self.weights[flat], counts)[:, None] - self.thresholds[None, :])


def _ordered(free: np.ndarray) -> np.ndarray:
    """The first threshold, then positive steps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit_ordinal(places: dict[int, int], rows: list[list[int]], grades: np.ndarray, levels: int, seed: int = 13) -> OrdinalModel:
    """AdaGrad on the likelihood; grades are 0 to ``levels`` - 1.

    The thresholds start at the observed shares, so without any term the model
    gives those shares.
    """
    n = len(places)
    share = np.array([((grades <= k).sum() + 0.5) / (len(grades) + 1) for k in range(levels - 1)])
    first = np.log(share / (1 - share))
    steps = np.maximum(np.diff(first), 1e-3)
    free = np.concatenate([first[:1], np.log(steps)])
    w = np.zeros(n)
    g_w, g_free = np.full(n, 1e-6), np.full(len(free), 1e-6)
    flat, counts = ragged(rows)
    rng = np.random.default_rng(seed)
    for _ in range(_EPOCHS if len(rows) and n else 0):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // _BATCH)):
            x, own = picked(flat, counts, at)
            d_w, d_free = gradient(w, free, x, own, grades[at])
            d_w += _DECAY * w
            g_w += d_w**2
            g_free += d_free**2
            w -= _RATE * d_w / np.sqrt(g_w)
            free -= 0.3 * _RATE * d_free / np.sqrt(g_free)
    return OrdinalModel(places, w, _ordered(free))


def gradient(w: np.ndarray, free: np.ndarray, flat: np.ndarray, counts: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean of minus the log likelihood, by the weights and by what the thresholds are made of."""
    levels, y = len(free) + 1, grades
    inner = _ordered(free)[None, :] - sums(w[flat], counts)[:, None]
    cum = _sigmoid(np.concatenate([np.full((len(y), 1), -np.inf), inner, np.full((len(y), 1), np.inf)], 1))
    i = np.arange(len(y))
    low, high = cum[i, y], cum[i, y + 1]
    p = np.maximum(high - low, 1e-9)
    slope_low, slope_high = low * (1 - low), high * (1 - high)
    e = (slope_high - slope_low) / p / len(y)
    d_t = np.zeros(levels + 1)
    np.add.at(d_t, y + 1, -slope_high / p / len(y))
    np.add.at(d_t, y, slope_low / p / len(y))
    tail = np.cumsum(d_t[1:levels][::-1])[::-1]
    return np.bincount(flat, np.repeat(e, counts), len(w)), tail * np.concatenate([[1.0], np.exp(free[1:])])


def train_ordinal(rated: DataFrame, levels: int, counted: DataFrame | None = None) -> OrdinalModel:
    """Fit on ``rated`` (text, grade from 0 to ``levels`` - 1); rows without a grade
    are left out, grades beyond the range count as its ends. Terms are chosen by all
    rows of ``counted`` (bins, grade) if ``rated`` is a sample."""
    grade = F.least(F.greatest(F.col("grade").cast("int"), F.lit(0)), F.lit(levels - 1)).alias("grade")
    graded = rated.where(F.col("grade").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), grade)
    whole = graded if counted is None else counted.where(F.col("grade").isNotNull()).select("bins", grade)
    places = telling_bins(whole, least_z=5.0)
    rows, grades = fitting_rows(graded, places, most=FIT_ROWS)
    return fit_ordinal(places, rows, grades, levels)


def _rated(batches: Iterator[pa.RecordBatch], model: OrdinalModel, wanted: int, at: int) -> Iterator[pa.RecordBatch]:
    terms = Terms(model.places)
    for batch in batches:
        above = [model.exceeding(*own) for own in placed_texts(terms, batch.column(at))]
        above = np.concatenate([np.zeros((0, len(model.thresholds))), *above])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(above.sum(1)), pa.array(np.ascontiguousarray(above[:, wanted - 1]))],
            [*batch.schema.names, "expected_grade", "tail_probability"],
        )


def rate_documents(docs: DataFrame, model: OrdinalModel, wanted: int, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``expected_grade`` and
    ``tail_probability``, the probability of grade ``wanted`` (1 at least) or better.

    A null text is rated as an empty one; repeated rows get equal ratings; columns
    that already have those names are replaced; an empty table stays empty.
    """
    kept = docs.drop("expected_grade", "tail_probability")
    at = kept.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", expected_grade double, tail_probability double"
    return kept.mapInArrow(lambda b: _rated(b, model, wanted, at), schema)
