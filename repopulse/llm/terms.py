"""Hashed terms of whole texts, and the terms that go with a grade.

Terms are words (letters, digits), runs of other signs, and the first four and
five letters of words, lower-cased and hashed into ``BINS``. A document has a
term or not; how often does not count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repopulse.llm.storage import store
from repopulse.llm.subwords import forget

BINS = 1 << 18
_TERM = re.compile(r"\w+|[^\w\s]+")
#: The texts that models are fitted on have so many terms together at most.
FIT_TERMS = 8_000_000
#: Words kept in each of two generations, the longest of them, and bytes of text worked on at once.
_KEPT, _LONGEST, _AT_ONCE = 40_000, 40, 1_000_000


def _bins(word: str) -> tuple[int, ...]:
    own = [word]
    if len(word) > 4 and word[0].isalnum():
        own += ["4" + word[:4], "5" + word[:5]] if len(word) > 5 else ["4" + word[:4]]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BINS for x in own)


class Terms:
    """Bins of texts. Words met lately are looked up: when a generation of them is
    full, the one before it is forgotten. ``only`` maps the wanted bins to their places."""

    def __init__(self, only: dict[int, int] | None = None) -> None:
        forget()
        self._only, self._new, self._old = only, {}, {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        found = self._new.get(word)
        if found is None:
            found = self._old.get(word)
            if found is None:
                found = _bins(word)
                if self._only is not None:
                    found = tuple(self._only[b] for b in found if b in self._only)
            if len(word) <= _LONGEST:
                if len(self._new) >= _KEPT:
                    self._old, self._new = self._new, {}
                self._new[word] = found
        return found

    def of(self, text: str | None) -> set[int]:
        return set(chain.from_iterable(map(self._of_word, set(_TERM.findall((text or "").lower())))))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of about a megabyte of text, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, side="right")))
        yield at, stop
        at = stop


def placed_texts(terms: Terms, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The terms of consecutive texts, one text after another, and how many each has."""
    for at, stop in slices(texts):
        yield ragged([sorted(terms.of(x)) for x in texts.slice(at, stop - at).to_pylist()])


def ragged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after another, and their lengths."""
    flat = np.fromiter(chain.from_iterable(rows), np.int64, sum(map(len, rows)))
    return flat, np.array([len(x) for x in rows], np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``counts`` rows; an empty stretch sums to zero."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def picked(flat: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the rows, one after another."""
    own, starts = counts[at], (np.cumsum(counts) - counts)[at]
    return flat[np.arange(own.sum()) + np.repeat(starts - (np.cumsum(own) - own), own)], own


def packed(bins: set[int]) -> bytes:
    """Two bytes a bin: how many have each pair of top bits, then the low 16 bits in order."""
    own = np.sort(np.fromiter(bins, np.int64, len(bins)))
    return np.bincount(own >> 16, minlength=BINS >> 16).astype("<u4").tobytes() + (own & 0xFFFF).astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    tops = BINS >> 16
    heads = np.repeat(np.arange(tops) << 16, np.frombuffer(data, "<u4", tops))
    return heads + np.frombuffer(data, "<u2", offset=4 * tops)


def packed_terms(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ids, texts and bit numbers to ids and packed bins, where the bit is set in ``wanted``."""
    terms = Terms()
    for batch in batches:
        bits = batch.column(2).to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array((wanted[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1))
        for at, stop in slices(batch.column(1)):
            own = [packed(terms.of(x)) for x in batch.column(1).slice(at, stop - at).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(own, pa.binary())], ["id", "bins"])


#: Bits of the map of labelled ids, and of one of its blocks.
_MAP_BITS, _BLOCK_BITS = 1 << 24, 1 << 15


def id_bit(identifier: Column) -> Column:
    """The bit of an id in a map of ids."""
    return F.pmod(F.xxhash64(identifier), F.lit(_MAP_BITS))


def id_map(ids: DataFrame) -> np.ndarray:
    """Two megabytes in which the bit of every id of ``ids`` (id) is set, whatever their number."""
    block = F.floor(id_bit(F.col("id")) / _BLOCK_BITS)
    rows = ids.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(id_bit(F.col("id")) % _BLOCK_BITS).alias("bits")).collect()
    out = np.zeros(_MAP_BITS // 8, np.uint8)
    for r in rows:
        at = r["block"] * (_BLOCK_BITS // 8)
        out[at : at + _BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For this task and each grade: documents in all, and with each bin."""
    terms, counts = Terms(), {}
    for batch in batches:
        for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(grade, np.zeros(BINS + 1, np.int64))
            own[BINS] += 1
            own[unpacked(text) if isinstance(text, bytes) else list(terms.of(text))] += 1
    for grade, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), grade, np.int64)), pa.array(own[at])], ["bin", "grade", "docs"])


def telling_bins(graded: DataFrame, *, least_z: float, least_docs: int = 4) -> dict[int, int]:
    """Bins whose documents have another mean grade than all, by all rows of ``graded``
    (text, or packed bins, and grade).

    The statistic is the distance of the bin's mean grade from the overall mean in
    standard errors. All bins of ``least_z`` or more are kept: common words never push
    rare ones out. There are ``BINS`` at most, so what reaches the driver is bounded,
    whatever the input.
    """
    tally = (
        graded.select("bins" if "bins" in graded.columns else "text", F.col("grade").cast("long").alias("grade"))
        .mapInArrow(_tallies, "bin long, grade long, docs long")
        .groupBy("bin")
        .agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("grade")).alias("s"), F.sum(F.col("docs") * F.col("grade") * F.col("grade")).alias("ss"))
    )
    tally = store(tally, "terms")
    whole = tally.where(F.col("bin") == BINS).first()
    if whole is None or not whole["n"]:
        return {}
    n, mean = whole["n"], whole["s"] / whole["n"]
    var = max(whole["ss"] / n - mean * mean, 1e-12)
    z = F.abs((F.col("s") / F.col("n") - F.lit(mean)) / F.sqrt(F.lit(var) / F.col("n")))
    rows = (
        tally.where((F.col("bin") < BINS) & (F.col("n") >= least_docs) & (F.col("n") <= F.lit(0.9 * n)))
        .withColumn("z", z)
        .where(F.col("z") >= least_z)
        .orderBy(F.col("z").desc(), "bin")
        .select("bin")
        .collect()
    )
    return {r["bin"]: i for i, r in enumerate(rows)}


def fitting_rows(graded: DataFrame, only: dict[int, int], *, most: int, most_terms: int = FIT_TERMS) -> tuple[list[np.ndarray], np.ndarray]:
    """Places and grades of at most ``most`` rows, those of smallest text hash, as long as they
    have ``most_terms`` terms at most together: a bounded sample for the driver."""
    placed = graded.select("text", F.col("grade").cast("long").alias("grade"), F.xxhash64("text", F.lit(7)).alias("hash"))
    chosen = placed.mapInArrow(lambda b: _hashed_places(b, only), "hash long, grade long, places binary").orderBy("hash", "grade").limit(most)
    # ``most`` rows at most reach this window.
    upto = Window.orderBy("hash", "grade").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.sum(F.octet_length("places")).over(upto)
    rows = chosen.withColumn("upto", size).where(F.col("upto") <= 4 * most_terms).select("grade", "places").collect()
    return [np.frombuffer(r["places"], "<i4") for r in rows], np.array([r["grade"] for r in rows], np.int64)


def _hashed_places(batches: Iterator[pa.RecordBatch], only: dict[int, int]) -> Iterator[pa.RecordBatch]:
    terms = Terms(only)
    for batch in batches:
        for at, stop in slices(batch.column(0)):
            own = [np.array(sorted(terms.of(x)), "<i4").tobytes() for x in batch.column(0).slice(at, stop - at).to_pylist()]
            columns = [batch.column(i).slice(at, stop - at) for i in (2, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary())], ["hash", "grade", "places"])
