"""Packing documents into sequences: minimum bin slack by subset sums.

A document's ids are cut at multiples of the capacity: those pieces are whole
sequences. What remains of each document waits in a window. Whenever the window
is full, in pieces and in ids, a bitset dynamic program over the multiset of waiting lengths finds the
sum closest to the capacity that contains the longest-waiting piece, and
backtracks how many pieces of each length make it. At the end of a task no
further piece arrives: a gap is then filled by cutting a waiting piece, and the
last ids of a task, fewer than the capacity, make sequences of powers of two.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.llm.storage import checked
from repopulse.llm.subwords import subwords

#: Pieces that wait, and how many sequences their ids would fill, before one is closed.
_WAITING, _WAITING_FILLS = 48, 4
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum is as large as
    possible without exceeding ``capacity``.

    Bit ``s`` of ``reach[i]`` says whether the first ``i`` parts can sum to ``s``; a
    part is a power of two of pieces of one length (the rest for the last).
    """
    parts: list[tuple[int, int]] = []
    for length in sorted(counts, reverse=True):
        left, k = counts[length], 1
        while left:
            take = min(k, left)
            parts.append((length, take))
            left -= take
            k *= 2
    mask = (1 << (capacity + 1)) - 1
    reach = [1]
    for length, k in parts:
        reach.append((reach[-1] | reach[-1] << length * k) & mask)
        if reach[-1] >> capacity:
            break
    total = reach[-1].bit_length() - 1
    taken: Counter[int] = Counter()
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> total & 1:
            length, k = parts[i - 1]
            taken[length] += k
            total -= length * k
    return dict(taken)


class _Packer:
    """The sequences of one task. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_sequence: int, capacity: int) -> None:
        self.sequence, self.capacity = first_sequence, capacity
        self.waiting: list[tuple] = []
        self.held = 0  # ids that wait
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        for start in range(0, n - c + 1, c):
            self._emit([(doc, start, ids[start : start + c], n)])
        if n % c:
            self.waiting.append((doc, n - n % c, ids[n - n % c :].copy(), n))
            self.held += n % c
        while len(self.waiting) >= _WAITING and self.held >= _WAITING_FILLS * c:
            self._emit(self._choose())

    def _choose(self) -> list[tuple]:
        head = self.waiting.pop(0)
        wanted = closest_fill(Counter(len(x[2]) for x in self.waiting), self.capacity - len(head[2]))
        chosen, rest = [head], []
        for x in self.waiting:
            if wanted.get(len(x[2]), 0):
                wanted[len(x[2])] -= 1
                chosen.append(x)
            else:
                rest.append(x)
        self.waiting = rest
        self.held -= sum(len(x[2]) for x in chosen)
        return chosen

    def finish(self) -> None:
        while self.held >= self.capacity:
            chosen = self._choose()
            gap = self.capacity - sum(len(x[2]) for x in chosen)
            if gap:  # the next piece alone is longer than the gap, or it would have been taken
                chosen += self._cut(gap)
            self._emit(chosen)
        while self.held:
            self._emit(self._cut(1 << self.held.bit_length() - 1))

    def _cut(self, size: int) -> list[tuple]:
        """The first ``size`` waiting ids."""
        out = []
        self.held -= size
        while size:
            doc, start, ids, total = self.waiting.pop(0)
            out.append((doc, start, ids[:size], total))
            if len(ids) > size:
                self.waiting.insert(0, (doc, start + size, ids[size:], total))
            size -= min(size, len(ids))
        return out

    def taken(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in names]
        batch = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names)
        self.rows = []
        return batch


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    tok = subwords(tokenizer)
    packer = _Packer(TaskContext.get().partitionId() << 32, capacity)
    for batch in batches:
        docs, at = batch.column(0).to_pylist(), 0
        for ids, counts in tok.documents(batch.column(1), end_id):
            for own in np.split(ids, np.cumsum(counts)[:-1]):
                packer.add(docs[at], own)
                at += 1
            yield packer.taken()
    packer.finish()
    yield packer.taken()


def pack_documents(
    docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` ids; one row for each piece.

    ``ids`` are little-endian unsigned 32-bit. A null text is empty, and an empty
    text is the end id alone; a null id stays null; rows that share an id are
    packed one by one; other columns are ignored; an empty table gives no rows.

    Each task packs the documents it reads and numbers its sequences from its
    partition number times 2^32: there is no shuffle, no document waits for another
    task, and a repeated task packs the same documents in the same way. A task
    holds the remainders of a few dozen documents, or of as many short ones as fill
    a few sequences. Sequences are as full as whole remainders make them, short and
    empty texts included; a few short ones come at the end of each task.
    """
    rows = checked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _packed(batches, tokenizer, end_id, capacity), _SCHEMA)
