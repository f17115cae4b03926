"""Chat formatting by columnar byte assembly.

A turn is written as ``### role: text</turn>`` and a line end. Control strings inside
roles and texts get a backslash before them, so they come back unchanged and
never start or end a turn. A batch of turns is assembled as bytes: lengths of the
segments, their cumulative offsets, and the places that each segment's bytes go to
are numpy arrays; headers, contents and ends are scattered into one buffer, which
becomes the Arrow column as it is. The loss mask is a list of spans over the
contents of one role.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.llm.storage import checked, store

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: What gets a backslash: in texts, and in roles, which a colon ends.
TEXT_CONTROLS, ROLE_CONTROLS = r"(\\|###|</turn>)", r"(\\|###|</turn>|:)"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")

#: Bytes that are scattered at once (an index of eight bytes for each); larger segments are copied as slices.
_AT_ONCE = 1 << 20
#: Bytes of one part: a conversation that is longer is written as several parts, each of whole turns.
PART_BYTES = 8 << 20

_COLUMNS = ("conv_id", "part", "text", "n_turns", "loss")
_SCHEMA = "conv_id long, part long, text string, n_turns long, loss array<struct<start:long,length:long>>"


def escaped(texts: pa.Array, controls: str) -> pa.Array:
    return pc.replace_substring_regex(texts, controls, r"\\\1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts and the last one ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), cuts


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy ``data[start : start + length]`` to ``out[to:]`` for each segment."""
    large = np.flatnonzero(length > _AT_ONCE)
    for i in large.tolist():
        out[to[i] : to[i] + length[i]] = data[start[i] : start[i] + length[i]]
    if len(large):
        small = np.flatnonzero(length <= _AT_ONCE)
        to, start, length = to[small], start[small], length[small]
    ends = np.cumsum(length)
    at = 0
    while at < len(length):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + _AT_ONCE, side="right")))
        own = length[at:stop]
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(to[at:stop], own) + within] = data[np.repeat(start[at:stop], own) + within]
        at = stop


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of consecutive turns, the end of each in bytes, and in code points
    the length of what precedes a turn's text and of the text itself, as written."""
    coded = roles.dictionary_encode()
    heads = pc.binary_join_element_wise(OPEN, escaped(coded.dictionary, ROLE_CONTROLS), MIDDLE, "")
    kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    said = escaped(texts, TEXT_CONTROLS)
    head_data, head_cuts = _bytes_of(heads)
    text_data, text_cuts = _bytes_of(said)
    tail = np.frombuffer(CLOSE.encode(), np.uint8)

    head_length, text_length = np.diff(head_cuts)[kind], np.diff(text_cuts)
    ends = np.cumsum(head_length + text_length + len(tail))
    starts = ends - (head_length + text_length + len(tail))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    scatter(out, starts, head_data, head_cuts[:-1][kind], head_length)
    scatter(out, starts + head_length, text_data, text_cuts[:-1], text_length)
    scatter(out, ends - len(tail), tail, np.zeros(len(ends), np.int64), np.full(len(ends), len(tail)))
    head_chars = pc.utf8_length(heads).to_numpy(zero_copy_only=False).astype(np.int64)[kind]
    return out, ends, head_chars, pc.utf8_length(said).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(conv: pa.Array, roles: pa.Array, texts: pa.Array, first: np.ndarray, base: int, loss_role: str) -> pa.RecordBatch:
    """Whole turns to parts, each of one conversation; ``first`` are the rows that open a part."""
    out, ends, before, said = assemble(roles, texts)
    last = np.append(first[1:], len(ends)) - 1
    cuts = np.concatenate([[0], ends[last]])
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out))
    chars = before + said + len(CLOSE)
    place = np.cumsum(chars) - chars
    place -= np.repeat(place[first], np.diff(np.append(first, len(ends))))
    masked = pc.equal(roles, loss_role).to_numpy(zero_copy_only=False).astype(bool)
    spans = pa.StructArray.from_arrays([pa.array((place + before)[masked]), pa.array(said[masked])], ["start", "length"])
    held = np.concatenate([[0], np.cumsum(masked)])
    loss = pa.ListArray.from_arrays(pa.array(held[np.append(first, len(ends))], pa.int32()), spans)
    part = pa.array(base + np.arange(len(first)))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), part, text.cast(pa.string()), pa.array(last - first + 1), loss], list(_COLUMNS))


def _formatted(batches: Iterator[pa.RecordBatch], loss_role: str, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, role, text, bytes, task) to parts. The last conversation
    of a batch waits for its other rows, unless it already fills a part."""
    held, made = None, 0
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        while held is not None and held.num_rows:
            stop = _last_start(held.column(0))
            if stop == 0:
                if held.column(3).to_numpy().sum() <= part_bytes:
                    break
                stop = held.num_rows
            for rows in _slices(held.slice(0, stop), part_bytes):
                done = _assembled(rows, made, loss_role)
                made += done.num_rows
                yield done
            held = held.slice(stop)
    if held is not None and held.num_rows:
        for rows in _slices(held, part_bytes):
            done = _assembled(rows, made, loss_role)
            made += done.num_rows
            yield done


def _changes(conv: pa.Array) -> np.ndarray:
    """Rows, from 1 on, whose conversation differs from the one before."""
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    none = conv.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero((np.diff(ids) != 0) | (np.diff(none.astype(np.int8)) != 0)) + 1


def _last_start(conv: pa.Array) -> int:
    changes = _changes(conv)
    return int(changes[-1]) if len(changes) else 0


def _slices(rows: pa.RecordBatch, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``part_bytes`` at most, one row at least, cut between
    conversations where one ends in time."""
    ends = np.cumsum(rows.column(3).to_numpy())
    starts, at = np.append(_changes(rows.column(0)), rows.num_rows), 0
    while at < rows.num_rows:
        most = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + part_bytes, side="right")))
        whole = starts[(starts > at) & (starts <= most)]
        stop = int(whole[-1]) if len(whole) else most
        yield rows.slice(at, stop - at)
        at = stop


def _assembled(rows: pa.RecordBatch, made: int, loss_role: str) -> pa.RecordBatch:
    conv = rows.column(0)
    first = np.concatenate([[0], _changes(conv)]).astype(np.int64)
    base = (rows.column(4)[0].as_py() << 33) + made
    return _parts(conv, rows.column(1), rows.column(2), first, base, loss_role)


def format_chats(conversations: DataFrame, *, loss_role: str = "assistant", part_bytes: int = PART_BYTES) -> DataFrame:
    """Conversations as training text: ``conv_id, part, text, n_turns, loss``.

    ``loss`` are the spans, in code points of ``text``, of what ``loss_role`` says, as
    written. A conversation is its parts in the order of ``part``; there is one, unless
    it is longer than ``part_bytes`` or a task ends inside it.

    Rows are taken by turn, nulls first, those of one turn by role, then by a hash of the text. A null
    role or text is empty; repeated rows are all written; rows without a conversation
    make one of their own; other columns are ignored; no rows give no parts.

    Rows are dealt out by ranges of conversation and turn, so a conversation
    that holds most of the table is written by many tasks, and a task holds a few parts at most.
    """
    rows = checked(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sized = dealt.select("conv_id", "role", "text", (F.octet_length("role") + F.octet_length("text") + 16).cast("long").alias("bytes"), F.spark_partition_id().cast("long").alias("task"))
    return sized.mapInArrow(lambda b: _formatted(b, loss_role, part_bytes), _SCHEMA)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a part, as they were before it was written."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn begins at {at}")
        yield unescaped(found[1]), unescaped(found[2])
        at = found.end()


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in _DIGESTS.split(", "))])
    own = None

    def done() -> dict:
        return {**own, "turns_sha256": own["turns_sha256"].hexdigest(), "loss_sha256": own["loss_sha256"].hexdigest()}

    for batch in batches:
        out = []
        columns = (batch.column(c) for c in ("conv_id", "text", "loss"))
        for conv, text, loss in zip(*columns, strict=True):
            conv, text = conv.as_py(), text.as_py()
            if own is None or own["conv_id"] != conv:
                if own is not None:
                    out.append(done())
                own = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
            for role, said in read_turns(text):
                own["n_turns"] += 1
                own["turns_sha256"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in loss.as_py():
                said = unescaped(text[span["start"] : span["start"] + span["length"]])
                own["loss_chars"] += len(said)
                own["loss_sha256"].update(said.encode("utf-8", "surrogatepass"))
            own["formatted_chars"] += len(text)
        yield pa.RecordBatch.from_pylist(out, schema)
    if own is not None:
        yield pa.RecordBatch.from_pylist([done()], schema)


def chat_digests(parts: DataFrame) -> DataFrame:
    """Read parts back: a row for each conversation with digests of its turns and of
    what the loss mask covers. A digest reads a conversation from its first turn to
    its last, so one task does, a part at a time."""
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digested, _DIGESTS)


def written_chats(conversations: DataFrame, **options) -> DataFrame:
    """:func:`format_chats`, written to the shared folder."""
    return store(format_chats(conversations, **options), "chats")
