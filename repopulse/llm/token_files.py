"""Token ids as flat binary files with 64-bit offsets.

A folder of token files holds, for every shard ``s`` in ascending document order:

* ``s.ids``      unsigned little-endian integers, two bytes each where the vocabulary allows it, else four;
* ``s.offsets``  unsigned 64-bit: where each document of the shard starts, counted in ids, and the shard's end;
* ``s.docs``     signed 64-bit document ids.

A shard's base, the ids in all shards before it, is a prefix sum over the
manifest, which has one row for each shard. Readers map the files into memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repopulse.llm.storage import checked, shared_folder, store
from repopulse.llm.subwords import subwords


def _written(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """One shard from this task's sorted documents; its row of the manifest."""
    tok = subwords(tokenizer)
    context = TaskContext.get()
    # The attempt is part of the name: a repeated task never writes to the file of another one.
    name = f"{context.partitionId():08d}-{context.taskAttemptId()}"
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    n_docs = n_ids = 0
    with (
        fs.open_output_stream(f"{root}/{name}.ids") as ids,
        fs.open_output_stream(f"{root}/{name}.offsets") as offsets,
        fs.open_output_stream(f"{root}/{name}.docs") as docs,
    ):
        for batch in batches:
            docs.write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += batch.num_rows
            for found, counts in tok.documents(batch.column(1), end_id):
                ids.write(found.tobytes())
                offsets.write((n_ids + np.cumsum(counts) - counts).astype("<u8").tobytes())
                n_ids += len(found)
        offsets.write(np.array([n_ids], "<u8").tobytes())
    if n_docs:
        row = [[context.partitionId()], [name], [n_docs], [n_ids], [tok.dtype.itemsize]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["shard", "file", "docs", "ids", "width"])


def write_token_files(
    docs: DataFrame, folder: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts and write them to ``folder``; returns the manifest with bases.

    A null text is empty, and an empty text is the end id alone. A null document
    id counts as the smallest 64-bit integer. Rows that share an id are all
    written, in the order of a hash of their texts. Other columns are ignored. An
    empty table gives a manifest without rows.

    ``folder`` is a path that all executors see, in any file system pyarrow knows.
    Each task writes a shard of its own, so a lost executor costs its shards only.
    """
    rows = checked(docs, id_col, text_col).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    keys = (F.col("doc"), F.xxhash64("text"))
    written = (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(
            lambda batches: _written(batches, folder, tokenizer, end_id),
            "shard long, file string, docs long, ids long, width long",
        )
    )
    # One row for each shard: the only window over everything is over these few rows.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return store(written, "manifest").withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _mapped(fs: pafs.FileSystem, path: str) -> pa.Buffer:
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with fs.open_input_file(path) as f:
        return f.read_buffer()


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(folder)
    for batch in batches:
        for shard in batch.to_pylist():
            path = f"{root}/{shard['file']}"
            ids = np.frombuffer(_mapped(fs, f"{path}.ids"), f"<u{shard['width']}")
            offsets = np.frombuffer(_mapped(fs, f"{path}.offsets"), "<u8").astype(np.int64)
            docs = np.frombuffer(_mapped(fs, f"{path}.docs"), "<i8")
            at = 0
            while at < len(docs):
                # About a million ids at a time, one document at least.
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 1_000_000)))
                to = min(to, len(docs))
                data = ids[offsets[at] : offsets[to]].astype("<u4")
                cuts = (offsets[at : to + 1] - offsets[at]) * 4
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(cuts.astype("<i8")), pa.py_buffer(data)])
                start = offsets[at:to] + shard["base"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[at:to]), pa.array(start), pa.array(np.diff(offsets[at : to + 1])), binary.cast(pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                at = to


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it),
    n_tokens and ``ids`` as little-endian unsigned 32-bit integers."""
    n = max(1, manifest.select("shard").count())
    # A number of partitions is given, or adaptive execution would put the few small rows into one task.
    return manifest.repartitionByRange(n, "shard").mapInArrow(
        lambda batches: _read(batches, folder), "doc_id long, start long, n_tokens long, ids binary"
    )


def encode_documents(docs: DataFrame, *, tokenizer: str, end_id: int) -> DataFrame:
    """Write token files to the shared folder and read the documents back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, tokenizer=tokenizer, end_id=end_id)
    return read_token_files(store(manifest, "bases"), folder)
