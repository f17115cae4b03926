"""Result documents: one JSON object with metadata, records and summary.

:func:`read_document` takes a file as a whole, for small ones of any form. A document
that is written with an indent of two, as the collection writes it, is split over
tasks: a string never holds a raw line end, so the indent of a line says how deep it
lies, and records and sections can be cut apart wherever a block of the file begins
(:func:`read_document_parts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.functions.presence import has_key, integer_at, number_at, object_key, string_at
from repopulse.schemas import RECORD
from repopulse.sinks.tables import consolidated_columns


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """``doc``: one variant per document file."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))


def document_metadata(documents: DataFrame, *keys: str) -> DataFrame:
    """Chosen metadata entries as text columns."""
    return documents.select(
        *[F.try_variant_get("doc", f"$.{V.DOCUMENT_METADATA}.{key}", "string").alias(key) for key in keys]
    )


def document_summary(documents: DataFrame, path: str) -> DataFrame:
    """The part of the stored summary under ``path``: ``name, value`` rows."""
    part = object_key(F.col("doc"), f"{V.DOCUMENT_SUMMARY}.{path}")
    entries = F.try_variant_get(part, "$", "map<string,variant>")
    return documents.select(F.explode(entries).alias("name", "value")).select(
        "name", F.col("value").cast("string").alias("value")
    )


def document_records(documents: DataFrame) -> DataFrame:
    """``pos, record``: the records as variants; no list gives no rows."""
    records = F.try_variant_get("doc", f"$.{V.DOCUMENT_RECORDS}", "array<variant>")
    return documents.select(F.posexplode(records).alias("pos", "record"))


#: First lines of a section and of a record in an indented document, and lines that belong to no section.
_SECTION, _RECORD, _OUTSIDE = r'^  "', r"^    \{", r"^\S"


def read_document_parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of indented documents: see :func:`document_parts`. Blocks of a large file
    are read by many tasks."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.rtrim("value", F.lit("\r")).alias("value"),
    )
    return document_parts(lines)


def document_parts(lines: DataFrame) -> DataFrame:
    """``file, no, section, text``: sections and records of documents, numbered in their order.

    ``lines`` has ``file, block, line, value``: a block is a stretch of a file, and lines
    are ordered inside it. A part is numbered by the parts that begin before it:
    in its block, and in the blocks before, of which there is one row each. ``section``
    is the name of a section, null for a record. No task holds more than a block or a part.
    """
    starts = F.col("value").rlike(_SECTION) | F.col("value").rlike(_RECORD)
    marked = lines.where(~F.col("value").rlike(_OUTSIDE)).withColumn("starts", starts.cast("int"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("file", "block").agg(F.sum("starts").alias("n"))
    blocks = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.withColumn("own", F.sum("starts").over(upto))
    numbered = numbered.join(blocks, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    part = numbered.select("file", (F.col("base") + F.col("own")).alias("no"), F.struct("block", "line", "value").alias("at"))
    joined = part.where("no > 0").groupBy("file", "no").agg(F.array_sort(F.collect_list("at"))["value"].alias("values"))
    is_record = F.col("values")[0].rlike(_RECORD)
    # The end of the list comes after its last record.
    own = F.when(is_record, F.filter("values", lambda v: v.startswith("    "))).otherwise(F.col("values"))
    text = F.regexp_replace(F.concat_ws("\n", own), r",\s*$", "")
    name = F.when(~is_record, F.regexp_extract(F.col("values")[0], r'^  "([^"]*)"', 1))
    return joined.select("file", "no", name.alias("section"), text.alias("text"))


def _sections(parts: DataFrame) -> DataFrame:
    """Sections with the number of the next one; a document has a few."""
    following = Window.partitionBy("file").orderBy("no")
    return parts.where(F.col("section").isNotNull()).withColumn("until", F.lead("no").over(following))


def records_of_parts(parts: DataFrame) -> DataFrame:
    """``file, pos, record``, as :func:`document_records` gives them: the records of the list, each
    parsed by itself."""
    lists = _sections(parts).where(F.col("section") == V.DOCUMENT_RECORDS).select(F.col("file").alias("_file"), F.col("no").alias("_from"), F.col("until").alias("_until"))
    inside = (F.col("file") == F.col("_file")) & (F.col("no") > F.col("_from")) & (F.col("_until").isNull() | (F.col("no") < F.col("_until")))
    records = parts.where(F.col("section").isNull()).join(lists, inside)
    return records.select("file", (F.col("no") - F.col("_from") - 1).cast("int").alias("pos"), F.parse_json("text").alias("record"))


def document_of_parts(parts: DataFrame) -> DataFrame:
    """``file, doc``: the documents without their records, for :func:`document_metadata` and
    :func:`document_summary`."""
    held = parts.where(F.col("section").isin(V.DOCUMENT_METADATA, V.DOCUMENT_SUMMARY)).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", "text")))["text"].alias("texts"))
    return held.select("file", F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", "texts"), F.lit("}"))).alias("doc"))


def _typed(record: Column, column: str) -> Column:
    key = V.DOCUMENT_KEYS[column]
    kind = RECORD[column].dataType.simpleString() if column in RECORD.fieldNames() else "string"
    if kind == "bigint":
        return integer_at(record, key)
    if kind == "double":
        return number_at(record, key)
    if kind == "string":
        return string_at(record, key)
    return F.try_variant_get(record, f"$.{key}", kind)


def records_from_document(records: DataFrame) -> DataFrame:
    """Typed records, in the order of the document, with the raw node as ``raw``."""
    record = F.col("record")
    named = [c for c in RECORD.fieldNames() if c in V.DOCUMENT_KEYS]
    raw = object_key(record, V.RAW_KEY)
    flags = [F.try_variant_get(record, f"$.{V.DOCUMENT_KEYS[c]}", "boolean").alias(c) for c in ("in_a", "in_b")]
    externals = [integer_at(record, k).alias(k) for k in (V.EXTERNAL_MERGED_PRS_KEY, V.EXTERNAL_RELEASES_KEY)]
    return records.select(
        "pos",
        *[_typed(record, c).alias(c) for c in named],
        *flags,
        *externals,
        F.when(~F.is_variant_null(raw), raw).alias("raw"),
    )


def consolidated_from_document(records: DataFrame, keep_position: bool = False) -> DataFrame:
    """The consolidated table: an absent count is 0, one stored as null stays null.

    ``keep_position`` adds ``pos``, the record's place in the document."""
    record = F.col("record")

    def count(column: str) -> Column:
        stored = integer_at(record, V.DOCUMENT_KEYS[column])
        return F.when(has_key(record, V.DOCUMENT_KEYS[column]), stored).otherwise(F.lit(0).cast("long"))

    name = F.when(
        has_key(record, V.DOCUMENT_KEYS["repo_key"]), string_at(record, V.DOCUMENT_KEYS["repo_key"])
    ).otherwise(F.lit(V.UNNAMED))
    return records.select(
        *consolidated_columns(
            name,
            number_at(record, V.DOCUMENT_KEYS["age_years"]),
            count("merged_prs"),
            count("releases"),
            number_at(record, V.DOCUMENT_KEYS["stale_days"]),
            string_at(record, V.DOCUMENT_KEYS["language"]),
            number_at(record, V.DOCUMENT_KEYS["closed_ratio"]),
        ),
        *(["pos"] if keep_position else []),
    )
