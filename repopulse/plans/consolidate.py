"""Consolidate a result document and report on the quality of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse import vocabulary as V
from repopulse.operators.grouping import top_groups
from repopulse.operators.quality import row_count
from repopulse.operators.summary import ratio_quality
from repopulse.sinks.tables import write_consolidated
from repopulse.sources.documents import consolidated_from_document, document_records, read_document
from repopulse.sources.tables import quality_columns


def consolidate(spark: SparkSession, document_path: str, output: str | None = None) -> DataFrame:
    """The consolidated table of a result document, written when asked."""
    table = consolidated_from_document(document_records(read_document(spark, document_path)))
    if output is not None:
        write_consolidated(table, output)
    return table


def document_report(spark: SparkSession, document_path: str, expected: int = V.MAX_RESULTS) -> dict[str, DataFrame]:
    """:func:`validation_report` of a result document: languages of equal size keep
    the order in which the document first names them."""
    table = consolidated_from_document(document_records(read_document(spark, document_path)), keep_position=True)
    as_text = table.select(*[F.col(c).cast("string").alias(c) for c in V.CONSOLIDATED_HEADERS.values()], "pos")
    return validation_report(as_text, "pos", expected)


def validation_report(consolidated: DataFrame, position: str | None = None, expected: int = V.MAX_RESULTS) -> dict[str, DataFrame]:
    """Row count, ratio distribution, language counts and the largest groups.

    ``position`` names the column that says which row came first; without it
    groups of equal size are ordered by name.
    """
    typed = quality_columns(consolidated)
    languages = typed.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    counted = languages.agg(
        F.coalesce(F.sum(F.when(F.col("language").isNull(), F.col("n"))), F.lit(0)).alias("without_language"),
        F.count("language").alias("distinct_languages"),
    )
    largest = top_groups(
        typed, "language", "merged_prs", ("merged_prs", "releases", "stale_days"), position or "language"
    )
    return {
        "row_count": row_count(typed, expected),
        "ratio": ratio_quality(typed, F.col("ratio")),
        "languages": counted,
        "top_languages": largest,
    }
