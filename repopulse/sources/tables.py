"""CSV tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from repopulse import vocabulary as V
from repopulse.schemas import AGE_TABLE, MERGED_PRS_TABLE, RELEASES_TABLE


def read_age_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AGE_TABLE).csv(path, header=True)


def read_merged_prs_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MERGED_PRS_TABLE).csv(path, header=True)


def read_releases_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELEASES_TABLE).csv(path, header=True)


def parse_metric_lines(lines: DataFrame, line: str, schema: StructType) -> DataFrame:
    """Lines of a metric table, landed as text, with the table's declared columns."""
    return lines.select(F.from_csv(line, schema.simpleString()[len("struct<") : -1].replace(":", " ")).alias("row")).select("row.*")


def read_consolidated(spark: SparkSession, path: str) -> DataFrame:
    """The consolidated table as text, sentinels included."""
    schema = ", ".join(f"{name} STRING" for name in V.CONSOLIDATED_HEADERS.values())
    return spark.read.schema(schema).csv(path, header=True)


#: What a number looks like; a cast of anything else costs an exception for each cell.
_NUMBERS = {
    "bigint": r"^\s*[-+]?\d+\s*$",
    "double": r"^\s*[-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|(?i:nan|inf|infinity))\s*$",
}


def sentinel_number(text: Column, kind: str = "double") -> Column:
    """A number kept as text; the sentinel, empty text and junk give null."""
    return F.when(text.rlike(_NUMBERS[kind]), text).try_cast(kind)


def quality_columns(consolidated: DataFrame) -> DataFrame:
    """Typed columns of the consolidated text table used by its checks."""
    h = V.CONSOLIDATED_HEADERS
    language = F.nullif(F.nullif(F.col(h["language"]), F.lit(V.NO_LANGUAGE)), F.lit(""))
    return consolidated.withColumns(
        {
            "repo_key": F.col(h["repo_key"]),
            "ratio": sentinel_number(F.col(h["closed_ratio"])),
            "merged_prs": sentinel_number(F.col(h["merged_prs"]), "bigint"),
            "releases": sentinel_number(F.col(h["releases"]), "bigint"),
            "stale_days": sentinel_number(F.col(h["stale_days"])),
            "language": language,
        }
    )
