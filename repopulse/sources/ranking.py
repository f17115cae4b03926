"""The popularity ranking as a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repopulse.operators.ranking import rank_dimension
from repopulse.schemas import RANKING_DOCUMENT


def read_ranking_document(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row; a ranking without names is an error."""
    document = spark.read.schema(RANKING_DOCUMENT).json(path, multiLine=True)
    names = F.coalesce(F.size("linguagens"), F.lit(0))
    return document.withColumn(
        "linguagens",
        F.when(names > 0, F.col("linguagens")).otherwise(
            F.raise_error(F.lit("the ranking document lists no language")).cast("array<string>")
        ),
    )


def ranking_from_document(document: DataFrame) -> DataFrame:
    """``lang_key, rank``: rank is the 1-based place in the list."""
    listed = document.select(F.posexplode("linguagens").alias("pos", "name"))
    return rank_dimension(listed.select("name", (F.col("pos") + 1).alias("position")))


#: What is kept of a ranking beside its ranks.
PROVENANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "edition", "title", "url", "published_at", "accessed_at", "metric", "reason")]
    + [T.StructField("n_names", T.LongType()), T.StructField("names", T.ArrayType(T.StringType()))]
)
_TOLD = {
    "source": "fonte", "edition": "edicao", "title": "titulo", "url": "url",
    "published_at": "publicado_em", "accessed_at": "acessado_em", "metric": "metrica", "reason": "justificativa",
}


def ranking_provenance(document: DataFrame) -> DataFrame:
    """One row: all a ranking document says of itself (empty where it does not), and its names as given."""
    told = [F.coalesce(F.col(key), F.lit("")).alias(name) for name, key in _TOLD.items()]
    return document.select(*told, F.size("linguagens").cast("long").alias("n_names"), F.col("linguagens").alias("names"))


def ranking_label() -> Column:
    """Source label written beside each rank."""
    return F.concat_ws(" ", F.coalesce("fonte", F.lit("")), F.coalesce("edicao", F.lit("")))
