"""Documents to packed training sequences, one stored stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse.llm.mixing import mix_documents
from repopulse.llm.near_copies import near_copies
from repopulse.llm.packing import pack_documents
from repopulse.llm.queries import END_ID, TOXIC_FROM, table, tokenizer_file
from repopulse.llm.secret_scan import redacted, scan_secrets
from repopulse.llm.storage import store
from repopulse.llm.toxicity import labelled_terms, learning_rows, score_documents, train

#: No stage but the secret scan has a SQL form; tests compare with plain versions.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM``; learnt from the labels of these documents.

    A document without a text has nothing toxic and stays."""
    labels = table(spark, sf_dir, "labels")
    machine = train(learning_rows(docs, labels), labelled_terms(docs, labels))
    return score_documents(docs.select(*COLUMNS), machine).where(F.col("score") < TOXIC_FROM).drop("score")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, component_id: groups of a Jaccard similarity of 0.8 or more of five-word shingles."""
    return near_copies(docs, words=5, similarity=0.8, id_col=id_col)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity
    of 0.8 or more): that of the smallest id, null ids last; of rows that share it, one.
    All texts without a word are copies of each other, null ones included."""
    numbered = store(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("no")), "numbered")
    groups = near_duplicates(numbered, id_col="no").select(F.col("doc_id").alias("no"), "component_id")
    ids = numbered.select("no", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "no").alias("order"))
    first = groups.join(ids, "no").groupBy("component_id").agg(F.min("order")["no"].alias("no"))
    return numbered.join(first.select("no"), "no").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets taken out of their texts. A null text stays null."""
    found = scan_secrets(docs.select(*COLUMNS), owner=F.col("source"), repository=F.col("lang"))
    clean = found.withColumn("new", redacted(F.col("text"), F.col("findings")))
    changed = F.col("new") != F.col("text")
    return clean.select(
        "doc_id", F.col("new").alias("text"), "lang", "source", F.when(changed, F.length("new").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mix_documents(docs.select(*COLUMNS), weights=(1.0, 2.0, 3.0), most=3)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids; every id of every document lies in one piece."""
    return pack_documents(docs, tokenizer=tokenizer_file("word_bpe_49k.json"), end_id=END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
