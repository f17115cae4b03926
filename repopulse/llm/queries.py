"""The operators as named queries on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse.llm.chat_format import chat_digests, written_chats
from repopulse.llm.conversation_repair import conversation_ids, damaged, repair_conversations, with_every
from repopulse.llm.mixing import mix_documents
from repopulse.llm.ordinal import rate_documents, train_ordinal
from repopulse.llm.packing import pack_documents
from repopulse.llm.secret_scan import scan_secrets
from repopulse.llm.simhash import near_duplicates
from repopulse.llm.spelling import count_words, spelling_groups
from repopulse.llm.threshold_search import top_inner_products
from repopulse.llm.token_counts import count_tokens, sentencepiece_vocabulary
from repopulse.llm.token_files import encode_documents
from repopulse.llm.toxicity import held_out, labelled_terms, learning_rows, score_documents, train
from repopulse.llm.vector_links import link_vectors

#: Id after each document.
END_ID = 2
#: From this score on a document is called toxic.
TOXIC_FROM = 0.7


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies; imported late, as only two queries need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component of its near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, most=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a unigram vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), sentencepiece_vocabulary(tokenizer_file("piece_bpe_32k.model")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_documents(docs, weights=(1.0, 2.0, 3.0), most=3, keep=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer=tokenizer_file("word_bpe_49k.json"), end_id=END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.93 or more within its label."""
    return link_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; learnt from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    machine = train(learning_rows(docs, labels), labelled_terms(docs, labels))
    return score_documents(docs, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted")
    )


def op7_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector."""
    return top_inner_products(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document and whether it is selected.

    The grade of a labelled document is 0 for low quality, 1 for good but toxic
    and 2 for good; it is selected if quality is likelier good than not.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").withColumn("grade", F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0))))
    rated = learning_rows(docs, labels, label_col="grade")
    return rate_documents(docs, train_ordinal(rated, 3, labelled_terms(docs, labels, label_col="grade")), 1).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected")
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A source is the owner, and its documents of one
    language are a repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = scan_secrets(docs, owner=F.col("source"), repository=F.col("lang"), keep=("doc_id",))
    live = F.size(F.filter("findings", lambda s: s["live"])).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", live.alias("n_live"), (F.size("findings") - live).alias("n_examples"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as read back from their token files."""
    encoded = encode_documents(table(spark, sf_dir, "documents"), tokenizer=tokenizer_file("byte_bpe_50k.json"), end_id=END_ID)
    return encoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, some thinned out, with the form each is a variant of."""
    words = count_words(table(spark, sf_dir, "documents"), one_in=199, least_length=6, least_n=5)
    return spelling_groups(words, times=5).select("word", "form", "root", "n", "n_near", "form_n")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, as read back from their formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(written_chats(rows.unionByName(tricky)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults and the cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    repair = repair_conversations(damaged(conversations))
    found = repair.report.join(repair.digests.withColumnRenamed("conv_id", "own_id"), F.col("conv_id").eqNullSafe(F.col("own_id")))
    nothing = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return with_every(conversation_ids(conversations), found, nothing)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_vector_links": op5_vector_links,
    "op6_toxicity": op6_toxicity,
    "op7_threshold_search": op7_threshold_search,
    "op8_ordinal_quality": op8_ordinal_quality,
    "op9_secrets": op9_secrets,
    "op10_token_files": op10_token_files,
    "op11_spelling": op11_spelling,
    "op12_chat_format": op12_chat_format,
    "op13_conversation_repair": op13_conversation_repair,
}

