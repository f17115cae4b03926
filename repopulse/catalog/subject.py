"""Repository-shaped subjects derived from the whole test tables.

A customer plays the repository: orders and line items give its dates and
counts, the market segment its language. Missing, null and malformed values
follow from columns of the data (balance, nation, region), so every case of the
metrics occurs at every scale factor.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse.functions.presence import integer_at, text_at
from repopulse.sources.pages import explode_nodes

REFERENCE_AT = datetime(2001, 1, 1, tzinfo=timezone.utc)
PAGE_ROWS = 100


#: Declared schemas of the test tables; reading the footers for them costs a job.
TABLES = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def iso_text(moment: Column) -> Column:
    """A zone-less timestamp as ISO text in UTC, whatever the session zone."""
    return F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def lines_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items reduced to one row per order before any join."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
            F.count_if(F.col("l_returnflag") == "N").alias("n_new"),
        )
    )


def _per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(
        lines_per_order(spark, sf_dir).select("l_orderkey", "n_returned"), F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    return orders.groupBy("o_custkey").agg(
        F.min(F.when(status == "F", F.col("o_orderdate"))).alias("created"),
        F.max(F.when(status == "O", F.col("o_orderdate"))).alias("pushed"),
        F.max("o_orderdate").alias("updated"),
        F.max(F.when(status == "P", F.col("o_orderdate"))).alias("committed"),
        F.count_if(urgent).alias("n_urgent"),
        F.count_if(urgent & (status == "F")).alias("n_urgent_done"),
        F.count_if(status == "O").alias("n_open"),
        F.coalesce(F.sum("n_returned"), F.lit(0)).alias("n_returned"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: dates as text and plain counts."""
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = (
        customers.join(_per_customer(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    balance, created, pushed = F.col("c_acctbal"), iso_text(F.col("created")), iso_text(F.col("pushed"))
    return joined.select(
        F.col("c_custkey").alias("pos"),
        F.col("c_name").alias("repo_key"),
        F.concat(F.lit("https://example.org/"), F.col("c_name")).alias("url"),
        F.floor(balance).cast("long").alias("stars"),
        # Negative balance: the creation date lost its day.
        F.when(balance < 0, F.substring(created, 1, 7)).otherwise(created).alias("created_raw"),
        # Small balance: the push date is not a date.
        F.when((balance >= 0) & (balance < 500) & pushed.isNotNull(), F.lit("n/a")).otherwise(pushed).alias("pushed_raw"),
        iso_text(F.col("updated")).alias("updated_raw"),
        iso_text(F.col("committed")).alias("commit_raw"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_nationkey").alias("nation"),
        F.col("n_regionkey").alias("region"),
        (balance >= -800).alias("has_node"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_urgent", "n_urgent_done", "n_open", "n_returned")],
    )


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts with the counts and the language as a profiled node shows them."""
    nation, region = F.col("nation"), F.col("region")
    return facts(spark, sf_dir).withColumns(
        {
            "issues_total": F.when(region == 0, None).when(nation == 7, 0).otherwise(F.col("n_urgent")),
            "issues_closed": F.when(region == 0, None).when(nation == 8, 0).otherwise(F.col("n_urgent_done")),
            "merged_prs": F.when((region == 2) & (F.col("segment") == "BUILDING"), None).otherwise(F.col("n_open")),
            "releases": F.when(nation.isin(11, 12, 13), 0).otherwise(F.col("n_returned")),
            "language_raw": F.when(region == 4, None).when(nation == 3, "  ").otherwise(F.col("segment")),
        }
    )


def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, node`` and the facts: one JSON node per customer.

    Some nodes are null or empty, some fields absent, null, empty or of the
    wrong type.
    """
    nation, region = F.col("nation"), F.col("region")

    def member(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    def quoted(text: Column) -> Column:
        return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))

    def counted(value: Column) -> Column:
        return F.concat(F.lit('{"totalCount":'), value.cast("string"), F.lit("}"))

    members = F.concat_ws(
        ",",
        member("segment", quoted(F.col("segment"))),
        member("nation", nation.cast("string")),
        member("nameWithOwner", quoted(F.col("repo_key"))),
        member("url", quoted(F.col("url"))),
        member("stargazerCount", F.col("stars").cast("string")),
        member("createdAt", quoted(F.col("created_raw"))),
        member("pushedAt", quoted(F.col("pushed_raw"))),
        member("updatedAt", quoted(F.col("updated_raw"))),
        member(
            "defaultBranchRef",
            F.when(F.col("commit_raw").isNull(), F.lit('{"name":"main","target":null}')).otherwise(
                F.concat(F.lit('{"name":"main","target":{"committedDate":'), quoted(F.col("commit_raw")), F.lit("}}"))
            ),
        ),
        member(
            "primaryLanguage",
            F.when(region == 4, F.lit("null"))
            .when(nation == 3, F.lit('{"name":"  "}'))
            .otherwise(F.concat(F.lit('{"name":'), quoted(F.col("segment")), F.lit("}"))),
        ),
        F.when(
            region != 0,
            member("issues", F.when(nation == 7, F.lit("null")).otherwise(counted(F.col("n_urgent")))),
        ),
        F.when(
            region != 0,
            member(
                "issuesFechadas",
                F.when(nation == 8, F.lit('{"totalCount":"3"}')).otherwise(counted(F.col("n_urgent_done"))),
            ),
        ),
        F.when(
            ~((region == 2) & (F.col("segment") == "BUILDING")),
            member("pullRequestsAceitos", counted(F.col("n_open"))),
        ),
        member(
            "releases",
            F.when(nation == 11, F.lit("null"))
            .when(nation == 12, F.lit("{}"))
            .when(nation == 13, F.lit('{"totalCount":1.5}'))
            .otherwise(counted(F.col("n_returned"))),
        ),
    )
    node = (
        F.when(F.col("has_node"), F.concat(F.lit("{"), members, F.lit("}")))
        .when(F.col("stars") < -900, F.lit("null"))
        .otherwise(F.lit("{}"))
    )
    return facts(spark, sf_dir).withColumn("node", node)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page, raw``: pages of 100 nodes, as a service returns them."""
    placed = node_text(spark, sf_dir).select(
        F.floor(F.col("pos") / PAGE_ROWS).alias("page"), F.struct("pos", "node").alias("entry")
    )
    # A page holds 100 nodes at most, so the list is bounded.
    joined = placed.groupBy("page").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["node"])).alias("nodes"),
        F.count(F.lit(1)).alias("n"),
    )
    document = F.concat(
        F.lit('{"data":{"search":{"repositoryCount":'), (F.lit(1000) + F.col("page")).cast("string"),
        F.lit(',"pageInfo":{"hasNextPage":true},"nodes":['), F.col("nodes"), F.lit("]}}}"),
    )
    return joined.select("page", F.parse_json(document).alias("raw"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, segment, nation, raw``: the non-empty nodes of all pages."""
    raw = F.col("raw")
    return explode_nodes(pages(spark, sf_dir)).select(
        (F.col("page") * PAGE_ROWS + F.col("pos")).alias("pos"),
        text_at(raw, "segment").alias("segment"),
        integer_at(raw, "nation").alias("nation"),
        raw,
    )


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two collections of customers: orders that are not finished (A), and those that
    are not open (B). Together they cover the table, and partly finished orders are in
    both. Customers repeat, some are in one collection only, and some keys are null.
    """
    orders = table(spark, sf_dir, "orders").join(
        lines_per_order(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    rows = orders.select(
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey")).alias("repo_key"),
        F.col("o_orderkey").alias("pos"),
        "o_orderstatus",
        F.concat(F.lit("https://example.org/order/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice").cast("long")).alias("stars"),
        iso_text(F.col("o_orderdate")).alias("date_raw"),
        F.col("o_orderpriority").alias("priority"),
        "n_lines",
        "n_returned",
        "n_new",
    )
    return rows.where(F.col("o_orderstatus") != "F"), rows.where(F.col("o_orderstatus") != "O")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source as language: blank for German, null for Spanish."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "de", F.lit(" \t"))
        .when(F.col("lang") != "es", F.col("source"))
        .alias("language_raw"),
    )


def ranking_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, position``: sources of all documents in document order, unevenly written."""
    listed = table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    name = F.when(F.col("lang") == "en", F.upper("source")).otherwise(F.concat(F.lit("\t "), F.col("source"), F.lit(" ")))
    return listed.select(name.alias("name"), (F.col("doc_id") + 1).alias("position"))
