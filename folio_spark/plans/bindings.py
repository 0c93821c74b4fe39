"""The given tables in the roles of our inputs: orders as versions, documents as laws, their lines as articles, …"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.session import table

#: The date that stands for today in registered queries.
TODAY = "1999-01-01"

#: DuckDB views of the same bindings, to put before an oracle's own part.
VERSIONS_SQL = """versions AS (SELECT CAST(o_custkey AS VARCHAR) AS work_key, o_orderkey AS version_id, o_orderkey AS ingest_seq,
  CAST(o_orderdate AS DATE) AS start, CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'O' THEN 'amended' ELSE 'repealed' END AS status FROM orders)"""
REQUESTS_SQL = """requests AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS request_id, CAST(o_custkey AS VARCHAR) AS work_key,
  CAST(max(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber) AS DATE) AS as_of
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ARTICLES_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, lang, source FROM documents WHERE text IS NOT NULL),
 articles AS (SELECT doc_id AS law_id, CAST(line_no AS INTEGER) AS position, CAST(line_no AS VARCHAR) AS number, line AS text, lang AS level, source AS issuing_body FROM lines WHERE line <> '')"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "current").when(F.col("o_orderstatus") == "O", "amended").otherwise("repealed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("work_key"),
        F.col("o_orderkey").alias("law_id"),
        F.col("o_orderkey").alias("version_id"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.to_date("o_orderdate").alias("start"),
        status.alias("status"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated request per order line, at its latest ship date."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.to_date(F.max("l_shipdate")).alias("as_of"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("work_key"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), "work_key", "as_of")


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("law_id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("lang").alias("level"),
        F.col("source").alias("issuing_body"),
        F.lit("current").alias("status"),
        "text",
    )


def articles(spark: SparkSession, sf_dir: str, titled: bool = False) -> DataFrame:
    """Lines that are not empty; on request with the document's first line, cut to 40 characters, as title."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    title = [F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("title")] * titled
    lines = d.select(F.col("doc_id").alias("law_id"), F.col("lang").alias("level"), F.col("source").alias("issuing_body"), *title, F.posexplode(F.split("text", "\n")).alias("p", "text"))
    kept = ["law_id", (F.col("p") + 1).cast("int").alias("position"), (F.col("p") + 1).cast("string").alias("number"), "text", "level", "issuing_body"]
    return lines.where("text <> ''").select(*kept, *["title"] * titled)
