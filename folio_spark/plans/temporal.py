"""Queries on versions in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.operators import versions as V
from folio_spark.plans import bindings as B
from folio_spark.plans.registry import query
from folio_spark.session import table

_ASOF = f"""WITH {B.VERSIONS_SQL}, {B.REQUESTS_SQL}, ranked AS (
 SELECT *, row_number() OVER (PARTITION BY work_key, start ORDER BY ingest_seq DESC) AS r FROM versions),
 picked AS (SELECT q.request_id, q.work_key, q.as_of, v.start, v.version_id, v.status FROM requests q ASOF LEFT JOIN (SELECT * FROM ranked WHERE r = 1) v
 ON q.work_key = v.work_key AND q.as_of >= v.start)"""


@query(_ASOF + " SELECT request_id, work_key, as_of, start, version_id FROM picked")
def j4_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.as_of(B.requests(spark, sf_dir), B.versions(spark, sf_dir))
    return found.select("request_id", "work_key", "as_of", "start", "version_id")


@query(_ASOF + " SELECT request_id, start FROM picked")
def j4_as_of_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.as_of_by_interval(B.requests(spark, sf_dir), V.version_intervals(B.versions(spark, sf_dir)))


@query(f"WITH {B.VERSIONS_SQL}, s AS (SELECT DISTINCT work_key, start FROM versions) SELECT work_key, start, lead(start) OVER (PARTITION BY work_key ORDER BY start) AS next_start FROM s")
def w2_version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.version_intervals(B.versions(spark, sf_dir))


_STATUS = f"""WITH {B.VERSIONS_SQL}, rows_ AS (SELECT work_key, version_id, start, status, DATE '1998-01-01' AS as_of,
  CASE WHEN version_id % 7 = 0 THEN start + INTERVAL 200 DAY END AS repealed_at FROM versions),
 j AS (SELECT r.*, (SELECT count(*) FROM versions v WHERE v.work_key = r.work_key AND v.start > r.start AND v.start <= r.as_of) AS later,
  (SELECT count(*) FROM versions v WHERE v.work_key = r.work_key AND v.start > r.start) AS any_later FROM rows_ r)
 SELECT version_id, CASE WHEN start > as_of THEN 'pending_effective' WHEN later > 0 THEN 'amended' WHEN repealed_at <= as_of THEN 'repealed'
  WHEN repealed_at IS NOT NULL THEN 'current' WHEN status = 'repealed' AND as_of >= DATE '{B.TODAY}' THEN 'repealed' WHEN status = 'repealed' THEN 'unknown'
  WHEN status = 'amended' AND any_later = 0 AND as_of >= DATE '{B.TODAY}' THEN 'amended' WHEN status = 'amended' AND any_later = 0 THEN 'unknown'
  ELSE 'current' END AS derived_status FROM j"""


@query(_STATUS)
def w3_status_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.versions(spark, sf_dir)
    rows = v.withColumn("as_of", F.lit("1998-01-01").cast("date")).withColumn("repealed_at", F.when(F.col("version_id") % 7 == 0, F.date_add("start", 200)))
    return V.status_as_of(rows, v, B.TODAY).select("version_id", "derived_status")


@query("""WITH laws AS (SELECT p_partkey AS law_id, p_name AS title, p_type AS level, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS body,
 CASE WHEN p_partkey % 4 = 0 THEN p_size END AS work_id, CASE WHEN p_partkey % 10 = 1 THEN 'seed' ELSE 'current' END AS status FROM part)
 SELECT law_id, CASE WHEN work_id IS NOT NULL THEN CAST(work_id AS VARCHAR) WHEN status = 'seed' THEN '~' || law_id
 ELSE '~' || min(law_id) FILTER (WHERE work_id IS NULL AND status <> 'seed') OVER (PARTITION BY title, level, coalesce(body, '')) END AS work_key FROM laws""")
def j6_work_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    laws = p.select(
        F.col("p_partkey").alias("law_id"), F.col("p_name").alias("title"), F.col("p_type").alias("level"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("issuing_body"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")).alias("work_id"),
        F.when(F.col("p_partkey") % 10 == 1, "seed").otherwise("current").alias("status"),
    )
    return V.with_work_key(laws).select("law_id", "work_key")


@query(f"""WITH {B.VERSIONS_SQL}, hits AS (SELECT ingest_seq % 5 AS query_id, work_key, version_id AS law_id, status AS derived_status, start FROM versions),
 r AS (SELECT *, count(DISTINCT law_id) OVER (PARTITION BY query_id, work_key) - 1 AS other_versions, row_number() OVER (PARTITION BY query_id, work_key
 ORDER BY CASE derived_status WHEN 'current' THEN 0 WHEN 'amended' THEN 3 WHEN 'repealed' THEN 3 ELSE 2 END, start DESC, law_id) AS n FROM hits)
 SELECT query_id, work_key, law_id, CAST(other_versions AS INTEGER) AS other_versions FROM r WHERE n = 1""")
def w4_fold_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = B.versions(spark, sf_dir).select((F.col("ingest_seq") % 5).alias("query_id"), "work_key", "law_id", F.col("status").alias("derived_status"), "start")
    return V.fold_versions(hits).select("query_id", "work_key", "law_id", "other_versions")


@query(f"""WITH {B.VERSIONS_SQL}, has AS (SELECT DISTINCT l_orderkey AS version_id FROM lineitem),
 live AS (SELECT v.* FROM versions v JOIN has USING (version_id) WHERE start <= DATE '{B.TODAY}'),
 best AS (SELECT work_key, version_id FROM (SELECT *, row_number() OVER (PARTITION BY work_key ORDER BY start DESC, ingest_seq DESC) r FROM live) WHERE r = 1)
 SELECT v.version_id AS mention_id, CASE WHEN v.version_id % 9 = 0 THEN v.version_id ELSE coalesce(b.version_id, v.version_id) END AS current_law_id
 FROM versions v LEFT JOIN best b USING (work_key)""")
def j5_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.versions(spark, sf_dir)
    resolved = v.select(F.col("law_id").alias("mention_id"), "law_id", "work_key", (F.col("law_id") % 9 == 0).alias("pinned"))
    articles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("law_id"))
    found = V.current_version(resolved, v.withColumnRenamed("start", "effective_at"), articles, B.TODAY)
    return found.select("mention_id", "current_law_id")


@query(f"""WITH {B.VERSIONS_SQL}, q AS (SELECT c_custkey AS request_id, CAST(c_custkey AS VARCHAR) AS work_key, CASE WHEN c_custkey % 2 = 0 THEN DATE '1995-01-01' ELSE DATE '1998-06-30' END AS a,
 CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-06-30' ELSE DATE '1995-01-01' END AS b FROM customer)
 SELECT request_id, CASE WHEN a <= b THEN string_agg(CAST(version_id AS VARCHAR), ',' ORDER BY start, version_id) ELSE string_agg(CAST(version_id AS VARCHAR), ',' ORDER BY start DESC, version_id DESC) END AS chain
 FROM q JOIN versions USING (work_key) WHERE start BETWEEN least(a, b) AND greatest(a, b) GROUP BY request_id, a, b""")
def w13_version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    early, late = F.lit("1995-01-01").cast("date"), F.lit("1998-06-30").cast("date")
    even = F.col("c_custkey") % 2 == 0
    q = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").cast("string").alias("work_key"),
        F.when(even, early).otherwise(late).alias("from_date"), F.when(even, late).otherwise(early).alias("to_date"),
    )
    found = V.version_chain(q, B.versions(spark, sf_dir))
    return found.select("request_id", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"))


_TWO_VERSIONS = f"""WITH {B.VERSIONS_SQL}, a AS (SELECT work_key, arg_max(version_id, (start, ingest_seq)) AS v FROM versions WHERE start <= DATE '1996-06-01' GROUP BY 1),
 b AS (SELECT work_key, arg_max(version_id, (start, ingest_seq)) AS v FROM versions WHERE start <= DATE '1998-06-01' GROUP BY 1),
 art AS (SELECT l_orderkey AS v, l_linenumber AS number, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_partkey) AS text FROM lineitem GROUP BY 1, 2),
 x AS (SELECT a.work_key, number, text FROM a JOIN art USING (v)), y AS (SELECT b.work_key, number, text FROM b JOIN art USING (v))"""


def _articles_at(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    v = B.versions(spark, sf_dir)
    asked = v.select(F.col("work_key").alias("request_id"), "work_key", F.lit(day).cast("date").alias("as_of")).distinct()
    picked = V.as_of(asked, v).where("version_id is not null")
    parts = F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), " ")
    art = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("number")).agg(parts.alias("text"))
    return picked.join(art, "version_id").select("request_id", "number", "text", F.lit(None).cast("string").alias("part"))


@query(_TWO_VERSIONS + """ SELECT coalesce(x.work_key, y.work_key) AS work_key, coalesce(x.number, y.number) AS number,
 CASE WHEN x.work_key IS NULL THEN 'added' WHEN y.work_key IS NULL THEN 'removed' WHEN x.text = y.text THEN 'unchanged' ELSE 'changed' END AS change
 FROM x FULL JOIN y ON x.work_key = y.work_key AND x.number = y.number""")
def d1_diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.diff_versions(_articles_at(spark, sf_dir, "1996-06-01"), _articles_at(spark, sf_dir, "1998-06-01"))
    return found.select(F.col("request_id").alias("work_key"), "number", "change")


@query("""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 3 <> 1), b AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN upper(text) ELSE text END AS text FROM conversations WHERE turn % 5 <> 4)
 SELECT coalesce(a.conv_id, b.conv_id) AS source_id, coalesce(a.turn, b.turn) AS position,
 CASE WHEN a.conv_id IS NULL THEN 'added' WHEN b.conv_id IS NULL THEN 'removed' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'unchanged' ELSE 'changed' END AS change
 FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def d2_diff_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), "text", F.lit(None).cast("string").alias("part"))
    after = c.where("position % 5 <> 4").withColumn("text", F.when(F.col("position") % 4 == 0, F.upper("text")).otherwise(F.col("text")))
    found = V.diff_versions(c.where("position % 3 <> 1"), after, "position")
    return found.select(F.col("request_id").alias("source_id"), "position", "change")


@query("""WITH c AS (SELECT o_custkey AS law_id, o_orderpriority AS number, o_orderkey AS position, o_orderstatus AS text FROM orders),
 b AS (SELECT law_id, number || '#' || row_number() OVER (PARTITION BY law_id, number ORDER BY position) AS item, text FROM c WHERE position % 6 <> 0),
 a AS (SELECT law_id, number || '#' || row_number() OVER (PARTITION BY law_id, number ORDER BY position) AS item, text FROM c WHERE position % 7 <> 0),
 fb AS (SELECT c_custkey AS law_id, 'field:name' AS item, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'field:segment', c_mktsegment FROM customer),
 fa AS (SELECT c_custkey AS law_id, 'field:name' AS item, CASE WHEN c_custkey % 8 = 0 THEN upper(c_name) ELSE c_name END AS text FROM customer UNION ALL SELECT c_custkey, 'field:segment', c_mktsegment FROM customer),
 x AS (SELECT * FROM b UNION ALL SELECT * FROM fb), y AS (SELECT * FROM a UNION ALL SELECT * FROM fa)
 SELECT coalesce(x.law_id, y.law_id) AS law_id, coalesce(x.item, y.item) AS item, CASE WHEN x.law_id IS NULL THEN 'added' WHEN y.law_id IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM x FULL JOIN y ON x.law_id = y.law_id AND x.item = y.item WHERE x.law_id IS NULL OR y.law_id IS NULL OR x.text IS DISTINCT FROM y.text""")
def d3_diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), F.col("o_orderpriority").alias("number"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("text"))
    fields = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("law_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    changed = fields.withColumn("name", F.when(F.col("law_id") % 8 == 0, F.upper("name")).otherwise(F.col("name")))
    return V.diff_documents(c.where("position % 6 <> 0"), c.where("position % 7 <> 0"), fields, changed)


@query("""SELECT o_custkey AS law_id, o_orderpriority AS number, o_orderkey AS position, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS occurrence FROM orders""")
def w12_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), F.col("o_orderpriority").alias("number"), F.col("o_orderkey").alias("position"))
    return V.with_occurrence(c)


@query("""WITH old AS (SELECT o_custkey AS source_id, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1)
 SELECT o.o_custkey AS source_id, o.o_orderkey AS seq, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS INTEGER) AS revision
 FROM orders o LEFT JOIN old ON old.source_id = o.o_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def w11_append_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("seq"), "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    old = o.where(early).groupBy("source_id").agg(F.count(F.lit(1)).alias("revision"))
    return V.append_revisions(old, o.where(~early)).select("source_id", "seq", "revision")


@query(f"WITH {B.VERSIONS_SQL} SELECT work_key AS source_id, version_id, CAST(row_number() OVER (PARTITION BY work_key ORDER BY start DESC NULLS LAST, ingest_seq DESC) AS INTEGER) AS place FROM versions")
def w11_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.history(B.versions(spark, sf_dir).withColumnRenamed("work_key", "source_id"))
    return found.select("source_id", "version_id", "place")


@query(f"WITH {B.ARTICLES_SQL} SELECT law_id, sha256(string_agg(number || chr(10) || text || chr(10), '' ORDER BY position)) AS content_hash FROM articles GROUP BY law_id")
def a5_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.content_hash(B.articles(spark, sf_dir).dropDuplicates(["law_id", "position"]))


@query(f"""WITH {B.ARTICLES_SQL} SELECT law_id * 3 AS revision_id, law_id, number, position, text, CASE WHEN law_id % 6 = 0 THEN 'stored_articles' END AS diagnostic FROM articles WHERE law_id % 6 IN (0, 1, 2)
 UNION ALL SELECT doc_id * 3, doc_id, NULL, NULL, NULL, CASE doc_id % 6 WHEN 3 THEN 'snapshot_missing' WHEN 4 THEN 'snapshot_corrupt' ELSE 'snapshot_foreign' END FROM documents WHERE doc_id % 6 > 2""")
def s9_explode_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots made of the documents; every sixth is missing with a known hash, one missing, one corrupt, one foreign."""
    a = B.articles(spark, sf_dir)
    packed = a.groupBy("law_id").agg(F.collect_list(F.struct("number", "text", "position")).alias("articles"))
    kind = F.col("law_id") % 6
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("law_id"))
    made = F.to_json(F.struct(F.when(kind == 5, F.col("law_id") + 1).otherwise(F.col("law_id")).cast("string").alias("id"), "articles"))
    revisions = docs.join(packed, "law_id", "left").select(
        (F.col("law_id") * 3).alias("revision_id"), "law_id", F.when(kind == 3, "old").otherwise("new").alias("content_hash"),
        F.when(kind.isin(1, 2, 5), made).when(kind == 4, F.lit('{"id": "1", broken')).alias("snapshot_json"),
    )
    laws = docs.withColumn("content_hash", F.lit("new"))
    return V.explode_snapshots(revisions, laws, a)
