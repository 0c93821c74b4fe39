"""Queries on lookups, rules, packs and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.operators import lookup as L
from folio_spark.operators.graphs import closure
from folio_spark.plans import bindings as B
from folio_spark.plans.registry import query
from folio_spark.session import table


@query("""WITH r AS (SELECT c_custkey AS request_id, c_custkey % 40 AS c, unnest(['1', '3', '4', '5', '9']) AS number FROM customer), a AS (SELECT l_orderkey AS law_id, CAST(l_linenumber AS VARCHAR) AS number, min(l_partkey) AS text FROM lineitem GROUP BY 1, 2)
 SELECT request_id, r.number, CASE WHEN c % 7 > 0 THEN c END AS law_id, a.text IS NOT NULL AND c % 7 > 0 AS found, CASE WHEN c % 7 = 0 THEN 'law_not_found' WHEN a.text IS NULL THEN 'article_not_found' END AS error FROM r LEFT JOIN a ON a.law_id = r.c AND a.number = r.number""")
def j3_lookup_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 40
    requests = c.select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("law "), k).alias("mention"), F.lit("1,3-5,第九条").alias("spec"))
    resolved = c.select(F.concat(F.lit("law "), k).alias("mention"), k.alias("law_id")).distinct().where("law_id % 7 > 0")
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("law_id"), F.col("l_linenumber").cast("string").alias("number")).agg(F.min("l_partkey").alias("text"))
    return L.lookup_articles(requests, resolved, a).select("request_id", "number", "law_id", "found", "error")


@query("""WITH c AS (SELECT c_custkey AS request_id, c_custkey AS k FROM customer), v AS (SELECT o_custkey AS law_id, o_orderkey AS version_id, CAST(o_orderdate AS DATE) AS d FROM orders),
 s AS (SELECT request_id, 0 AS place, 'law ' || k AS name, '1,2,99' AS spec, k AS key, k, true AS is_law FROM c UNION ALL SELECT request_id, 1, 'set ' || k % 5, '1-3', k % 5, k, false FROM c UNION ALL SELECT request_id, 2, 'law ' || k, '', k, k, true FROM c UNION ALL SELECT request_id, 3, 'nothing', '4', -1, k, false FROM c),
 p AS (SELECT s.*, CASE WHEN is_law AND k % 10 <> 3 THEN key END AS law_id, CASE WHEN name LIKE 'set%' AND k % 4 <> 1 AND key < 4 THEN 's' || key END AS source_id,
  (SELECT arg_max(version_id, (d, version_id)) FROM v WHERE v.law_id = s.key AND s.is_law AND s.k % 4 = 1 AND s.k % 10 <> 3 AND d <= DATE '1994-01-01') AS version_id FROM s),
 e AS (SELECT *, CASE WHEN k % 4 = 2 THEN 'invalid_as_of' WHEN spec = '' THEN 'missing_numbers' WHEN law_id IS NULL AND source_id IS NULL THEN 'law_not_found' WHEN k % 4 = 1 AND version_id IS NULL THEN 'version_not_found_as_of' END AS error FROM p),
 n AS (SELECT *, CASE WHEN error IS NOT NULL THEN 0 ELSE 3 END AS item_count, CASE WHEN error IS NOT NULL THEN 0 WHEN source_id IS NOT NULL THEN 2 WHEN k % 4 = 1 THEN 1 + CAST(version_id % 2 AS INTEGER) ELSE 2 END AS found_count FROM e)
 SELECT request_id, CAST(place AS INTEGER) AS place, name, error, CAST(item_count AS BIGINT) AS item_count, CAST(found_count AS BIGINT) AS found_count, CAST(item_count - found_count AS BIGINT) AS missing_count, error IS NULL AND item_count = found_count AS ok FROM n""")
def j3_batch_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of four sections for each customer: a law, a private rule set, one without numbers, one that nobody knows."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    batch = F.concat(F.lit("law "), k, F.lit(":1,2,99；set "), k % 5, F.lit("：1-3; law "), k, F.lit(";nothing:4;  ;"))
    day = F.when(k % 4 == 1, "1994-01-01").when(k % 4 == 2, "1994-13-01").when(k % 4 == 3, "")
    requests = c.select(k.alias("request_id"), batch.alias("batch"), day.alias("as_of_text"))
    resolved = c.where(k % 10 != 3).select(F.concat(F.lit("law "), k).alias("mention"), k.alias("law_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("law_id"), F.col("o_orderkey").alias("version_id"), F.to_date("o_orderdate").alias("start"))
    # every law has 1 and 2 now; its versions have 1, and 2 where their number is odd
    now = resolved.select("law_id", F.lit(None).cast("long").alias("version_id"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("number"))
    then = o.select("law_id", "version_id", F.explode(F.when(F.col("version_id") % 2 == 1, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1")))).alias("number"))
    articles = now.unionByName(then).withColumn("text", F.lit("text"))
    sets = spark.range(4)
    private = sets.select(F.concat(F.lit("set "), "id").alias("mention"), F.concat(F.lit("s"), "id").alias("source_id"))
    clauses = private.select("source_id", F.explode(F.array(F.lit("1"), F.lit("3"))).alias("number")).withColumn("text", F.lit("clause"))
    found = L.answer_batches(requests, resolved, articles, o, private, clauses)
    return found.sections.select("request_id", "place", "name", "error", "item_count", "found_count", "missing_count", "ok")


_VER = "v AS (SELECT CAST(o_custkey AS VARCHAR) AS work_key, o_orderkey AS law_id, CAST(o_orderdate AS DATE) AS start, CASE WHEN o_orderkey % 11 = 0 THEN 'seed' ELSE 'current' END AS status, o_orderkey % 4 AS article_count FROM orders)"


@query(f"""WITH {_VER}, m AS (SELECT o_orderkey AS miss_id, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS law_id, CASE o_orderkey % 5 WHEN 0 THEN '1997-13-01' WHEN 1 THEN '1992-02-01' WHEN 2 THEN '1999-01-01' END AS d FROM orders),
 e AS (SELECT work_key, min(start) AS earliest FROM v GROUP BY 1), j AS (SELECT m.*, v.work_key, status, article_count, earliest FROM m LEFT JOIN v USING (law_id) LEFT JOIN e USING (work_key)),
 x AS (SELECT miss_id, earliest, CASE WHEN d = '1997-13-01' THEN 'invalid_as_of' WHEN work_key IS NULL THEN 'law_missing' WHEN d IS NOT NULL AND earliest > CAST(d AS DATE) THEN 'version_not_found_as_of' WHEN d IS NOT NULL THEN 'article_null_as_of' WHEN status = 'seed' THEN 'law_seed' WHEN article_count = 0 THEN 'law_stub' ELSE 'article_null' END AS reason
  FROM (SELECT * FROM j) q) SELECT miss_id, reason, CASE WHEN reason = 'version_not_found_as_of' THEN earliest END AS earliest FROM x""".replace("CAST(d AS DATE)", "TRY_CAST(d AS DATE)"))
def j18_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.versions(spark, sf_dir)
    k = F.col("law_id")
    laws = v.select("law_id", "work_key", F.when(k % 11 == 0, "seed").otherwise("current").alias("status"), (k % 4).alias("article_count"))
    day = F.when(k % 5 == 0, "1997-13-01").when(k % 5 == 1, "1992-02-01").when(k % 5 == 2, "1999-01-01")
    misses = v.select(k.alias("miss_id"), F.when(k % 6 == 0, k + 10000000).otherwise(k).alias("law_id"), day.alias("as_of_text"), F.lit("1").alias("number"))
    return L.diagnose(misses, laws, v)


@query("""WITH n AS (SELECT conv_id AS source_id, 'set ' || (conv_id % 30) AS mention FROM (SELECT DISTINCT conv_id FROM conversations)), c AS (SELECT conv_id AS source_id, conv_id * 1000 + turn AS clause_id, turn AS position, CAST(turn AS VARCHAR) AS number, 'T' || turn AS display FROM conversations),
 m AS (SELECT c_custkey AS miss_id, 'set ' || (c_custkey % 40) AS mention, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 5 AS VARCHAR) ELSE 'T' || (c_custkey % 5) END AS number FROM customer WHERE c_custkey % 3 > 0),
 h AS (SELECT miss_id, source_id, clause_id, CASE WHEN c.number = m.number THEN 0 ELSE 1 END AS tier, position FROM m JOIN n USING (mention) JOIN c USING (source_id) WHERE m.number = c.number OR m.number = c.display)
 SELECT miss_id, source_id, clause_id, CASE tier WHEN 0 THEN 'private_number' ELSE 'private_display' END AS via FROM (SELECT *, row_number() OVER (PARTITION BY miss_id ORDER BY tier, source_id, position, clause_id) AS r FROM h) WHERE r = 1""")
def j16_norm_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, k = F.col("conv_id"), F.col("turn"), F.col("c_custkey")
    c = table(spark, sf_dir, "conversations")
    norms = c.select(conv.alias("source_id"), F.array(F.concat(F.lit("set "), conv % 30)).alias("names")).distinct()
    clauses = c.select(conv.alias("source_id"), (conv * 1000 + turn).alias("clause_id"), turn.cast("string").alias("number"), F.concat(F.lit("T"), turn).alias("number_display"), F.lit(None).cast("string").alias("title"), turn.alias("position"))
    number = F.when(k % 2 == 0, (k % 5).cast("string")).otherwise(F.concat(F.lit("T"), k % 5))
    misses = table(spark, sf_dir, "customer").select(k.alias("miss_id"), F.concat(F.lit("set "), k % 40).alias("mention"), number.alias("number"), F.when(k % 3 == 0, "1999-01-01").alias("as_of_text"))
    return L.norm_fallback(misses, norms, clauses)


@query("""WITH e AS (SELECT s_suppkey AS f, s_nationkey AS t, CASE WHEN s_suppkey % 2 = 0 THEN 'amends' ELSE 'cites' END AS relation_type FROM supplier), b AS (SELECT f AS law_id, 'out' AS direction, relation_type, t AS other_id FROM e UNION ALL SELECT t, 'in', relation_type, f FROM e)
 SELECT s_suppkey AS request_id, direction, relation_type, other_id, s2.s_name AS other_title FROM (SELECT s_suppkey FROM supplier) q JOIN b ON b.law_id = q.s_suppkey LEFT JOIN (SELECT s_suppkey AS k, s_name FROM supplier) s2 ON s2.k = other_id""")
def j12_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    edges = s.select(F.col("s_suppkey").alias("from_law_id"), F.col("s_nationkey").cast("long").alias("to_law_id"), F.when(F.col("s_suppkey") % 2 == 0, "amends").otherwise("cites").alias("relation_type"), F.lit(None).cast("date").alias("effective_at"))
    laws = s.select(F.col("s_suppkey").alias("law_id"), F.col("s_name").alias("title"))
    return L.relations(laws.select(F.col("law_id").alias("request_id"), "law_id"), edges, laws).drop("effective_at")


_RULES = "rules AS (SELECT p_partkey AS rule_id, p_name AS topic, CASE WHEN p_size % 5 = 0 THEN 'all' ELSE p_brand END AS domain, CASE WHEN p_size % 7 > 0 THEN DATE '1995-01-01' + p_size * 20 END AS f, CASE WHEN p_size % 4 > 0 THEN DATE '1996-01-01' + p_size * 30 END AS t FROM part)"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    day = lambda d, k: F.date_add(F.lit(d).cast("date"), z * k)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("topic"), F.when(z % 5 == 0, "all").otherwise(F.col("p_brand")).alias("domain"),
        F.when(z % 7 > 0, day("1995-01-01", 20)).alias("effective_from"), F.when(z % 4 > 0, day("1996-01-01", 30)).alias("effective_to"),
        F.when(z % 9 > 0, F.col("p_partkey") + 5).alias("primary_law_id"), F.when(z % 3 == 0, F.col("p_partkey") + 1000).alias("fallback_law_id"), F.col("p_type").alias("rule_text"),
    )


@query(f"""WITH {_RULES}, q AS (SELECT c_custkey AS request_id, p_name AS topic, p_brand AS domain, DATE '1996-01-01' + CAST(c_custkey % 900 AS INT) AS d FROM customer JOIN part ON p_partkey = c_custkey),
 h AS (SELECT request_id, rule_id, f, r.topic <> q.topic AS other FROM q JOIN rules r ON contains(lower(r.topic), lower(q.topic)) WHERE (f IS NULL OR f <= d) AND (t IS NULL OR t >= d) AND (r.domain = 'all' OR r.domain = q.domain))
 SELECT request_id, rule_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY other, f DESC NULLS LAST, rule_id) AS INTEGER) AS place FROM h""")
def j13_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("topic"), F.col("p_brand").alias("domain"))
    q = table(spark, sf_dir, "customer").join(p, "c_custkey").select(F.col("c_custkey").alias("request_id"), "topic", "domain", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("as_of"))
    return L.applicable(q, _rules(spark, sf_dir))


@query("""WITH r AS (SELECT p_partkey AS rule_id, 'primary' AS role, p_partkey + 5 AS law_id FROM part WHERE p_size % 9 > 0 UNION ALL SELECT p_partkey, 'fallback', p_partkey + 1000 FROM part WHERE p_size % 3 = 0), l AS (SELECT p_partkey AS law_id, p_size FROM part)
 SELECT rule_id, role, law_id, need FROM (SELECT rule_id, role, r.law_id, CASE WHEN l.law_id IS NULL THEN 'missing' WHEN p_size % 10 = 0 THEN 'seed' WHEN p_size % 4 = 0 THEN 'stub' END AS need FROM r LEFT JOIN l USING (law_id)) WHERE need IS NOT NULL""")
def j14_needs_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("law_id"), F.when(F.col("p_size") % 10 == 0, "seed").otherwise("current").alias("status"), (F.col("p_size") % 4).alias("article_count"))
    return L.needs_fetch(_rules(spark, sf_dir), laws)


@query("SELECT topic, count(*) AS rules, count(DISTINCT domain) AS domains FROM (SELECT p_name AS topic, CASE WHEN p_size % 5 = 0 THEN 'all' ELSE p_brand END AS domain FROM part) GROUP BY 1")
def a11_rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rule_coverage(_rules(spark, sf_dir))


@query("""WITH n AS (SELECT DISTINCT l_partkey AS law_id, l_linenumber AS number, l_suppkey AS book_id, l_orderkey AS note_id FROM lineitem), q AS (SELECT p_partkey AS request_id, p_partkey AS law_id, p_size % 7 + 1 AS number FROM part)
 SELECT request_id, note_id, CAST(place AS INTEGER) AS place FROM (SELECT request_id, note_id, row_number() OVER (PARTITION BY request_id ORDER BY book_id, note_id) AS place FROM q JOIN n USING (law_id, number)) WHERE place <= 3""")
def j15_commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("law_id"), F.col("l_linenumber").alias("number"), F.col("l_suppkey").alias("book_id"), F.col("l_orderkey").alias("note_id")).distinct().withColumn("position", F.lit(1))
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("law_id"), (F.col("p_size") % 7 + 1).alias("number"))
    return L.commentary_for(q, notes, 3)


@query("""WITH i AS (SELECT DISTINCT l_orderkey % 100 AS pack_id, l_partkey AS item_id, l_linenumber AS n FROM lineitem), a AS (SELECT pack_id, item_id, CASE WHEN n <= p_size % 8 AND p_partkey IS NOT NULL THEN NULL WHEN p_partkey IS NULL THEN 'law_missing' WHEN p_size % 10 = 0 THEN 'law_seed' WHEN p_size % 8 = 0 THEN 'law_stub' ELSE 'article_missing' END AS code
  FROM i LEFT JOIN part ON p_partkey = item_id + 30) SELECT pack_id, item_id, code FROM a WHERE code IS NOT NULL UNION ALL SELECT s_suppkey, NULL, 'dependency_pack_missing' FROM supplier WHERE s_suppkey + 50 > 99""")
def j19_validate_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, none = table(spark, sf_dir, "part"), F.lit(None).cast("string")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("pack_id"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("n")).distinct()
    items = lines.select("pack_id", "item_id", (F.col("item_id") + 30).alias("law_id"), F.col("n").cast("string").alias("article_number"), F.lit("article").alias("item_type"), none.alias("norm_source_id"), none.alias("clause_number"))
    laws = p.select(F.col("p_partkey").alias("law_id"), F.when(F.col("p_size") % 10 == 0, "seed").otherwise("current").alias("status"), (F.col("p_size") % 8).alias("article_count"))
    articles = laws.where("article_count > 0").select("law_id", F.explode(F.sequence(F.lit(1), "article_count")).alias("n")).select("law_id", F.col("n").cast("string").alias("number"))
    packs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("pack_id")).distinct()
    deps = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pack_id"), F.lit("pack").alias("kind"), (F.col("s_suppkey") + 50).alias("ref"))
    empty = laws.limit(0).select(F.col("law_id").cast("string").alias("source_id"), F.lit("").alias("number"))
    return L.validate_packs(items, deps, laws, articles, empty, empty, packs)


@query("""WITH i AS (SELECT o_custkey AS pack_id, o_orderkey % 50 AS ref, o_orderpriority AS role, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'F'),
 n AS (SELECT o_custkey AS pack_id, o_orderkey % 50 AS ref, o_orderpriority AS role, min(o_orderkey) AS seq FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2, 3), f AS (SELECT n.* FROM n WHERE ref % 6 > 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.pack_id = n.pack_id AND i.ref = n.ref AND i.role = n.role)),
 l AS (SELECT pack_id, max(position) AS last FROM i GROUP BY 1) SELECT f.pack_id, ref, role, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY f.pack_id ORDER BY seq) AS INTEGER) AS position FROM f LEFT JOIN l USING (pack_id)""")
def s17_append_pack_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pack_id"), (F.col("o_orderkey") % 50).alias("ref"), F.col("o_orderpriority").alias("role"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    old = o.where("o_orderstatus = 'F'").withColumn("position", F.row_number().over(L.Window.partitionBy("pack_id").orderBy("seq"))).select("pack_id", "ref", "role", "position")
    return L.append_pack_items(old, o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), o.where("ref % 6 > 0").select("ref").distinct()).select("pack_id", "ref", "role", "position")


@query("""SELECT 's' || s_suppkey AS root, node, depth FROM supplier, LATERAL (SELECT 's' || s_suppkey AS node, 0 AS depth UNION ALL SELECT 'n' || s_nationkey, 1 UNION ALL SELECT 'r' || n_regionkey, 2 FROM nation WHERE n_nationkey = s_nationkey)""")
def j24_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    name = lambda p, c: F.concat(F.lit(p), c)
    edges = s.select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent")).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(r.select(name("r", "r_regionkey"), F.lit(None).cast("string")))
    return closure(s.select(name("s", "s_suppkey").alias("node")), edges).select("root", "node", "depth")


@query("SELECT p_name AS id, count(DISTINCT (p_brand, p_type)) AS definitions FROM part GROUP BY 1 HAVING count(DISTINCT (p_brand, p_type)) > 1")
def j24_definition_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.definition_conflicts(table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_partkey").alias("doc_id"), "p_brand", "p_type"))


@query("""WITH l AS (SELECT o_orderkey AS law_id, CAST(o_custkey AS VARCHAR) AS work_key, o_custkey % 400 AS n, o_orderstatus AS name, CAST(o_orderdate AS DATE) AS at FROM orders), d AS (SELECT c_custkey AS doc_id, c_custkey % 400 AS n, DATE '1996-01-01' + CAST(c_custkey AS INT) AS at FROM customer),
 b AS (SELECT doc_id, d.at, arg_max(law_id, (l.at, law_id)) AS law_id, arg_max(work_key, (l.at, law_id)) AS work_key FROM d JOIN l USING (n) WHERE name IN ('F', 'O') GROUP BY 1, 2)
 SELECT doc_id, law_id, b.work_key, EXISTS (SELECT 1 FROM l WHERE l.work_key = b.work_key AND l.at = b.at) AS same_day FROM b""")
def j25_align_reissues(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda k: F.concat(F.lit("证监会公告〔2020〕"), F.col(k) % 400, F.lit("号"))
    laws = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("law_id"), F.col("o_custkey").cast("string").alias("work_key"), number("o_custkey").alias("document_number"), F.array("o_orderstatus").alias("names"), F.to_date("o_orderdate").alias("effective_at"))
    full = F.concat(F.lit("中国证券监督管理委员会公告〔2020〕"), F.col("c_custkey") % 400, F.lit("号"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), full.alias("docnum"), F.array(F.lit("F"), F.lit("O")).alias("names"), F.date_add(F.lit("1996-01-01").cast("date"), F.col("c_custkey").cast("int")).alias("effective_at"))
    return L.align_reissues(docs, laws)
