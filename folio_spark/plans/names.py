"""Queries on names and numbers. Parts are records, their names and brands are what is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions import docnum, numerals, similarity
from folio_spark.operators import names as N
from folio_spark.plans import bindings as B
from folio_spark.plans.registry import query
from folio_spark.session import table


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    status = F.when(F.col("p_size") % 10 == 0, "seed").when(F.col("p_size") % 3 == 0, "amended").otherwise("current")
    return p.select(
        F.col("p_partkey").alias("law_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_name").alias("short_title"),
        F.concat(F.lit("No. "), "p_size", F.lit("/"), "p_brand").alias("document_number"),
        F.array(F.concat_ws(" ", "p_brand", "p_name")).alias("aliases"), status.alias("status"), (F.col("p_size") % 4).alias("article_count"),
        F.date_add(F.lit("1990-01-01").cast("date"), F.col("p_size")).alias("released_at"), F.col("p_partkey").alias("ingest_seq"),
    )


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part asks for something: an id, a title, a short name, an alias, a number, a piece of a title, or nothing known."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    kinds = [
        k.cast("string"), F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name"),
        F.concat(F.lit("No. "), "p_size", F.lit("/"), "p_brand"), F.concat(F.substring("p_name", 3, 30), F.lit(" "), F.substring("p_type", 1, 3)), F.concat("p_name", F.lit(" zzz"), k),
    ]
    mention = F.coalesce(*[F.when(k % 7 == i, c) for i, c in enumerate(kinds)])
    return p.select(k.alias("mention_id"), mention.alias("mention"))


_LAWS = """laws AS (SELECT p_partkey AS law_id, p_name || ' ' || p_type AS title, p_name AS short_title, 'No. ' || p_size || '/' || p_brand AS document_number, p_brand || ' ' || p_name AS alias,
 CASE WHEN p_size % 10 = 0 THEN 'seed' WHEN p_size % 3 = 0 THEN 'amended' ELSE 'current' END AS status, p_size % 4 AS article_count, DATE '1990-01-01' + p_size AS released_at FROM part),
 mentions AS (SELECT p_partkey AS mention_id, CASE p_partkey % 7 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_name WHEN 3 THEN p_brand || ' ' || p_name
 WHEN 4 THEN 'No. ' || p_size || '/' || p_brand WHEN 5 THEN substr(p_name, 3, 30) || ' ' || substr(p_type, 1, 3) ELSE p_name || ' zzz' || p_partkey END AS mention FROM part),
 keys AS (SELECT CAST(law_id AS VARCHAR) AS key, law_id, 0 AS tier FROM laws UNION ALL SELECT title, law_id, 1 FROM laws UNION ALL SELECT short_title, law_id, 2 FROM laws
 UNION ALL SELECT alias, law_id, 3 FROM laws UNION ALL SELECT document_number, law_id, 5 FROM laws),
 m AS (SELECT DISTINCT trim(mention) AS mention FROM mentions),
 eq AS (SELECT mention, law_id, tier FROM m JOIN keys ON mention = key),
 sub AS (SELECT mention, law_id, 6 AS tier FROM m JOIN laws ON contains(lower(title), lower(mention)) WHERE mention NOT IN (SELECT mention FROM eq)),
 allm AS (SELECT * FROM eq UNION ALL SELECT * FROM sub),
 r AS (SELECT mention, law_id, tier, row_number() OVER (PARTITION BY mention ORDER BY tier, CASE WHEN status = 'seed' THEN 1 ELSE 0 END,
 CASE status WHEN 'current' THEN 0 WHEN 'amended' THEN 1 ELSE 4 END, CASE WHEN article_count > 0 THEN 0 ELSE 1 END, released_at DESC, article_count DESC, length(title), law_id DESC) AS n FROM allm JOIN laws USING (law_id)),
 resolved AS (SELECT mention_id, mentions.mention, law_id, tier FROM mentions LEFT JOIN (SELECT * FROM r WHERE n = 1) w ON trim(mentions.mention) = w.mention)"""


@query(f"WITH {_LAWS} SELECT mention_id, mention, law_id, tier FROM resolved")
def j1_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = _laws(spark, sf_dir)
    return N.resolve(_mentions(spark, sf_dir), laws, N.build_name_index(laws)).select("mention_id", "mention", "law_id", "tier")


@query(f"""WITH {_LAWS}, c AS (SELECT p_size AS mention_id, law_id, status, article_count, released_at, title FROM laws JOIN part ON law_id = p_partkey)
 SELECT mention_id, law_id FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY CASE WHEN status = 'seed' THEN 1 ELSE 0 END, CASE status WHEN 'current' THEN 0 WHEN 'amended' THEN 1 ELSE 4 END,
 CASE WHEN article_count > 0 THEN 0 ELSE 1 END, released_at DESC, article_count DESC, length(title), law_id DESC) AS n FROM c) WHERE n = 1""")
def w1_prefer_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("law_id"), F.col("p_size").alias("mention_id"))
    return N.prefer_record(_laws(spark, sf_dir).join(sizes, "law_id")).select("mention_id", "law_id")


@query(f"""WITH {_LAWS}, ids AS (SELECT DISTINCT law_id FROM resolved WHERE law_id IS NOT NULL) SELECT l_partkey AS law_id, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT law_id FROM ids) GROUP BY 1""")
def f2_restrict_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = _laws(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("law_id"))
    kept, _ = N.restrict_to(rows, _mentions(spark, sf_dir), laws, N.build_name_index(laws))
    return kept.groupBy("law_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LAWS} SELECT mention_id, mention FROM resolved WHERE law_id IS NULL")
def f2_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = _laws(spark, sf_dir)
    return N.restrict_to(laws, _mentions(spark, sf_dir), laws, N.build_name_index(laws))[1]


@query(f"""WITH {_LAWS} SELECT DISTINCT trim(r.mention) AS mention, r.law_id, CASE WHEN r.law_id IS NULL THEN 'missing' WHEN status = 'seed' THEN 'seed' WHEN article_count > 0 THEN 'present' ELSE 'stub' END AS state
 FROM resolved r LEFT JOIN laws USING (law_id)""")
def j26_coverage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    laws = _laws(spark, sf_dir)
    return N.coverage_plan(_mentions(spark, sf_dir), laws, N.build_name_index(laws))


@query("""WITH l AS (SELECT p_partkey AS law_id, unnest([p_name, p_brand || ' ' || p_type]) AS name FROM part),
 p AS (SELECT DISTINCT a.law_id, b.law_id AS sibling_id FROM l a JOIN l b USING (name) WHERE a.law_id <> b.law_id),
 f AS (SELECT p_partkey AS sibling_id, p_size, CASE WHEN p_size % 10 = 0 THEN 'seed' WHEN p_size % 3 = 0 THEN 'amended' ELSE 'current' END AS status, p_size % 4 AS article_count, p_name || ' ' || p_type AS title FROM part),
 r AS (SELECT law_id, sibling_id, row_number() OVER (PARTITION BY law_id ORDER BY CASE WHEN status = 'seed' THEN 1 ELSE 0 END, CASE status WHEN 'current' THEN 0 WHEN 'amended' THEN 1 ELSE 4 END,
 CASE WHEN article_count > 0 THEN 0 ELSE 1 END, p_size DESC, article_count DESC, length(title), sibling_id DESC) AS place FROM p JOIN f USING (sibling_id))
 SELECT law_id, sibling_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def j17_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("law_id"), F.concat_ws(" ", "p_brand", "p_type").alias("b"))
    laws = _laws(spark, sf_dir).join(brand, "law_id").withColumn("names", F.array("short_title", "b"))
    return N.siblings(laws)


@query("""WITH v AS (SELECT o_orderkey AS law_id, 'No.' || (o_orderkey % 3000) AS docnum, CASE WHEN o_orderkey % 3000 < 2000 THEN 'w' || (o_orderkey % 3000) ELSE 'w' || o_custkey END AS work_key, CAST(o_orderdate AS DATE) AS d FROM orders),
 q AS (SELECT c_custkey AS mention_id, 'No.' || (c_custkey * 3) AS docnum FROM customer),
 g AS (SELECT mention_id, count(DISTINCT work_key) AS works, arg_max(law_id, (CASE WHEN d <= DATE '1997-01-01' THEN 1 ELSE 0 END, d, law_id)) AS law_id FROM q JOIN v USING (docnum) GROUP BY 1)
 SELECT q.mention_id, CASE WHEN works = 1 THEN law_id END AS law_id, CASE WHEN works IS NULL THEN 'missing' WHEN works > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM q LEFT JOIN g USING (mention_id)""")
def j2_resolve_docnum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3000
    laws = o.select(
        F.col("o_orderkey").alias("law_id"), F.concat(F.lit("No. "), k).alias("document_number"),
        F.when(k < 2000, F.concat(F.lit("w"), k)).otherwise(F.concat(F.lit("w"), "o_custkey")).alias("work_key"), F.to_date("o_orderdate").alias("effective_at"), F.col("o_orderkey").alias("ingest_seq"),
    )
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mention_id"), F.concat(F.lit(" No. "), F.col("c_custkey") * 3).alias("mention"))
    return N.resolve_docnum(asked, laws, "1997-01-01")


@query("""SELECT c_custkey AS row_id, '证监会令第' || c_custkey || '号' AS variant FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '中国证监会令第' || c_custkey || '号' FROM customer WHERE c_custkey % 2 = 0
 UNION ALL SELECT c_custkey, '中国证券监督管理委员会令第' || c_custkey || '号' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '法释〔2023〕' || c_custkey || '号' FROM customer WHERE c_custkey % 2 = 1""")
def p5_docnum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    raw = F.when(c % 2 == 0, F.concat(F.lit("证监会令 第"), c, F.lit(" 号"))).otherwise(F.concat(F.lit("法释〔2023〕 "), c, F.lit("号")))
    rows = table(spark, sf_dir, "customer").select(c.alias("row_id"), raw.alias("docnum"))
    return docnum.docnum_variants(rows).select("row_id", "variant")


@query("""SELECT l_orderkey AS row_id, l_linenumber AS line, l_partkey AS part, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_partkey % 9999 + 1 AS VARCHAR) WHEN 1 THEN (l_partkey % 9999 + 1) || '-' || l_linenumber
 WHEN 2 THEN CAST(l_partkey % 9999 + 1 AS VARCHAR) ELSE (l_partkey % 9999 + 1) || '.' || l_linenumber END AS article_key FROM lineitem""")
def p1_article_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References spelled in Chinese numerals, with inserted numbers, paragraph suffixes or dots, back to keys."""
    rows = table(spark, sf_dir, "lineitem").withColumn("value", F.col("l_partkey") % 9999 + 1).join(F.broadcast(numerals.numeral_dim(spark)), "value")
    n, p = F.col("l_linenumber"), F.col("value")
    raw = F.coalesce(
        F.when(n % 4 == 0, F.concat(F.lit("第"), "numeral", F.lit("条"))), F.when(n % 4 == 1, F.concat(F.lit(" 第"), "numeral", F.lit("条之"), n)),
        F.when(n % 4 == 2, F.concat(F.lit("第 "), p, F.lit("条第二款第（一）项"))), F.concat(p, F.lit("."), n),
    )
    raw = F.regexp_replace(raw, "第（一）项", "第三项")
    rows = rows.select(F.col("l_orderkey").alias("row_id"), n.alias("line"), F.col("l_partkey").alias("part"), raw.alias("raw"))
    return numerals.with_article_key(rows, "raw").drop("raw")


@query("SELECT DISTINCT l_partkey % 9999 + 1 AS value, CAST(l_partkey % 9999 + 1 AS VARCHAR) AS back FROM lineitem")
def p2_numeral_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numerals that the order lines' parts need, and what they read as, character by character."""
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 9999 + 1).alias("value")).distinct()
    return numerals.numeral_dim(spark).join(asked, "value").select("value", numerals.folded_value(F.col("numeral")).cast("string").alias("back"))


@query("""WITH t AS (SELECT o_orderkey AS row_id, unnest(range(o_orderkey % 50, o_orderkey % 50 + 4)) AS number FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders)
 SELECT DISTINCT row_id, CAST(number AS VARCHAR) AS number FROM t""")
def p3_explode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 50
    spec = F.concat(k, F.lit("-"), k + 3, F.lit("，"), "o_custkey", F.lit(","), k)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), spec.alias("spec"))
    return numerals.explode_number_spec(rows).select("row_id", "number")


@query("SELECT o_custkey AS doc, string_agg(number, ' ' ORDER BY length(number), number) AS numbers FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey AS VARCHAR) AS number FROM orders) GROUP BY 1")
def t2_order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("string").alias("number")).distinct()
    keys = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(numerals.order_numbers(F.col("number")))])
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(keys)), lambda x: x["k1"]), " ").alias("numbers"))


@query("""SELECT s_suppkey AS law_id, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['N' || s_nationkey || '号法'] ELSE ['N' || s_nationkey || '号法解释一', 'N' || s_nationkey || '号法解释（一）', 'N' || s_nationkey || '号法解释'] END) AS alias FROM supplier""")
def p7_derive_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = F.concat(F.lit("N"), "s_nationkey", F.lit("号法"))
    title = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(N.PRC), law)).otherwise(F.concat(F.lit("最高人民法院关于适用《" + N.PRC), law, F.lit("》若干问题的解释（1）")))
    laws = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("law_id"), title.alias("title"))
    return N.derive_aliases(laws).select("law_id", "alias")


@query("SELECT s_suppkey AS law_id, 'N' || s_nationkey || '法' AS alias, 'exact' AS kind FROM supplier UNION ALL SELECT s_suppkey, 'Supplier' || s_suppkey || '法', 'derived' FROM supplier WHERE s_suppkey % 3 > 0")
def p8_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    title = F.when(k % 3 == 0, F.concat(F.lit(N.PRC + "N"), "s_nationkey", F.lit("法"))).otherwise(F.concat(F.lit(N.PRC + "Supplier"), k, F.lit("法")))
    laws = table(spark, sf_dir, "supplier").select(k.alias("law_id"), title.alias("title"), F.array(F.concat(F.lit("N"), "s_nationkey", F.lit("法"))).alias("aliases"))
    return N.build_name_index(laws).select("law_id", "alias", "kind")


@query("""WITH b AS (SELECT c_custkey AS batch_id, CAST(c_nationkey AS VARCHAR) || '/' || (c_custkey % 40) AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS source FROM customer),
 l AS (SELECT c_custkey AS law_id, CAST(c_nationkey AS VARCHAR) || '/' || (c_custkey % 40) AS name, c_mktsegment AS source FROM customer WHERE c_custkey % 2 = 0),
 rec AS (SELECT batch_id, list_sort(list(DISTINCT CAST(law_id AS VARCHAR))) AS r FROM b JOIN l USING (name) WHERE b.source IS NULL OR b.source = l.source GROUP BY 1),
 refs AS (SELECT batch_id, list_sort(list(DISTINCT CAST(s_suppkey AS VARCHAR))) AS q FROM b JOIN (SELECT s_suppkey, s_nationkey || '/' || (s_suppkey % 40) AS name FROM supplier) USING (name) GROUP BY 1),
 j AS (SELECT b.batch_id, coalesce(r, []) AS r, coalesce(q, []) AS q FROM b LEFT JOIN rec USING (batch_id) LEFT JOIN refs USING (batch_id))
 SELECT batch_id, CASE WHEN len(q) = 1 THEN q[1] WHEN len(q) > 1 AND len(list_intersect(r, q)) = 1 THEN list_intersect(r, q)[1] WHEN len(q) = 0 AND len(r) = 1 THEN r[1] END AS canonical_id,
 CASE WHEN len(q) = 1 OR len(q) > 1 AND len(list_intersect(r, q)) = 1 THEN 'reference' WHEN len(q) > 1 THEN 'ambiguous' WHEN len(r) = 1 THEN 'record' WHEN len(r) > 1 THEN 'ambiguous' ELSE 'new' END AS outcome FROM j""")
def j20_match_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, none = table(spark, sf_dir, "customer"), F.lit(None).cast("date")
    names = F.array(F.concat_ws("/", "c_nationkey", F.col("c_custkey") % 40)).alias("names")
    dates = [none.alias("released_at"), none.alias("effective_at")]
    batch = c.select(F.col("c_custkey").alias("batch_id"), names, F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("source"), *dates)
    laws = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("law_id"), names, F.col("c_mktsegment").alias("source"), *dates)
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref_id"), F.concat_ws("/", "s_nationkey", F.col("s_suppkey") % 40).alias("name"))
    return N.match_entities(batch, laws, refs)


@query("""WITH n AS (SELECT s_suppkey AS name_id, CASE s_suppkey % 4 WHEN 0 THEN (SELECT p_name FROM part p WHERE p.p_partkey = s_suppkey) WHEN 1 THEN (SELECT p_name || p_type FROM part p WHERE p.p_partkey = s_suppkey)
  WHEN 2 THEN (SELECT substr(p_name, 2, 6) FROM part p WHERE p.p_partkey = s_suppkey) ELSE (SELECT substr(p_name, 1, 3) || substr(p_type, 1, 4) FROM part p WHERE p.p_partkey = s_suppkey) END AS name FROM supplier),
 q AS (SELECT name_id, lower(replace(name, ' ', '')) AS q FROM n), c AS (SELECT p_partkey AS candidate_id, lower(replace(p_name || p_type, ' ', '')) AS t, lower(replace(p_name, ' ', '')) AS s, CASE WHEN p_size % 3 = 0 THEN 'current' ELSE 'amended' END AS status, p_size AS d FROM part),
 r AS (SELECT name_id, candidate_id, status, d, CASE WHEN t = q THEN 0 WHEN s = q THEN 1 WHEN contains(t, q) THEN 2 WHEN length(q) >= 4 AND regexp_matches(t, array_to_string(string_split(q, ''), '.*')) THEN 3 END AS rank FROM q, c),
 b AS (SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY name_id) AS m FROM r WHERE rank IS NOT NULL) WHERE rank = m),
 g AS (SELECT name_id, rank, count(*) AS n, count(*) FILTER (WHERE status = 'current') AS live, min(candidate_id) AS only_, arg_max(candidate_id, (status = 'current', d, -candidate_id)) AS newest FROM b GROUP BY 1, 2)
 SELECT q.name_id, CASE WHEN n = 1 THEN only_ WHEN live > 0 THEN newest END AS candidate_id, CAST(rank AS INTEGER) AS rank, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 OR live > 0 THEN 'chosen' ELSE 'ambiguous' END AS outcome FROM q LEFT JOIN g USING (name_id)""")
def j21_choose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("s_suppkey")
    kinds = [F.col("p_name"), F.concat("p_name", "p_type"), F.substring("p_name", 2, 6), F.concat(F.substring("p_name", 1, 3), F.substring("p_type", 1, 4))]
    asked = table(spark, sf_dir, "supplier").join(p, k == F.col("p_partkey")).select(k.alias("name_id"), F.coalesce(*[F.when(k % 4 == i, c) for i, c in enumerate(kinds)]).alias("name"))
    listings = p.select(
        F.col("p_partkey").alias("candidate_id"), F.concat("p_name", "p_type").alias("title"), F.array("p_name").alias("names"), F.when(F.col("p_size") % 3 == 0, "current").otherwise("amended").alias("status"), F.col("p_size").alias("released_at")
    )
    return N.choose_candidates(asked, listings)


@query()
def j22_name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelled part names against all part titles; scores need matching blocks, so there is no SQL."""
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("mention_id"), F.concat(F.expr("substring(p_name, 2)"), F.lit("x "), F.substring("p_type", 1, 5)).alias("mention"))
    laws = p.select(F.col("p_partkey").alias("law_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return N.name_candidates(asked, laws)


@query("SELECT doc_id, lower(replace(text, 'ﬁ', 'fi')) AS normal FROM documents WHERE doc_id % 2 = 0 OR doc_id % 2 = 1")
def u_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", similarity.normal(F.col("text")).alias("normal"))
