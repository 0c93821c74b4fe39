"""Queries on logs, streams and readers. Streams run over the given tables as files and end when all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.operators import logs as L
from folio_spark.operators.versions import content_hash
from folio_spark.plans import bindings as B
from folio_spark.plans.registry import query
from folio_spark.session import scratch, table
from folio_spark.sources import readers as R
from folio_spark.streaming import streams as X
from folio_spark.streaming import sync as Y

_EV = "e AS (SELECT event_id AS id, ts AS at, event_type AS tool, CASE WHEN event_type = 'error' THEN 'x' END AS error, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value AS duration_ms FROM events)"


def _events(df: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "x").alias("error"), (k % 5).alias("hits"), F.col("value").alias("duration_ms"))


def _landed(spark: SparkSession, df: DataFrame, at: str, files: int | None = 4) -> DataFrame:
    """A table laid down as files in the shared folder, as a stream."""
    df.write.parquet(f"{at}/landed")
    return X.file_stream(spark, f"{at}/landed", df.schema, files=files)


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS hits, CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 END AS found FROM events")
def p20_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "article").otherwise("other")
    k = F.get_json_object("props", "$.k").cast("int")
    result = F.when(F.col("event_id") >= 0, F.to_json(F.struct(k.alias("total"), (k % 2 == 0).alias("found"))))
    return L.summarize_outcomes(e.select(F.col("event_id").alias("id"), tool.alias("tool"), result.alias("result"))).select("id", "hits", "found")


@query(f"WITH {_EV} SELECT tool, count(*) AS calls, count(error) AS errors, count(*) FILTER (WHERE k % 5 = 0 AND tool = 'search') AS zero_hits FROM (SELECT *  REPLACE (CASE tool WHEN 'view' THEN 'search' ELSE tool END AS tool) FROM e) GROUP BY 1")
def a8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(table(spark, sf_dir, "events")).withColumn("tool", F.when(F.col("tool") == "view", "search").otherwise(F.col("tool")))
    return L.usage(e.withColumn("found", F.lit(True))).select("tool", "calls", "errors", "zero_hits")


@query("SELECT event_type AS tool, count(*) AS calls, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a9_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.latency(_events(table(spark, sf_dir, "events")))
    return found.select("tool", "calls", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY event_id LIMIT 500")
def s8_read_query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "id", "ts": "at"})
    return R.read_query_log(log, "2024-01-15 00:00:00", 500).select(F.col("id").alias("event_id"), F.col("at").alias("ts"))


@query("WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT o_orderkey AS request_id, 1 AS laws, CAST((SELECT count(*) FROM t WHERE l_orderkey = o_orderkey) AS INTEGER) AS articles FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def p21_build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("law_id"), F.col("o_orderpriority").alias("title"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("string").alias("number"), F.col("l_linenumber").cast("string").alias("text"))
    found = L.build_evidence(o.join(items, "request_id").withColumn("command", F.lit("article")))
    return found.select("request_id", F.size("laws").alias("laws"), F.size("articles").alias("articles"))


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS INTEGER) % 5 = 0) AS zero_hits FROM events GROUP BY 1, 2)
 SELECT * FROM w WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def x4_stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream; windows that the watermark has closed when all is read."""
    at = scratch(spark, "usage")
    source = _landed(spark, table(spark, sf_dir, "events"), at)
    X.stream_usage(_events(source), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("window_start", "tool", "calls", "errors", "zero_hits")


@query("SELECT doc_id AS law_id, 'insert' AS action FROM documents")
def x1_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, then all again as if after a failure: a repeated batch replaces its own rows."""
    at = scratch(spark, "ingest")
    docs = table(spark, sf_dir, "documents")
    for run in ("first", "second"):
        source = _landed(spark, docs, f"{at}/{run}")
        rows = source.select(F.col("doc_id").alias("law_id"), F.sha1("text").alias("content_hash"), F.sha1(F.concat_ws("|", "lang", "source")).alias("metadata_hash"), F.sha1("text").alias("text_hash"), F.lit(0).alias("seq"))
        X.stream_ingest(rows, f"{at}/target", f"{at}/checkpoint-{run}").awaitTermination()
    return X.latest(spark, f"{at}/target").select("law_id", "action")


@query("SELECT c_custkey AS source, CASE WHEN c_custkey % 4 = 0 THEN DATE '1997-01-01' ELSE DATE '1997-06-01' + CAST(c_custkey % 30 AS INTEGER) - 7 END AS from_date, CASE WHEN c_custkey % 4 = 0 THEN DATE '1997-02-01' ELSE DATE '1998-01-01' END AS to_date FROM customer")
def x2_next_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = lambda d: F.lit(d).cast("date"), F.col("c_custkey")
    states = table(spark, sf_dir, "customer").select(k.alias("source"), F.date_add(day("1997-06-01"), (k % 30).cast("int")).alias("last_end"), day("1997-01-01").alias("open_from"), F.when(k % 4 == 0, day("1997-02-01")).alias("open_to"), day("1998-01-01").alias("today"))
    return X.next_window(states, 7)


@query("""WITH o AS (SELECT 's' || (o_custkey % 10) AS source, o_orderkey, o_orderkey % 30 AS law_id, CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE 'y' END AS content, o_orderpriority AS meta, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS rn FROM orders),
 p AS (SELECT *, (rn - 1) // 10 + 1 AS page, lag((content, meta)) OVER (PARTITION BY source, law_id ORDER BY rn) AS was FROM o),
 c AS (SELECT *, CASE WHEN was IS NULL OR content <> was[1] THEN 'load' WHEN meta <> was[2] THEN 'refresh' ELSE 'skip' END AS change FROM p),
 f AS (SELECT source, page, count(*) AS n, count(*) FILTER (WHERE change = 'load') AS l, count(*) FILTER (WHERE change = 'skip') AS s, count(*) FILTER (WHERE change = 'refresh') AS r FROM c GROUP BY 1, 2),
 g AS (SELECT *, page - coalesce(max(CASE WHEN l > 0 THEN page END) OVER (PARTITION BY source ORDER BY page), 0) AS stable FROM f),
 e AS (SELECT source, min(page) AS stop FROM g WHERE page > 5 AND l = 0 AND stable >= 2 GROUP BY 1),
 t AS (SELECT g.*, stop FROM g LEFT JOIN e USING (source) WHERE page > 5 AND page <= coalesce(stop, page))
 SELECT source, CAST(6 AS BIGINT) AS start_page, max(page) + 1 AS next_page, count(*) AS pages_synced, CAST(sum(n) AS BIGINT) AS rows_seen, CAST(sum(l) AS BIGINT) AS laws_loaded, CAST(sum(s) AS BIGINT) AS laws_skipped,
  CAST(sum(r) AS BIGINT) AS metadata_refreshed, arg_max(stable, page) AS stable_pages_seen, (SELECT max(page) FROM f WHERE f.source = t.source AND f.l > 0 AND f.page <= max(t.page)) AS last_changed_page, CASE WHEN any_value(stop) IS NULL THEN 'no_rows' ELSE 'stable_pages' END AS stop_reason FROM t GROUP BY source""")
def x3_sync_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as list pages of ten sources: five pages each, then on from there until two pages in a row bring nothing new."""
    o = table(spark, sf_dir, "orders").withColumn("source", F.concat(F.lit("s"), F.col("o_custkey") % 10))
    n = F.row_number().over(Window.partitionBy("source").orderBy("o_orderkey"))
    pages = o.select("source", n.alias("n"), (F.col("o_orderkey") % 30).alias("law_id"), F.when(F.col("o_orderstatus") == "P", "x").otherwise("y").alias("content_hash"), F.col("o_orderpriority").alias("metadata_hash"))
    pages = pages.select("source", (F.floor((F.col("n") - 1) / 10) + 1).alias("page"), F.col("n").alias("position"), "law_id", "content_hash", "metadata_hash")
    store = scratch(spark, "sync")
    Y.sync(pages, store, Y.Rules(max_pages=5))
    return Y.sync(pages, store, Y.Rules(stable_after=2))


@query("SELECT DISTINCT user_id % 100 AS request FROM events")
def x5_stream_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lines made of the events, a hundred different ones and broken ones between; each is kept once."""
    at = scratch(spark, "evidence")
    source = _landed(spark, table(spark, sf_dir, "events"), at)
    n = F.col("user_id") % 100
    good = F.to_json(F.struct(F.concat(F.lit("ev-"), n).alias("evidence_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("article").alias("command")))
    lines = source.select(F.explode(F.array(good, F.lit('{"evidence_id": "br'))).alias("value"))
    X.stream_evidence(lines, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.substring("evidence_id", 4, 9).cast("long").alias("request"))


@query("""SELECT conv_id AS law_id, turn || '#1' AS item, 'added' AS change FROM conversations UNION ALL SELECT DISTINCT conv_id, 'field:articles', 'added' FROM conversations""")
def x6_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents that arrive in one batch of many files: everything is an addition."""
    at = scratch(spark, "changes")
    source = _landed(spark, table(spark, sf_dir, "conversations").repartition("conv_id"), at, files=None)
    rows = source.select(F.col("conv_id").alias("law_id"), F.col("turn").cast("string").alias("number"), F.col("turn").alias("position"), "text")
    X.stream_changes(rows, f"{at}/state", f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/log").select("law_id", "item", "change")


@query("SELECT doc_id AS law_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS reviewed FROM documents")
def x6_valid_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as review marks; a mark with quality 0 saw an older text."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("law_id"), F.col("quality").cast("string").alias("fingerprint"))
    current = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("law_id"), F.lit("1").alias("fingerprint"))
    return X.valid_reviews(marks, current)


def _written(spark: SparkSession, df: DataFrame, label: str, rows: int = 1000) -> str:
    """Rows as JSON files in the shared folder, each an array of about so many objects, one a line, as the readers take them."""
    at = scratch(spark, label)
    files = max(32, -(-df.count() // rows))
    one = F.to_json(F.struct(*df.columns))
    arrays = df.select(one.alias("o")).withColumn("file", F.pmod(F.xxhash64("o"), F.lit(files))).groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("o"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("file").text(at)
    return at


@query(f"WITH {B.ARTICLES_SQL} SELECT CAST(law_id AS VARCHAR) AS law_id, number, text, CAST(row_number() OVER (PARTITION BY law_id ORDER BY position) AS INTEGER) AS position FROM articles")
def s1_read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as canonical JSON and read back as articles."""
    a = B.articles(spark, sf_dir)
    one = F.struct("position", F.concat(F.lit("第"), "number", F.lit("条")).alias("number"), "text")
    docs = a.groupBy("law_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"), x["position"].alias("position"))).alias("articles"))
    path = _written(spark, docs.select(F.col("law_id").cast("string").alias("id"), F.lit("t").alias("title"), "articles"), "corpus")
    return R.read_corpus(spark, path)["articles"].select("law_id", "number", "text", "position")


@query("SELECT CAST(p_partkey AS VARCHAR) AS rule_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey < 1500 THEN 'n' || p_partkey ELSE 'o' || p_partkey END AS primary_law_id, CASE WHEN p_size % 2 = 0 THEN 'own' ELSE 'file' END AS source_name FROM part")
def s2_read_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    rule = F.struct(k.cast("string").alias("id"), F.concat(F.lit("o"), k).alias("primary_law_id"), F.when(F.col("p_size") % 2 == 0, "own").alias("source_name"))
    ids = F.when(k % 3 == 0, F.create_map(F.concat(F.lit("o"), k), F.concat(F.lit("n"), k)))
    path = _written(spark, p.select(F.lit("file").alias("source_name"), ids.alias("law_id_map"), F.array(rule).alias("rules")), "rules")
    laws = p.where("p_partkey < 1500").select(F.concat(F.lit("n"), k).alias("law_id"))
    return R.read_rules(spark, path, laws)["rules"].select("rule_id", "primary_law_id", "source_name")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'contract' ELSE 'other' END AS source_type, s_name AS aliases FROM supplier")
def s3_read_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "internal_policy").when(k % 3 == 1, "contract").otherwise("strange")
    padded = F.array(F.concat(F.lit(" "), "s_name"), F.col("s_name"), F.lit("  "))
    path = _written(spark, table(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.col("s_name").alias("name"), kind.alias("source_type"), padded.alias("aliases")), "norms")
    return R.read_norms(spark, path)["norms"].select("source_id", "source_type", F.array_join("aliases", "|").alias("aliases"))


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS x FROM conversations WHERE trim(text) <> '')
 SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn + 1 AS VARCHAR) AS number, md5(replace(string_agg(x, '' ORDER BY x), ' ', '')) AS text FROM t GROUP BY 1, 2""")
def s4_ingest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as whole text files, one a conversation, and cut into clauses, which hold their turns."""
    at = scratch(spark, "texts")
    turns = table(spark, sf_dir, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("x"))
    turns = turns.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x"))
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "x"))), lambda t: F.concat(F.lit("第"), t["turn"] + 1, F.lit("条 "), t["x"])), "\n")
    files = turns.groupBy("conv_id").agg(one.alias("value"))
    files.repartition(64, "conv_id").write.partitionBy("conv_id").text(at)
    found = R.ingest_text(spark, f"{at}/*/*.txt")
    return found.select(F.regexp_extract("doc_id", "conv_id=([0-9]+)", 1).cast("long").alias("conv_id"), "number", F.md5(F.regexp_replace("text", r"\s", "")).alias("text"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey % 50 AS k, l_suppkey AS s, l_orderkey, l_linenumber, l_partkey FROM lineitem)
 SELECT k || '/' || s AS pack_id, CAST(row_number() OVER (PARTITION BY k, s ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS position, CAST(l_partkey AS VARCHAR) AS law_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'clause' ELSE 'law' END AS item_type FROM i""")
def s5_read_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").distinct()
    item = F.struct("l_orderkey", "l_linenumber", "l_partkey", F.when(n == 0, "1").alias("article_number"), F.when(n == 1, "2").alias("clause_number"))
    read = lambda x: F.struct(x["l_partkey"].cast("string").alias("law_id"), x["article_number"].alias("article_number"), x["clause_number"].alias("clause_number"))
    packs = items.groupBy(F.concat_ws("/", "k", "l_suppkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(item)), read).alias("items"))
    return R.read_packs(spark, _written(spark, packs, "packs"))["items"].select("pack_id", "position", "law_id", "item_type")


@query("SELECT DISTINCT (l_orderkey % 50) || '/' || l_suppkey AS pack_id, 'law' AS kind, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem")
def s5_pack_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that items imply."""
    item = F.struct(F.col("l_partkey").cast("string").alias("law_id"))
    packs = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("/", F.col("l_orderkey") % 50, "l_suppkey").alias("id")).agg(F.collect_set(item).alias("items"))
    return R.read_packs(spark, _written(spark, packs, "packs"))["dependencies"]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS book_id, CAST(s_suppkey AS VARCHAR) || '#1' AS note_id, CAST(s_nationkey + 1 AS VARCHAR) AS number FROM supplier")
def s6_read_commentary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    note = F.struct(F.concat(F.lit("第"), F.col("s_nationkey") + 1, F.lit("条")).alias("article_number"), F.lit("l").alias("law_id"))
    path = _written(spark, table(spark, sf_dir, "supplier").select(F.struct(k.alias("id"), F.col("s_name").alias("title")).alias("book"), F.array(note).alias("items")), "books")
    return R.read_commentary(spark, path)["notes"].select("book_id", "note_id", "number")


@query("SELECT CAST(event_id AS VARCHAR) AS evidence_id, CAST(user_id AS VARCHAR) AS law_id FROM events")
def s7_read_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lines made of the events, every one followed by a broken line."""
    article = F.struct(F.lit("article").alias("evidence_level"), F.col("user_id").cast("string").alias("law_id"), F.lit("1").alias("number"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("evidence_id"), F.array(article).alias("articles")))
    at = scratch(spark, "evidence")
    table(spark, sf_dir, "events").select(F.explode(F.array(line, F.lit('{"evidence_id": "b'))).alias("value")).write.text(at)
    return R.evidence_items(R.read_evidence(spark, at)).select("evidence_id", "law_id")
