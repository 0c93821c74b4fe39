"""Fast paths against plain ones: prefix filter, postings, substrings, closure, streams, registry."""

import random

from pyspark.sql import functions as F

from folio_spark.functions import similarity
from folio_spark.operators import grams as G
from folio_spark.operators import lookup as L
from folio_spark.operators import logs as Q
from folio_spark.operators import names as N
from folio_spark.operators import retrieval as R
from folio_spark.operators.graphs import closure, strong_parts
from folio_spark.plans import registry
from folio_spark.session import scratch
from folio_spark.sources import store as S
from folio_spark.streaming import streams as X

TITLES = ["中华人民共和国公司法", "中华人民共和国合伙企业法", "公司登记管理条例", "最高人民法院关于适用公司法若干问题的规定", "证券公司监督管理条例", "企业破产法", "商业银行法", "保险公司管理规定", "公司债券发行与交易管理办法", "外商投资法"]
ASKED = ["公司法", "公司登记条例", "合伙企业", "证券公司管理条例", "破产企业法", "银行商业法", "公司债券管理办法", "外商法"]


def test_fuzzy_names_lose_nothing(spark):
    laws = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "law_id long, title string")
    mentions = spark.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "mention_id long, mention string")
    got = {(r["mention_id"], r["title"]) for r in N.name_candidates(mentions, laws, most=99).collect()}
    assert got == {(i, t) for i, q in enumerate(ASKED) for t in TITLES if similarity._score(q, t) >= 0.6}


def test_resolution_tiers(spark):
    rows = [(1, "甲法", "current", 3, None, 1), (2, "甲法", "amended", 9, None, 2), (3, "乙条例实施细则", "current", 1, None, 3), (4, "丙法", "seed", 5, None, 4)]
    laws = spark.createDataFrame(rows, "law_id long, title string, status string, article_count int, released_at date, ingest_seq long").withColumn("aliases", F.array(F.concat(F.lit("别名"), "law_id")))
    mentions = spark.createDataFrame([(1, "甲法"), (2, " 别名3 "), (3, "实施细则"), (4, "细则"), (5, "条例"), (6, "2"), (7, None)], "mention_id int, mention string")
    got = {r["mention_id"]: (r["law_id"], r["tier"]) for r in N.resolve(mentions, laws, N.build_name_index(laws)).collect()}
    assert got == {1: (1, 1), 2: (3, 3), 3: (3, 6), 4: (3, 6), 5: (None, None), 6: (2, 0), 7: (None, None)}


def test_postings_search_equals_substrings(spark):
    texts = ["第三十条 公司应当依法登记。", "公司，应当", "应当公司登记依法", "第300条 abc123", "依法登记公司", ""]
    articles = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "article_id long, title string, text string")
    asked = ["公司应当", "依法登记", "登记 公司", "第300条"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, query string")
    got = {(r["query_id"], r["article_id"]) for r in R.verbatim_search(queries, articles, R.build_postings(articles)).collect()}
    assert got == {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if all(s in t for s in q.split())}
    everything = R.scan(queries, articles.withColumn("law_id", F.col("article_id")).withColumn("position", F.lit(1)).withColumn("released_at", F.lit(None).cast("date")), 99)
    assert got == {(r["query_id"], r["article_id"]) for r in everything.collect()}


def test_substring_search_equals_a_scan(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("aabbc Cé第条") for _ in range(r.randrange(0, 60))) for _ in range(120)] + [None, "", "ab", "a" * 500, "abcabcabcabd 😀😀😀x"]
    titles = [None if i % 7 == 0 else "abac" if i % 5 == 0 else "" for i in range(len(texts))]
    rows = [(i, titles[i], t, None, i // 9, i) for i, t in enumerate(texts)]
    articles = spark.createDataFrame(rows, "article_id long, title string, text string, released_at date, law_id long, position int")
    asked = ["abc", "aab bca", "bb aabb", "a", "ABAC", "bcabd", "aaaaaaa", "zzz", "第条", "é第条", "abcabcabd", "😀😀x", "aba bab", "abcab bc a"]
    asked += ["".join(r.choice("abc") for _ in range(r.randrange(3, 8))) for _ in range(40)]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, query string")
    pairs = lambda df: {(x["query_id"], x["article_id"]) for x in df.select("query_id", "article_id").collect()}
    want = pairs(R.scan(queries, articles, 1 << 30))
    assert want == {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if all(s in (t or "").lower() or s in (titles[j] or "") for s in q.lower().split())}
    assert pairs(R.substring_search(queries, articles, G.Grams(G.build_grams(articles)))) == want
    found = R.substring_search(queries, articles, G.store_grams(articles, scratch(spark, "grams"), buckets=4, spread=3))
    assert pairs(found) == want and found.count() == len(want)
    assert R.substring_search(queries, articles.limit(0), G.Grams(G.build_grams(articles.limit(0)))).count() == 0


def test_a_batch_reads_through_texts_and_stores_no_trigrams(spark, monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("aabbc Cé第条\n") for _ in range(r.randrange(0, 60))) for _ in range(120)] + [None, "", "ab", "a" * 500, "abcabcabcabd 😀😀😀x"]
    titles = [None if i % 7 == 0 else "abac" if i % 5 == 0 else "" for i in range(len(texts))]
    articles = spark.createDataFrame(list(zip(range(len(texts)), titles, texts)), "article_id long, title string, text string")
    asked = ["abc", "aab bca", "bb aabb", "a", "", "ABAC", "aaaaaaa", "zzz", "第条", "é第条", "😀😀x", "abcab bc a", "abc"]
    asked += ["".join(r.choice("abc") for _ in range(r.randrange(3, 6))) for _ in range(20)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = sorted((i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if all(s in (t or "").lower() or s in (titles[j] or "") for s in q.lower().split()))
    for most in (G.MOST_GRAMS, 0):
        monkeypatch.setattr(G, "MOST_GRAMS", most)
        found = R.substring_search(queries, articles)
        assert sorted((x["query_id"], x["article_id"]) for x in found.collect()) == want
    monkeypatch.undo()
    plan = R.substring_search(queries, articles)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(article_id" not in plan


def test_scans_in_batches(spark, monkeypatch):
    monkeypatch.setattr(R, "BATCH", 3)
    articles = spark.createDataFrame([(i, "", "ab" * i, None, 1, i) for i in range(5)], "article_id long, title string, text string, released_at date, law_id long, position int")
    queries = spark.createDataFrame([(i, "b" * (i % 2) + "a") for i in range(10)], "query_id long, query string")
    assert R.scan(queries, articles, 99).count() == 5 * 4 + 5 * 3


def test_tokens_of_an_arrow_step_are_those_of_columns(spark):
    texts = ["第三十条 公司应当 abc12 Ｄ．e", "ÀÉ ẞ Straße", "公", "a公b 公司c12公", "x" * 3, "ﬁ①２", "İstanbul ǅ 가나 12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["ts"] for r in df.select(R.tokens(similarity.normal(F.col("t"))).alias("ts")).collect()] == [R.token_list(t) for t in texts]


def test_an_index_is_stored_once(spark):
    at = scratch(spark, "table")
    spark.createDataFrame([(1, "", "a b a")], "article_id long, title string, text string").write.parquet(at)
    articles, stored = spark.read.parquet(at), []
    store = lambda path: stored.append(path) or R.store_index(articles, path, 2, 2)
    for _ in range(2):
        index = R.kept(articles, "kept", store, lambda path: R.open_index(articles, path, 2))
        assert sorted((r["token"], r["tf"], r["size"]) for r in index.postings.collect()) == [("a", 2, 3), ("b", 1, 3)] and index.articles == 1
    assert len(stored) == 1


def test_closure_finds_cycles_and_unknown_parents(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "gone"), ("y", None)], "node string, parent string")
    rows = closure(spark.createDataFrame([("a",), ("x",), ("y",)], "node string"), edges).collect()
    got = {(r["root"], r["node"], r["depth"], r["issue"]) for r in rows}
    assert got == {("a", "a", 0, None), ("a", "b", 1, None), ("a", "c", 2, None), ("a", "a", 3, "cycle"), ("x", "x", 0, None), ("x", "gone", 1, "unknown_parent"), ("y", "y", 0, None)}


def test_strong_parts_and_closure_equal_plain_walks(spark):
    r = random.Random(3)
    edges = sorted({(r.randrange(24), r.randrange(24)) for _ in range(40)} | {(100, 101), (101, 102), (100, 102)})
    near = {u: {v for a, v in edges if a == u} for u, _ in edges}

    def reached(u):
        out, todo = {}, [(u, 0)]
        for node, d in todo:
            for v in near.get(node, ()):
                if v not in out:
                    out[v] = d + 1
                    todo.append((v, d + 1))
        return out

    ahead = {u: reached(u) for u in range(103)}
    df = spark.createDataFrame(edges, "u long, v long")
    got = {x["node"]: x["part"] for x in strong_parts(df).collect()}
    same = lambda a, b: a != b and b in ahead[a] and a in ahead[b]
    assert set(got) == {a for a in ahead if any(same(a, b) for b in ahead)}
    assert all((got[a] == got[b]) == same(a, b) for a in got for b in got if a != b)
    rows = closure(spark.createDataFrame([(0,), (5,), (100,), (999,)], "node long"), df.toDF("node", "parent")).collect()
    nodes = {u for u, _ in edges}
    plain = {(x["root"], x["node"]): (x["depth"], x["issue"]) for x in rows if x["issue"] != "cycle"}
    want = {(q, v): (0 if v == q else d, None if v in nodes else "unknown_parent") for q in (0, 5, 100) if q in nodes for v, d in {**ahead[q], q: 0}.items()}
    assert plain == want
    for x in rows:
        if x["issue"] == "cycle":
            assert x["node"] in ahead[x["node"]]


def test_a_long_chain_has_no_limit(spark):
    edges = spark.range(40).select(F.col("id").alias("node"), F.when(F.col("id") < 39, F.col("id") + 1).alias("parent"))
    rows = closure(spark.createDataFrame([(0,)], "node long"), edges)
    assert [tuple(x) for x in rows.orderBy("depth").collect()] == [(0, i, i, None) for i in range(40)]


def test_latency_equals_percentiles(spark):
    r = random.Random(4)
    rows = [("a", r.choice([1.0, 2.0, 2.0, 1e9, r.random()]), i) for i in range(501)] + [("b", 5.0, 1), ("b", None, 2), ("c", None, 3), (None, 7.0, 4), (None, 9.0, 5)]
    rows += [("hot", 3.0, i) for i in range(2000)] + [("hot", float(i), i) for i in range(100)]
    events = spark.createDataFrame(rows, "tool string, duration_ms double, s long").withColumn("at", F.timestamp_seconds("s"))
    want = events.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.expr("percentile(duration_ms, 0.5)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95"))
    key = lambda df: sorted((str(x["tool"]), x["calls"], x["median"], x["p95"]) for x in df.collect())
    assert key(Q.latency(events)) == key(want)


def test_siblings_of_a_name_that_everyone_has(spark):
    laws = spark.range(5000).select(F.col("id").alias("law_id"), F.lit("t").alias("title"), F.lit("current").alias("status"), F.lit(1).alias("article_count"), F.lit(None).cast("date").alias("released_at"), F.col("id").alias("ingest_seq"), F.array(F.lit("all"), F.concat(F.lit("n"), F.col("id") % 2000)).alias("names"))
    got = N.siblings(laws)
    assert got.count() == 25000 and got.where("sibling_id = law_id").count() == 0
    some = {r["sibling_id"] for r in got.where("law_id = 4999").collect()}
    assert some == {4998, 4997, 4996, 4995, 4994}


def test_zero_hits_and_folding_guard(spark):
    q = spark.createDataFrame([(1, "甲 乙丙 丁戊", []), (2, "x", ["某法"]), (3, "y", [])], "query_id int, query string, unresolved array<string>")
    got = {r["query_id"]: (r["code"], r["retries"]) for r in R.zero_hits(q, q.where("query_id = 3")).collect()}
    assert got == {1: ("no_match_under_filters", ["乙丙", "丁戊"]), 2: ("unresolved_law_scope", ["某法"])}


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 7)
    a, b = (S.release_digest(d, "t").first()["digest"] for d in (df, df.orderBy(F.desc("id")).repartition(7)))
    assert a == b != S.release_digest(df.where("id > 0"), "t").first()["digest"]


def test_ingest_repeats_and_refreshes(spark, tmp_path):
    def land(name, rows):
        spark.createDataFrame(rows, "law_id long, content_hash string, metadata_hash string, text_hash string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = X.file_stream(spark, str(tmp_path / "in"), "law_id long, content_hash string, metadata_hash string, text_hash string, seq long")
        X.stream_ingest(source, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        return {r["law_id"]: (r["content_hash"], r["metadata_hash"], r["action"]) for r in X.latest(spark, str(tmp_path / "out")).collect()}

    land("a", [(1, "c", "m", "t", 1), (2, "c", "m", "t", 1)])
    assert run() == {1: ("c", "m", "insert"), 2: ("c", "m", "insert")}
    land("b", [(1, "c", "new", "t", 2), (2, "c", "m", "t", 2), (3, "c", "m", "t", 2)])
    assert run() == {1: ("c", "new", "refresh"), 2: ("c", "m", "insert"), 3: ("c", "m", "insert")}
    assert run()[1] == ("c", "new", "refresh")


def test_registry_names_and_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 120


def test_batches_of_lookups(spark):
    requests = [(1, "甲法：1,第三条;乙制度:2-3；丙法", None), (2, "甲法:1;丁法:9", "2020-05-01"), (3, "甲法:1", "2020-5-1"), (4, "甲法:，；：5; 甲法:2", ""), (5, None, None), (6, "乙制度:2", "2020-05-01"), (7, "甲法:1", "2001-01-01")]
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    found = L.answer_batches(
        frame(requests, "request_id int, batch string, as_of_text string"), frame([("甲法", 10)], "mention string, law_id int"),
        frame([(10, None, "1", "今一"), (10, None, "3", "今三"), (10, 7, "1", "旧一"), (10, 8, "1", "新一")], "law_id int, version_id int, number string, text string"),
        frame([(10, 7, "2010-01-01"), (10, 8, "2021-01-01")], "law_id int, version_id int, start string").withColumn("start", F.to_date("start")),
        frame([("乙制度", "s")], "mention string, source_id string"), frame([("s", "2", "条")], "source_id string, number string, text string"),
    )
    sections = {(r["request_id"], r["place"]): (r["name"], r["kind"], r["error"], r["found_count"], r["missing_count"], r["ok"]) for r in found.sections.collect()}
    assert sections == {
        (1, 0): ("甲法", "law_articles", None, 2, 0, True), (1, 1): ("乙制度", "norm_clauses", None, 1, 1, False), (1, 2): ("丙法", None, "missing_numbers", 0, 0, False),
        (2, 0): ("甲法", "law_articles", None, 1, 0, True), (2, 1): ("丁法", None, "law_not_found", 0, 0, False), (3, 0): ("甲法", None, "invalid_as_of", 0, 0, False),
        (4, 0): ("甲法", None, "empty_numbers", 0, 0, False), (4, 1): ("甲法", "law_articles", None, 0, 1, False),
        (6, 0): ("乙制度", None, "law_not_found", 0, 0, False), (7, 0): ("甲法", None, "version_not_found_as_of", 0, 0, False),
    }
    assert {(r["request_id"], r["number"], r["text"]) for r in found.items.collect()} == {(1, "1", "今一"), (1, "3", "今三"), (1, "2", "条"), (1, "3", None), (2, "1", "旧一"), (4, "2", None)}
    report = {r["request_id"]: (r["law_count"], r["item_count"], r["error_count"], r["ok"]) for r in found.report.collect()}
    assert report[1] == (3, 4, 2, False) and report[3] == (1, 0, 1, False) and 5 not in report
