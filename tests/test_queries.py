"""Registered queries on rows that larger tables have, and the shape of their joins."""

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from folio_spark.functions import numerals, similarity
from folio_spark.operators import citations as C
from folio_spark.operators import lookup as L
from folio_spark.operators import names as N
from folio_spark.operators import pages as P
from folio_spark.operators import quality as Q
from folio_spark.operators import retrieval as R
from folio_spark.operators import texts as X
from folio_spark.plans import registry


def most_rows(spark, df):
    """The rows of df, and the most that any step of it gave."""
    bus, store = spark._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    at = store.executionsCount()
    rows = df.collect()
    bus.waitUntilEmpty()
    most, runs = 0, store.executionsList()
    for i in range(at, runs.size()):
        run = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for metric in (m for n in map(nodes.apply, range(nodes.size())) for m in map(n.metrics().apply, range(n.metrics().size()))):
            value = values.get(metric.accumulatorId())
            if metric.name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "")))
    return rows, most


def test_records_are_not_sent_whole_to_resolve_names(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    rows = [(1, "甲乙条例实施细则", "seed", 3, day, 1), (2, "甲乙条例实施细则", "current", 0, day, 2), (3, "甲乙条例实施细则", "current", 2, None, 3), (4, "甲乙条例实施细则二", "current", 2, day, 4)]
    laws = spark.createDataFrame(rows, "law_id long, title string, status string, article_count int, released_at date, ingest_seq long").withColumn("aliases", F.array(F.lit("别名")))
    laws.write.parquet(f"{tmp_path}/laws")  # small on disk, which is all that a plan knows of it
    laws = spark.read.parquet(f"{tmp_path}/laws")
    mentions = spark.createDataFrame([(1, "实施细则"), (2, "条例实施细则二"), (3, "别名"), (4, "乙条例实")], "mention_id int, mention string")
    found = N.resolve(mentions, laws, N.build_name_index(laws))
    assert {r["mention_id"]: (r["law_id"], r["tier"]) for r in found.collect()} == {1: (4, 6), 2: (4, 6), 3: (4, 3), 4: (4, 6)}
    assert "SortMergeJoin [law_id" in found._jdf.queryExecution().executedPlan().toString()


def test_titles_keep_the_references_that_the_sql_keeps(spark, tmp_path):
    titles = ["a &amp; b", "k = &quot;x", "so&amp", "&amp;quot; y", "&AMP; &lt;"]
    rows = [(i, "http://a/", f"<html><head><title>{t}</title></head><body><p>k = &quot;x &amp</p></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.queries()["s10_pages_to_text"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [r["title"] for r in got][:4] == ["a & b", "k = &quot;x", "so&amp", "&quot; y"]
    assert {r["text"] for r in got} == {'k = "x &'}


def test_texts_keep_the_references_that_the_sql_keeps(spark, tmp_path):
    titles = ["token = &quot", "token = &qu", "it&#x27;s &#x2", "&copy &copy; &lt;b&gt; &AMP;", "&amp;quot; &amp;amp; &amp;amp &amp x"]
    rows = [(i, "http://a/", f"<html><head><title>{t}</title></head><body><nav>x</nav><article><h1>{t}</h1><p>y &quot;{t}&quot;</p></article></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = ["token = &quot", "token = &qu", "it&#x27;s &#x2", "&copy © &lt;b&gt; &AMP;", "&quot; &; & & x"]
    for query, before in (("p13_main_content", ""), ("s10_pages_to_text", "x\n")):
        got = registry.queries()[query](spark, str(tmp_path)).orderBy("page_id").collect()
        assert [r["text"] for r in got] == [f'{before}{x}\ny "{x}"' for x in want]
    assert [r["title"] for r in got] == [t.replace("&amp;", "&") for t in titles]


def test_records_that_come_anew_meet_no_order_of_that_number(spark, tmp_path):
    rows = [(5, 7, "F"), (10, 8, "O"), (1_000_005, 9, "P"), (1_000_011, 3, "O")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, registry.queries()["s11_upsert"](spark, str(tmp_path)).select("law_id", "status", F.coalesce("work_id", F.lit(0))).collect()))
    assert got == [(5, "Z", 7), (10, "Z", -1), (1_000_005, "Z", 0), (1_000_005, "Z", 9), (1_000_010, "Z", -1), (1_000_011, "O", 3), (2_000_005, "Z", 0)]


def test_rules_of_a_plan_to_delete_are_those_below_100(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (2, 99, 100, 102)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i,) for i in (99, 100, 102)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(2,)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in registry.queries()["s13_plan_delete"](spark, str(tmp_path)).collect()}
    assert got == {(2, "", 1), (99, "rules,packs", 0), (100, "", 0), (102, "packs", 0)}


def test_network_addresses_start_no_item(spark):
    lines = ["甲", "28.68.191.238 Den", "1.2.3.4 总则", "2. 丙", "3.1 丁", "10.20.30.40", "1.2.3.4.5 戊"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    assert X.rejoin_lines(rows).first()["text"] == "甲28.68.191.238 Den\n1.2.3.4 总则\n2. 丙\n3.1 丁10.20.30.40\n1.2.3.4.5 戊"


def test_equal_listings_are_compared_once(spark):
    listings = [(i, "公司登记条例", ["登记条例"], "current" if i < 50 else "amended", i) for i in range(100)] + [(200, "银行法", ["行法"], "amended", 1), (201, "银行法", ["行法"], "amended", 2), (202, "证券法", None, "amended", 1)]
    listings = spark.createDataFrame(listings, "candidate_id long, title string, names array<string>, status string, released_at int")
    names = spark.createDataFrame([(i, "登记 条例") for i in range(100)] + [(100, "银行"), (101, "《证券法》"), (102, "无")], "name_id long, name string")
    rows, most = most_rows(spark, N.choose_candidates(names, listings))
    assert {tuple(r) for r in rows} == {(i, 49, 1, "chosen") for i in range(100)} | {(100, None, 2, "ambiguous"), (101, 202, 0, "chosen"), (102, None, None, "none")}
    assert most < 2000


def test_rules_are_paired_by_distinct_topics_and_not_sent_whole(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    spark.createDataFrame([(i, "公司登记" if i % 2 else "登记", "all", None, None) for i in range(60)], "rule_id long, topic string, domain string, effective_from date, effective_to date").write.parquet(f"{tmp_path}/r")
    requests = spark.createDataFrame([(1, "公司登记", "x", day), (2, "登记", "x", day), (3, "无", "x", day)], "request_id long, topic string, domain string, as_of date")
    found = L.applicable(requests, spark.read.parquet(f"{tmp_path}/r"))
    got = {}
    for r in found.collect():
        got.setdefault(r["request_id"], []).append((r["place"], r["rule_id"]))
    assert [x for _, x in sorted(got[1])] == list(range(1, 60, 2)) and [x for _, x in sorted(got[2])] == [*range(0, 60, 2), *range(1, 60, 2)] and 3 not in got
    assert "SortMergeJoin [l#" in found._jdf.queryExecution().executedPlan().toString()


def test_articles_that_cite_a_target_are_found_without_a_shuffle_of_all(spark):
    hosts = range(1000, 1100)
    edges = [(h, n, 7, "3") for h in hosts for n in ("1", "1", "2")] + [(1000, "1", 7, "4"), (1000, "1", 8, "4"), (7, "1", 7, "3")]
    edges = spark.createDataFrame(edges, "host_law_id long, host_number string, law_id long, number string")
    shape = "target_id long, law_id long, number string"
    one = spark.createDataFrame([(t, 7, "3") for t in range(100)] * 2, shape)
    found = C.cited_by(edges, one)
    assert sorted(map(tuple, found.collect())) == sorted((t, h, n) for t in range(100) for h in hosts for n in "12")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    more = spark.createDataFrame([(200, 7, "3"), (200, 7, "4"), (200, 8, "4"), (201, 8, "4")], shape)
    several = C.cited_by(edges, one.union(more), include_self=True).where("target_id >= 200")
    assert sorted(map(tuple, several.collect())) == sorted([(200, h, n) for h in hosts for n in "12"] + [(200, 7, "1"), (201, 1000, "1")])


def test_requests_of_one_topic_share_a_list_of_rules(spark, monkeypatch):
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    rules = [(i, "公司登记" if i % 2 else "登记", ("all", "x", "y")[i % 3], day(i) if i % 5 else None, day(i + 20) if i % 4 else None) for i in range(60)] + [(0, "登记", "all", None, day(3))]
    requests = [(i, "登记", ("x", None)[i % 2], day(i) if i < 50 else None) for i in range(52)] + [(100, "登记", "y", day(9)), (100, "公司登记", "y", day(9))]

    def place(own):
        hits = {(t != q, -(f.toordinal() if f else 0), i) for q, d, at in own for i, t, of, f, to in rules if q in t and (d is None or of in ("all", d)) and (f is None or at and f <= at) and (to is None or at and to >= at)}
        return [i for *_, i in sorted(hits)]

    asked = {}
    for i, *what in requests:
        asked.setdefault(i, []).append(what)
    want = sorted((i, rule, n + 1) for i, own in asked.items() if i < 100 for n, rule in enumerate(place(own)))
    shape = "rule_id long, topic string, domain string, effective_from date, effective_to date"
    for most in (L.LISTED, 7):
        monkeypatch.setattr(L, "LISTED", most)
        found = L.applicable(spark.createDataFrame(requests, "request_id long, topic string, domain string, as_of date"), spark.createDataFrame(rules, shape))
        got = sorted(map(tuple, found.collect()))
        assert [x for x in got if x[0] < 100] == want
        assert len({x[2] for x in got if x[0] == 100}) == len([x for x in got if x[0] == 100]) > 0
    alone = L.applicable(spark.createDataFrame(requests[:-2], "request_id long, topic string, domain string, as_of date"), spark.createDataFrame(rules, shape).limit(7))
    assert "Window" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_equal_mentions_are_scored_once(spark):
    laws = spark.createDataFrame([(i, f"公司登记条例{i}") for i in range(40)], "law_id long, title string")
    mentions = spark.createDataFrame([(i, "公司登记条列") for i in range(100)] + [(100, None)], "mention_id long, mention string")
    rows, most = most_rows(spark, N.name_candidates(mentions, laws))
    assert len(rows) == 500 and {r["place"] for r in rows} == {1, 2, 3, 4, 5} and len({r["title"] for r in rows}) == 5
    assert most < 2000


def test_reissues_do_not_meet_all_records_of_their_number(spark):
    day = lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(i)
    laws = [(i, f"w{i}", "No. 1", ["x", None] if i % 2 else ["y", "x"], day(i)) for i in range(200)] + [(500, "v", "No. 1", ["z"], None), (501, "v", "No. 2", ["x"], day(900))]
    docs = [(i, "No. 1", ["y"] if i else ["x", "x"], day(198)) for i in range(200)] + [(300, "No. 1", ["z"], day(1)), (301, "No. 1", ["q"], day(1)), (302, "No. 1", None, day(1))]
    laws = spark.createDataFrame(laws, "law_id long, work_key string, document_number string, names array<string>, effective_at date")
    docs = spark.createDataFrame(docs, "doc_id long, docnum string, names array<string>, effective_at date")
    rows, most = most_rows(spark, L.align_reissues(docs, laws))
    assert {tuple(r) for r in rows} == {(0, 199, "w199", False), (300, 500, "v", False)} | {(i, 198, "w198", True) for i in range(1, 200)}
    assert most < 5000


def test_drafts_do_not_meet_all_records_of_their_name(spark):
    current = spark.createDataFrame([(i, "f", "a") for i in range(200)] + [(200, "f", "b")], "law_id long, fingerprint string, name string")
    drafts = spark.createDataFrame([(i, i, "f", "a") for i in range(200)] + [(200, 200, "old", "b"), (201, 0, "f", "b"), (202, None, "f", "b")], "draft_id long, law_id long, base_fingerprint string, name string")
    rows, most = most_rows(spark, Q.conflicts(drafts, current))
    assert {tuple(r) for r in rows} == {(i, "name_taken") for i in range(200)} | {(200, "base_changed"), (201, "name_taken"), (202, "base_changed")}
    assert most < 1000


def test_equal_quotes_of_a_batch_are_compared_once(monkeypatch):
    asked = []
    monkeypatch.setattr(similarity, "_best", lambda q, t: asked.append((q, t)) or 0.5)
    got = similarity.best_window_ratio.func(pd.Series(["a", None, "a", "b", None]), pd.Series(["x", None, "x", "x", None]))
    assert list(got) == [0.5] * 5 and len(asked) == 3


def test_queries_meet_the_articles_of_their_rarest_token(spark):
    articles = spark.createDataFrame([(i, "", f"all rare{i % 40}") for i in range(400)], "article_id long, title string, text string")
    queries = spark.createDataFrame([(k, f"all rare{k}") for k in range(40)], "query_id long, query string")
    rows, most = most_rows(spark, R.bm25(queries, R.build_postings(articles), 400))
    assert {(r["query_id"], r["article_id"]) for r in rows} == {(i % 40, i) for i in range(400)} and most <= 1000


def test_pools_of_any_token_lose_nothing(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(9)]
    texts = [" ".join(r.choices(words, [2**-i for i in range(9)], k=r.randrange(1, 7))) for _ in range(300)]
    postings = R.build_postings(spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "article_id long, title string, text string"))
    queries = spark.createDataFrame([(k, " ".join(r.sample(words, 3)) + " nowhere") for k in range(12)], "query_id long, query string")
    got, want = R._best_any(queries, postings, 300, "text", 20, None).collect(), {}
    for x in sorted(R.bm25(queries, postings, 300, require_all=False, only="text").collect(), key=lambda x: (-round(x["score"], 6), x["article_id"])):
        want.setdefault(x["query_id"], []).append(x["article_id"])
    assert {(x["query_id"], x["article_id"]) for x in got} == {(q, a) for q, ids in want.items() for a in ids[:20]}


def test_a_search_stores_no_row_for_every_character(spark, tmp_path):
    laws = spark.createDataFrame([(1, "alpha ab", "law", "x", "w1", datetime.date(2020, 1, 1), "current"), (2, "beta", "law", "x", "w2", datetime.date(2020, 1, 1), "current")], "law_id long, title string, level string, issuing_body string, work_key string, start date, derived_status string")
    laws = laws.withColumn("short_title", F.lit(None).cast("string"))
    articles = spark.createDataFrame([(10, 1, "1", "p", "one two", "alpha ab"), (20, 2, "1", "p", "one", "beta")], "article_id long, law_id long, number string, part string, text string, title string")
    corpus = R.Corpus(articles, laws, laws.select(F.col("title").alias("name"), "law_id"))
    index = R.store_corpus(corpus, f"{tmp_path}/kinds")
    assert sorted(x.name for x in (tmp_path / "kinds").iterdir()) == ["kind=article", "kind=law"]
    queries = spark.createDataFrame([(1, "ab", None), (2, "alpha ab", None), (3, "one", ["beta"]), (4, "one", ["gone"])], "query_id long, query string, in_laws array<string>")
    got = {(r["query_id"], r["kind"], r["ref"]) for r in R.search(queries, corpus, index, R.Options(limit=10)).collect()}
    assert got == {(1, "article", "10"), (1, "law", "1"), (2, "article", "10"), (2, "law", "1"), (3, "article", "20")}


def test_misses_meet_the_first_clause_of_a_name_and_number(spark):
    misses = spark.range(200).select(F.col("id").alias("miss_id"), F.lit("set").alias("mention"), F.when(F.col("id") % 2 == 0, "1").otherwise("T1").alias("number"), F.when(F.col("id") == 7, "1999-01-01").alias("as_of_text"))
    norms = spark.range(50).select((F.col("id") + 3).alias("source_id"), F.array(F.lit("set"), F.lit("set")).alias("names"))
    clauses = norms.select("source_id", (F.col("source_id") * 10).alias("clause_id"), F.lit("1").alias("number"), F.lit("T1").alias("number_display"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("position"))
    rows, most = most_rows(spark, L.norm_fallback(misses, norms, clauses))
    assert {tuple(r) for r in rows} == {(i, 3, 30, "private_display" if i % 2 else "private_number") for i in range(200) if i != 7} and most <= 400


def test_equal_askers_meet_a_name_s_records_once(spark):
    none = [F.lit(None).cast("date").alias(c) for c in ("released_at", "effective_at")]
    kind = lambda k: F.when(F.col("id") % 3 != 0, F.concat(F.lit("s"), F.col("id") % 2)).alias("source")
    names = F.array(F.when(F.col("id") < 100, "many").otherwise(F.concat(F.lit("n"), F.col("id")))).alias("names")
    batch = spark.range(103).select(F.col("id").alias("batch_id"), names, kind(0), *none)
    laws = spark.range(102).select(F.col("id").alias("law_id"), names, kind(0), *none)
    refs = spark.createDataFrame([(5, "many"), (6, "many"), (4, "many"), (900, "n102")], "ref_id long, name string")
    rows, most = most_rows(spark, N.match_entities(batch, laws, refs))
    got = {r["batch_id"]: (r["canonical_id"], r["outcome"]) for r in rows}
    # 6 has no source and agrees with all; 4 is of s0, 5 of s1
    assert got[0] == (None, "ambiguous") and got[2] == (None, "ambiguous") and got[100] == ("100", "record") and got[101] == ("101", "record") and got[102] == ("900", "reference")
    assert len(rows) == 103 and most <= 700


def test_a_reference_that_one_record_confirms(spark):
    none = [F.lit(None).cast("date").alias(c) for c in ("released_at", "effective_at")]
    of = lambda rows, key: spark.createDataFrame(rows, f"{key} long, names array<string>, source string").select("*", *none)
    laws = of([(10, ["a"], "s"), (11, ["a"], "t"), (20, ["b", "c"], None), (21, ["b"], "s")], "law_id")
    batch = of([(1, ["a"], "s"), (2, ["a"], None), (3, ["c", "b"], "t"), (4, ["b"], None), (5, [], "s")], "batch_id")
    refs = spark.createDataFrame([(10, "a"), (99, "a"), (7, "x")], "ref_id long, name string")
    got = {r["batch_id"]: (r["canonical_id"], r["outcome"]) for r in N.match_entities(batch, laws, refs).collect()}
    assert got == {1: ("10", "reference"), 2: ("10", "reference"), 3: ("20", "record"), 4: (None, "ambiguous"), 5: (None, "new")}


def test_links_are_read_a_few_pages_at_a_time(spark):
    rows = [(i, f"http://h{i}/x", "".join(f'<p>t<a href="/{i}/{k}">a{k}</a></p>' for k in range(i % 3)) if i % 7 else None) for i in range(150)]
    found = P.explode_links(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    got = {(r["page_id"], r["target"], r["anchor"], r["place"]) for r in found.collect()}
    assert got == {(i, f"http://h{i}/{i}/{k}", f"a{k}", k) for i in range(150) if i % 7 for k in range(i % 3)}
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_lists_of_numbers_are_read_once(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "1,3-5,第九条,4").when(F.col("id") % 3 == 1, "").alias("spec"))
    rows, most = most_rows(spark, numerals.explode_number_spec(df).groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("ordinal")))
    want = {("1", 100, 0), ("3", 100, 1_000_000), ("4", 100, 1_000_001), ("5", 100, 1_000_002), ("9", 100, 2_000_000)}
    assert {tuple(r) for r in rows} == want and most <= 500


def test_usual_displays_need_no_patterns(spark):
    rows = [(1, 1, "12", "t", "第12条"), (2, 1, "12", "t", "第十二条"), (3, 1, "12", "t", "第13条"), (4, 1, "012", "t", "第012条"), (5, 1, "12", "t", None), (6, 1, "正文", "t", "第1条")]
    articles = spark.createDataFrame(rows, "law_id long, position int, number string, text string, number_display string")
    found = Q.article_violations(articles)
    assert sorted(map(tuple, found.collect())) == [(3, "display_disagrees"), (4, "display_disagrees")]
    assert "^[1-9][0-9]{0,17}$" in found._jdf.queryExecution().optimizedPlan().toString()
