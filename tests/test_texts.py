"""Segmentation, cleaning, citations, names, pages, readers on small Chinese cases."""

import json
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folio_spark.functions import cited
from folio_spark.functions import markup as M
from folio_spark.functions import similarity
from folio_spark.functions.numerals import article_key, key_of, staged_article_key
from folio_spark.operators import citations as C
from folio_spark.operators import names as N
from folio_spark.operators import outline as O
from folio_spark.operators import pages as P
from folio_spark.operators import texts as X
from folio_spark.sources import readers as R


def segment(spark, text):
    rows = X.segment(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("position").collect()
    return [(r["number"], r["text"], r["part"], r["shape"]) for r in rows]


def test_articles_with_chapters(spark):
    text = "目 录\n第一章 总则 ...... 1\n第一章 总则\n第一条 甲。\n续行\n第二条 乙。\n第二章 分则\n第一节 一般\n第三条 丙。\n第三条第二款规定的除外。\n附则\n第四条之一 丁。"
    assert segment(spark, text) == [
        ("1", "甲。\n续行", "第一章 总则", "articles"), ("2", "乙。", "第一章 总则", "articles"),
        ("3", "丙。\n第三条第二款规定的除外。", "第二章 分则 第一节 一般", "articles"), ("4-1", "丁。", "附则", "articles"),
    ]


def test_other_shapes(spark):
    assert [x[:2] for x in segment(spark, "前言\n1．甲事项\n2．乙事项\n说明")] == [("1", "甲事项"), ("2", "乙事项\n说明")]
    assert [x[3] for x in segment(spark, "1.甲\n1.乙")] == ["body"]
    assert [x[:2] for x in segment(spark, "（一）甲\n（二）乙")] == [("1", "甲"), ("2", "乙")]
    assert segment(spark, "只有正文") == [("正文", "只有正文", None, "body")]


def test_rejoin(spark):
    lines = X.lines_of(spark.createDataFrame([(1, "第一条 当事人\n应当\n12\n遵守。\n第二条 另")], "doc_id int, text string"))
    assert X.rejoin_lines(lines).first()["text"] == "第一条 当事人应当遵守。\n第二条 另"


def test_outlines():
    """Forms, lead-ins, sections without items, breaks: what each line becomes."""
    rows = lambda t: [(n, title, text, part) for _, n, _, title, text, part in O.outline(t)[0]]
    nested = "通知\n一、总则\n导语\n（一）甲\n续\n（二）项规定\n（二）乙\n二、只有段落\n段一\n段二\n三、本规定自公布之日起施行。\n四、末节\n（一）丙\n1．子项\n（二）丁\n（三）戊"
    assert rows(nested) == [
        ("序言", None, "通知", None), ("1", "（一）", "导语\n甲\n续\n（二）项规定", "一、总则"), ("2", "（二）", "乙", "一、总则"), ("3", None, "段一\n段二", "二、只有段落"),
        ("4", "三、", "本规定自公布之日起施行。", None), ("5", "（一）", "丙\n1．子项", "四、末节"), ("6", "（二）", "丁", "四、末节"), ("7", "（三）", "戊", "四、末节"),
    ]
    flat = "一、电信诈骗数额较大的，依法处理。\n（一）其一\n二、从重处罚：\n其他"
    assert rows(flat) == [("1", "一、", "电信诈骗数额较大的，依法处理。\n（一）其一", None), ("2", "二、", "从重处罚：\n其他", None)]
    assert rows("前\n一、甲\n文一\n二、空\n三、乙\n文三\n五、跳号") == [("序言", None, "前", None), ("1", "一、甲", "文一", "一、甲"), ("2", "三、乙", "文三\n五、跳号", "三、乙")]
    chapters = "第一章 总\n第一节 小\n（一）甲\n第二章 分\n（一）乙\n附则\n（一）丙"
    assert [r[3] for r in rows(chapters)] == ["第一章 总 第一节 小", "第二章 分", "附则"]
    assert O.outline("一、甲\n（二）乙\n（三）丙")[1].startswith("sequence_broken") and O.outline("一、甲\n（一）乙\n（一）丙")[1].startswith("sequence_broken")
    assert O.outline("一、甲。\n三、乙。")[1].startswith("sequence_broken") and O.outline("一、总\n（一）\n（二）乙")[1] == "empty_text: 1"
    assert O.outline("（一）只有一项") == ([], None) == O.outline("") == O.outline("没有标记")
    assert [O.ordinal(x) for x in ("一", "十", "十二", "二十", "一百", "两", "〇", "12", "一二")] == [1, 10, 12, 20, 100, 2, 0, 12, None]


def test_segments_of_outlines(spark):
    assert segment(spark, "意见\n一、总则\n（一）甲\n（二）乙")[1:] == [("1", "甲", "一、总则", "outline"), ("2", "乙", "一、总则", "outline")]
    assert segment(spark, "说明：（一）无\n一、只有一节\n文") == [("正文", "说明：（一）无\n一、只有一节\n文", None, "body")]
    broken = X.segment(spark.createDataFrame([(1, "一、甲\n（一）乙\n（三）丙"), (2, None), (3, "")], "doc_id int, text string")).collect()
    assert [(r["doc_id"], r["shape"], r["issue"][:15], r["text"]) for r in broken] == [(1, "outline", "sequence_broken", None)]


def test_citations(spark):
    text = "依据《民法典》第一百四十三条规定：“具备下列条件的民事法律行为有效”。又见《法学评论》第3条、《合同法》第2020条、见民§577条。\n参《公司法》第3至5条。"
    rows = C.extract_citations(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("start", "number").collect()
    assert [(r["law_input"], r["number"]) for r in rows] == [("民法典", "143"), ("民法典", "577"), ("公司法", "3"), ("公司法", "4"), ("公司法", "5")]
    assert rows[0]["quoted_text"] == "具备下列条件的民事法律行为有效" and rows[0]["line"] == 1 and rows[2]["line"] == 2
    assert text[rows[0]["start"] : rows[0]["end"]] == rows[0]["raw"] == "《民法典》第一百四十三条"


def test_citation_forms(spark):
    """Forms with and without 第, wide white space, numbers with parts, and what looks like a citation and is none."""
    cases = {
        "依《民法典》577条处理": [("民法典", "577")],
        "《民法典》\u3000第5条": [("民法典", "5")],
        "《民法典》\u00a0第\u2003五\u3000条": [("民法典", "5")],
        "人民§5": [],
        "参民§5": [("民法典", "5")],
        "（公§16-1条），见九民§12": [("公司法", "16-1"), ("九民纪要", "12")],
        "《刑法》第一百三十三条之一": [("刑法", "133-1")],
        "《公司法》3-5条": [("公司法", "3"), ("公司法", "4"), ("公司法", "5")],
        "《公司法》第5-3条": [("公司法", "")],
        "《公司法》第1-200条": [("公司法", "")],
        "《公司法》第三项": [("公司法", "3")],
        "《论公司法的现代化改革》第3条": [],
        "《什么是法？》第3条，《合同法》2020条": [],
        "《》第3条，《法》第": [],
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(99, None), (98, "")], "doc_id int, text string")
    got = {}
    for r in C.extract_citations(docs).orderBy("doc_id", "start", "number").collect():
        got.setdefault(r["doc_id"], []).append((r["law_input"], r["number"]))
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values()) and not got.keys() & {98, 99}


def test_quotes_after_citations(spark):
    cases = [
        ("《民法典》第5条规定：“甲乙丙丁戊己庚辛；壬癸”", "甲乙丙丁戊己庚辛"),
        ("《民法典》第5条\u3000原文：甲乙丙丁戊己庚辛壬。癸", "甲乙丙丁戊己庚辛壬"),
        ("《民法典》第5条“甲乙丙丁戊己庚”", None),
        ("《民法典》第5条说明甲乙丙丁戊己庚辛壬", None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    assert [r["quoted_text"] for r in C.extract_citations(docs).orderBy("doc_id").collect()] == [q for _, q in cases]


def test_trace_against_all_pairs(spark):
    """Every pair compared by hand, as the rules are worded."""
    import re
    from difflib import SequenceMatcher

    chance = random.Random(5)
    signs = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥，。"
    rows_a, rows_b = [], []
    for k in (1, 2, 3):
        texts = ["".join(chance.choice(signs) for _ in range(chance.randint(0, 40))) for _ in range(12)]
        rows_a += [(k, str(i + 1), i + 1, t, "一" if i < 6 else None) for i, t in enumerate(texts)]
        after = [t for i, t in enumerate(texts) if i % 5]
        after = [t[3:] + "新" if i % 3 == 0 else t + "，" if i % 3 == 1 else t for i, t in enumerate(after)]
        rows_b += [(k, str(i + 1), i + 1, t, "一" if i < 5 else None) for i, t in enumerate(after)]
    clean = lambda t: re.sub(r"[\s，。]+", "", t)

    def same(x, y):
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        if x in y or y in x:
            return max(0.72, min(0.96, min(len(x), len(y)) / max(len(x), len(y)) + 0.12))
        return SequenceMatcher(None, x, y).ratio()

    want = {}
    for k, number, position, text, _ in rows_a:
        others = [r for r in rows_b if r[0] == k]
        scored = []
        for _, n, p, t, _ in others:
            sim = same(clean(text), clean(t))
            conf = round(min(1.0, sim + 0.05 * (n == number) + max(0.0, 0.03 * (1 - min(abs(p - position), len(others)) / len(others)))), 4)
            scored.append((conf, round(sim, 4), -abs(p - position), n))
        best = max(scored)
        want[k, number] = best[3] if best[0] >= 0.72 else number if any(n == number for _, n, *_ in others) else None
    shape = "request_id int, number string, position int, text string, part string"
    a, b = spark.createDataFrame(rows_a, shape), spark.createDataFrame(rows_b, shape)
    got = {(r["request_id"], r["number"]): r["target_number"] for r in C.trace(a.select("request_id").distinct(), a, b).collect()}
    assert got == want


def test_bounds_are_never_exceeded():
    r = random.Random(6)
    texts = ["".join(r.choice("abcde 第条款") for _ in range(r.randrange(0, 40))) for _ in range(120)]
    texts += [t[: len(t) // 2] + r.choice("xyz") + t[len(t) // 2 :] for t in texts[:60]] + [t[3:-3] for t in texts[:30]]
    signs, pairs = C._counts(texts)
    sizes = np.array([len(t) for t in texts])
    for i, x in enumerate(texts):
        most = C._most(len(x), sizes, np.minimum(signs, signs[i]).sum(1), np.minimum(pairs, pairs[i]).sum(1))
        assert all(C._alike(x, y) <= m + 1e-9 or x == y for y, m in zip(texts, most, strict=True))


def test_trace_of_a_large_request_in_blocks(spark, monkeypatch):
    """Blocks of any size give the same targets, and a request of many articles is many tasks."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    before = [line(12) for _ in range(300)]
    after = [t if i % 3 else " ".join([*t.split()[2:], "new", "end"]) for i, t in enumerate(before) if i % 10 != 7]
    after = after[50:] + [line(12) for _ in range(20)] + after[:50]
    shape = "request_id long, number string, position int, text string, part string"
    rows = lambda texts: spark.createDataFrame([(1, str(i), i, t, None) for i, t in enumerate(texts)], shape)
    a, b = rows(before), rows(after)
    result = lambda: {tuple(x) for x in C.trace(a.select("request_id").distinct(), a, b).collect()}
    want = result()
    monkeypatch.setattr(C, "SOURCES", 16)
    monkeypatch.setattr(C, "TARGETS", 32)
    assert result() == want and len(want) == 300


def test_trace_by_items(spark):
    shape = "request_id int, number string, position int, text string, part string"
    a = spark.createDataFrame([(1, "1", 1, "总述：\n（一）甲乙丙丁戊己；\n（二）子丑寅卯辰巳。", None)], shape)
    b = spark.createDataFrame([(1, "7", 7, "完全另写的一段话在此：\n（一）全然不同的内容文字；\n（二）子丑寅卯辰巳。", None), (1, "8", 8, "天地玄黄", None)], shape)
    asked = spark.createDataFrame([(1, ["2"])], "request_id int, items array<string>")
    got = [(r["target_number"], r["confidence"]) for r in C.trace(asked, a, b).collect()]
    plain = [r["target_number"] for r in C.trace(asked.drop("items"), a, b).collect()]
    assert got == [("7", 1.0)] and plain == [None]


def test_quotes(spark):
    official = "具备下列条件的民事法律行为有效：行为人具有相应的民事行为能力。"
    cases = [("具备下列条件的，民事法律行为有效", "exact_excerpt"), ("具备下列条件的民事法律行为无效", "wording_drift"), ("完全不相干的另外一句话在这里", "mismatch"), (None, "not_checked")]
    df = spark.createDataFrame([(q, "具备下列条件的民事法律行为有效" if k == "wording_drift" else official, k) for q, k in cases], "quoted_text string, official_text string, want string")
    assert C.verify_quotes(df).where("quote_kind <> want").count() == 0


def test_trace(spark):
    shape = "request_id int, number string, position int, text string, part string"
    a = spark.createDataFrame([(1, "1", 1, "甲乙丙丁戊己", None), (1, "2", 2, "子丑寅卯辰巳午未", None), (1, "3", 3, "天地玄黄宇宙洪荒", None)], shape)
    b = spark.createDataFrame([(1, "1", 1, "甲乙丙丁戊己", None), (1, "3", 2, "子丑寅卯辰巳午未", None)], shape)
    got = {r["number"]: (r["status"], r["target_number"]) for r in C.trace(a.select("request_id").distinct(), a, b).collect()}
    assert got["1"] == ("unchanged", "1") and got["2"] == ("renumbered", "3") and got["3"][0] == "amended"


def test_aliases(spark):
    titles = {
        "中华人民共和国公司法": {"公司法"},
        "中华人民共和国民事诉讼法": {"民事诉讼法", "民诉法"},
        "中华人民共和国公司法（2023修订）": {"中华人民共和国公司法", "公司法"},
        "最高人民法院关于适用《中华人民共和国民法典》婚姻家庭编的解释（一）": {"婚姻家庭编解释一", "婚姻家庭编解释（一）", "婚姻家庭编解释", "民法典婚姻家庭编解释一", "民法典婚姻家庭编解释"},
        "最高人民法院关于适用《中华人民共和国公司法》时间效力的若干规定": {"公司法时间效力规定", "公司法时间效力解释", "公司法时效规定"},
        "最高人民法院关于审理民间借贷案件适用法律若干问题的规定": {"民间借贷规定"},
        "国务院关于某事的通知": set(),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "law_id int, title string")
    got = {}
    for r in N.derive_aliases(df).collect():
        got.setdefault(r["law_id"], set()).add(r["alias"])
    assert [got.get(i, set()) for i in range(len(titles))] == list(titles.values())


def test_pages(spark):
    html = '<html><head><title>标题 - 网站</title></head><body><p>一 &amp; 二<br>三</p><script>x</script><a href="/a?b">甲</a><a href="c.html#x">乙</a></body></html>'
    pages = spark.createDataFrame([(1, "http://h.cn/d/e.html", html)], "page_id int, url string, html string")
    row = P.pages_to_text(pages).first()
    assert row["title"] == "标题" and row["text"].split("\n")[:2] == ["一 & 二", "三"]
    assert {(r["href"], r["anchor"]) for r in P.explode_links(pages).collect()} == {("http://h.cn/a?b", "甲"), ("http://h.cn/d/c.html#x", "乙")}


def test_page_scanner():
    """Nesting, unclosed scripts and comments, all entities, quotes in tags, links that go unclosed."""
    text = lambda h: M.scan(h).text
    assert text("<p>a<p>b&nbsp;&hellip;&#x4e2d;&#65;&notit;&amp;lt;") == "a\nb …中A¬it;&lt;"
    assert text("a<script>if (x < y) '</p>'</script>b<!-- c -- > --><style>d</style>e") == "abe"
    assert text("a<script>b</p>c") == "a" and text("a<!-- b <p>c") == "a" and text("a<STYLE>b</sTyLe >c") == "ac"
    assert text('a<img alt="1 > 0">b<a title=\'x > y\' href=z>c</a>d') == "abcd" and text("a<b title=\"x>y") == "ay"
    assert text("1 < 2 and <3") == "1 < 2 and <3" and text("a<p") == "a" and text("\u3000 a \u3000b\r\nc") == "a b c"
    nested = "<div id=x><article>a<article><p>b</article><p>c</article>d</div>"
    assert M.scan(nested).block == "a\nb\nc"
    assert M.scan("<article>no</article><div class='w gb_x'><div id='gb_content'>a<div>b</div><div><div>c</div>d</div>").block == "a\nb\nc\nd"
    assert M.scan("<main>a<article>b</article>c</main>").block == "b" and M.scan("<p>a").block is None
    links = M.scan("<a href='/x?a=1&amp;b=2'>one <b>two</b><a href=y>three<p>four</a><a name=z>five</a><a href=''>six").links
    assert links == [("/x?a=1&b=2", "one two"), ("y", "three four"), ("", "six")]
    assert M.scan("<html><head><title> a\n<b>b</b> &mdash; c</title><meta x></head><body>d").title == "a b — c"
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert text(deep) == "x" and text("<article>" + deep) == "x"


def test_main_content_stops(spark):
    cases = ["<article><p>一<p>二<p>【责任编辑：甲】<p>三</article>", "<div id=fontzoom><p>条文<p>最高检负责人答记者问<p>问：</div>", "<p>一<p>相关新闻<p>二", "", None]
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "page_id int, html string")
    assert [r["text"] for r in P.main_content(pages).orderBy("page_id").collect()] == ["一\n二", "条文", "一", "", ""]
    assert [r["text"] for r in P.pages_to_text(pages).orderBy("page_id").collect()][3:] == ["", ""]


def test_read_corpus(spark, tmp_path):
    doc = {"id": "l1", "title": "T", "effective_at": "2020-02-30", "released_at": "2020-02-03", "articles": [{"number": "第一条", "text": "甲"}, {"number": "14-1", "text": "乙"}], "categories": [{"id": "c", "name": "n"}], "category_ids": ["c", "c"]}
    (tmp_path / "l1.json").write_text(json.dumps(doc, ensure_ascii=False))
    got = R.read_corpus(spark, str(tmp_path))
    assert [r["article_id"] for r in got["articles"].orderBy("position").collect()] == ["l1#1", "l1#14-1"]
    law = got["laws"].first()
    assert law["effective_at"] is None and str(law["released_at"]) == "2020-02-03" and got["law_categories"].count() == 1


def test_contract_of_nested_fields(spark):
    from folio_spark.operators import quality as Q

    shape = R.LAW.replace("id string, title", "doc_id string, title", 1)
    good = {"doc_id": "a", "title": "T", "level": "law", "status": "current", "source_url": "https://h", "source_name": "n", "source_hash": "x"}
    good |= {"categories": [{"id": "c", "name": "n"}, {"id": "d", "name": "m", "parent_id": "c"}], "category_ids": ["d"], "relations": [{"relation_type": "amends", "to_law_id": "b"}]}
    good["articles"] = [{"number": "1", "text": "甲", "position": 1}]
    bad = good | {"doc_id": "b", "categories": [{"id": "c", "name": " ", "parent_id": "z"}], "category_ids": ["q"], "relations": [{"to_law_id": "", "effective_at": "2020-02-30"}]}
    bad["articles"] = [{"number": "", "text": None, "position": 0}]
    docs = spark.createDataFrame([good, bad, good | {"doc_id": "c", "articles": [], "relations": None}], shape)
    got = {}
    for r in Q.violations(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["code"])
    assert got == {
        "b": {"incomplete_category", "unknown_parent_category", "unknown_category", "missing_relation_type", "missing_relation_target", "invalid_relation_date", "missing_article_number", "missing_article_text", "invalid_article_position"},
        "c": {"no_articles"},
    }


def test_every_number_of_a_sentence_is_an_edge_and_leads_are_looked_up_once(spark, monkeypatch):
    texts = ["依照公司法第3条、证券法第五条之一办理。见\n第9条", "公司法第3条", "本公司法　第3条，保险法第2条；公司法。第7条", "《公司法》第8条", "依照" + "长" * 90 + "公司法第6条", "没有", None]
    articles = spark.createDataFrame([(f"h{i}", "1", t) for i, t in enumerate(texts)], "law_id string, number string, text string")
    names = spark.createDataFrame([("公司法", 1), ("证券法", 2), ("本公司法", 3), ("法", 4)], "name string, law_id long")
    want = {("h0", 1, "3"), ("h0", 2, "5-1"), ("h1", 1, "3"), ("h3", 1, "8"), ("h4", 1, "6")}
    for most in (C.MOST_FORMS, 0):
        monkeypatch.setattr(C, "MOST_FORMS", most)
        found = C.citation_edges(articles, names).collect()
        assert {(r["host_law_id"], r["law_id"], r["number"]) for r in found} == want and len(found) == len(want)


def test_texts_of_citations_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"依据《民法典》第{i}条规定：“甲乙丙丁戊己庚辛”") for i in range(1, 50)], "doc_id int, text string")
    found = C.extract_citations(docs)
    assert sorted((r["doc_id"], r["number"], r["quoted_text"]) for r in found.collect()) == [(i, str(i), "甲乙丙丁戊己庚辛") for i in range(1, 50)]
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once_for_citations_and_their_numbers(spark):
    docs = spark.createDataFrame([(1, "e\u0301民§5，九民§九民§3；《公司法》\x85第\u2003２条，《公司法》第9999999999-10000000000条，《法》第两百〇三条之〇")], "doc_id int, text string")
    found = C.extract_citations(docs)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["law_input"], r["number"], r["raw"]) for r in found.orderBy("start", "number").collect()]
    assert got == [("九民纪要", "9", "九民§九"), ("公司法", "", "《公司法》\x85第\u2003２条"), ("公司法", "10000000000", "《公司法》第9999999999-10000000000条"), ("公司法", "9999999999", "《公司法》第9999999999-10000000000条"), ("法", "", "《法》第两百〇三条之〇")]


def test_keys_of_references_are_those_of_columns(spark):
    r = random.Random(12)
    forms = {"".join(r.choice("第条之项款目-－.零一三十百千万〇两029３ \u3000") for _ in range(r.randrange(0, 8))) for _ in range(4000)} | {"正文", "序言", "第1.2.3条", "第十条第三款", "0", "第〇条"}
    rows = spark.createDataFrame([(f,) for f in forms], "f string").select("f", article_key(F.col("f")).alias("k")).collect()
    assert {r["f"]: r["k"] for r in rows} == {f: key_of(f) for f in forms}


def test_leads_of_citations_without_marks_are_looked_up_where_they_are(spark):
    assert cited.leads("第3条公司法第4条，依\u3000公司法第五条之一。见；第9条", 5) == [("4", "公司法"), ("5-1", "依\u3000公司法")]
    articles = spark.createDataFrame([(f"h{i % 50}", "1", f"依公司法第{i % 7 + 1}条") for i in range(100)], "law_id string, number string, text string")
    names = spark.createDataFrame([("公司法", 1)], "name string, law_id long")
    found = C.citation_edges(articles, names)
    assert sorted((r["host_law_id"], r["number"]) for r in found.collect()) == sorted({(f"h{i % 50}", str(i % 7 + 1)) for i in range(100)})
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_laws_are_audited_where_the_citations_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"《{'甲乙'[i % 2]}法》第{i % 4 + 1}条规定：“一二三四五六七八{'九' * (i % 3)}”") for i in range(60)], "doc_id int, text string")
    laws = spark.createDataFrame([(1, "甲法", "current", None)], "law_id long, law_input string, status string, repealed_at date")
    articles = spark.createDataFrame([(1, "1", "一二三四，五六七八。"), (1, "4", "无")], "law_id long, number string, text string")
    want = {i: (None, False, "law_not_found") if i % 2 else (1, False, "article_not_found") if i % 4 else (1, True, None if i % 3 == 0 else "quote_wording_drift") for i in range(60)}
    for signs in (C.MOST_SIGNS, 3):
        monkeypatch.setattr(C, "MOST_SIGNS", signs)
        found = C.audit_citations(C.extract_citations(docs), laws.select("law_input", "law_id"), laws, articles)
        assert {r["doc_id"]: (r["law_id"], r["found"], r["code"]) for r in found.collect()} == want
        assert ("Exchange hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()) == (signs == 3)


def test_equal_short_quotes_of_many_batches_are_compared_once(spark):
    similarity._remembered.cache_clear()
    rows = [("一二三四五六", "一二三四五七", 2 * 5 / 12), (None, "一", None), ("一" * 600, "一" * 599 + "二", 2 * 599 / 1200)] * 3
    for a, b, want in rows:
        got = similarity.best_window_ratio.func(pd.Series([a]), pd.Series([b])).tolist()[0]
        assert got == want or want is None and got != got
    seen = similarity._remembered.cache_info()
    assert seen.misses == 2 and seen.hits == 4


def test_small_requests_are_handed_over_together(spark, monkeypatch):
    r = random.Random(8)
    line = lambda: "".join(r.choice("abcdef") for _ in range(30))
    before = [(k, str(i), i, line(), None) for k in range(60) for i in range(1, 6)]
    after = [(k, str(int(n) % 5 + 1), i, t[4:] + "xy" if i % 2 else t, p) for k, n, i, t, p in before if (k + i) % 7]
    shape = "request_id long, number string, position int, text string, part string"
    a, b = spark.createDataFrame(before, shape), spark.createDataFrame(after, shape)
    result = lambda: sorted(map(tuple, C.trace(a.select("request_id").distinct(), a, b).collect()))
    together = result()
    monkeypatch.setattr(C, "HANDED", 1)
    assert result() == together and len(together) == 300 and {x[3] for x in together} >= {"renumbered", "amended"}


def test_texts_are_made_once(spark):
    """Lines and outlines are cut from the same texts; whatever makes these runs once a document."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return ["第一条 甲", "一、总\n（一）甲\n（二）乙", "正文"][i % 3]

    docs = spark.range(12).select(F.col("id").alias("doc_id"), text("id").alias("text"))
    assert X.segment(docs).count() == 16 and made.value == 12


def test_staged_article_keys(spark):
    raws = ["第一条", "第十条之二", "第 1,2 条", "12-3", "第12—3条", "1.2.3", "第一条第二款", "正文", "序言", "", None, "零", "第二〇三条", "两千条", "第99999999999条", "一万零三", "第三项", "x", "第1条之一第2项"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = staged_article_key(rows, "raw", "key").select("i", "key").orderBy("i").collect()
    assert got == rows.select("i", article_key(F.col("raw")).alias("key")).orderBy("i").collect()
