"""Texts to articles: line cleaning, re-joining, segmentation, headings, ordinals, excerpts, amendments, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import docnum
from folio_spark.functions.numerals import NUMERALS, article_key, staged_article_key
from folio_spark.operators.outline import outline_items
from folio_spark.session import spooled

#: The forms of headings, items and contents lines.
N = f"[{NUMERALS}0-9]"
ARTICLE = rf"^(第{N}+条(?:之{N}+)?)(.*)$"
REFERENCE = rf"^(?:第{N}+[款项目]|[、和及与至或]\s*第|规定|所称|的)"
DECIMAL = r"^(\d{1,3}(?:\.\d{1,2})+)(?!\s*条)(?:[\s\x{3000}]+|(?=[\x{4E00}-\x{9FFF}]))(.*)$"
ITEM = r"^(\d{1,3})[.．]\s*([\x{4E00}-\x{9FFF}“‘《（(【].*)$"
TITLED = r"^(\d{1,3})[.．][\x{3000}\s]*【([^】]{1,80})】(.*)$"
STRUCTURE = rf"^(第{N}+(?:编|章|节|分编).+|附则)$"
SECTION = rf"^{N}{{1,3}}、[\x{{4E00}}-\x{{9FFF}}（）()《》·“”‘’、]{{2,24}}$"
CONTENTS = rf"^目\s*录$|(?:\.{{3,}}|…{{2,}})\s*[-－]?\s*\d{{1,4}}\s*[-－]?\s*$|^(?:第{N}+(?:编|章|节|分编).+|附则|{N}{{1,3}}、.+)\s+\d{{1,4}}$|^第{N}+(?:编|章|节|分编).+?(?:\.{{3,}}|…{{2,}})\s*$"
UNSEEN = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, UNSEEN, ""), r"[\s\x{3000}\x{00A0}]+", " "))


def lines_of(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, line_no (from 0), line of every line of docs (doc, text)."""
    return docs.where("text is not null").select(doc, F.posexplode(F.split("text", "\r\n|\r|\n|\f")).alias("line_no", "line"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines without invisible characters and extra space; empty lines and those of a table of contents go."""
    return lines.withColumn("line", clean(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike(CONTENTS))


def rejoin_lines(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Doc, text: broken lines glued again, page numbers dropped.

    A line goes on the one before unless it starts a structure or that one ends a sentence or clause.
    """
    address = r"\d{1,3}(?:[.．]\d{1,3}){2}(?![\d.．]|\s*[\x{4E00}-\x{9FFF}])"  # after a first number: a network address, no item
    starts = rf"^(?:第{N}+(?:编|章|节|条|分编)|附则|{N}{{1,3}}、|[（(]{N}{{1,3}}[）)]|\d{{1,3}}[.．](?!{address}))"
    refers = rf"^第?{N}+(?:款|项|段)"
    rows = lines.withColumn("line", clean(F.col("line"))).where((F.col("line") != "") & ~F.col("line").rlike(r"^\d{1,4}$"))
    by = Window.partitionBy(doc).orderBy("line_no")
    before = F.lag("line").over(by)
    opens = before.isNull() | (~F.col("line").rlike(refers) & (F.col("line").rlike(starts) | before.rlike("[。；：！？，、:]$")))
    grouped = rows.withColumn("g", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = grouped.groupBy(doc, "g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("line"))
    return joined.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _running(c: Column, doc: str) -> Column:
    return c.over(Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _shaped(lines: DataFrame, number: Column, body: Column, doc: str) -> DataFrame:
    """Articles of lines (…, shape) in which `number` is not null where one starts: doc, position, shape, number, number_display, text, part."""
    level = F.when(F.col("line") == "附则", 0).when(F.col("line").rlike(f"^第{N}+编"), 1).when(F.col("line").rlike(f"^第{N}+分编"), 2).when(F.col("line").rlike(f"^第{N}+章"), 3).when(F.col("line").rlike(f"^第{N}+节"), 4)
    level = F.when(F.col("line").rlike(STRUCTURE) & (F.col("shape") != "body"), level)
    rows = lines.withColumn("__n", number).withColumn("__b", body).withColumn("__level", F.when(F.col("__n").isNull(), level))
    rows = rows.withColumn("g", _running(F.sum(F.col("__n").isNotNull().cast("int")), doc))
    # a heading is a part's name only if another article follows, else its line is text
    rows = rows.withColumn("__last", F.max(F.when(F.col("__n").isNotNull(), F.col("line_no"))).over(Window.partitionBy(doc)))
    rows = rows.withColumn("__heading", F.col("__level").isNotNull() & F.coalesce(F.col("line_no") < F.col("__last"), F.lit(False)))
    for k in range(5):  # the last heading of each level; it counts while no higher one has come after it
        at = F.when(F.col("__heading") & (F.col("__level") == k), F.struct("line_no", "line"))
        rows = rows.withColumn(f"__l{k}", _running(F.last(at, ignorenulls=True), doc))
    place = lambda k: F.coalesce(F.col(f"__l{k}.line_no"), F.lit(-1))
    above = lambda k: F.greatest(F.lit(-1), *[place(j) for j in range(k)]) if k > 1 else place(0) if k else F.greatest(*[place(j) for j in range(1, 5)])
    parts = [F.when(place(k) > above(k), F.col(f"__l{k}.line")) for k in range(5)]
    rows = rows.withColumn("__part", F.concat_ws(" ", *parts)).where("g > 0")
    piece = F.when(F.col("__n").isNotNull(), F.col("__b")).when(~F.col("__heading"), F.col("line"))
    made = rows.groupBy(doc, F.col("g").alias("position"), "shape").agg(
        F.max("__n").alias("number_display"),
        F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("x")))), lambda r: r["x"]), lambda x: x.isNotNull() & (x != "")), "\n").alias("text"),
        F.min_by("__part", "line_no").alias("part"),
    )
    return staged_article_key(made.where("text <> ''"), "number_display", "number").withColumn("part", F.nullif("part", F.lit("")))


def segment(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Doc, position, number, number_display, text, part, shape, title, issue of the articles that docs (doc, text) consist of.

    Shapes are tried in this order and the first that fits a document is taken: articles (`第N条`, or decimal numbers
    where there is none); items `1.` that rise strictly, two or more; an outline of `一、` and `（一）` (outline.py, whose
    items keep their marks in `title`, and whose broken numbers are an `issue`); the whole text as one `正文`. A heading
    that goes on as a reference, or repeats the number before it, starts nothing.
    """
    docs = spooled(docs.select(doc, "text"), "texts")  # made once: lines and outlines both read them
    raw = clean_lines(lines_of(docs, doc).withColumn("line", F.regexp_replace(F.trim("line"), "^#+", "")))
    has = Window.partitionBy(doc)
    body = F.trim(F.regexp_extract("line", ARTICLE, 2))
    raw = raw.withColumn("__head", F.regexp_extract("line", ARTICLE, 1)).withColumn("__article", (F.col("__head") != "") & ~body.rlike(REFERENCE))
    head, is_article = F.col("__head"), F.col("__article")
    seen = _running(F.max(is_article.cast("int")), doc)
    is_decimal = F.col("line").rlike(DECIMAL) & (seen == 0)
    rows = raw.withColumn("__h", F.when(is_article, head).when(is_decimal, F.regexp_extract("line", DECIMAL, 1)))
    rows = rows.withColumn("__before", _lagged("__h", doc)).withColumn("__h", F.when(F.col("__h").eqNullSafe(F.col("__before")), F.lit(None)).otherwise(F.col("__h")))
    item = F.when(F.col("line").rlike(ITEM), F.regexp_extract("line", ITEM, 1).cast("int"))
    rows = rows.withColumn("__i", item).withColumn("__i0", _running(F.min(F.when(item == 1, F.col("line_no"))), doc))
    rows = rows.withColumn("__i", F.when(F.col("line_no") >= F.col("__i0"), F.col("__i")))
    top = F.max("__i").over(Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__falls", F.col("__i") <= F.coalesce(top, F.lit(0)))
    marked = F.col("line").rlike(rf"^(?:（{N}{{1,3}}）(?![款项目段])|{N}{{1,3}}、)")
    shape = (
        F.when(F.count("__h").over(has) > 0, "articles")
        .when((F.count("__i").over(has) > 1) & (F.max(F.col("__falls").cast("int")).over(has) == 0), "items")
        .when(F.max(marked.cast("int")).over(has) == 1, "outline")
        .otherwise("body")
    )
    rows = spooled(rows.withColumn("shape", shape).select(doc, "line_no", "line", "__h", "__i", "shape"), "lines")
    outlines = spooled(outline_items(docs.join(rows.where("shape = 'outline'").select(doc).distinct(), doc, "left_semi"), doc), "outlines")
    # what has marks but is no outline is a body
    rows = rows.join(outlines.select(doc).distinct(), doc, "left_anti").withColumn("shape", F.when(F.col("shape") == "outline", "body").otherwise(F.col("shape")))
    first = F.col("line_no") == F.min("line_no").over(has)
    rows = rows.withColumn("__first", first)
    per = {
        "articles": (F.col("__h"), F.coalesce(F.nullif(F.regexp_extract("line", ARTICLE, 2), F.lit("")), F.regexp_extract("line", DECIMAL, 2), F.lit(""))),
        "items": (F.when(F.col("__i").isNotNull(), F.concat(F.lit("第"), "__i", F.lit("项"))), F.regexp_extract("line", ITEM, 2)),
        "body": (F.when(F.col("__first"), F.lit("正文")), F.col("line")),
    }
    pick = lambda i: F.coalesce(*[F.when(F.col("shape") == k, v[i]) for k, v in per.items()])
    found = _shaped(rows, pick(0), F.trim(pick(1)), doc)
    none = F.lit(None).cast("string")
    found = found.withColumns({"title": none, "issue": none, "position": F.col("position").cast("int")})
    return found.unionByName(outlines.withColumn("shape", F.lit("outline")))


def _lagged(c: str, doc: str) -> Column:
    return F.last(c, ignorenulls=True).over(Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))


def titled_items(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """W9 on request: doc, position, number, title, text, issue of `N.【title】` items.

    They run from the first item 1 and must be 1..N; a break is an issue on its row. Text before item 1 is 序言.
    """
    lines = clean_lines(lines_of(docs, doc))
    n = F.when(F.col("line").rlike(TITLED), F.regexp_extract("line", TITLED, 1).cast("int"))
    first = F.min(F.when(n == 1, F.col("line_no"))).over(Window.partitionBy(doc))
    rows = lines.withColumn("__first", first).withColumn("__n", F.when(F.col("line_no") >= F.col("__first"), n)).where("__first is not null")
    rows = rows.withColumn("position", _running(F.count("__n"), doc))
    piece = F.when(F.col("__n").isNotNull(), F.trim(F.regexp_extract("line", TITLED, 3))).otherwise(F.col("line"))
    out = rows.groupBy(doc, "position").agg(
        F.max("__n").alias("n"),
        F.max(F.when(F.col("__n").isNotNull(), F.regexp_extract("line", TITLED, 2))).alias("title"),
        F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("x")))), lambda r: r["x"]), lambda x: x != ""), "\n").alias("text"),
    )
    issue = F.when((F.col("position") > 0) & (F.col("n") != F.col("position")), "number_out_of_order")
    return out.select(doc, "position", F.coalesce(F.col("n").cast("string"), F.lit("序言")).alias("number"), "title", "text", issue.alias("issue"))


def fix_trailing_headings(articles: DataFrame, law: str = "law_id") -> DataFrame:
    """Structural headings at the end of an article's text move to the part of the article after it."""
    rows = articles.select(law, "position", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    back = Window.partitionBy(law, "position").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trimmed = clean(F.col("line"))
    heads = rows.withColumn("t", F.min((trimmed.rlike(STRUCTURE) | trimmed.rlike(SECTION)).cast("int")).over(back) == 1)
    text = lambda keep, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("p", "line")))), lambda x: x["line"]), sep)
    cut = heads.groupBy(law, "position").agg(text(~F.col("t"), "\n").alias("text"), F.nullif(text(F.col("t"), " "), F.lit("")).alias("__moved"))
    moved = F.last("__moved", ignorenulls=True).over(Window.partitionBy(law).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return articles.drop("text").join(cut, [law, "position"]).withColumn("part", F.coalesce("part", moved)).drop("__moved")


def ordinal_issues(items: DataFrame, by: str = "law_id") -> DataFrame:
    """By, n, issue (restart, duplicate, gap, with the missing number for gaps) of items (by, position, n)."""
    order = Window.partitionBy(by).orderBy("position")
    before = F.max("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = F.row_number().over(Window.partitionBy(by, "n").orderBy("position")) > 1
    rows = items.withColumn("issue", F.when(again, "duplicate").when(F.col("n") < before, "restart")).where("issue is not null")
    span = items.groupBy(by).agg(F.min("n").alias("a"), F.max("n").alias("b"))
    every = span.select(by, F.explode(F.sequence("a", "b")).alias("n"))
    gaps = every.join(items.select(by, "n").distinct(), [by, "n"], "left_anti").withColumn("issue", F.lit("gap"))
    return rows.select(by, "n", "issue").unionByName(gaps)


def explode_items(articles: DataFrame) -> DataFrame:
    """law_id, number, item (key), body of the `（一）…` items of articles, the last of a label staying."""
    label = r"[（(]([一二三四五六七八九十百千万两\d]+)[）)]"
    marks = F.regexp_extract_all("text", F.lit(label), 1)
    cut = F.split("text", r"\n?[（(][一二三四五六七八九十百千万两\d]+[）)]")
    bodies = F.slice(cut, 2, F.size(cut))
    rows = articles.select("law_id", "number", F.posexplode(F.arrays_zip(marks.alias("l"), bodies.alias("b"))).alias("p", "x"))
    rows = rows.select("law_id", "number", "p", article_key(F.col("x.l")).alias("item"), F.trim("x.b").alias("body")).where("item <> '' and body <> ''")
    return rows.groupBy("law_id", "number", "item").agg(F.max_by("body", "p").alias("body"))


def split_quality(docs: DataFrame, clauses: DataFrame, large: int = 2000) -> DataFrame:
    """doc_id, warning (single_clause_from_large_text, no_numbered_clauses) about how documents were split."""
    per = clauses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("number").rlike(r"^\d")).alias("numbered"))
    j = docs.select("doc_id", F.length("text").alias("size")).join(per, "doc_id")
    codes = [F.when((F.col("n") == 1) & (F.col("size") > large), "single_clause_from_large_text"), F.when(F.col("numbered") == 0, "no_numbered_clauses")]
    return j.select("doc_id", F.explode(F.array_compact(F.array(*codes))).alias("warning"))


def with_snippet(df: DataFrame, radius: int, text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """Df with `snippet`: the text from `radius` before to `radius` after a match (offsets from 0), with ellipses."""
    a, b = F.greatest(F.col(start) - radius, F.lit(0)), F.least(F.col(end) + radius, F.length(text))
    cut = F.trim(F.regexp_replace(F.substring(F.col(text), a + 1, b - a), "\n", " "))
    return df.withColumn("snippet", F.concat(F.when(a > 0, "…").otherwise(""), cut, F.when(b < F.length(text), "…").otherwise("")))


def with_excerpt(hits: DataFrame, size: int = 240) -> DataFrame:
    """Hits (query_id, hit_id, query, text) with excerpt, start_char, end_char, truncated, text_sha256.

    The longest term of the query that occurs sets the place; the excerpt starts a quarter of its size before it.
    """
    terms = F.array_distinct(F.concat(F.array(F.col("query")), F.split(F.trim("query"), r"\s+")))
    at = F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"), (F.instr(F.lower("text"), F.lower(t)) - 1).alias("p")))
    place = F.array_min(F.filter(at, lambda x: x["p"] >= 0))["p"]
    total = F.length("text")
    start = F.least(F.greatest(F.coalesce(place, F.lit(0)) - size // 4, F.lit(0)), F.greatest(total - size, F.lit(0)))
    end = F.least(start + size, total)
    out = hits.withColumn("start_char", start).withColumn("end_char", end)
    return out.withColumn("excerpt", F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))).withColumn(
        "truncated", (F.col("start_char") != 0) | (F.col("end_char") != total)
    ).withColumn("text_sha256", F.sha2("text", 256))


def outline(articles: DataFrame, part: str | None = None, preview: int = 60, with_text: bool = False) -> DataFrame:
    """law_id, position, number, part, preview, truncated (and text) of articles in order."""
    rows = articles if part is None else articles.where(F.col("part").contains(part))
    cols = ["law_id", "position", "number", "part", F.substring("text", 1, preview).alias("preview"), (F.length("text") > preview).alias("truncated")]
    return rows.select(*cols, *(["text"] if with_text else [])).sortWithinPartitions("law_id", "position")


#: Hosts of official sources and how their pages name a document.
SOURCES = (
    ("flk.npc.gov.cn", "flk_npc", r"[?&]id=([0-9A-Fa-f%]+)"), ("www.court.gov.cn", "court_main", r"/([a-z]+/xiangqing/\d+)\.html"),
    ("gongbao.court.gov.cn", "court_gongbao", r"/Details/([0-9A-Fa-f]{20,40})\.html"), ("www.spp.gov.cn", "spp_gov_cn", r"spp\.gov\.cn/([\w/\-]+)\.s?html"),
    ("www.csrc.gov.cn", "csrc_gov_cn", r"/(csrc/c\d+/c[\w-]+)"), ("xzfg.moj.gov.cn", "gov_xzfgk", r"[?&]LawID=(\d+)"), ("www.nfra.gov.cn", "nfra_gov_cn", r"[?&]docId=(\d+)"),
)


def build_docnum_index(laws: DataFrame) -> DataFrame:
    """Docnum, source, source_id, law_id; the last arrival per (docnum, source). Re-issues of amended texts claim none.

    laws: law_id, document_number, source_url, is_reissue, ingest_seq.
    """
    host = F.parse_url("source_url", F.lit("HOST"))
    source = F.coalesce(*[F.when(host == h, s) for h, s, _ in SOURCES], host, F.lit("unknown"))
    own = F.coalesce(*[F.when(host == h, F.nullif(F.regexp_extract("source_url", p, 1), F.lit(""))) for h, _, p in SOURCES], F.parse_url("source_url", F.lit("PATH")))
    rows = laws.where("document_number is not null and not is_reissue").select(docnum.docnum_key(F.col("document_number")).alias("docnum"), source.alias("source"), own.alias("source_id"), "law_id", "ingest_seq")
    last = F.max_by(F.struct("source_id", "law_id"), "ingest_seq")
    return rows.where("docnum <> ''").groupBy("docnum", "source").agg(last.alias("x")).select("docnum", "source", "x.source_id", "x.law_id")
