"""A document's own facts by rules of its source: level, issuer, number, dates, and amending decisions.

Rules are rows: source, field, place, pattern, value, which match. For a field, a source's rules are tried in order, then
those of all sources; each is one expression over the place that it reads, so a document is one row from end to end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import docnum
from folio_spark.operators.texts import ARTICLE, clean_lines, lines_of


@dataclass(frozen=True)
class Rule:
    """In `place` (title, head, text, both, column, channel, docnum) a match of `pattern` gives `value`; {1} is its first group.

    last: the last match of a place counts, else the first.
    """

    field: str
    place: str
    pattern: str
    value: str
    last: bool = False


_DAY = r"((?:19|20)\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
_ANY_DAY = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
_DATE = "{1}-{2}-{3}"

# --- fixed values: what titles, texts and columns of each source say ------------------------------------------------
_COURT_LEVELS = (
    ("纪要", "judicial_meeting_minutes"), ("解释|批复", "judicial_interpretation"), ("(?s)^(?=.*规定)(?=.*(?:适用法律|案件))", "judicial_interpretation"),
    ("指导意见|意见|通知|工作指引|实施方案", "judicial_policy"), ("指导性案例|典型案例", "guiding_case"),
)
RULES: dict[str, tuple[Rule, ...]] = {
    "court_main": (
        *(Rule("level", place, pattern, value) for place in ("title", "head") for pattern, value in _COURT_LEVELS),
        Rule("level", "title", "", "other"),
        Rule("issuer", "both", r"最高人民法院[、\s]*最高人民检察院[、\s]*公安部|两高一部", "最高人民法院、最高人民检察院、公安部"),
        Rule("issuer", "both", r"最高人民法院[、\s]*最高人民检察院|两高", "最高人民法院、最高人民检察院"),
        Rule("issuer", "title", "", "最高人民法院"),
        Rule("effective_at", "text", f"自{_ANY_DAY}起施行", _DATE),
    ),
    "spp_gov_cn": (
        Rule("level", "title", "指导性案例|公报案例", "guiding_case"), Rule("level", "title", "纪要", "judicial_meeting_minutes"),
        Rule("level", "title", "解释|批复|复函", "judicial_interpretation"), Rule("level", "title", "意见|通知", "judicial_policy"),
        Rule("level", "channel", "^sfjs$", "judicial_interpretation"), Rule("level", "channel", "^gfwj$", "judicial_policy"),
        Rule("level", "channel", "^jczdal$", "guiding_case"), Rule("level", "title", "", "other"),
        Rule("effective_at", "text", rf"自\s*{_DAY}\s*起施行", _DATE),
    ),
    "csrc_gov_cn": (
        Rule("docnum", "text", r"中国证券监督管理委员会公告\s*[〔\[]((?:19|20)\d{2})[〕\]]\s*0*(\d+)\s*号", "中国证券监督管理委员会公告〔{1}〕{2}号", last=True),
        Rule("docnum", "text", r"证监会公告\s*[〔\[]((?:19|20)\d{2})[〕\]]\s*0*(\d+)\s*号", "中国证券监督管理委员会公告〔{1}〕{2}号", last=True),
        Rule("docnum", "text", r"证监会令\s*(?:第)?\s*0*(\d+)\s*号", "证监会令第{1}号", last=True),
        Rule("docnum", "text", r"证监会令[【〔\[]\s*第?\s*0*(\d+)\s*号[】〕\]]", "证监会令第{1}号", last=True),
        Rule("docnum", "text", r"中国证券监督管理委员会令\s*(?:第)?\s*0*(\d+)\s*号", "证监会令第{1}号", last=True),
        Rule("docnum", "title", r"^【第0*(\d+)号令】", "证监会令第{1}号"),
        Rule("level", "docnum", "^证监会令", "department_rule"), Rule("level", "docnum", "^中国证券监督管理委员会公告", "other"),
        Rule("level", "column", "^(?:证监会令|规章)$", "department_rule"), Rule("level", "title", "", "other"),
        Rule("issuer", "title", "", "中国证券监督管理委员会"),
        Rule("effective_at", "text", rf"自\s*{_DAY}起施行", _DATE),
        Rule("released_at", "text", _DAY, _DATE, last=True),
    ),
    "gov_xzfgk": (
        Rule("docnum", "text", r"(?:中华人民共和国)?国务院令\s*(?:第)?\s*0*(\d+)\s*号", "国务院令第{1}号", last=True),
        Rule("docnum", "text", r"((?:中国)?(?:银行保险监督管理委员会|保险监督管理委员会|银监会|保监会)令\s*\d{4}\s*年\s*第\s*\d+\s*号|银保监发\s*[\[〔]\s*\d{4}\s*[\]〕]\s*\d+\s*号)", "{1}"),
        Rule("issuer", "text", "中国银行保险监督管理委员会", "中国银行保险监督管理委员会"), Rule("issuer", "text", "中国保险监督管理委员会", "中国保险监督管理委员会"),
        Rule("issuer", "text", "中国银行业监督管理委员会|银监会", "中国银行业监督管理委员会"), Rule("issuer", "text", "保监会", "中国保险监督管理委员会"),
        Rule("effective_at", "text", rf"自\s*{_DAY}起施行", _DATE),
        Rule("released_at", "text", rf"{_DAY}\s*(?:公布|发布)", _DATE),
    ),
}
ISSUERS = ("全国人民代表大会常务委员会", "全国人民代表大会", "国务院", "最高人民法院", "最高人民检察院", "中国证券监督管理委员会", "公安部")
SHARED_ISSUERS = ("最高人民法院", "最高人民检察院", "公安部", "国家安全部", "司法部")
COMMON: tuple[Rule, ...] = (
    *(Rule("issuer", place, name, name) for place in ("title", "text") for name in ISSUERS),
    Rule("level", "title", "(?:解释|批复)(?:（.*）)?$", "judicial_interpretation"), Rule("level", "title", "条例$", "admin_regulation"),
    Rule("level", "title", "(?:办法|规定|规则)$", "department_rule"), Rule("level", "title", "法$", "law"), Rule("level", "title", "", "other"),
    Rule("docnum", "both", docnum.INLINE, "{1}"),
    Rule("released_at", "text", _ANY_DAY + r"[^\n，。；]{0,20}(?:通过|公布|发布|印发)", _DATE), Rule("released_at", "text", _ANY_DAY, _DATE),
    Rule("effective_at", "text", f"自{_ANY_DAY}起(?:施行|实施|生效)", _DATE),
)
REISSUED = r"根据本决定[，,]?\s*《([^》]{4,120})》([^。\n]{0,80}?)重新公布。"
BATCH = r"《|等[〇零一二三四五六七八九十百两\d]+件"
REPRINT_NOTE = r"^[（(](?=[^\n]*根据[^\n]*决定》[^（）()\n]{0,8}修正)[^\n]*[）)]$"
PROMULGATED = "现予公布"
LEADS_ELSEWHERE = r"(?:根据|依据|参照|按照|正确理解和适用)[^。；：\n]{0,60}$"
BOOK_BEFORE = r"》\s*[（(]?\s*$"
LEAD = r"^.*(?:根据|依据|参照|按照|适用|修改为|修改|废止|执行)"
# --- end of fixed values --------------------------------------------------------------------------------------------

GROUPS = 3


def _matched(rule: Rule, place: Column) -> Column:
    """The rule's value where its pattern matches in the place, else null."""
    if not rule.pattern:
        return F.lit(rule.value)
    holds = F.coalesce(place.rlike(rule.pattern), F.lit(False))
    if "{" not in rule.value:
        return F.when(holds, rule.value)
    groups = []
    for i in range(1, GROUPS + 1):
        if f"{{{i}}}" in rule.value:
            found = F.regexp_extract_all(place, F.lit(rule.pattern), F.lit(i))
            groups.append(F.when(holds, F.element_at(found, -1 if rule.last else 1)))
    if rule.value == _DATE:
        return F.when(holds, F.concat_ws("-", groups[0], *[F.lpad(g, 2, "0") for g in groups[1:]]))
    out, rest = [], rule.value
    for i, group in enumerate(groups, 1):
        head, _, rest = rest.partition(f"{{{i}}}")
        out += [F.lit(head), group]
    return F.when(holds, F.concat(*out, F.lit(rest)))


def _field(name: str, source: Column, places: dict[str, Column]) -> Column:
    """The first value that the rules of a field give: those of the document's source, then those of all."""
    own = [F.when(source == s, _matched(r, places[r.place])) for s, rules in RULES.items() for r in rules if r.field == name]
    if name == "issuer":  # the bodies that a joint paper names, in a fixed order
        both = F.when(~places["title"].contains(SHARED_ISSUERS[0]) & ~places["title"].contains(SHARED_ISSUERS[1]) & places["title"].contains("两高"), F.array(*map(F.lit, SHARED_ISSUERS[:2])))
        named = F.concat(
            F.coalesce(both, F.filter(F.array(*map(F.lit, SHARED_ISSUERS[:2])), lambda b: places["title"].contains(b))), F.filter(F.array(*map(F.lit, SHARED_ISSUERS[2:])), lambda b: places["title"].contains(b))
        )
        own.append(F.when(source == "spp_gov_cn", F.when(F.size(named) > 0, F.array_join(named, " ")).otherwise(SHARED_ISSUERS[1])))
    return F.coalesce(*own, *[_matched(r, places[r.place]) for r in COMMON if r.field == name])


def infer_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, issuer, level, docnum, released_at, effective_at of docs (doc_id, title, text, maybe source, column, channel).

    A source's own rules go before the common ones; titles go before texts where the rules say so. Dates that are none are null.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in docs.columns else F.lit("")
    text, title = has("text"), has("title")
    places = {"title": title, "text": text, "head": F.substring(text, 1, 500), "both": F.concat_ws("\n", title, text), "column": has("column"), "channel": F.lower(has("channel"))}
    source = has("source")
    rows = docs.withColumn("__docnum", F.nullif(docnum.docnum_key(_field("docnum", source, places)), F.lit("")))
    places["docnum"] = F.coalesce(F.col("__docnum"), F.lit(""))
    # a text of csrc that takes effect on its publication has that date
    released = F.try_to_date(_field("released_at", source, places), "yyyy-MM-dd")
    effective = F.try_to_date(_field("effective_at", source, places), "yyyy-MM-dd")
    effective = F.coalesce(effective, F.when((source == "csrc_gov_cn") & text.contains("自公布之日起施行"), released))
    return rows.select(
        "doc_id", _field("issuer", source, places).alias("issuer"), _field("level", source, places).alias("level"), F.col("__docnum").alias("docnum"), released.alias("released_at"), effective.alias("effective_at")
    )


def own_docnum(docs: DataFrame) -> DataFrame:
    """doc_id, docnum: a document's own number, from the lines before its first article.

    A number that stands at a line's start is its own. One behind another document's name in book marks, or behind words
    that lead to another document within the sentence, is not; the first that is neither counts.
    """
    lines = clean_lines(lines_of(docs))
    first = F.min(F.when(F.col("line").rlike(ARTICLE), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    head = lines.withColumn("__f", first).where("__f is null or line_no < __f")
    pieces = F.regexp_extract_all("line", F.lit("(?s)(.*?)" + docnum.INLINE), F.lit(1))
    numbers = F.regexp_extract_all("line", F.lit("(?s)(.*?)" + docnum.INLINE), F.lit(2))
    # what stands before a number: the pieces and numbers up to it, and its own piece
    earlier = F.transform(F.sequence(F.lit(1), F.col("at")), lambda k: F.concat(F.element_at("__p", k), F.element_at("__n", k)))
    found = head.withColumns({"__p": pieces, "__n": numbers}).where(F.size("__n") > 0)
    each = found.select("doc_id", "line_no", "__p", "__n", F.posexplode("__n").alias("at", "n"))
    before = F.when(F.col("at") == 0, F.element_at("__p", 1)).otherwise(F.concat(F.array_join(earlier, ""), F.element_at("__p", F.col("at") + 1)))
    # words that run into a number are before it
    lead = F.regexp_extract("n", LEAD, 0)
    each = each.withColumn("before", F.concat(before, lead)).withColumn("n", F.regexp_replace("n", LEAD, ""))
    own = each.where((F.trim("before") == "") | ~(F.col("before").rlike(BOOK_BEFORE) | F.col("before").rlike(LEADS_ELSEWHERE)))
    return own.groupBy("doc_id").agg(docnum.docnum_key(F.min_by("n", F.struct("line_no", "at"))).alias("docnum"))


def split_amendments(docs: DataFrame) -> DataFrame:
    """doc_id, is_decision, amended_number, decision_text, reissued_title, reissued_text, is_batch of amending decisions.

    A decision ends with the sentence that orders the amended text to be published again; what follows is that text. Where
    there is no such sentence, the text begins at its title, above a note in brackets that says under which decision it was
    amended. Older pages mark it as an appendix. Before its sentence of promulgation a page is news, not decision.
    """
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    amends = (title.contains("修改") & title.endswith("决定")) | title.rlike("关于(?:修改|修正|修订)")
    cited = F.regexp_extract(title, "《([^》]{2,120})》", 1)
    plain = lambda c: F.regexp_replace(c, r"[\s《》〈〉（）()]", "")
    rows = docs.select("doc_id", title.alias("title"), text.alias("text"), amends.alias("is_decision"), cited.alias("cited"))
    order = F.regexp_instr("text", F.lit(REISSUED))
    sentence = F.regexp_extract("text", REISSUED, 0)
    rows = rows.withColumn("at", F.when(order > 0, order + F.length(sentence) - 1))
    # the last lines above a note of amendment that spell the cited title
    lines = F.split("text", "\n")
    note = F.transform(lines, lambda x: F.trim(x).rlike(REPRINT_NOTE))
    noted = F.array_position(note, True)
    titled = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda k: (noted - k >= 1) & (plain(F.col("cited")) != "") & F.endswith(plain(F.array_join(F.slice(lines, F.greatest(noted - k, F.lit(1)).cast("int"), k), "")), plain(F.col("cited"))))
    from_line = F.when((noted > 1) & (F.size(titled) > 0), noted - titled[0])
    head = F.array_join(F.slice(lines, 1, (from_line - 1).cast("int")), "\n")
    rows = rows.withColumn("at", F.coalesce("at", F.when(from_line > 1, F.length(head) + 1)))
    mark = "(?s)^.*?\n\\s*(?:附[:：]?|本决定[^\n]*重新公布[。]?)\\s*\n"
    rows = rows.withColumn("appendix", F.when(F.col("at").isNull() & F.col("text").rlike(mark), F.length(F.regexp_extract("text", mark, 0))))
    rows = rows.withColumn("end", F.coalesce("at", "appendix"))
    rest = F.nullif(F.trim(F.regexp_replace(F.expr("substring(text, end + 1)"), r"^\s+|\s+$", "")), F.lit(""))
    rows = rows.withColumn("rest", F.when(F.col("is_decision"), rest))
    decision = F.expr("substring(text, 1, end)")
    decision = F.regexp_replace(decision, "(?s)\n\\s*附[:：]?\\s*\n$", "")
    promulgated = F.regexp_extract(decision, f"(?s)^.*\n([^\n]*{PROMULGATED}.*)$", 1)  # the last sentence of the kind
    decision = F.trim(F.regexp_replace(F.when(promulgated != "", promulgated).otherwise(decision), r"^\s+|\s+$", ""))
    scope = F.when(order > 0, F.regexp_extract("text", REISSUED, 2)).otherwise(F.regexp_replace("title", "(?s)^[^》]*》", ""))
    batch = F.col("is_decision") & (scope.rlike(BATCH) | (F.size(F.regexp_extract_all("title", F.lit("《([^》]+)》"), 1)) > 1) | F.col("title").rlike("等[\\x{4E00}-\\x{9FFF}]*(?:件|部)"))
    named = F.when(order > 0, F.regexp_extract("text", REISSUED, 1)).otherwise(F.col("cited"))
    after = F.expr("substring(text, instr(text, concat('《', named, '》')) + length(named) + 2)")
    rows = rows.withColumns({"named": named, "batch": batch})
    bracketed = F.regexp_extract(after, r"^\s*[（(]\s*([^（）()\s]{2,40}?号)\s*[）)]", 1)
    inline = F.nullif(docnum.docnum_key(F.regexp_extract("text", docnum.INLINE, 1)), F.lit(""))
    number = F.when((F.col("named") != "") & (F.instr(F.col("text"), F.concat(F.lit("《"), F.col("named"), F.lit("》"))) > 0), F.nullif(bracketed, F.lit("")))
    return rows.select(
        "doc_id", "is_decision", F.when(F.col("is_decision"), F.coalesce(F.when(~F.col("batch"), number), inline)).alias("amended_number"),
        F.when(F.col("rest").isNotNull(), decision).otherwise(F.col("text")).alias("decision_text"),
        F.when(F.col("rest").isNotNull() & F.col("at").isNotNull(), F.regexp_replace("named", r"\s+", "")).alias("reissued_title"), F.col("rest").alias("reissued_text"), F.col("batch").alias("is_batch"),
    )
