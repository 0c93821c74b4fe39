"""Checks and reports: contract and article violations, referential integrity, gates, status, rebuild impact, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions.numerals import SYMBOLIC, article_key

#: Levels and statuses of documents.
LEVELS = (
    "law", "admin_regulation", "supervisory_regulation", "judicial_interpretation", "department_rule", "local_regulation",
    "local_government_rule", "normative_document", "industry_rule", "guiding_case", "treaty", "other",
)
STATUSES = ("current", "amended", "repealed", "pending_effective", "unknown", "seed")
#: Source categories and codes, and what they are stored as.
CATEGORY_LEVELS = {
    "宪法": "law", "法律": "law", "修正案": "law", "行政法规": "admin_regulation", "司法解释": "judicial_interpretation", "地方法规": "local_regulation",
    "地方性法规": "local_regulation", "自治条例和单行条例": "local_regulation", "经济特区法规": "local_regulation", "浦东新区法规": "local_regulation",
    "海南自由贸易港法规": "local_regulation", "部门规章": "department_rule", "地方政府规章": "local_government_rule", "监察法规": "supervisory_regulation",
}
CODE_STATUS = {1: "repealed", 2: "amended", 3: "current", 4: "pending_effective"}


def map_codes(df: DataFrame, col: str, mapping: dict, out: str, default: str) -> DataFrame:
    """Df with `out`, the mapped code or a default, by a join with the small table of codes."""
    kind = "int" if all(isinstance(k, int) for k in mapping) else "string"
    dim = df.sparkSession.createDataFrame(list(mapping.items()), f"__k {kind}, __v string")
    dim = F.broadcast(dim) if len(mapping) <= 100_000 else dim
    return df.join(dim, df[col] == dim["__k"], "left").withColumn(out, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def with_coverage(laws: DataFrame) -> DataFrame:
    """P10: coverage of each record by status and article count: seed, unknown, populated or stub."""
    c = F.when(F.col("status") == "seed", "seed").when(F.col("article_count").isNull(), "unknown").when(F.col("article_count") > 0, "populated").otherwise("stub")
    return laws.withColumn("coverage", c)


def with_freshness(laws: DataFrame, today: str) -> DataFrame:
    """P10: days since the source was checked, never negative."""
    return laws.withColumn("freshness_days", F.greatest(F.datediff(F.lit(today).cast("date"), F.to_date("source_checked_at")), F.lit(0)))


def with_version_label(laws: DataFrame) -> DataFrame:
    """P10: the given label, or one from the dates, or from the day of the check."""
    r, e = F.col("released_at").cast("string"), F.col("effective_at").cast("string")
    made = F.when(r.isNotNull() & e.isNotNull() & (r != e), F.concat(r, F.lit(" 发布 / "), e, F.lit(" 施行"))).when(r.isNotNull(), F.concat(r, F.lit(" 发布版"))).when(e.isNotNull(), F.concat(e, F.lit(" 施行版")))
    seen = F.concat(F.substring(F.col("source_checked_at").cast("string"), 1, 10), F.lit(" 快照"))
    return laws.withColumn("version_label", F.coalesce(F.nullif("version_label", F.lit("")), made, seen, F.lit("未命名版本")))


def violations(docs: DataFrame) -> DataFrame:
    """V1: doc_id, code for each rule that a document's fields break.

    Nested fields are checked where docs has them: categories (id, name, parent_id) and category_ids, relations
    (relation_type, to_law_id, effective_at), articles (number, text, position).
    """
    text = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"missing_{c}") for c in ("title", "source_url", "source_name", "source_hash")]
    dates = [F.when(F.col(c).isNotNull() & F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")).isNull(), f"invalid_{c}") for c in ("released_at", "effective_at", "repealed_at")]
    other = [
        F.when(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)), "invalid_level"), F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid_status"),
        F.when(~F.coalesce(F.col("source_url").rlike("^(?:https?|file)://"), F.lit(False)), "invalid_source_url"),
        F.when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.coalesce(F.trim(a), F.lit("")) == ""), "blank_alias"),
    ]
    nested = []
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = lambda name, breaks, code: F.when(F.exists(F.coalesce(F.col(name), F.array().cast(docs.schema[name].dataType)), breaks), code)
    if "categories" in docs.columns:
        nested.append(some("categories", lambda c: blank(c["id"]) | blank(c["name"]), "incomplete_category"))
        ids = F.transform("categories", lambda c: c["id"])
        nested.append(some("categories", lambda c: c["parent_id"].isNotNull() & ~F.array_contains(ids, c["parent_id"]), "unknown_parent_category"))
        if "category_ids" in docs.columns:
            nested.append(some("category_ids", lambda i: blank(i) | ~F.coalesce(F.array_contains(ids, i), F.lit(False)), "unknown_category"))
    if "relations" in docs.columns:
        nested.append(some("relations", lambda r: blank(r["relation_type"]), "missing_relation_type"))
        nested.append(some("relations", lambda r: blank(r["to_law_id"]), "missing_relation_target"))
        wrong = lambda d: d.isNotNull() & F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(d, "yyyy-MM-dd")).isNull()
        nested.append(some("relations", lambda r: wrong(r["effective_at"]), "invalid_relation_date"))
    if "articles" in docs.columns:
        nested.append(F.when(F.coalesce(F.size("articles"), F.lit(0)) < 1, "no_articles"))
        nested.append(some("articles", lambda a: blank(a["number"]), "missing_article_number"))
        nested.append(some("articles", lambda a: blank(a["text"]), "missing_article_text"))
        nested.append(some("articles", lambda a: ~F.coalesce(a["position"] >= 1, F.lit(False)), "invalid_article_position"))
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*text, *dates, *other, *nested))).alias("code"))


def article_violations(articles: DataFrame) -> DataFrame:
    """V2: law_id, code: empty texts, repeated numbers or positions, positions not 1..N, displays that disagree."""
    display = F.col("number_display").isNotNull() & ~F.col("number").isin(*SYMBOLIC)
    # a number as it is usually displayed is its own key, without the patterns of all other forms
    usual = F.col("number").rlike("^[1-9][0-9]{0,17}$") & (F.col("number_display") == F.concat(F.lit("第"), "number", F.lit("条")))
    keyed = articles.withColumn("__k", F.when(usual, F.col("number")).when(display, article_key(F.col("number_display"))))
    per = keyed.groupBy("law_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("numbers"), F.count_distinct("position").alias("positions"), F.min("position").alias("low"), F.max("position").alias("high"),
        F.max((F.coalesce(F.trim("text"), F.lit("")) == "").cast("int")).alias("blank"), F.max(((F.col("__k") != "") & (F.col("__k") != F.col("number"))).cast("int")).alias("differs"),
    )
    n = F.col("n")
    codes = [
        F.when(F.col("blank") == 1, "empty_text"), F.when(F.col("numbers") < n, "duplicate_number"), F.when(F.col("positions") < n, "duplicate_position"),
        F.when((F.col("low") != 1) | (F.col("high") != n) | (F.col("positions") < n), "positions_not_contiguous"), F.when(F.col("differs") == 1, "display_disagrees"),
    ]
    return per.select("law_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def rule_violations(rules: DataFrame) -> DataFrame:
    """V3: rule_id, code."""
    codes = [F.when(F.col("effective_from") > F.col("effective_to"), "window_reversed")] + [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"missing_{c}") for c in ("topic", "primary_law_id", "rule_text")]
    return rules.select("rule_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def consolidate(base: DataFrame, changes: DataFrame, expected: DataFrame) -> DataFrame:
    """V4: law_id, number, issue where a text with its replacements differs from the expected one, space and notes aside."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"〔[^〕]*〕|\[[^\]]*\]", ""), r"\s+", "")
    key = ["law_id", "number"]
    made = base.select(*key, "text").join(changes.select(*key, F.col("text").alias("new")), key, "full_outer").select(*key, F.coalesce("new", "text").alias("made"))
    j = made.join(expected.select(*key, F.col("text").alias("want")), key, "full_outer")
    issue = F.when(F.col("made").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(plain(F.col("made")) != plain(F.col("want")), "differs")
    return j.select(*key, issue.alias("issue")).where("issue is not null")


def orphans(children: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """V5: constraint, key, n: keys of children that have no parent. {name: (child, column, parent, column)}."""
    out = None
    for name, (child, c, parent, p) in children.items():
        lost = child.where(F.col(c).isNotNull()).join(parent.select(F.col(p).alias("__p")).distinct(), F.col(c) == F.col("__p"), "left_anti")
        rows = lost.groupBy(F.col(c).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("constraint"), "key", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def conflicts(drafts: DataFrame, current: DataFrame) -> DataFrame:
    """V6: draft_id, code: a draft whose base is not the current text any more, or whose name another record has.

    drafts: draft_id, law_id, base_fingerprint, name; current: law_id, fingerprint, name.
    """
    c = current.select("law_id", F.col("fingerprint").alias("now")).hint("merge")
    stale = drafts.join(c, "law_id", "left").where(~F.col("now").eqNullSafe(F.col("base_fingerprint"))).select("draft_id", F.lit("base_changed").alias("code"))
    # one row per name: another record has it if its first or its last one is another
    names = current.groupBy("name").agg(F.min("law_id").alias("first"), F.max("law_id").alias("last"))
    taken = drafts.hint("merge").join(names, "name").where("first <> law_id or last <> law_id").select("draft_id", F.lit("name_taken").alias("code")).distinct()
    return stale.unionByName(taken)


def corpus_gate(laws: DataFrame, revisions: DataFrame, articles: DataFrame) -> DataFrame:
    """Code, key: what keeps a corpus from release.

    laws: law_id, work_key, status, effective_at; revisions: revision_id, law_id, snapshot_id; articles: law_id, number, text.
    """
    live = laws.where("status = 'current'")
    several = live.groupBy("work_key").agg(F.size(F.collect_set("effective_at")).alias("n")).where("n > 1").select(F.lit("several_current_dates").alias("code"), F.col("work_key").cast("string").alias("key"))
    undated = live.where("effective_at is null").select(F.lit("missing_date"), F.col("law_id").cast("string"))
    markup = articles.where(F.col("text").rlike("</?[a-zA-Z][^>]*>|&[a-z]+;")).select(F.lit("markup_residue"), F.concat_ws("#", "law_id", "number"))
    foreign = revisions.where("not (snapshot_id <=> law_id)").select(F.lit("snapshot_identity"), F.col("revision_id").cast("string"))
    bare = laws.join(revisions.select("law_id").distinct(), "law_id", "left_anti").select(F.lit("missing_revision"), F.col("law_id").cast("string"))
    return several.union(undated).union(markup).union(foreign).union(bare)


def corpus_status(laws: DataFrame, articles: DataFrame) -> DataFrame:
    """A1: dimension, value, laws, articles: counts in all and by level, status and coverage, in one pass over laws."""
    counts = articles.groupBy("law_id").agg(F.count(F.lit(1)).alias("article_count"))
    j = with_coverage(laws.select("law_id", "level", "status").join(counts, "law_id", "left").fillna(0, ["article_count"]))
    sets = j.groupingSets([["level"], ["status"], ["coverage"], []], "level", "status", "coverage").agg(F.count(F.lit(1)).alias("laws"), F.sum("article_count").alias("articles"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "level").when(F.col("g") == 5, "status").when(F.col("g") == 6, "coverage").otherwise("all")
    return sets.select(name.alias("dimension"), F.coalesce("level", "status", "coverage", F.lit("")).alias("value"), "laws", "articles")


def with_counts(parent: DataFrame, child: DataFrame, key: str, out: str = "n") -> DataFrame:
    """A2: parent with the number of its children, 0 where there are none; children are counted before the join."""
    return parent.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(out)), key, "left").fillna(0, [out])


def distinct_issues(issues: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first of issues that are equal in `by`."""
    return issues.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("__r = 1").drop("__r")


def rebuild_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """law_id, added, removed, changed_text, changed_part of articles between two builds; unchanged laws are left out."""
    b, a = (d.select("law_id", "number", F.col("text").alias("t" + s), F.col("part").alias("p" + s), F.lit(True).alias("h" + s)) for d, s in ((before, "0"), (after, "1")))
    j = b.join(a, ["law_id", "number"], "full_outer")
    both = F.col("h0").isNotNull() & F.col("h1").isNotNull()
    out = j.groupBy("law_id").agg(
        F.count_if(F.col("h0").isNull()).alias("added"), F.count_if(F.col("h1").isNull()).alias("removed"),
        F.count_if(both & ~F.col("t0").eqNullSafe(F.col("t1"))).alias("changed_text"), F.count_if(both & ~F.col("p0").eqNullSafe(F.col("p1"))).alias("changed_part"),
    )
    return out.where("added + removed + changed_text + changed_part > 0")


def manifest_check(data: DataFrame, manifest: DataFrame) -> DataFrame:
    """File, issue (missing, stale, count_mismatch). data: file, n; manifest: file, expected."""
    j = data.join(manifest, "file", "full_outer")
    issue = F.when(F.col("n").isNull(), "stale").when(F.col("expected").isNull(), "missing").when(F.col("n") != F.col("expected"), "count_mismatch")
    return j.select("file", issue.alias("issue")).where("issue is not null")
