"""Readers of the input formats: documents, rules, private sets, texts, packs, commentary, evidence, query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions.numerals import article_key

LAW = """id string, title string, short_title string, aliases array<string>, level string, status string, issuing_body string, document_number string,
 released_at string, effective_at string, repealed_at string, source_url string, source_name string, source_checked_at string, source_hash string, work_id string,
 version_label string, categories array<struct<id:string,name:string,parent_id:string,description:string>>, category_ids array<string>,
 relations array<struct<relation_type:string,to_law_id:string,to_law_title:string,effective_at:string,notes:string>>,
 articles array<struct<number:string,number_display:string,text:string,part:string,title:string,position:int>>"""
RULES = """kind string, id string, name string, source_name string, source_url string, source_checked_at string, law_id_map map<string,string>,
 relations array<struct<id:string,relation_type:string,from_law_id:string,to_law_id:string,effective_at:string,notes:string,source_name:string,source_url:string>>,
 rules array<struct<id:string,topic:string,domain:string,primary_law_id:string,fallback_law_id:string,effective_from:string,effective_to:string,rule_text:string,confidence:double,source_name:string,source_url:string>>"""
NORMS = """id string, name string, short_name string, aliases array<string>, source_type string, authority string, jurisdiction string, effective_at string, repealed_at string,
 clauses array<struct<number:string,number_display:string,title:string,text:string,part:string>>"""
PACKS = """id string, name string, summary string, items array<struct<id:string,item_type:string,law_id:string,law_title:string,article_number:string,norm_source_id:string,norm_source_name:string,clause_number:string,role:string,note:string>>,
 dependencies struct<laws:array<struct<law_id:string,law_title:string>>,norm_sources:array<struct<norm_source_id:string,norm_source_name:string>>,packs:array<struct<pack_id:string,pack_name:string>>>"""
COMMENTARY = """book struct<id:string,title:string,author:string,publisher:string,edition:string>,
 items array<struct<id:string,law_id:string,article_number:string,page_start:int,page_end:int,excerpt:string,summary:string,ocr_confidence:double>>"""
EVIDENCE = """evidence_id string, timestamp string, command string, ok boolean, laws array<struct<evidence_level:string,law_id:string,title:string>>,
 articles array<struct<evidence_level:string,law_id:string,number:string,text_hash:string>>"""

#: Older names of private sets' types.
LEGACY_TYPES = {"internal_policy": "policy", "company_policy": "policy", "contract_template": "contract", "checklist": "guide"}
NORM_TYPES = ("policy", "contract", "guide", "standard", "other")


def as_date(c: Column) -> Column:
    """A date in strict ISO form, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Laws, articles, categories, law_categories, relations of a folder of document JSON files."""
    raw = _json(spark, path, LAW).where("id is not null")
    dates = {c: as_date(F.col(c)) for c in ("released_at", "effective_at", "repealed_at")}
    laws = raw.select("id", "title", "short_title", "level", "status", "issuing_body", "document_number", *[v.alias(k) for k, v in dates.items()], "source_url", "source_name", "source_checked_at", "source_hash", "work_id", "version_label", F.array_distinct(F.filter("aliases", lambda a: F.trim(a) != "")).alias("aliases")).withColumnRenamed("id", "law_id")
    a = raw.select(F.col("id").alias("law_id"), F.posexplode("articles").alias("p", "a")).select("law_id", "p", "a.*")
    number = F.when(F.col("number").isin("正文", "序言"), F.col("number")).otherwise(article_key(F.coalesce(F.nullif("number", F.lit("")), "number_display")))
    articles = a.select(F.concat_ws("#", "law_id", number).alias("article_id"), "law_id", number.alias("number"), F.coalesce("number_display", "number").alias("number_display"), "text", "part", "title", (F.col("p") + 1).alias("position"))
    categories = raw.select(F.explode("categories").alias("c")).select("c.*").dropDuplicates(["id"])
    law_categories = raw.select(F.col("id").alias("law_id"), F.explode(F.array_distinct("category_ids")).alias("category_id")).where("category_id <> ''")
    relations = raw.select(F.col("id").alias("from_law_id"), F.explode("relations").alias("r")).select("from_law_id", "r.*")
    return {"laws": laws, "articles": articles, "categories": categories, "law_categories": law_categories, "relations": relations}


def read_rules(spark: SparkSession, path: str, laws: DataFrame) -> dict[str, DataFrame]:
    """Rules and relations, with their file's source where they have none and ids mapped where the target exists."""
    raw = _json(spark, path, RULES)
    ids = raw.select(F.explode("law_id_map").alias("old", "new")).join(laws.select(F.col("law_id").alias("new")), "new", "left_semi").dropDuplicates(["old"])

    def mapped(df: DataFrame, col: str) -> DataFrame:
        return df.join(ids.select(F.col("old").alias("__o"), F.col("new").alias("__n")), F.col(col) == F.col("__o"), "left").withColumn(col, F.coalesce("__n", col)).drop("__o", "__n")

    def rows(name: str) -> DataFrame:
        d = raw.select(F.col("source_name").alias("fn"), F.col("source_url").alias("fu"), F.explode(name).alias("x")).select("fn", "fu", "x.*")
        return d.withColumn("source_name", F.coalesce("source_name", "fn")).withColumn("source_url", F.coalesce("source_url", "fu")).drop("fn", "fu")

    rules, relations = rows("rules"), rows("relations")
    for c in ("primary_law_id", "fallback_law_id"):
        rules = mapped(rules, c)
    for c in ("from_law_id", "to_law_id"):
        relations = mapped(relations, c)
    for c in ("effective_from", "effective_to"):
        rules = rules.withColumn(c, as_date(F.col(c)))
    return {"rules": rules.withColumnRenamed("id", "rule_id"), "relations": relations}


def read_norms(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: private sets and their clauses; aliases trimmed and distinct, older types mapped, unknown types 'other'."""
    raw = _json(spark, path, NORMS)
    kind = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in LEGACY_TYPES.items()], F.when(F.col("source_type").isin(*NORM_TYPES), F.col("source_type")), F.lit("other"))
    own = F.coalesce("id", F.concat(F.lit("norm-"), F.substring(F.sha1("name"), 1, 12)))
    aliases = F.array_distinct(F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: a != ""))
    sources = raw.select(own.alias("source_id"), "name", "short_name", aliases.alias("aliases"), kind.alias("source_type"), "authority", "jurisdiction", as_date(F.col("effective_at")).alias("effective_at"), as_date(F.col("repealed_at")).alias("repealed_at"))
    clauses = raw.select(own.alias("source_id"), F.posexplode("clauses").alias("p", "c")).select("source_id", (F.col("p") + 1).alias("position"), "c.*")
    return {"norms": sources, "clauses": clauses}


def ingest_text(spark: SparkSession, path: str) -> DataFrame:
    """Clauses of whole text files: doc_id (the file's path), position, number, text, part, shape."""
    from folio_spark.operators.texts import segment

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return segment(raw)


def read_packs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Packs, items with inferred types, dependencies stated or implied by items."""
    raw = _json(spark, path, PACKS)
    items = raw.select(F.col("id").alias("pack_id"), F.posexplode("items").alias("p", "i")).select("pack_id", (F.col("p") + 1).alias("position"), "i.*")
    kind = F.coalesce("item_type", F.when(F.col("clause_number").isNotNull(), "clause").when(F.col("article_number").isNotNull(), "article").when(F.col("norm_source_id").isNotNull() | F.col("norm_source_name").isNotNull(), "norm_source").otherwise("law"))
    items = items.withColumn("item_type", kind)
    said = [raw.select(F.col("id").alias("pack_id"), F.explode(f"dependencies.{f}").alias("d")).select("pack_id", F.lit(k).alias("kind"), F.col(f"d.{c}").alias("ref")) for f, k, c in (("laws", "law", "law_id"), ("norm_sources", "norm_source", "norm_source_id"), ("packs", "pack", "pack_id"))]
    implied = [items.select("pack_id", F.lit(k).alias("kind"), F.col(c).alias("ref")) for k, c in (("law", "law_id"), ("norm_source", "norm_source_id"))]
    deps = said[0]
    for d in said[1:] + implied:
        deps = deps.unionByName(d)
    return {"packs": raw.select(F.col("id").alias("pack_id"), "name", "summary"), "items": items, "dependencies": deps.where("ref is not null").distinct()}


def read_commentary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Books and notes, ids and positions given where they are missing."""
    raw = _json(spark, path, COMMENTARY).withColumn("book_id", F.coalesce("book.id", F.concat(F.lit("book-"), F.substring(F.sha1("book.title"), 1, 12))))
    notes = raw.select("book_id", F.posexplode("items").alias("p", "i")).select("book_id", (F.col("p") + 1).alias("position"), "i.*")
    notes = notes.withColumn("note_id", F.coalesce("id", F.concat_ws("#", "book_id", "position"))).withColumn("number", article_key(F.col("article_number"))).drop("id")
    return {"books": raw.select("book_id", "book.title", "book.author", "book.publisher", "book.edition"), "notes": notes}


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence lines; broken ones are dropped."""
    return spark.read.schema(EVIDENCE).option("mode", "DROPMALFORMED").json(path).where("evidence_id is not null")


def evidence_items(evidence: DataFrame) -> DataFrame:
    """evidence_id, level, law_id, number (null for whole laws) of evidence lines."""
    laws = evidence.select("evidence_id", F.explode("laws").alias("x")).select("evidence_id", F.col("x.evidence_level").alias("level"), "x.law_id", F.lit(None).cast("string").alias("number"))
    articles = evidence.select("evidence_id", F.explode("articles").alias("x")).select("evidence_id", F.col("x.evidence_level").alias("level"), "x.law_id", "x.number")
    return laws.unionByName(articles)


def read_query_log(log: DataFrame, since: str, limit: int) -> DataFrame:
    """The first rows of the log since an instant, by id."""
    return log.where(F.col("at") >= F.lit(since).cast("timestamp")).orderBy("id").limit(limit)
