"""Lookups and rules: batch articles, misses, private fallback, relations, applicability, commentary, packs, closures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.functions import docnum
from folio_spark.functions.numerals import explode_number_spec
from folio_spark.operators.names import rarest_gram
from folio_spark.session import spooled


def lookup_articles(requests: DataFrame, resolved: DataFrame, articles: DataFrame) -> DataFrame:
    """request_id, mention, number, ordinal, law_id, found, error, text. Requests name a law and a list of numbers.

    requests: request_id, mention, spec; resolved: mention, law_id; articles: law_id, number, text.
    """
    rows = explode_number_spec(requests).join(resolved, "mention", "left").join(articles, ["law_id", "number"], "left")
    error = F.when(F.col("law_id").isNull(), "law_not_found").when(F.col("text").isNull(), "article_not_found")
    return rows.select("request_id", "mention", "number", "ordinal", "law_id", F.col("text").isNotNull().alias("found"), error.alias("error"), "text")


def batch_sections(requests: DataFrame) -> DataFrame:
    """request_id, place, name, spec (and as_of_text) of requests (request_id, batch, maybe as_of_text): `law1:1,3-5;law2:9`.

    Sections are in order; blank ones, and those without a name before the colon, are none. Without a colon all is the name.
    """
    has = "as_of_text" in requests.columns
    chunks = F.transform(F.split(F.coalesce("batch", F.lit("")), "[;；]+"), lambda c: F.split(F.trim(c), "[:：]", 2))
    named = F.filter(chunks, lambda c: F.trim(c[0]) != "")
    rows = requests.select("request_id", *["as_of_text"] * has, F.posexplode(named).alias("place", "c"))
    spec = F.when(F.size("c") > 1, F.trim(F.get("c", F.lit(1)))).otherwise("")
    return rows.select("request_id", "place", F.trim(F.col("c")[0]).alias("name"), spec.alias("spec"), (F.col("as_of_text") if has else F.lit(None).cast("string")).alias("as_of_text"))


@dataclass(frozen=True)
class Answers:
    """items: request_id, place, number, ordinal, found, text; sections: what each asked law gave; report: a row a request."""

    items: DataFrame
    sections: DataFrame
    report: DataFrame


def answer_batches(requests: DataFrame, resolved: DataFrame, articles: DataFrame, versions: DataFrame, private: DataFrame, clauses: DataFrame) -> Answers:
    """J3 as a whole: batches of laws and numbers, with an answer or a code for every section.

    requests: batch_sections'; resolved: mention, law_id; articles: law_id, version_id (null: as it stands now), number, text;
    versions: law_id, version_id, start; private: mention, source_id; clauses: source_id, number, text. Codes, the first that
    holds: invalid_as_of, missing_numbers, empty_numbers, law_not_found (where no private rule set has the name either, which
    is asked only without a date), version_not_found_as_of. A section is ok if it has no code and no number is missing.
    """
    s = batch_sections(requests)
    day = F.when(F.col("as_of_text").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("as_of_text", "yyyy-MM-dd"))
    asked = F.coalesce("as_of_text", F.lit("")) != ""
    s = s.withColumn("day", day).withColumn("dated", asked)
    key = ["request_id", "place"]
    numbers = explode_number_spec(s.select(*key, "spec")).drop("spec")
    law = resolved.select(F.col("mention").alias("name"), "law_id").dropDuplicates(["name"])
    own = private.select(F.col("mention").alias("name"), "source_id").dropDuplicates(["name"])
    s = s.join(law, "name", "left").join(own, "name", "left").withColumn("source_id", F.when(F.col("law_id").isNull() & ~F.col("dated"), F.col("source_id")))
    # the version in force on the day: the last that began by then
    begun = s.where("day is not null and law_id is not null").select(*key, "law_id", "day").join(versions, "law_id").where("start <= day")
    picked = begun.groupBy(*key).agg(F.max_by("version_id", F.struct("start", "version_id")).alias("version_id"))
    s = s.join(picked, key, "left")
    counted = numbers.groupBy(*key).agg(F.count(F.lit(1)).alias("asked"))
    s = s.join(counted, key, "left")
    error = (
        F.when(F.col("dated") & F.col("day").isNull(), "invalid_as_of").when(F.col("spec") == "", "missing_numbers").when(F.col("asked").isNull(), "empty_numbers")
        .when(F.col("law_id").isNull() & F.col("source_id").isNull(), "law_not_found").when(F.col("dated") & F.col("version_id").isNull(), "version_not_found_as_of")
    )
    s = spooled(s.withColumn("error", error), "sections")
    good = s.where("error is null").select(*key, "law_id", "source_id", "version_id", "dated").join(numbers, key)
    public = good.where("law_id is not null").join(
        articles.select(F.col("law_id").alias("__l"), F.col("version_id").alias("__v"), F.col("number").alias("__n"), "text"),
        (F.col("law_id") == F.col("__l")) & (F.col("number") == F.col("__n")) & F.when(F.col("dated"), F.col("version_id")).eqNullSafe(F.col("__v")), "left",
    )
    inner = good.where("law_id is null").join(clauses.select("source_id", "number", "text"), ["source_id", "number"], "left")
    columns = [*key, "number", "ordinal", "text"]
    items = spooled(public.select(*columns).unionByName(inner.select(*columns)).withColumn("found", F.col("text").isNotNull()), "items")
    per = items.groupBy(*key).agg(F.count(F.lit(1)).alias("item_count"), F.count_if("found").alias("found_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    s = s.join(per, key, "left").withColumns({"item_count": zero("item_count"), "found_count": zero("found_count")}).withColumn("missing_count", F.col("item_count") - F.col("found_count"))
    kind = F.when(F.col("error").isNull(), F.when(F.col("law_id").isNotNull(), "law_articles").otherwise("norm_clauses"))
    sections = s.select(*key, "name", "spec", kind.alias("kind"), "law_id", "source_id", "version_id", "item_count", "found_count", "missing_count", "error", (F.col("error").isNull() & (F.col("missing_count") == 0)).alias("ok"))
    failed, missing = F.count("error"), F.sum("missing_count")
    report = sections.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("law_count"), F.sum("item_count").alias("item_count"), F.sum("found_count").alias("found_count"), missing.alias("missing_count"),
        failed.alias("failed_section_count"), (failed + missing).alias("error_count"), F.every("ok").alias("ok"),
    )
    return Answers(items, sections, report)


def diagnose(misses: DataFrame, laws: DataFrame, versions: DataFrame) -> DataFrame:
    """miss_id, reason, earliest of articles that were not found.

    misses: miss_id, law_id, number, as_of_text (as asked, may be no date); laws: law_id, work_key, status,
    article_count; versions: work_key, start. First that holds: invalid date, law missing, no version then, null then,
    seed, stub, null number.
    """
    day = F.when(F.col("as_of_text").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("as_of_text", "yyyy-MM-dd"))
    first = versions.groupBy("work_key").agg(F.min("start").alias("earliest"))
    j = misses.join(laws, "law_id", "left").join(first, "work_key", "left").withColumn("day", day)
    asked = F.col("as_of_text").isNotNull()
    reason = (
        F.when(asked & F.col("day").isNull(), "invalid_as_of").when(F.col("work_key").isNull(), "law_missing")
        .when(asked & (F.col("earliest").isNull() | (F.col("earliest") > F.col("day"))), "version_not_found_as_of").when(asked, "article_null_as_of")
        .when(F.col("status") == "seed", "law_seed").when(F.coalesce("article_count", F.lit(0)) == 0, "law_stub").otherwise("article_null")
    )
    return j.select("miss_id", reason.alias("reason"), F.when(reason == "version_not_found_as_of", F.col("earliest")).alias("earliest"))


def norm_fallback(misses: DataFrame, norms: DataFrame, clauses: DataFrame) -> DataFrame:
    """miss_id, source_id, clause_id, via: private clauses for public requests that found nothing and have no date.

    misses: miss_id, mention, number, as_of_text; norms: source_id, names (array); clauses: source_id, clause_id,
    number, number_display, title, position. A clause's number comes before its displayed number and its title.
    """
    open_ = misses.where("as_of_text is null")
    named = norms.select("source_id", F.explode("names").alias("mention")).distinct()
    keys = F.array(*[F.struct(F.lit(i).alias("tier"), F.col(c).alias("number")) for i, c in enumerate(("number", "number_display", "title"))])
    by_key = clauses.select("source_id", "clause_id", "position", F.explode(keys).alias("k")).select("source_id", "clause_id", "position", "k.*").where("number is not null")
    # the first clause of a name and number is the same for all who ask, so they meet that one alone
    first = named.join(by_key, "source_id").groupBy("mention", "number").agg(F.min(F.struct("tier", "source_id", "position", "clause_id")).alias("x"))
    hits = open_.join(first, ["mention", "number"]).groupBy("miss_id").agg(F.min("x").alias("x")).select("miss_id", "x.*")
    return hits.select("miss_id", "source_id", "clause_id", F.concat(F.lit("private_"), F.element_at(F.array(*map(F.lit, ("number", "display", "title"))), F.col("tier") + 1)).alias("via"))


def relations(requests: DataFrame, edges: DataFrame, laws: DataFrame) -> DataFrame:
    """request_id, direction, relation_type, other_id, other_title, effective_at for both ends' records."""
    out = edges.select(F.col("from_law_id").alias("law_id"), F.lit("out").alias("direction"), "relation_type", F.col("to_law_id").alias("other_id"), "effective_at")
    back = edges.select(F.col("to_law_id").alias("law_id"), F.lit("in").alias("direction"), "relation_type", F.col("from_law_id").alias("other_id"), "effective_at")
    names = laws.select(F.col("law_id").alias("other_id"), F.col("title").alias("other_title"))
    return requests.join(out.unionByName(back), "law_id").join(names, "other_id", "left").select("request_id", "direction", "relation_type", "other_id", "other_title", "effective_at")


#: Rules of one list that a request meets at once.
LISTED = 8192


def _fitting(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """asked (topic, domain, lo, hi, …) with the rules whose topic and domain fit and whose window meets its days: rule_topic, rule_id, effective_from, effective_to."""
    topics = rules.select("topic").distinct().select(F.col("topic").alias("law_id"), F.col("topic").alias("title"))
    near = rarest_gram(asked.select(F.col("topic").alias("mention")), topics).where(F.lower("law_id").contains(F.lower("mention")))
    near = near.select(F.col("mention").alias("m"), F.col("law_id").alias("l"))
    r = asked.alias("q").join(near, F.col("q.topic") == F.col("m")).join(rules.hint("merge").alias("r"), F.col("r.topic") == F.col("l"))
    inside = (F.col("r.effective_from").isNull() | (F.col("r.effective_from") <= F.col("hi"))) & (F.col("r.effective_to").isNull() | (F.col("r.effective_to") >= F.col("lo")))
    domain = F.col("q.domain").isNull() | F.col("r.domain").isin("all") | (F.col("r.domain") == F.col("q.domain"))
    return r.where(inside & domain).select("q.*", F.col("l").alias("rule_topic"), "r.rule_id", "r.effective_from", "r.effective_to")


def applicable(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """request_id, rule_id, place: rules in whose window the date lies and whose topic and domain fit.

    requests: request_id, topic, domain, as_of; rules: rule_id, topic, domain, effective_from, effective_to. An open
    end is null; a rule's topic equals the asked one or contains it, equal ones first; a domain equals or is 'all'.
    Distinct topics are paired by the asked one's rarest pair of characters, which every topic that contains it has.

    Requests of one topic and domain share a list of rules that is in order once; each keeps those of its day, so what is
    found is neither shuffled nor sorted. Long lists are cut, and a request counts what it has in the parts before.
    """
    asked = requests.select("request_id", "topic", "domain", "as_of").distinct()
    asked = spooled(asked.withColumn("__several", F.count(F.lit(1)).over(Window.partitionBy("request_id")) > 1), "requests")
    other = (F.col("rule_topic") != F.col("topic")).cast("int")
    order = [other, F.col("effective_from").desc_nulls_last(), F.col("rule_id")]
    one, by = asked.where("not __several").drop("__several"), ["topic", "domain"]
    fit = _fitting(one.groupBy(*by).agg(F.min("as_of").alias("lo"), F.max("as_of").alias("hi")), rules)
    until = F.when(F.count_if(F.col("effective_to").isNull()) == 0, F.max("effective_to"))
    fit = fit.groupBy(*by, "rule_topic", "rule_id", "effective_from").agg(until.alias("effective_to"))
    fit = fit.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "rule_topic"))).withColumn("part", F.floor((F.col("at") - 1) / LISTED))
    listed = fit.groupBy(*by, "part").agg(F.sort_array(F.collect_list(F.struct("at", "rule_id", "effective_from", "effective_to"))).alias("rules"))
    listed = spooled(listed.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(*by))), "listed")
    open_ = lambda x: (x["effective_from"].isNull() | (x["effective_from"] <= F.col("as_of"))) & (x["effective_to"].isNull() | (x["effective_to"] >= F.col("as_of")))

    def meet(found: DataFrame) -> DataFrame:
        """The requests and parts that they meet, with the rules of their day."""
        kept = found.select(F.col("topic").alias("t"), F.col("domain").alias("d"), "part", "rules").hint("merge")
        met = one.withColumnRenamed("topic", "l").join(kept, (F.col("l") == F.col("t")) & F.col("domain").eqNullSafe(F.col("d")))
        return met.select("request_id", "part", F.filter("rules", open_).alias("rules"))

    # _outer, since Spark works an array out once more to leave out empty ones
    each = lambda met, *own: met.select("request_id", *own, F.posexplode_outer(F.transform("rules", lambda x: x["rule_id"])).alias("p", "rule_id")).where("p is not null")
    out = each(meet(listed.where("parts = 1"))).select("request_id", "rule_id", (F.col("p") + 1).alias("place"))
    if listed.where("parts > 1").limit(1).count():
        long = meet(listed.where("parts > 1"))
        before = F.sum("n").over(Window.partitionBy("request_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        counts = long.select("request_id", "part", F.size("rules").alias("n")).select("request_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
        more = each(long.join(counts, ["request_id", "part"]), "before")
        out = out.unionByName(more.select("request_id", "rule_id", (F.col("p") + 1 + F.col("before")).cast("int").alias("place")))
    several = asked.where("__several")
    if several.limit(1).count():
        hits = _fitting(several.select("request_id", *by, F.col("as_of").alias("lo"), F.col("as_of").alias("hi")), rules).select("request_id", "rule_id", "rule_topic", "topic", "effective_from").distinct()
        out = out.unionByName(hits.select("request_id", "rule_id", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)).alias("place")))
    return out


def needs_fetch(rules: DataFrame, laws: DataFrame) -> DataFrame:
    """rule_id, role, law_id, need (missing, stub, seed) for the laws that rules name and the corpus lacks."""
    roles = F.array(F.struct(F.lit("primary").alias("role"), F.col("primary_law_id").alias("law_id")), F.struct(F.lit("fallback").alias("role"), F.col("fallback_law_id").alias("law_id")))
    named = rules.select("rule_id", F.explode(roles).alias("x")).select("rule_id", "x.*").where("law_id is not null")
    j = named.join(laws.select("law_id", "status", "article_count", F.lit(True).alias("__here")), "law_id", "left")
    need = F.when(F.col("__here").isNull(), "missing").when(F.col("status") == "seed", "seed").when(F.coalesce("article_count", F.lit(0)) == 0, "stub")
    return j.select("rule_id", "role", "law_id", need.alias("need")).where("need is not null")


def commentary_for(requests: DataFrame, notes: DataFrame, n: int) -> DataFrame:
    """request_id, note_id, place: the first n notes of each article, by book and position."""
    order = Window.partitionBy("request_id").orderBy("book_id", "position", "note_id")
    found = requests.join(notes, ["law_id", "number"]).withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= n).select("request_id", "note_id", "place")


def rule_coverage(rules: DataFrame) -> DataFrame:
    """Topic, rules, domains."""
    return rules.groupBy("topic").agg(F.count(F.lit(1)).alias("rules"), F.count_distinct("domain").alias("domains"))


def validate_packs(items: DataFrame, deps: DataFrame, laws: DataFrame, articles: DataFrame, norms: DataFrame, clauses: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, item_id, code: what pack items and dependencies name that is not there.

    items: pack_id, item_id, item_type, law_id, article_number, norm_source_id, clause_number; deps: pack_id, kind
    (law, norm_source, pack), ref. Four causes for an article: law missing, seed, stub, number unknown.
    """
    a = items.where("item_type = 'article'").join(laws.select("law_id", "status", "article_count", F.lit(True).alias("__l")), "law_id", "left")
    a = a.join(articles.select("law_id", F.col("number").alias("article_number"), F.lit(True).alias("__a")).distinct(), ["law_id", "article_number"], "left")
    code = F.when(F.col("__a").isNotNull(), None).when(F.col("__l").isNull(), "law_missing").when(F.col("status") == "seed", "law_seed").when(F.coalesce("article_count", F.lit(0)) == 0, "law_stub").otherwise("article_missing")
    c = items.where("item_type = 'clause'").join(norms.select(F.col("source_id").alias("norm_source_id"), F.lit(True).alias("__s")), "norm_source_id", "left")
    c = c.join(clauses.select(F.col("source_id").alias("norm_source_id"), F.col("number").alias("clause_number"), F.lit(True).alias("__c")).distinct(), ["norm_source_id", "clause_number"], "left")
    clause = F.when(F.col("__c").isNotNull(), None).when(F.col("__s").isNull(), "norm_source_missing").otherwise("clause_missing")
    known = laws.select(F.lit("law").alias("kind"), F.col("law_id").cast("string").alias("ref")).union(norms.select(F.lit("norm_source"), F.col("source_id").cast("string"))).union(packs.select(F.lit("pack"), F.col("pack_id").cast("string")))
    lost = deps.withColumn("ref", F.col("ref").cast("string")).join(known, ["kind", "ref"], "left_anti").select("pack_id", F.lit(None).cast("long").alias("item_id"), F.concat(F.lit("dependency_"), "kind", F.lit("_missing")).alias("code"))
    return a.select("pack_id", "item_id", code.alias("code")).union(c.select("pack_id", "item_id", clause.alias("code"))).where("code is not null").unionByName(lost)


def append_pack_items(items: DataFrame, incoming: DataFrame, resolvable: DataFrame) -> DataFrame:
    """Incoming items that are new and resolvable, with the next positions of their packs.

    items, incoming: pack_id, ref, role (the semantic key), and position for items, seq for incoming.
    """
    first = Window.partitionBy("pack_id", "ref", "role").orderBy("seq")
    fresh = incoming.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r").join(items, ["pack_id", "ref", "role"], "left_anti").join(resolvable, "ref", "left_semi")
    last = items.groupBy("pack_id").agg(F.max("position").alias("__last"))
    n = F.row_number().over(Window.partitionBy("pack_id").orderBy("seq"))
    return fresh.join(last, "pack_id", "left").withColumn("position", (F.coalesce("__last", F.lit(0)) + n).cast("int")).drop("__last")


def definition_conflicts(entries: DataFrame, by: str = "id") -> DataFrame:
    """Ids that are defined differently by different documents: id, definitions."""
    cols = [c for c in entries.columns if c not in (by, "doc_id")]
    return entries.select(by, F.struct(*cols).alias("d")).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("definitions")).where("definitions > 1")


def align_reissues(docs: DataFrame, laws: DataFrame) -> DataFrame:
    """doc_id, law_id, work_key, same_day of re-issued texts with the record whose number and a name they share.

    docs: doc_id, docnum, names (array), effective_at; laws: law_id, work_key, document_number, names, effective_at.
    Of the records with one number and name only the latest can be a text's record, so texts meet that one alone.
    """
    at = F.struct("l_at", "law_id", "work_key")
    spelled = docnum.docnum_variants(docs, "docnum").withColumn("name", F.explode(F.array_distinct("names")))
    l = laws.select("law_id", "work_key", docnum.docnum_key(F.col("document_number")).alias("variant"), F.explode(F.array_distinct("names")).alias("name"), F.col("effective_at").alias("l_at"))  # noqa: E741
    latest = l.groupBy("variant", "name").agg(F.max(at).alias("y"))
    best = spelled.hint("merge").join(latest, ["variant", "name"]).groupBy("doc_id", "effective_at").agg(F.max("y").alias("x"))
    starts = laws.select(F.col("work_key").alias("wk"), F.col("effective_at").alias("at")).distinct().withColumn("same_day", F.lit(True))
    j = best.select("doc_id", "effective_at", "x.law_id", "x.work_key")
    return j.join(starts, (j["work_key"] == starts["wk"]) & (j["effective_at"] == starts["at"]), "left").select("doc_id", "law_id", "work_key", F.coalesce("same_day", F.lit(False)).alias("same_day"))
