"""Versions of works in time: grouping, intervals, as-of lookup, status on a date, folding, chains and diffs.

A record is one version of a work: law_id, work_id, title, level, issuing_body, status, effective_at (dates), and
ingest_seq, the order of arrival that settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How search and folding rank a status.
STATUS_RANK = {"current": 0, "pending_effective": 1, "unknown": 2, "amended": 3, "repealed": 3}


def status_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, r) for s, r in STATUS_RANK.items()], F.lit(2))


def with_work_key(laws: DataFrame) -> DataFrame:
    """work_key is work_id; records without one share a key by (title, level, issuing_body), nulls being equal.

    Seed records stand alone. Only records without a work_id are grouped, in their own branch.
    """
    grouped = Window.partitionBy("title", "level", F.coalesce("issuing_body", F.lit("")))
    known = laws.where("work_id is not null").withColumn("work_key", F.col("work_id").cast("string"))
    free = laws.where("work_id is null")
    alone = free.where("status <=> 'seed'").withColumn("work_key", F.concat(F.lit("~"), F.col("law_id")))
    shared = free.where("not (status <=> 'seed')").withColumn("work_key", F.concat(F.lit("~"), F.min("law_id").over(grouped).cast("string")))
    return known.unionByName(alone).unionByName(shared)


def version_intervals(starts: DataFrame) -> DataFrame:
    """work_key, start, next_start from all dates at which a version of a work starts (rows may repeat)."""
    by = Window.partitionBy("work_key").orderBy("start")
    return starts.where("start is not null").select("work_key", "start").distinct().withColumn("next_start", F.lead("start").over(by))


def as_of(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """For each request (request_id, work_key, as_of, law_id or null) the version in force on its date.

    versions: work_key, law_id, version_id, start, ingest_seq. The greatest start on or before the date wins; ties
    prefer the requested record, then the latest arrival. Requests and versions of a work are merged in date order and
    the last version is carried along, so a work is read once and nothing is multiplied.
    """
    v = versions.where("start is not null").select(
        "work_key", F.col("start").alias("__at"), F.lit(0).alias("__kind"), "ingest_seq", F.struct("start", "ingest_seq", "law_id", "version_id").alias("__v"),
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.lit(None).cast(versions.schema["law_id"].dataType).alias("__asked"),
    )
    asked = F.col("law_id") if "law_id" in requests.columns else F.lit(None)
    q = requests.select(
        "work_key", F.col("as_of").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("ingest_seq"), F.lit(None).cast(v.schema["__v"].dataType).alias("__v"),
        "request_id", asked.cast(versions.schema["law_id"].dataType).alias("__asked"),
    )
    order = Window.partitionBy("work_key").orderBy("__at", "__kind", "ingest_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = v.unionByName(q).withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__kind = 1")
    out = found.select("request_id", "work_key", F.col("__at").alias("as_of"), "__v.start", "__v.law_id", "__v.version_id", "__asked")
    if "law_id" not in requests.columns:
        return out.drop("__asked")
    own = versions.groupBy(F.col("work_key").alias("k"), F.col("start").alias("s"), F.col("law_id").alias("l")).agg(F.max_by("version_id", "ingest_seq").alias("own"))
    tied = (out["work_key"] == own["k"]) & (out["start"] == own["s"]) & (out["__asked"] == own["l"])
    picked = out.join(own, tied, "left")
    return picked.select(
        "request_id", "work_key", "as_of", "start", F.when(F.col("own").isNotNull(), F.col("__asked")).otherwise(F.col("law_id")).alias("law_id"),
        F.coalesce("own", "version_id").alias("version_id"),
    )


def as_of_by_interval(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """J4 by W2's intervals: request_id, start. An equi-join on the work with a range condition."""
    r, i = requests.alias("r"), intervals.alias("i")
    inside = (F.col("r.work_key") == F.col("i.work_key")) & (F.col("r.as_of") >= F.col("i.start")) & (F.col("i.next_start").isNull() | (F.col("r.as_of") < F.col("i.next_start")))
    return r.join(i, inside, "left").select("r.request_id", "i.start")


def status_as_of(rows: DataFrame, starts: DataFrame, today: str) -> DataFrame:
    """Rows (work_key, start, repealed_at, status, as_of, any others) with derived_status and its reason.

    starts: work_key, start of every version of the works. The rules are tried in this order and the first that holds
    decides; `today` is a parameter, so that runs repeat.
    """
    per_work = starts.where("start is not null").groupBy("work_key").agg(F.sort_array(F.collect_set("start")).alias("__starts"))
    joined = rows.join(per_work, "work_key", "left")
    d, start, now = F.col("as_of"), F.col("start"), F.lit(today).cast("date")
    later = F.filter(F.coalesce("__starts", F.array()), lambda s: (start.isNull() | (s > start)) & (s <= d))
    any_later = F.exists(F.coalesce("__starts", F.array()), lambda s: start.isNull() | (s > start))
    rules = [
        (start > d, "pending_effective", "starts_later"),
        ((F.size(later) > 0) & start.isNotNull(), "amended", "superseded"),
        (F.col("repealed_at").isNotNull() & (F.col("repealed_at") <= d), "repealed", "repealed_at"),
        (F.col("repealed_at").isNotNull(), "current", "before_repeal"),
        ((F.col("status") == "repealed") & (d >= now), "repealed", "upstream"),
        (F.col("status") == "repealed", "unknown", "repeal_undated"),
        (F.col("status") == "unknown", "unknown", "upstream"),
        ((F.col("status") == "amended") & ~any_later & (d >= now), "amended", "upstream"),
        ((F.col("status") == "amended") & ~any_later, "unknown", "amendment_undated"),
        (start.isNull() & (d < now), "unknown", "undated"),
    ]
    status = F.coalesce(*[F.when(c, F.lit(s)) for c, s, _ in rules], F.when(start.isNull(), F.col("status")), F.lit("current"))
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, _, r in rules], F.when(start.isNull(), F.lit("undated_upstream")), F.lit("in_force"))
    return joined.withColumn("derived_status", status).withColumn("status_reason", reason).drop("__starts")


def fold_versions(hits: DataFrame) -> DataFrame:
    """Hits (query_id, work_key, law_id, derived_status, start, …) of one version per query and work.

    The best status stays, then the newest start, then the least id; other_versions counts the rest.
    """
    by = Window.partitionBy("query_id", "work_key")
    order = by.orderBy(status_rank(F.col("derived_status")), F.col("start").desc_nulls_last(), "law_id")
    chosen = F.first("law_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    others = F.size(F.collect_set("law_id").over(by)) - 1
    return hits.withColumn("__chosen", chosen).withColumn("other_versions", others).where("law_id = __chosen").drop("__chosen")


def current_version(resolved: DataFrame, laws: DataFrame, articles: DataFrame, today: str) -> DataFrame:
    """For a resolved name (mention_id, law_id, work_key, pinned) the record in force today that has articles.

    A pinned mention (asked by id, number or with a year) keeps its record.
    """
    has = articles.select("law_id").distinct().withColumn("__has", F.lit(True))
    live = laws.join(has, "law_id").where(F.col("effective_at") <= F.lit(today).cast("date"))
    best = live.groupBy("work_key").agg(F.max_by("law_id", F.struct("effective_at", "ingest_seq")).alias("__best"))
    joined = resolved.join(best, "work_key", "left")
    return joined.withColumn("current_law_id", F.when(F.col("pinned"), F.col("law_id")).otherwise(F.coalesce("__best", "law_id"))).drop("__best")


def version_chain(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """request_id, chain: versions between two dates, in the direction that the request runs."""
    low, high = F.least("from_date", "to_date"), F.greatest("from_date", "to_date")
    inside = requests.join(versions, "work_key").where((F.col("start") >= low) & (F.col("start") <= high))
    chain = F.sort_array(F.collect_list(F.struct("start", "version_id")))
    out = inside.groupBy("request_id", "from_date", "to_date").agg(chain.alias("c"))
    ids = F.transform("c", lambda x: x["version_id"])
    return out.select("request_id", F.when(F.col("from_date") > F.col("to_date"), F.reverse(ids)).otherwise(ids).alias("chain"))


def diff_versions(before: DataFrame, after: DataFrame, key: str = "number") -> DataFrame:
    """(request_id, key) with change: added, removed, changed (text or part differs) or unchanged."""
    a = before.select("request_id", key, F.col("text").alias("text_before"), F.col("part").alias("part_before"), F.lit(True).alias("__a"))
    b = after.select("request_id", key, F.col("text").alias("text_after"), F.col("part").alias("part_after"), F.lit(True).alias("__b"))
    same = F.col("text_before").eqNullSafe(F.col("text_after")) & F.col("part_before").eqNullSafe(F.col("part_after"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, ["request_id", key], "full_outer").withColumn("change", change).drop("__a", "__b")


def with_occurrence(clauses: DataFrame, doc: str = "law_id", number: str = "number", position: str = "position") -> DataFrame:
    """The how-manieth clause of its number each clause is."""
    return clauses.withColumn("occurrence", F.row_number().over(Window.partitionBy(doc, number).orderBy(position)))


def diff_documents(before: DataFrame, after: DataFrame, fields_before: DataFrame, fields_after: DataFrame) -> DataFrame:
    """D3: changes of a document, numbers matched by occurrence, fields by name: law_id, item, change.

    before, after: law_id, number, position, text; fields: law_id and one column per field.
    """
    shape = lambda d: with_occurrence(d).select(F.col("law_id").alias("request_id"), F.concat_ws("#", "number", "occurrence").alias("item"), "text", F.lit(None).cast("string").alias("part"))

    def flat(d: DataFrame) -> DataFrame:
        names = [c for c in d.columns if c != "law_id"]
        wide = d.select("law_id", *[F.col(c).cast("string").alias(c) for c in names])
        long = wide.unpivot("law_id", names, "item", "text")
        return long.select(F.col("law_id").alias("request_id"), F.concat(F.lit("field:"), "item").alias("item"), "text", F.lit(None).cast("string").alias("part"))

    found = diff_versions(shape(before).unionByName(flat(fields_before)), shape(after).unionByName(flat(fields_after)), "item")
    return found.where("change <> 'unchanged'").select(F.col("request_id").alias("law_id"), "item", "change")


def append_revisions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (source_id, seq, content_hash) with revision numbers after the greatest one of their source."""
    last = existing.groupBy("source_id").agg(F.max("revision").alias("__last"))
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("seq"))
    return incoming.join(last, "source_id", "left").withColumn("revision", (F.coalesce("__last", F.lit(0)) + n).cast("int")).drop("__last")


def history(revisions: DataFrame, newest_first: bool = True) -> DataFrame:
    """Revisions of each source with place 1..n, newest first for laws, oldest first for private sets."""
    order = [F.col("start").desc_nulls_last(), F.col("ingest_seq").desc()] if newest_first else [F.col("start").asc_nulls_first(), "ingest_seq"]
    return revisions.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))


def content_hash(articles: DataFrame, by: str = "law_id") -> DataFrame:
    """A5: one digest per document over its articles' numbers and texts in order."""
    rows = F.sort_array(F.collect_list(F.struct("position", "number", "text")))
    flat = F.array_join(F.transform(rows, lambda r: F.concat(r["number"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    return articles.groupBy(by).agg(F.sha2(flat, 256).alias("content_hash"))


def explode_snapshots(revisions: DataFrame, laws: DataFrame, articles: DataFrame) -> DataFrame:
    """revision_id, law_id, number, position, text, diagnostic of every revision's snapshot.

    revisions: revision_id, law_id, content_hash, snapshot_json. A snapshot that is missing falls back to the stored
    articles only where the record's hash equals the revision's; what cannot be replayed gives one row that says why.
    """
    shape = "struct<id:string,articles:array<struct<number:string,text:string,position:int>>>"
    parsed = revisions.withColumn("s", F.from_json("snapshot_json", shape))
    known = parsed.join(laws.select("law_id", F.col("content_hash").alias("__hash")), "law_id", "left")
    none = F.col("snapshot_json").isNull() | (F.trim("snapshot_json") == "")
    diagnostic = (
        F.when(none & F.col("__hash").eqNullSafe(F.col("content_hash")), "stored_articles")
        .when(none, "snapshot_missing")
        .when(F.col("s.id").isNull() | F.col("s.articles").isNull(), "snapshot_corrupt")
        .when(F.col("s.id") != F.col("law_id"), "snapshot_foreign")
    )
    known = known.withColumn("diagnostic", diagnostic)
    good = known.where("diagnostic is null").select("revision_id", "law_id", F.explode("s.articles").alias("a"), "diagnostic").select("revision_id", "law_id", "a.number", "a.position", "a.text", "diagnostic")
    stored = known.where("diagnostic = 'stored_articles'").select("revision_id", "law_id", "diagnostic").join(articles, "law_id").select("revision_id", "law_id", "number", "position", "text", "diagnostic")
    bad = known.where("diagnostic not in ('stored_articles')").select("revision_id", "law_id", F.lit(None).cast("string").alias("number"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("text"), "diagnostic")
    return good.unionByName(stored).unionByName(bad)
