"""Query logs and evidence: outcomes, usage, latency, evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.session import spooled


def summarize_outcomes(events: DataFrame) -> DataFrame:
    """P20: id, tool, hits, found, law_id out of each result's JSON (result), by tool; what is not there is null."""
    v = F.try_parse_json("result")
    rows = events.withColumn("__v", v)
    get = lambda p, t: F.try_variant_get("__v", p, t)
    hits = F.when(F.col("tool") == "search", get("$.total", "int")).when(F.col("tool") == "list", get("$.count", "int"))
    return rows.select("id", "tool", hits.alias("hits"), F.when(F.col("tool") == "article", get("$.found", "boolean")).alias("found"), get("$.law_id", "string").alias("law_id"))


def usage(events: DataFrame) -> DataFrame:
    """Tool, calls, errors, zero_hits, missing: usage of events (tool, error, hits, found)."""
    return events.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if((F.col("tool") == "search") & (F.col("hits") == 0)).alias("zero_hits"), F.count_if((F.col("tool") == "article") & ~F.col("found")).alias("missing"),
    )


#: Buckets of a range of values in one pass of a selection, and rows of a state that is broadcast.
BUCKETS, FEW = 4096, 10_000


def selected(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """by, k, value: the k-th least (from 0) value of each group of values (by, value), for wanted (by, k).

    A pass counts the values of a range in BUCKETS buckets of equal width, finds the bucket that holds the rank by running
    sums over these counts, and goes on with the bucket's own least and greatest value; it ends where these are equal. So
    no task holds a group's values, however many they are, and equal ones cost no pass of their own.
    """
    ends = values.groupBy("by").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = spooled(wanted.distinct().join(ends, "by").select("by", "k", "lo", "hi", F.lit(0).cast("long").alias("before")), "ranks")
    while (open_ := state.where("lo < hi")).limit(1).count():
        few = F.broadcast(open_) if open_.limit(FEW + 1).count() <= FEW else open_
        inside = values.join(few, "by").where("value between lo and hi")
        at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        counts = inside.groupBy("by", "k", "before", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("by", "k").orderBy("at"))
        chosen = counts.withColumn("upto", F.col("before") + upto).where("k < upto and k >= upto - n").select("by", "k", "lo", "hi", (F.col("upto") - F.col("n")).alias("before"))
        state = spooled(state.where("lo >= hi").union(chosen), "ranks")
    return state.select("by", "k", F.col("lo").alias("value"))


def latency(events: DataFrame, by: str = "tool") -> DataFrame:
    """By, calls, median, p95 (nearest rank), per_second of events (by, duration_ms, at).

    Calls without a duration count as calls only; the median of an even number is the mean of the middle two.
    """
    span = F.greatest(F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at")), F.lit(1))
    rows = events.select(F.col(by).alias("by"), F.col("duration_ms").cast("double").alias("value"), "at")
    timed = F.col("value").isNotNull() & ~F.isnan("value")
    facts = rows.groupBy("by").agg(F.count(F.lit(1)).alias("calls"), F.count_if(timed).alias("n"), (F.count(F.lit(1)) / span).alias("per_second"))
    facts = spooled(facts, "calls")
    ranks = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.ceil(F.col("n") * 0.95) - 1)
    # null groups are one
    keyed = lambda df: df.withColumn("by", F.coalesce(F.concat(F.lit("+"), F.col("by").cast("string")), F.lit("")))
    wanted = keyed(facts).where("n > 0").select("by", F.explode(F.array_distinct(ranks)).alias("k"))
    found = selected(keyed(rows.where(timed)).select("by", "value"), wanted)
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    per = wanted.select("by").distinct().join(keyed(facts).select("by", "n"), "by").join(found, "by").groupBy("by").agg(
        ((value(F.floor((F.col("n") - 1) / 2)) + value(F.floor(F.col("n") / 2))) / 2).alias("median"), value(F.ceil(F.col("n") * 0.95) - 1).alias("p95")
    )
    out = facts.withColumn("__by", F.coalesce(F.concat(F.lit("+"), F.col("by").cast("string")), F.lit(""))).join(per.withColumnRenamed("by", "__by"), "__by", "left")
    return out.select(F.col("by").alias(by), "calls", "median", "p95", "per_second")


def build_evidence(results: DataFrame, excerpt: int = 120) -> DataFrame:
    """request_id, evidence_id, laws, articles of results (request_id, command, law_id, title, number, text), each once."""
    law = F.struct(F.lit("law").alias("evidence_level"), "law_id", "title")
    article = F.struct(F.lit("article").alias("evidence_level"), "law_id", "number", F.sha2("text", 256).alias("text_hash"), F.substring("text", 1, excerpt).alias("text_excerpt"))
    out = results.groupBy("request_id", "command").agg(F.sort_array(F.collect_set(law)).alias("laws"), F.sort_array(F.collect_set(F.when(F.col("number").isNotNull(), article))).alias("articles"))
    return out.withColumn("evidence_id", F.sha2(F.to_json(F.struct("command", "laws", "articles")), 256))
