"""Sync of landed list pages with resumable progress, a stable-page counter and stop rules (X3), all sources at once.

A run goes on where the last one stopped. A source's pages are taken in order until `max_pages` of them are done, a
page is missing, or `stable_after` pages in a row held nothing new. A run's rows and its progress are one folder that gets
its name when both are complete, so a run that fails leaves nothing, and one that is repeated starts from the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio_spark.session import exists, finish, spooled

PROGRESS = "source string, start_page long, next_page long, pages_synced long, rows_seen long, laws_loaded long, laws_skipped long, metadata_refreshed long, stable_pages_seen long, last_changed_page long, stop_reason string"


@dataclass(frozen=True)
class Rules:
    """When a source's run stops: after so many pages, after so many unchanged ones in a row (or never); where it begins."""

    max_pages: int | None = None
    stable_after: int | None = None
    start_page: int = 1
    resume: bool = True

    def __post_init__(self) -> None:
        if any(x is not None and x < 1 for x in (self.max_pages, self.stable_after, self.start_page)):
            raise ValueError("pages are counted from 1")


def changes(pages: DataFrame, state: DataFrame) -> DataFrame:
    """pages (source, page, position, law_id, content_hash, metadata_hash) with change: load, refresh (metadata only) or skip.

    A row is held against the last one of its law before it, in earlier pages of the run or else in state (source, law_id,
    content_hash, metadata_hash). Rows without an id have no change.
    """
    # rows without an id are no group
    by = Window.partitionBy("source", "law_id", F.when(F.col("law_id").isNull(), F.col("page"))).orderBy("page", "position")
    known = state.select("source", "law_id", F.struct("content_hash", "metadata_hash").alias("__known"))
    rows = pages.withColumn("__before", F.lag(F.struct("content_hash", "metadata_hash")).over(by)).join(known, ["source", "law_id"], "left")
    last = F.coalesce("__before", "__known")
    same = lambda c: F.col(c).eqNullSafe(last[c])
    change = F.when(F.col("law_id").isNull(), None).when(last.isNull() | ~same("content_hash"), "load").when(~same("metadata_hash"), "refresh").otherwise("skip")
    return rows.withColumn("change", change).drop("__before", "__known")


def taken_pages(rows: DataFrame, progress: DataFrame, rules: Rules) -> DataFrame:
    """source, page, facts of each page of rows (changes) that a run takes, with stable, nth, and `stop` on the last one.

    progress: source, next_page, stable_pages_seen. Windows are over pages, one row each, not over their rows.
    """
    count = lambda c: F.count_if(F.col("change") == c)
    facts = rows.groupBy("source", "page").agg(
        F.count("law_id").alias("rows"), count("load").alias("loaded"), count("skip").alias("skipped"), count("refresh").alias("refreshed"),
    )
    start = progress.select("source", "next_page", "stable_pages_seen")
    facts = facts.join(start, "source", "left").withColumn("first", F.coalesce("next_page", F.lit(rules.start_page)) if rules.resume else F.lit(rules.start_page))
    facts = facts.withColumn("seen", F.coalesce("stable_pages_seen", F.lit(0)) if rules.resume else F.lit(0)).where("page >= first").drop("next_page", "stable_pages_seen")
    order = Window.partitionBy("source").orderBy("page")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    facts = facts.withColumn("nth", F.row_number().over(order)).where("page = first + nth - 1")  # up to the first gap
    last = F.max(F.when(F.col("loaded") > 0, F.col("nth"))).over(upto)
    facts = facts.withColumn("changed_at", last).withColumn("stable", F.when(last.isNull(), F.col("seen") + F.col("nth")).otherwise(F.col("nth") - last))
    stop = F.lit(None).cast("string")
    if rules.max_pages is not None:
        stop = F.when(F.col("nth") == rules.max_pages, "max_pages")
    if rules.stable_after is not None:  # the rule that is looked at first after a page
        stop = F.when((F.col("loaded") == 0) & (F.col("stable") >= rules.stable_after), "stable_pages").otherwise(stop)
    facts = facts.withColumn("stop", stop)
    ends = F.coalesce(F.min(F.when(F.col("stop").isNotNull(), F.col("nth"))).over(Window.partitionBy("source")), F.col("nth"))
    return facts.withColumn("__ends", ends).where("nth <= __ends").drop("__ends")


def report(taken: DataFrame, sources: DataFrame, progress: DataFrame, rules: Rules) -> DataFrame:
    """PROGRESS of each of sources after its taken pages; a source without a further page stops for want of rows."""
    per = taken.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages_synced"), F.sum("rows").alias("rows_seen"), F.sum("loaded").alias("laws_loaded"), F.sum("skipped").alias("laws_skipped"),
        F.sum("refreshed").alias("metadata_refreshed"), F.max_by("stable", "nth").alias("stable"), F.max(F.when(F.col("loaded") > 0, F.col("page"))).alias("changed"), F.max("stop").alias("stop"),
    )
    before = progress.select("source", F.col("next_page").alias("__next"), F.col("stable_pages_seen").alias("__stable"), F.col("last_changed_page").alias("__changed"))
    rows = sources.select("source").distinct().join(per, "source", "left").join(before, "source", "left")
    start = F.coalesce("__next", F.lit(rules.start_page)) if rules.resume else F.lit(rules.start_page)
    stable = F.coalesce("__stable", F.lit(0)) if rules.resume else F.lit(0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = [zero(c) for c in ("pages_synced", "rows_seen", "laws_loaded", "laws_skipped", "metadata_refreshed")]
    return rows.select(
        "source", start.cast("long").alias("start_page"), (start + F.coalesce("pages_synced", F.lit(0))).cast("long").alias("next_page"), *counts,
        F.coalesce("stable", stable).cast("long").alias("stable_pages_seen"), F.coalesce("changed", "__changed").cast("long").alias("last_changed_page"), F.coalesce("stop", F.lit("no_rows")).alias("stop_reason"),
    )


def _runs(spark: SparkSession, store: str) -> int:
    """How many runs are complete; they are numbered without a gap."""
    n = 0
    while exists(spark, f"{store}/run-{n}/done"):
        n += 1
    return n


def progress_of(spark: SparkSession, store: str) -> DataFrame:
    """What the last complete run left behind, a row a source (none before the first)."""
    n = _runs(spark, store)
    return spark.read.schema(PROGRESS).parquet(f"{store}/run-{n - 1}/progress") if n else spark.createDataFrame([], PROGRESS)


def state_of(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """source, law_id (of a type), content_hash, metadata_hash: the last of each law that complete runs took."""
    shape = f"source string, law_id {kind}, content_hash string, metadata_hash string"
    n = _runs(spark, store)
    return spark.read.schema(shape).parquet(f"{store}/run-{n - 1}/state") if n else spark.createDataFrame([], shape)


def sync(pages: DataFrame, store: str, rules: Rules) -> DataFrame:
    """One run over landed pages (source, page, position, law_id, content_hash, metadata_hash); its PROGRESS rows.

    Pages of equal numbers are one page. The state of all laws, compacted, and the progress of all sources are written
    with the run, which is there as a whole or not at all.
    """
    spark = pages.sparkSession
    number, progress = _runs(spark, store), progress_of(spark, store)
    state = state_of(spark, store, pages.schema["law_id"].dataType.simpleString())
    start = F.coalesce("next_page", F.lit(rules.start_page)) if rules.resume else F.lit(rules.start_page)
    ahead = pages.select("source", "page", "position", "law_id", "content_hash", "metadata_hash").join(progress.select("source", "next_page"), "source", "left").where(F.col("page") >= start).drop("next_page")
    rows = spooled(changes(ahead, state), "sync-rows")
    taken = spooled(taken_pages(rows, progress, rules), "sync-pages")
    part = f"{store}/part-{number}"
    new = rows.where("law_id is not null").join(taken.select("source", "page"), ["source", "page"], "left_semi")
    both = new.select("source", "law_id", F.struct(F.lit(1).alias("new"), "page", "position").alias("at"), "content_hash", "metadata_hash")
    both = both.unionByName(state.select("source", "law_id", F.struct(F.lit(0).alias("new"), F.lit(0).cast(pages.schema["page"].dataType).alias("page"), F.lit(0).cast(pages.schema["position"].dataType).alias("position")).alias("at"), "content_hash", "metadata_hash"))
    latest = both.groupBy("source", "law_id").agg(F.max_by(F.struct("content_hash", "metadata_hash"), "at").alias("x")).select("source", "law_id", "x.*")
    latest.write.mode("overwrite").parquet(f"{part}/state")
    new.where("change <> 'skip'").select("source", "law_id", "page", "position", "change").write.mode("overwrite").parquet(f"{part}/rows")
    sources = pages.select("source").union(progress.select("source"))
    report(taken, sources, progress, rules).write.mode("overwrite").parquet(f"{part}/progress")
    if not finish(spark, part, f"{store}/run-{number}"):
        raise RuntimeError(f"run {number} of {store} was written by another job")
    return spark.read.schema(PROGRESS).parquet(f"{store}/run-{number}/progress")
