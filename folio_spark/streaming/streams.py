"""Streams: incremental ingest, sync windows, usage windows, evidence, change log.

State is Spark's: checkpoints hold source offsets, watermarks bound what is kept. Sinks write a batch under its number,
so that a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folio_spark.operators.versions import diff_documents
from folio_spark.sources.readers import EVIDENCE
from folio_spark.session import spooled
from folio_spark.sources.store import plan_refresh


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def latest(spark: SparkSession, target: str, key: str = "law_id") -> DataFrame:
    """The state of a target that batches were written to: the last row of each key."""
    rows = spark.read.parquet(target)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch_id").alias("x"))
    return last.select(key, "x.*")


#: Parts that the state of an ingest is kept in; a batch reads and writes those that its rows fall into.
PARTS = 64
HASHES = ("content_hash", "metadata_hash", "text_hash")


def _state(spark: SparkSession, path: str, parts: list[int], number: int, shape: str) -> DataFrame:
    """The state of some parts as it was before a batch: of each part the last file that an earlier batch wrote."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for part in parts:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        fs = folder.getFileSystem(hadoop)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        before = [n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if n < number]
        if before:
            found.append(f"{path}/part={part}/batch={max(before)}")
    return spark.read.schema(shape).parquet(*found) if found else spark.createDataFrame([], shape)


def stream_ingest(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each batch is compared with the state; what is new or changed is written under the batch's number.

    source: law_id, content_hash, metadata_hash, text_hash, any others. A batch that is run again after a failure
    overwrites its own rows, and a batch never reads its own, so the result is the same. The state, a row of hashes a law,
    is kept beside the target in PARTS parts by law, and a batch reads and writes only the parts of its laws.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["law_id", *HASHES])
        fresh = fresh.groupBy("law_id").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "law_id"]), "seq").alias("x")).select("law_id", "x.*")
        fresh = spooled(fresh.withColumn("__part", F.pmod(F.xxhash64("law_id"), F.lit(PARTS)).cast("int")), "ingest-batch")
        parts = [r["__part"] for r in fresh.select("__part").distinct().collect()]  # PARTS at most
        shape = f"law_id {fresh.schema['law_id'].dataType.simpleString()}, " + ", ".join(f"{c} string" for c in HASHES)
        state = _state(spark, f"{target}-state", parts, number, shape)
        plain = fresh.drop("__part")
        action = spooled(plan_refresh(state, plain).where("action <> 'keep'"), "ingest-action")
        plain.join(action, "law_id").write.mode("overwrite").parquet(f"{target}/batch_id={number}")
        new = fresh.select("law_id", *HASHES).unionByName(state.join(fresh.select("law_id"), "law_id", "left_anti"))
        new = new.withColumns({"part": F.pmod(F.xxhash64("law_id"), F.lit(PARTS)).cast("int"), "batch": F.lit(number)})
        out = new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("part", "batch").parquet(f"{target}-state")

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_window(states: DataFrame, overlap_days: int) -> DataFrame:
    """Source, from_date, to_date of the next sync: an unfinished window again, else from the last end less an overlap.

    states: source, last_end, open_from, open_to (null unless unfinished), today.
    """
    open_ = F.col("open_to").isNotNull()
    return states.select("source", F.when(open_, F.col("open_from")).otherwise(F.date_sub("last_end", overlap_days)).alias("from_date"), F.when(open_, F.col("open_to")).otherwise(F.col("today")).alias("to_date"))


def usage_windows(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """window_start, tool, calls, errors, zero_hits, p95 per window and tool; rows later than the delay are dropped.

    events: at, tool, error, hits, duration_ms. Works on streams and on tables.
    """
    grouped = events.withWatermark("at", delay).groupBy(F.window("at", width), "tool")
    out = grouped.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("hits") == 0).alias("zero_hits"), F.percentile_approx("duration_ms", 0.95, 10000).alias("p95"))
    return out.select(F.col("window.start").alias("window_start"), "tool", "calls", "errors", "zero_hits", "p95")


def stream_usage(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """X4 as a job: closed windows are appended to a table."""
    return usage_windows(events).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def evidence_rows(lines: DataFrame, delay: str = "1 day") -> DataFrame:
    """Evidence lines (value) with ids from their content; broken lines go, repeated ones within the delay too."""
    parsed = lines.select(F.from_json("value", EVIDENCE).alias("e"), "value").where("e is not null and (e.laws is not null or e.articles is not null or e.command is not null)")
    rows = parsed.select("e.*", F.sha2("value", 256).alias("content_id"), F.to_timestamp("e.timestamp").alias("at"))
    return rows.withColumn("evidence_id", F.coalesce("evidence_id", "content_id")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["evidence_id"])


def stream_evidence(lines: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return evidence_rows(lines).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_rows(before: DataFrame, after: DataFrame, fields_before: DataFrame, fields_after: DataFrame, number: int) -> DataFrame:
    """Rows for the change log: law_id, item, change, batch_id."""
    return diff_documents(before, after, fields_before, fields_after).withColumn("batch_id", F.lit(number).cast("long"))


def stream_changes(articles: DataFrame, state: str, log: str, checkpoint: str) -> StreamingQuery:
    """X6 as a job: each batch of whole documents (law_id, number, position, text) is compared with what came before."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("law_id", "number", "position", "text")
        path = spark._jvm.org.apache.hadoop.fs.Path(state)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            rows = spark.read.parquet(state).where(F.col("batch_id") < number).join(new.select("law_id").distinct(), "law_id", "left_semi")
            last = rows.groupBy("law_id").agg(F.max("batch_id").alias("batch_id"))
            old = rows.join(last, ["law_id", "batch_id"]).drop("batch_id")
        else:
            old = new.limit(0)
        fields = lambda d: d.groupBy("law_id").agg(F.count(F.lit(1)).alias("articles"))
        change_rows(old, new, fields(old), fields(new), number).drop("batch_id").write.mode("overwrite").parquet(f"{log}/batch_id={number}")
        new.write.mode("overwrite").parquet(f"{state}/batch_id={number}")

    return articles.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def valid_reviews(reviews: DataFrame, current: DataFrame) -> DataFrame:
    """law_id, reviewed: a review holds while the content's fingerprint is the one that was reviewed."""
    marks = reviews.select("law_id", F.col("fingerprint").alias("seen"))
    return current.join(marks, "law_id", "left").groupBy("law_id").agg(F.coalesce(F.bool_or(F.col("seen") == F.col("fingerprint")), F.lit(False)).alias("reviewed"))
