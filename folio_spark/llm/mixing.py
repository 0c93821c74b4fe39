"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The mix is as long as all sources together. Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ...; a
source's target is its share by weight, but `max_repeats` times its own size at most, the excess being shared again by
weight. The mix is a row of slots, each a block of `block_words` words. Slot i takes the golden-ratio point
frac(i * phi), which falls into one source's stretch of the cumulative targets; the r-th slot of a source takes the
r-th block of that source's shuffled stream of words, which starts over when it ends. The points are spread evenly, so
every prefix of the mix is close to the targets, and the same rows give the same mix. A source's last block is cut to
its target, to the word; slots beyond it are void, and what few blocks the points left out come in slots at the end.

Plan: streams are cut into hash buckets, summed per bucket and then inside each; slots are ranked in chunks in the same
way, so neither a source with a third of all rows nor the list of slots is ever one task. Slots and the blocks that each
document touches meet in an equi-join on (source, rank). Only the table of sources, one row each, is sorted as a whole.

Defined cases: null text has no words; documents without words take none; rows with equal ids are told apart by their
size, and equal rows share a place in the stream's order but not their words; an empty table gives an empty result;
other columns of the table are kept by `mix`, whatever their names, and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.llm.common import digest, n_words

PHI = 0.6180339887498949
#: Hex digits that name a bucket of a source's stream (256 of them), slots in a chunk, cells of the cumulative targets.
STREAM_DIGITS, CHUNK, CELLS = 2, 65536, 4096


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source, source_size, weight, target from (source, source_size), one row per source.

    Raising a common level v, a source gets min(max_repeats * size, v * weight). Sorted by the level at which each
    stops growing, the level that shares out everything lies in one stretch, found with running sums. One row per
    source is all that this sorts.
    """
    cap = F.col("source_size") * max_repeats
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.partitionBy(F.lit(0)).orderBy("stop", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    below = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    open_ = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("stop", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum(cap).over(below), F.lit(0))) / F.sum("weight").over(open_),
        )
    )
    # the level is right for the first source that does not stop below it, and all later ones share it
    found = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(every)["level"]
    return levels.withColumn("found", found).select(
        "source",
        "source_size",
        "weight",
        F.least(cap.cast("double"), F.coalesce(F.col("found"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def golden(i: Column) -> Column:
    """frac(i * phi), in two steps so that large i lose no digits."""
    high, low = F.floor(i / 65536).cast("double"), F.pmod(i, F.lit(65536)).cast("double")
    return F.pmod(low * F.lit(PHI) + high * F.lit((65536 * PHI) % 1.0), F.lit(1.0))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """slot, source_no, rank: which source each slot of the mix takes, and which block of it, for targets (numbered_targets)."""
    spark = targets.sparkSession
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    n_slots = -(-int(total) // block_words)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), golden(F.col("id")).alias("x"))
    every, by_no = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("source_no")
    stretches = (
        targets.where("target > 0")
        .withColumn("hi", F.sum("target").over(by_no) / F.sum("target").over(every))
        .withColumn("last", F.col("source_no") == F.max("source_no").over(every))
        .withColumn("lo", F.coalesce(F.lag("hi").over(by_no), F.lit(0.0)))
        .withColumn("hi", F.when(F.col("last"), F.lit(1.0)).otherwise(F.col("hi")))
    )
    cells = stretches.select(
        "source_no",
        "lo",
        "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    dealt = (
        slots.withColumn("cell", F.floor(F.col("x") * CELLS))
        .join(cells, "cell")
        .where("x >= lo and x < hi")
        .select("slot", "source_no", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    )
    counts = dealt.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk")
    counts = counts.withColumn("start", F.sum("n").over(before) - F.col("n"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = dealt.withColumn("__r", F.row_number().over(inside) - 1).join(counts, ["source_no", "chunk"]).select(
        "slot", "source_no", (F.col("start") + F.col("__r")).alias("rank")
    )
    need = targets.select("source_no", F.ceil(F.col("words") / block_words).alias("blocks"))
    had = counts.groupBy("source_no").agg(F.sum("n").alias("had"))
    late = need.join(had, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
    late = late.withColumn("after", F.sum(F.col("blocks") - F.col("had")).over(by_no) - F.col("blocks")).select(
        "source_no", "after", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("rank")
    )
    late = late.select((F.lit(n_slots) + F.col("after") + F.col("rank")).alias("slot"), "source_no", "rank")
    return ranked.join(need, "source_no").where("rank < blocks").select("slot", "source_no", "rank").union(late)


def streams(docs: DataFrame, seed: int) -> DataFrame:
    """docs (doc_id, source_no, size) with `start`: the words before each document in its source's shuffled stream.

    (source_no, `bucket`, `place`) names a row.
    """
    h = digest(F.lit(seed), F.col("doc_id"), F.col("size"))
    keyed = docs.withColumn("__h", h).withColumn("bucket", F.substring("__h", 1, STREAM_DIGITS))
    sums = keyed.groupBy("source_no", "bucket").agg(F.sum("size").alias("__in"))
    before = Window.partitionBy("source_no").orderBy("bucket")
    sums = sums.select("source_no", "bucket", (F.sum("__in").over(before) - F.col("__in")).alias("__base"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum("size").over(inside) - F.col("size")
    placed = keyed.withColumn("__own", own).withColumn("place", F.count(F.lit(1)).over(inside)).join(sums, ["source_no", "bucket"])
    return placed.withColumn("start", F.col("__base") + F.col("__own")).drop("__h", "__own", "__base")


def numbered_targets(docs: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source_targets of docs (source, size), with source_no in the order of names, and words: the target in whole words."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    words = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_repeats)
    return source_targets(sizes, max_repeats).withColumn("source_no", F.row_number().over(by_name) - 1).withColumn("words", words)


def _pieces(docs: DataFrame, targets: DataFrame, block_words: int, max_repeats: int, seed: int) -> DataFrame:
    """docs with source_no, source_size, target, bucket, place, start, round, rank, lo, hi: the stretch of words (of the
    endless stream) that each block of the mix has of a document; a document without any has one row of nulls."""
    plan = targets.select("source", "source_no", "source_size", "target", "words")
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan
    placed = streams(docs.join(plan, docs["source"].eqNullSafe(plan["source"])).drop(plan["source"]), seed)
    rounds = F.filter(
        F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda r: (F.col("size") > 0) & (F.col("start") + r * F.col("source_size") < F.col("words"))
    )
    turns = placed.withColumn("round", F.explode_outer(rounds)).withColumn("at", F.col("start") + F.col("round") * F.col("source_size"))
    end = F.least(F.col("at") + F.col("size"), F.col("words"))
    ranks = F.sequence(F.floor(F.col("at") / block_words), F.floor((end - 1) / block_words))
    cut = turns.withColumn("rank", F.explode_outer(ranks))
    lo = F.greatest(F.col("at"), F.col("rank") * block_words)
    return cut.withColumn("lo", lo).withColumn("hi", F.least(end, (F.col("rank") + 1) * block_words))


def mix(docs: DataFrame, block_words: int = 128, max_repeats: int = 3, seed: int = 11) -> DataFrame:
    """What the mix takes of each document of docs (doc_id, source, size, any others).

    Returns docs' columns with source_size, target, start (in the source's stream), taken: words that the blocks of the
    mix have of the document, repeats counted. Keep docs narrow: its columns go through the join of blocks.
    """
    targets = numbered_targets(docs, max_repeats)
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "size")}
    plain = docs.select("doc_id", "source", "size", *[F.col(c).alias(n) for c, n in names.items()])
    pieces = _pieces(plain, targets, block_words, max_repeats, seed)
    slots = schedule(targets, block_words)
    joined = pieces.join(slots, ["source_no", "rank"], "left")
    own = ["doc_id", "source", "size", *names.values(), "source_size", "target", "start"]
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("hi") - F.col("lo")).otherwise(0)).alias("taken")
    found = joined.groupBy("source_no", "bucket", "place").agg(*[F.first(c).alias(c) for c in own], taken)
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return found.select(*back, *[c for c in ("source_size", "target", "start", "taken") if c not in docs.columns])


def sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mix_blocks(docs: DataFrame, block_words: int = 128, max_repeats: int = 3, seed: int = 11) -> DataFrame:
    """The mix itself: slot, doc_id, first_word, n_words, round: the stretch of a document that a slot holds.

    The slots' ranks are joined with the blocks that each document's stretch of its stream touches. Equi-join on
    (source, rank), so its rows are the blocks' pieces and nothing more.
    """
    targets = numbered_targets(docs, max_repeats)
    pieces = _pieces(docs.select("doc_id", "source", "size"), targets, block_words, max_repeats, seed).where("rank is not null")
    return pieces.join(schedule(targets, block_words), ["source_no", "rank"]).select(
        "slot", "doc_id", "round", (F.col("lo") - F.col("at")).alias("first_word"), (F.col("hi") - F.col("lo")).alias("n_words")
    )
