"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Every row gets a global number 0..n-1 in the order of its key; a keyed permutation of that range sends the number to a
place, and the place gives the shard (place mod shards) and the slot (place div shards). Shards differ by one row at
most, slots have no gaps, and anyone who knows (n, seed) can compute shard and slot of a row number, or the row number
of a shard and slot, without looking at data.

Plan: rows are dealt to many hash buckets, numbered inside their bucket, and shifted by the sum of the smaller
buckets' counts, so no sort of the whole table and no single task sees all rows. Rows that are equal in every key
column are interchangeable: they are counted once with their multiplicity before the shuffle and expanded afterwards,
CHUNK at a time and in many tasks, so one row repeated over a third of the table fills none. Buckets hold about PER_BUCKET
rows each, however large the table is.

Defined cases: null keys sort first and are rows like any other; an empty table gives an empty result; a table may have
columns named like ours, since only key columns are read and the names given out are new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.llm.common import digest, digest_number, partitions

#: Rows of a bucket, about, which one task sorts; most hex digits of a row's digest that name its bucket (16 million buckets).
PER_BUCKET, MOST_DIGITS = 65536, 6
#: Equal rows that are expanded at once.
CHUNK = 65536
#: Buckets whose counts are given to every task.
MOST_BROADCAST = 1 << 16
ROUNDS = 4
#: Steps of the cycle walk. Fewer than 1 in sqrt(n) steps leaves the range, see `permute`.
WALK = 12


def _half(x: Column, r: Column, seed: int, modulus: Column) -> Column:
    return F.pmod(digest_number(F.lit(seed), r, x), modulus)


def _div(x: Column, by: Column) -> Column:
    return ((x - F.pmod(x, by)) / by).cast("long")


def permute(x: Column, n: Column, seed: int) -> Column:
    """A keyed permutation of 0..n-1 applied to x.

    The domain is the grid a*b, a = ceil(sqrt(n)), b = ceil(n/a), which exceeds n by less than a. Each round adds a
    hash of one coordinate to the other, which is undone by subtracting it, so the grid is permuted. A result outside
    0..n-1 is sent through again until it is inside (cycle walking), which keeps the map one-to-one. The walk leaves
    the range with probability under 1/sqrt(n) per step; should WALK steps not do, the query fails loudly.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(v: Column) -> Column:
        start = F.struct(_div(v, b).alias("l"), F.pmod(v, b).alias("r"))

        def round_(s: Column, r: Column) -> Column:
            return F.when(
                r % 2 == 0, F.struct(F.pmod(s["l"] + _half(s["r"], r, seed, a), a).alias("l"), s["r"].alias("r"))
            ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _half(s["l"], r, seed, b), b).alias("r")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        F.lit(-1).cast("long"),
        lambda v, i: F.when((v >= 0) & (v < n), v).otherwise(once(F.when(i == 1, x).otherwise(v))),
    )
    return F.when(walked < n, walked).otherwise(
        F.raise_error(F.lit("cycle walk too short: raise WALK")).cast("long")
    )


def number_rows(df: DataFrame, keys: list[str], seed: int, digits: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """The key columns of df with `row_number` (0..n-1, reproducible) and `n_rows`.

    Numbers follow the rows' digests, so they do not depend on the number of buckets (16 ** digits).
    """
    if digits is None:
        n, digits = df.count(), 1
        while digits < MOST_DIGITS and n > PER_BUCKET * 16**digits:
            digits += 1
    h = digest(F.lit(seed), *[F.col(k) for k in keys])
    counted = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__times"))
    dealt = counted.withColumn("__h", h).withColumn("__bucket", F.substring("__h", 1, digits))
    # counted from the rows, not from `counted`: the partial sums then need no second shuffle of the keys
    sums = (
        df.select(F.substring(h, 1, digits).alias("__bucket"))
        .groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__in"))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket")  # one row per bucket
    sums = sums.select(
        "__bucket",
        (F.sum("__in").over(before) - F.col("__in")).alias("__start"),
        F.sum("__in").over(Window.partitionBy(F.lit(0))).alias("n_rows"),
    )
    inside = Window.partitionBy("__bucket").orderBy("__h", *keys)
    first = F.sum("__times").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__times")
    placed = dealt.withColumn("__first", first).join(F.broadcast(sums) if 16**digits <= MOST_BROADCAST else sums, "__bucket")
    placed = placed.select(*keys, (F.col("__start") + F.col("__first")).alias("__from"), "__times", "n_rows")
    # rows that are repeated more often go to other tasks chunk by chunk before they are expanded
    often = placed.where(F.col("__times") > chunk).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / chunk))))
    often = often.repartition(partitions(df.sparkSession), "__from", "__k").select(
        *keys, (F.col("__from") + F.col("__k") * chunk).alias("__from"), F.least(F.lit(chunk), F.col("__times") - F.col("__k") * chunk).alias("__times"), "n_rows"
    )
    every = placed.where(F.col("__times") <= chunk).unionByName(often)
    return every.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1))).select(
        *keys, (F.col("__from") + F.col("__k")).alias("row_number"), "n_rows"
    )


def feistel_shards(df: DataFrame, keys: list[str], shards: int, seed: int = 7) -> DataFrame:
    """The key columns of every row of df, with `shard` 0..shards-1 and `slot`, gapless from 0 in each shard."""
    place = permute(F.col("row_number"), F.col("n_rows"), seed)
    return (
        number_rows(df, keys, seed)
        .withColumn("__place", place)
        .select(
            *keys,
            F.pmod(F.col("__place"), F.lit(shards)).cast("int").alias("shard"),
            _div(F.col("__place"), F.lit(shards)).alias("slot"),
        )
    )
