"""Merkle manifests of datasets: a tree per source over its rows, a tree over the sources' roots, proofs for every row.

A row's leaf digest takes its columns' values. In each source the leaves are numbered in order; ARITY neighbours at a time
become one node of the next level. Every level is a table of (group, idx), and nodes meet their siblings by equi-joins
with computed indices (idx XOR 1 where the arity is two, the other slots of the run otherwise); the rows of slot zero,
which then hold their whole run, emit the parents. All sources climb together, so a source with a third of all rows is
no task of its own. Down the levels, each node hands its path, the siblings from there to the root, to its children.

Plan: rows are numbered by a range-partitioned sort and counts per partition, never in one window. Texts are read once;
from then on rows are digests. A level whose nodes take BROADCAST bytes at most (counted, not guessed) is broadcast to
its join, a larger one is shuffled by (group, idx), which spreads evenly. Levels are tables in the shared folder.

Defined cases: nulls in any column are the mark `-`, so a null text and an empty one differ; a null doc_id comes first
and is never tampered with; rows with equal ids are ordered by leaf, equal rows have places of their own and any of them
may have any of these; a null source is a source of its own and the first; a source of one row has its leaf as root; an
empty table has no root and gives an empty result; texts of any length are one value; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from folio_spark.llm.common import partitions, spool

ARITY = 3
#: Bytes of a table of nodes that is broadcast, and the bytes that a node and a step of a path take.
BROADCAST, NODE_BYTES, STEP_BYTES = 8 << 20, 120, 160
#: Nodes in a file of a small level.
FILE_NODES = 65536
#: Levels of a tree of arity two over 2^63 rows.
MOST_LEVELS = 63


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(text: Column) -> Column:
    """SHA-256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf(*values: Column) -> Column:
    """The digest of a row's values: `-` for null, else the UTF-8 byte count, `:` and the value."""
    own = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in own]))


def group_key(name: Column) -> Column:
    """A key that is never null and sorts null first, then names by their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("+"), name), F.lit(""))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `idx`, their place in their group by `order` (nulls first, from 0), and `n`, the group's rows.

    Rows are sorted over ranges of (group, order), so no group is one task; equal rows are spread as well. A range keeps
    one line of counts for each group in it.
    """
    keys = [group, *order]
    asc = [F.col(c).asc_nulls_first() for c in [*keys, "__tie"]]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *asc)
    placed = spool(dealt.sortWithinPartitions(*asc).drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__in"), F.min("__at").alias("__first"))
    before = Window.partitionBy(group).orderBy("__part")
    counts = counts.select(
        group,
        "__part",
        (F.sum("__in").over(before) - F.col("__in") - F.col("__first")).alias("__shift"),
        F.sum("__in").over(Window.partitionBy(group)).alias("n"),
    )
    found = placed.join(counts, [group, "__part"])
    return found.withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _above(n: Column, arity: int, level: int) -> Column:
    """The nodes of a group of n leaves at a level."""
    return F.ceil(n / F.lit(arity**level)) if arity**level < 1 << 53 else F.lit(1).cast("long")


def siblings(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """nodes (g, idx, digest, any others) with `before` and `after`: the digests of the run's other nodes, left and right."""
    slot, first = F.col("idx") % arity, F.col("idx") - F.col("idx") % arity
    met = nodes
    for k in range(1, arity):
        theirs = nodes.select(F.col("g").alias("__g"), F.col("idx").alias("__i"), F.col("digest").alias(f"__d{k}"))
        theirs = F.broadcast(theirs) if small else theirs
        wanted = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else first + (slot + k) % arity
        met = met.join(theirs, (F.col("g") == F.col("__g")) & (wanted == F.col("__i")), "left").drop("__g", "__i")
    empty = F.lit(b"")
    at_slot = [empty for _ in range(arity)]
    for t in range(arity):
        for k in range(1, arity):
            at_slot[t] = F.when((slot + k) % arity == t, F.coalesce(f"__d{k}", empty)).otherwise(at_slot[t])
    before = F.concat(*[F.when(slot > t, at_slot[t]).otherwise(empty) for t in range(arity)])
    after = F.concat(*[F.when(slot < t, at_slot[t]).otherwise(empty) for t in range(arity)])
    return met.withColumns({"before": before, "after": after}).drop(*[f"__d{k}" for k in range(1, arity)])


@dataclass
class Forest:
    """Trees of all groups: levels[l] holds (g, idx, n, digest, before, after) of the level's nodes that have a parent."""

    levels: list[DataFrame]
    #: Nodes of each level in all groups.
    counts: list[int]
    #: g, digest, height: the root of each group and the level that it is on.
    roots: DataFrame
    arity: int


def climb(leaves: DataFrame, arity: int = ARITY) -> Forest:
    """The trees over leaves (g, idx, n, digest, any others, which level 0 keeps)."""
    every = [_above(F.col("n"), arity, k) for k in range(MOST_LEVELS)]
    sizes = leaves.where("idx = 0").select("n").agg(*[F.sum(F.when(x > 1, x)).alias(f"l{k}") for k, x in enumerate(every)]).first()
    counts = [x for x in sizes if x]
    roots = leaves.where("n = 1").select("g", "digest", F.lit(0).alias("height"))
    levels, nodes = [], leaves.where("n > 1")
    for k, count in enumerate(counts):
        small = count * NODE_BYTES <= BROADCAST
        met = siblings(nodes, arity, small)
        levels.append(spool(met.coalesce(-(-count // FILE_NODES)) if small else met, f"level{k}"))
        whole = levels[-1].where(F.col("idx") % arity == 0)
        nodes = whole.select(
            "g",
            (F.col("idx") / arity).cast("long").alias("idx"),
            F.ceil(F.col("n") / arity).alias("n"),
            digest(F.concat(hexed(F.col("digest")), hexed(F.col("after")))).alias("digest"),
        )
        roots = roots.union(nodes.where("n = 1").select("g", "digest", F.lit(k + 1).alias("height")))
        nodes = nodes.where("n > 1")
    return Forest(levels, counts, roots, arity)


def paths(forest: Forest, tops: DataFrame, top_steps: int) -> DataFrame:
    """The leaves (level 0 as it is, and lone ones as g, idx) with `path`, the steps (before, after) up to the root of all, and `subroot`.

    tops (g, height, subroot, path) has what follows each group's root, top_steps steps at most.
    """
    lower = tops.select("g", F.lit(0).cast("long").alias("idx"), "subroot", "path", "height")
    n, above = len(forest.levels), None
    for k in range(n - 1, -1, -1):
        ended = lower.where(F.col("height") == k + 1).drop("height")
        parents = ended if above is None else above.select("g", "idx", "subroot", "path").union(ended)
        count = forest.counts[k + 1] if k + 1 < n else 0
        small = (count + forest.counts[k] // 2) * ((n - k + top_steps) * STEP_BYTES + NODE_BYTES) <= BROADCAST
        parents = parents.select(F.col("g").alias("__g"), F.col("idx").alias("__i"), "subroot", F.col("path").alias("__path"))
        parents = F.broadcast(parents) if small else parents
        own = F.array(F.struct("before", "after"))
        up = (F.col("g") == F.col("__g")) & ((F.col("idx") / forest.arity).cast("long") == F.col("__i"))
        above = forest.levels[k].join(parents, up).withColumn("path", F.concat(own, "__path")).drop("__g", "__i", "__path", "before", "after")
    return above


def folded(start: Column, path: Column) -> Column:
    """The root (hex) that a leaf's digest and its path lead to."""
    return F.aggregate(path, hexed(start), lambda d, s: F.sha2(F.concat(hexed(s["before"]), d, hexed(s["after"])).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 (hex) of the siblings on a path, level by level, left to right."""
    steps = F.transform(path, lambda s: F.concat(hexed(s["before"]), hexed(s["after"])))
    return F.sha2(F.array_join(steps, "").cast("binary"), 256)


@dataclass
class Manifest:
    """Digests of a dataset: `root` (hex), `sources` (source, n_rows, subroot), and `proofs` of every row.

    proofs: doc_id, leaf, tampered (digests), subroot, path.
    """

    root: str | None
    sources: DataFrame
    proofs: DataFrame


def build(rows: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of rows (doc_id, source, leaf, any others, which proofs keep)."""
    keyed = spool(rows.withColumn("g", group_key(F.col("source"))), "leaves")
    # a leaf's place ends with its digest, so rows of one id have an order
    leaves = spool(numbered(keyed.withColumnRenamed("leaf", "digest"), "g", ["doc_id", "digest"]), "placed")
    forest = climb(leaves, arity)
    roots = spool(forest.roots, "roots")
    named = leaves.where("idx = 0").select("g", "source", F.col("n").alias("n_rows")).join(roots, "g")
    # the sources' roots are the leaves of one more tree
    one = numbered(roots.withColumnRenamed("g", "name").withColumn("g", F.lit("")), "g", ["name"])
    upper = climb(spool(one, "sources"), arity)
    top = upper.roots.first()
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    end = upper.roots.select("g", "height", F.col("digest").alias("subroot"), none.alias("path"))
    over = paths(upper, end, 0) if upper.levels else spool(one, "alone").withColumn("path", none)
    tops = spool(over.select(F.col("name").alias("g"), "height", F.col("digest").alias("subroot"), "path"), "tops")
    lone = leaves.where("n = 1").join(tops.select("g", "subroot", "path"), "g")
    kept = [c for c in rows.columns if c != "leaf"]
    found = lone.select(*kept, F.col("digest").alias("leaf"), "subroot", "path")
    if forest.levels:
        found = paths(forest, tops, len(upper.levels)).select(*kept, F.col("digest").alias("leaf"), "subroot", "path").union(found)
    root = top["digest"].hex() if top else None
    return Manifest(root, named.select("source", "n_rows", hexed(F.col("digest")).alias("subroot")), found)


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered of docs (doc_id, source, lang, n_chars, text).

    tampered is the leaf of the row without its text's line feeds where 2 divides the id's crc32, else the leaf.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.when(crc % 2 == 0, leaf(*cols, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    own = leaf(*cols, F.col("text"))
    return docs.select("doc_id", "source", own.alias("leaf"), F.coalesce(other, own).alias("tampered"))


def verify(manifest: Manifest, column: str = "tampered") -> DataFrame:
    """proofs with proof_sha256, folded_root (from the digest in `column` and the row's path) and verified."""
    root = F.lit(manifest.root).cast("string")
    back = folded(F.col(column), F.col("path"))
    found = manifest.proofs.withColumns({"root": root, "proof_sha256": proof_digest(F.col("path")), "folded_root": back})
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
