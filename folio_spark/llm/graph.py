"""Connected components as DataFrame rounds: alternating large and small stars, lineage cut in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.common import spool

#: Edges of a graph that one task joins up: some 2 MB.
FEW = 1 << 17


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (u, v): root is the smallest node that can be reached. Loops are dropped.

    Each round takes minima per node with partial sums and joins them back, so a node with very many links is only a
    skewed join, which Spark can split. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = spool(
        links.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = spool(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    # at rest, every edge is a node and its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the smallest node that it can reach."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)  # a root is hooked to the least root that an edge leads to
        np.minimum.at(new, root[b], low)
        while (further := new[new] != new).any():
            new = np.where(further, new[new], new)
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components_of_numbers(links: DataFrame) -> DataFrame:
    """components() of links between longs: a graph of FEW edges at most is joined up in one task, a larger one in rounds.

    Both give the same rows. Rounds over many small files cost more than a small graph is worth.
    """
    edges = spool(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if edges.limit(FEW + 1).count() > FEW:
        return components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, roots = joined_up(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.record_batch([pa.array(nodes), pa.array(roots)], ["node", "root"])

    return spool(edges.coalesce(1).mapInArrow(run, "node long, root long"), "roots")
