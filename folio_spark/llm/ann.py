"""Approximate nearest neighbours over learned partitions, by cosine.

Fitting, on a sample of at most SAMPLE vectors (those with the least digests of their ids): the sample's neighbour graph
is cut into parts of nearly equal size, by balanced moves that keep neighbours together; a small softmax classifier
then learns the part of a vector, with an offset for each part that keeps the parts that it deals rows to near equal. A
fifth of the sample is not fitted on: it asks for its neighbours among the rest, and the number of parts that a query is
sent to is the least that finds TARGET of them. So the same rule holds for tables of any size, clustered or not.
Indexing routes every vector to its most probable part. All vectors of a query's parts are ranked by the exact cosine.

Plan: parts are cut into blocks of at most BLOCK vectors by a hash, queries of a part into chunks of at most ASKED; every
pair of a block and a chunk of a part is one group, so a part that holds a third of all rows is many groups. Each gives k
rows a query, of which a window keeps the nearest. Work is queries times the vectors of the probed parts.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of each length
are searched among themselves; equal scores go to the smaller vec_id; with fewer candidates than k all are returned; a
repeated row is asked once, and each of its copies but one is a candidate; rows with equal ids and different vectors are
asked each; components are scaled by a power of two first, so that no size overflows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.llm.common import digest, partitions, spool

SAMPLE, BLOCK, ASKED = 8192, 8192, 4096
#: Fitted vectors in a part, about; with SAMPLE this bounds the number of parts.
PER_PART = 32
#: Share of the neighbours that the number of probed parts has to find for vectors that were not fitted on.
TARGET = 0.93
NEIGHBOURS = 10


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def neighbour_graph(unit: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest other rows of each row of unit vectors, in blocks of rows."""
    out = np.empty((len(unit), k), np.int32)
    for at in range(0, len(unit), 1024):
        near = unit[at : at + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        out[at : at + 1024] = np.argpartition(-near, k, axis=1)[:, :k]
    return out


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 20, slack: float = 0.05) -> np.ndarray:
    """A part for each row: neighbours together, no part larger than its share and a slack.

    Starts with capacity-bound nearest seeds, then moves rows to the part that most of their neighbours, either way of
    the edge, are in, best gains first, as long as the part has room.
    """
    n = len(unit)
    most = int(np.ceil(n / parts * (1 + slack)))
    chance = np.random.default_rng(7)
    seeds = unit[chance.choice(n, parts, replace=False)]
    for _ in range(8):
        affinity = unit @ seeds.T
        part = _fill(affinity, most)
        seeds = np.stack([unit[part == p].sum(axis=0) if (part == p).any() else seeds[p] for p in range(parts)])
        seeds /= np.maximum(np.linalg.norm(seeds, axis=1, keepdims=True), 1e-12)
    rows = np.repeat(np.arange(n), graph.shape[1])
    ends = graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (rows, part[ends]), 1)
        np.add.at(votes, (ends, part[rows]), 1)
        after = _fill(votes + 0.5 * np.eye(parts)[part], most)
        if (after == part).all():
            break
        part = after
    return part


def _fill(affinity: np.ndarray, most: int) -> np.ndarray:
    """Each row to its best part that has room, the rows with most to lose first."""
    order = np.argsort(-affinity, axis=1, kind="stable")
    best = np.take_along_axis(affinity, order[:, :2], axis=1)
    first = np.argsort(best[:, 1] - best[:, 0], kind="stable") if affinity.shape[1] > 1 else np.arange(len(affinity))
    room, out = np.full(affinity.shape[1], most), np.empty(len(affinity), np.int64)
    for i in first:
        for p in order[i]:
            if room[p]:
                room[p] -= 1
                out[i] = p
                break
    return out


def fit_router(unit: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, steps: int = 300) -> np.ndarray:
    """Softmax weights (dimension + 1, parts) by Adam over the whole sample.

    The target of a vector is where its neighbours are, and itself: that is what a query needs to find.
    """
    x = np.column_stack([unit * np.sqrt(unit.shape[1]), np.ones(len(unit))])
    w, m, v = np.zeros((x.shape[1], parts)), 0.0, 0.0
    target = 0.3 * np.eye(parts)[part] + 0.7 * np.eye(parts)[part[graph]].mean(axis=1)
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - target) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


class Router:
    """Scores of parts for unit vectors, and how many of the best parts a query needs."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.offsets, self.probes = weights, np.zeros(weights.shape[1]), weights.shape[1]

    def order(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The `most` most probable parts of each vector."""
        z = unit * np.sqrt(unit.shape[1]) @ self.weights[:-1] + self.weights[-1] + self.offsets
        return np.argsort(-z, axis=1, kind="stable")[:, :most].astype(np.int32)

    def balance(self, unit: np.ndarray, rounds: int = 200) -> None:
        """Offsets with which the best parts of the vectors are near equal in size."""
        for _ in range(rounds):
            sizes = np.bincount(self.order(unit, 1)[:, 0], minlength=len(self.offsets)) + 1
            self.offsets -= 0.1 * np.log(sizes / sizes.mean())

    def calibrate(self, unit: np.ndarray, asked: np.ndarray, k: int, target: float) -> None:
        """The least number of probes with which `asked` find `target` of their k nearest vectors of unit."""
        near = asked @ unit.T
        k = min(k, len(unit))
        homes = self.order(unit, 1)[:, 0][np.argpartition(-near, k - 1, axis=1)[:, :k]]
        order = self.order(asked, len(self.offsets))
        ranks = np.argmax(order[:, None, :] == homes[:, :, None], axis=2)
        found = np.array([(ranks < n).mean() for n in range(1, len(self.offsets) + 1)])
        self.probes = int(np.argmax(found >= target)) + 1


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors by powers of two, so that the largest component is near one; this rounds nothing."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def fit(vectors: DataFrame, sample: int = SAMPLE, per_part: int = PER_PART, k: int = 5, target: float = TARGET) -> Router | None:
    """The router of vectors (vec_id, vector), usable ones of one length; None where there are none."""
    rows = vectors.orderBy(digest(F.col("vec_id")), "vec_id").limit(sample).select("vector").toPandas()  # bounded sample
    if not len(rows):
        return None
    unit = np.unique(_unit(_scaled(np.stack(rows["vector"]).astype(np.float64))), axis=0)  # copies would only pull the parts together
    held_out = np.arange(len(unit)) % 5 == 4
    unit, asked = unit[~held_out], unit[held_out]
    parts = min(len(unit) // per_part, 256)
    if parts < 2:
        return Router(np.zeros((unit.shape[1] + 1, 1)))
    graph = neighbour_graph(unit, min(NEIGHBOURS, len(unit) - 2))
    router = Router(fit_router(unit, balanced_parts(unit, graph, parts), graph, parts))
    router.balance(unit)
    router.calibrate(unit, asked, k, target)
    return router


def route(vectors: DataFrame, router: Router) -> DataFrame:
    """vectors (vec_id, vector, asked) with vector scaled, and `parts`: the most probable part of a vector, all probed ones where it is asked."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)  # (dimension + 2) x 256 numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _scaled(np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
            order = router.order(_unit(x), router.probes)
            most = np.where(batch.column(2).to_numpy(zero_copy_only=False).astype(bool), router.probes, 1)
            parts = [own[:n] for own, n in zip(order, most, strict=True)]
            cols = [batch.column(0), pa.array(list(x), pa.list_(pa.float64())), batch.column(2), pa.array(parts, pa.list_(pa.int32()))]
            yield pa.record_batch(cols, ["vec_id", "vector", "asked", "parts"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "vector", "asked").mapInArrow(run, f"vec_id {kind}, vector array<double>, asked boolean, parts array<int>")


def nearest(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query: exact cosine, ties to smaller ids, never the query's own row (`row`)."""
    rows = []
    if len(queries) and len(block):
        b, ids, numbers = np.stack(block["vector"]), block["vec_id"].to_numpy(), block["row"].to_numpy()
        size_b = np.sqrt((b * b).sum(axis=1))
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            q, own, name = np.stack(part["vector"]), part["row"].to_numpy(), part["vec_id"].to_numpy()
            size_q = np.sqrt((q * q).sum(axis=1))
            rough = (q @ b.T) / (size_q[:, None] * size_b)
            rough[own[:, None] == numbers] = -np.inf
            n = min(k, len(b))
            floor = -np.partition(-rough, n - 1, axis=1)[:, n - 1 : n] - 1e-9
            for i in range(len(part)):
                near = np.flatnonzero((rough[i] >= floor[i]) & (rough[i] > -np.inf))
                # summed in one fixed order, so that equal vectors have equal scores wherever they are
                score = (b[near] * q[i]).sum(axis=1) / (size_q[i] * size_b[near])
                first = np.lexsort((numbers[near], ids[near], -score))[:k]
                rows += [(own[i], name[i], numbers[near[j]], ids[near[j]], score[j]) for j in first]
    return pd.DataFrame(rows, columns=["row", "query_id", "found", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, per_part: int = PER_PART, block: int = BLOCK, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors (vec_id, vector) where is_query holds."""
    good = vectors.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    good = good.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    found = None
    for row in good.select(F.size("vector").alias("n")).distinct().orderBy("n").collect():  # a row for each length
        part = _search_equal(good.where(F.size("vector") == row["n"]), k, sample, per_part, block, target)
        found = part if found is None else found.union(part)
    if found is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    return found


def _search_equal(good: DataFrame, k: int, sample: int, per_part: int, block: int, target: float) -> DataFrame:
    """search for usable vectors of one length."""
    router = fit(good, sample, per_part, k, target)
    routed = spool(route(good, router).withColumn("row", F.monotonically_increasing_id()), "routed")
    asked = routed.where("asked").groupBy("vec_id", "vector").agg(F.min("row").alias("row"), F.first("parts").alias("parts"))
    asked = spool(asked.select("vec_id", "vector", "row", F.explode("parts").alias("part")), "asked")
    sizes = routed.groupBy(F.col("parts")[0].alias("part")).count().collect()  # a row for each part
    waiting = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["part"], -(-r["count"] // block))])
    chunks = F.create_map(*[F.lit(x) for r in sizes for x in (r["part"], -(-waiting.get(r["part"], 0) // ASKED))])
    own = F.xxhash64("row")
    indexed = routed.withColumn("part", F.col("parts")[0]).where(chunks[F.col("part")] > 0)
    indexed = indexed.withColumn("block", F.pmod(own, blocks[F.col("part")]).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks[F.col("part")] - 1)))
    asked = asked.where(blocks[F.col("part")].isNotNull())
    asked = asked.withColumn("chunk", F.pmod(own, chunks[F.col("part")]).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)))
    n, key = partitions(good.sparkSession), ["part", "block", "chunk"]

    def rank(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return nearest(asked, block, k)

    columns = ["vec_id", "vector", "row", *key]
    by_block = asked.select(columns).repartition(n, *key).groupBy(*key).cogroup(indexed.select(columns).repartition(n, *key).groupBy(*key))
    kind = good.schema["vec_id"].dataType.simpleString()
    found = by_block.applyInPandas(rank, f"row long, query_id {kind}, found long, vec_id {kind}, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "found")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
