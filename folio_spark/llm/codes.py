"""Vector code compression: product codes whose codebooks are learned exactly, over Hilbert-sorted blocks.

Vectors become integers and are cut into parts. The parts of one position are sorted along a Hilbert curve and stored in
flat blocks of BLOCK neighbours, each with its box (least and most of every component) and its sum. In a round, the
distances between a block's box and the entries leave a shortlist: only entries that are at least as near to the box as
the entry with the least greatest distance can be any part's nearest. Where one is left, the whole block goes to it by
its stored sum; otherwise a small integer kernel compares the block's parts with the shortlist. So results are exactly
those of comparing everything, ties going to the lower entry, and blocks shrink, and shortlists with them, as data grow.

Plan: one range-partitioned sort of the parts by (position, Hilbert key, row), so that neither a position nor a vector
that a third of the rows hold is one task; blocks are written once and read in each round. A round sends codebooks
(parts x entries x components numbers, whatever the data) to all tasks and gets one sum for each entry that a task used.
Codes of a row meet in one grouping by row whose state is three numbers.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do those of another
length than most kept vectors have (of equally frequent lengths the longest counts); a length that the number of parts
does not divide is an error, as are components of 2^19 and more, whose distances do not fit; rows with equal or null ids
are rows of their own, null ids come last and equal ones in the order of their values; fewer vectors than entries give
fewer entries; null labels are one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.common import partitions, spool

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Parts in a block, components that the Hilbert key looks at, bits of the key.
BLOCK, KEY_DIMS, KEY_BITS = 256, 16, 62
#: Scaled components stay below this, so that squared distances of 64 of them fit 63 bits.
LIMIT = 1 << 27


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points (rows of non-negative integers below 2^bits), columns x bits below 64 bits.

    The Gray-code transform of the axes, after J. Skilling, for all points at once.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[-1] & q, q - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, x (integers) of the usable vectors (vec_id, vector, label) of the usual length."""
    held = vectors.select("vec_id", "label", F.col("vector").cast("array<double>").alias("v")).where(usable(F.col("v")))
    whole = F.transform("v", lambda c: F.floor(c * scale))
    held = spool(held.select("vec_id", "label", whole.alias("x")).withColumn("row", F.monotonically_increasing_id()), "integers")
    usual = held.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).first()
    return held.where(F.size("x") == (usual["d"] if usual else 0))


def part_rows(held: DataFrame, parts: int, low: int, high: int) -> DataFrame:
    """part, key, row, x (32-bit integers, flat): every vector's parts with their places along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, parts, -1)
            used = min(x.shape[2], KEY_DIMS)
            bits = KEY_BITS // used
            shift = max(0, (high - low).bit_length() - bits)
            bits = max(1, min(bits, (high - low).bit_length()))
            rows = batch.column(0)
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p])
                keys = hilbert_keys((own[:, :used] - low) >> shift, bits)
                flat = own.astype("<i4").tobytes()
                wide = own.shape[1] * 4
                values = pa.array([flat[i : i + wide] for i in range(0, len(flat), wide)], pa.binary())
                yield pa.record_batch([pa.array(np.full(n, p, np.int32)), pa.array(keys), rows, values], ["part", "key", "row", "x"])

    return held.select("row", "x").mapInArrow(run, "part int, key long, row long, x binary")


def blocks(held: DataFrame, parts: int) -> DataFrame:
    """part, n, rows, x (flat), lo, hi, sums: blocks of up to BLOCK parts of one position that are neighbours on the curve."""
    ends = held.select(F.array_min("x").alias("a"), F.array_max("x").alias("b")).agg(F.min("a"), F.max("b")).first()
    low, high = (ends[0], ends[1]) if ends[0] is not None else (0, 0)
    if max(abs(low), abs(high)) >= LIMIT:
        raise ValueError(f"components from {LIMIT // SCALE} on do not fit exact distances")
    cut = part_rows(held, parts, low, high)
    order = ["part", "key", "row"]
    dealt = cut.repartitionByRange(partitions(held.sparkSession), *order).sortWithinPartitions(*order)

    def packed(part: int, rows: list[np.ndarray], values: list[bytes]) -> tuple:
        own = np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64)
        return part, len(own), np.array(rows, "<i8").tobytes(), b"".join(values), own.min(0).tolist(), own.max(0).tolist(), own.sum(0).tolist()

    def table(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3)
        names = ("part", "n", "rows", "x", "lo", "hi", "sums")
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, values = -1, [], []
        for batch in batches:
            found = []
            for p, r, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if rows and (p != part or len(rows) == BLOCK):
                    found.append(packed(part, rows, values))
                    rows, values = [], []
                part = p
                rows.append(r)
                values.append(x)
            if found:
                yield table(found)
        if rows:
            yield table([packed(part, rows, values)])

    shape = "part int, n int, rows binary, x binary, lo array<long>, hi array<long>, sums array<long>"
    return spool(dealt.mapInArrow(run, shape), "blocks")


def shortlist(lo: np.ndarray, hi: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries, ascending, that can be the nearest of some point in the box, or as near as it."""
    below, above = lo - entries, entries - hi
    gap = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return np.flatnonzero((gap * gap).sum(1) <= (far * far).sum(1).min())


def nearest(points: np.ndarray, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry among some, ties to the lower one, and its squared distance; exact integers."""
    apart = points[:, None, :] - entries[None, among, :]
    squares = np.einsum("ijk,ijk->ij", apart, apart)
    best = squares.argmin(1)
    return among[best], squares[np.arange(len(points)), best]


def _block(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    for part, n, rows, x, lo, hi, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield part, n, rows, x, np.array(lo), np.array(hi), np.array(sums)


def round_sums(stored: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """part, entry, n, s0, s1, ...: how many parts chose each entry, and their sums."""
    wide = codebooks.shape[2]
    shared = stored.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for part, n, _, x, lo, hi, whole in _block(batch):
                among = shortlist(lo, hi, books[part])
                if len(among) == 1:
                    counts[part, among[0]] += n
                    sums[part, among[0]] += whole
                    continue
                points = np.frombuffer(x, "<i4").reshape(n, -1).astype(np.int64)
                chosen, _ = nearest(points, books[part], among)
                counts[part] += np.bincount(chosen, minlength=books.shape[1])
                np.add.at(sums[part], chosen, points)
        at = np.argwhere(counts)
        if len(at):
            cols = [at[:, 0], at[:, 1], counts[counts > 0], *sums[counts > 0].T]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c, np.int64)) for c in cols], ["part", "entry", "n", *[f"s{i}" for i in range(wide)]])

    names = ["n", *[f"s{i}" for i in range(wide)]]
    found = stored.mapInArrow(run, ", ".join(f"{c} long" for c in ("part", "entry", *names)))
    return found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names])


def seeds(held: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The first codebooks (part, entry, component): the parts of the vectors with the least ids."""
    first = held.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    x = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


@dataclass
class Codes:
    """What compress() gives: codebooks (part, entry, component), and row, vec_id, label, code, error of every vector."""

    codebooks: np.ndarray
    coded: DataFrame

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimals, joined by commas."""
        return sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def learn(held: DataFrame, stored: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks after so many rounds of assigning parts and moving entries to the floors of their means."""
    books = seeds(held, parts, entries)
    for _ in range(rounds if books.size else 0):
        moved = books.copy()
        for r in round_sums(stored, books).collect():  # one row an entry
            moved[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
        books = moved
    return books


def assign(stored: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """row, high, low, error: each row's codes, 8 bits a part in two 64-bit halves, and its squared distances summed."""
    shared = stored.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for part, n, rows, x, lo, hi, _ in _block(batch):
                points = np.frombuffer(x, "<i4").reshape(n, -1).astype(np.int64)
                chosen, squares = nearest(points, books[part], shortlist(lo, hi, books[part]))
                code = (chosen.astype(np.uint64) << np.uint64(8 * (7 - part % 8))).view(np.int64)
                none = np.zeros(n, np.int64)
                cols = [np.frombuffer(rows, "<i8"), *((code, none) if part < 8 else (none, code)), squares]
                yield pa.record_batch([pa.array(c) for c in cols], ["row", "high", "low", "error"])

    found = stored.mapInArrow(run, "row long, high long, low long, error long")
    return found.groupBy("row").agg(F.bit_or("high").alias("high"), F.bit_or("low").alias("low"), F.sum("error").alias("error"))


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of PARTS parts of vectors (vec_id, vector, label), with the codebooks that they point into."""
    held = integers(vectors, scale)
    wide = held.select(F.size("x").alias("d")).limit(1).collect()
    if wide and (wide[0]["d"] % PARTS or not wide[0]["d"]):
        raise ValueError(f"vectors of {wide[0]['d']} components can not be cut into {PARTS} equal parts")
    if not wide:
        kinds = dict(vectors.dtypes)
        none = vectors.sparkSession.createDataFrame([], f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
        return Codes(np.zeros((PARTS, 0, 0), np.int64), none)
    stored = blocks(held, PARTS)
    books = learn(held, stored, PARTS, entries, rounds)
    half = lambda c: F.lpad(F.hex(c), 16, "0")
    coded = held.select("row", "vec_id", "label").join(assign(stored, books), "row")
    return Codes(books, coded.select("row", "vec_id", "label", F.lower(F.concat(half("high"), half("low"))).alias("code"), "error"))


def decoded(codes: Codes, scale: int = SCALE) -> DataFrame:
    """row, vec_id, vector: what the codes stand for, entries as doubles."""
    spark, books = codes.coded.sparkSession, codes.codebooks
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column(2).to_pylist())), np.uint8).reshape(-1, PARTS)
            found = (shared.value[np.arange(PARTS), at].reshape(len(at), -1) / scale).tolist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["row", "vec_id", "vector"])

    kind = codes.coded.schema["vec_id"].dataType.simpleString()
    return codes.coded.select("row", "vec_id", "code").mapInArrow(run, f"row long, vec_id {kind}, vector array<double>")


def code_rows(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels), codebooks_sha256."""
    codes = compress(vectors, entries, rounds)
    coded = spool(codes.coded.drop("row"), "coded")
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    met = coded.join(of_label, F.col("label").eqNullSafe(F.col("__label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
