"""SimHash near-duplicates: fingerprints of word shingles, searched with BK-trees in shards.

A BK-tree keeps each fingerprint under its parent by their Hamming distance; a search at distance d from a node with
radius r follows only the edges d-r..d+r. One tree over everything would have to be broadcast and grows with the data,
so a tree is built per shard, inside the task that holds the shard, and shards are cut so that no link is lost:

* `link_fingerprints` (radius 2 on 64 bits): of four 16-bit blocks at least two agree, so the six pairs of blocks are
  the shard keys. A shard over MAX_SHARD fingerprints is cut again: of the eight 4-bit blocks that remain at least six
  agree, which leaves 8 free bits, so that such a shard has 256 fingerprints at most.
* `near_duplicates` (sets of five-word shingles, similarity 0.8): texts of that similarity share each min-hash with
  probability 0.8 or more, so min-hashes are the shard keys, two of them together where both have large shards; trees then
  find 128-bit SimHashes that may be of such texts, and a shard of two min-hashes that is large still is one group of
  candidates. What is connected so is then compared text by text: only a similarity of 0.8 or more is a link.

Each tree gives a spanning star per cluster, never all pairs, and stars are joined into components. A large group of
candidates is held against PIVOTS of its texts first, in chunks that each get the pivots' texts; only what these leave
outside of the largest component is then held against all texts of the group, in blocks. So a group of copies takes time
in proportion to its size, a chunk is bounded in texts and (but for a text larger than that) in bytes, and until then
nodes are numbers: neither texts nor marks go through the search for candidates.

Defined cases: null text is an empty text; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle has are one shingle; a passage that a text repeats counts once for similarity (sets), and by
its repeats for `simhash64`; equal texts have equal fingerprints and one node between them; rows with equal or null ids keep their own row, and a null id is never a component's name unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.common import by_group, drop_spool, spool
from folio_spark.llm.graph import components, components_of_numbers

#: Fingerprints in one tree, before its shard is cut again.
MAX_SHARD = 1024
#: Min-hashes of a text.
MIN_HASHES = 16
#: Bits of 128 that the SimHashes of similar texts differ in at most.
RADIUS = 44
#: Texts and bytes in a chunk of a large group.
CHUNK, CHUNK_BYTES = 512, 16 << 20
#: Texts that all texts of a large group of candidates are held against first.
PIVOTS = 8
#: Jaccard similarity of shingle sets from which texts are near-duplicates.
SIMILAR = 0.8
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def shingles(text: bytes, words: int) -> list[bytes]:
    """Lower-cased (A-Z) word shingles, repeats included; bytes.split() cuts at ASCII white space only."""
    found = text.lower().split()
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return [b" ".join(x) for x in zip(*(found[i:] for i in range(words)), strict=False)]


def majority(digests: bytes, width: int) -> bytes:
    """The bits set in over half of the digests, each `width` bytes."""
    n = len(digests) // width
    if not n:
        return bytes(width)
    rows, counts = np.frombuffer(digests, np.uint8).reshape(n, width), np.zeros(width * 8, np.int64)
    for at in range(0, n, STEP):
        counts += np.unpackbits(rows[at : at + STEP], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n).tobytes()


def simhash64(text: bytes, words: int = 3) -> bytes:
    h = xxhash.xxh64_digest
    return majority(b"".join([h(x, 42) for x in shingles(text, words)]), 8)


def sketch(text: bytes, words: int = 5) -> tuple[bytes, list[int]]:
    """128-bit SimHash and min-hashes of the set of shingles; a text without words has zeros."""
    h = xxhash.xxh3_128_digest
    digests = b"".join([h(x) for x in set(shingles(text, words))])
    if not digests:
        return bytes(16), [0] * MIN_HASHES
    low = np.frombuffer(digests, np.uint64)[::2]
    odd = (np.arange(1, MIN_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    mins = [int((low * k ^ (low * k >> np.uint64(29))).min() >> np.uint64(1)) for k in odd]
    return majority(digests, 16), mins


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in slices, with the column's texts as bytes (null: empty)."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        col = part.column(part.schema.get_field_index(column)).cast(pa.large_binary())
        yield part, [x or b"" for x in col.to_pylist()]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (64 bits as a long) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, "text"):
                values = [int.from_bytes(simhash64(t, words), "big", signed=True) for t in texts]
                yield pa.record_batch([part.column(0), pa.array(values, pa.int64())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


class BKTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of value; a value that is there already keeps its node."""
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """The nodes at distance `radius` or less, by the edges that can lead to them."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if self.children[at]:
                todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its cluster), for clusters of two and more."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for v in sorted(set(values)):
        near = tree.within(v, radius)
        i = tree.add(v)
        parent.append(i)
        for j in near:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [(tree.values[i], tree.values[root(i)]) for i in range(len(parent)) if root(i) != i]


def _bits(value: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1))


def _packed(value: Column, blocks: tuple[int, ...], width: int) -> Column:
    out = F.lit(0).cast("long")
    for k in blocks:
        out = F.shiftleft(out, width).bitwiseOR(_bits(value, k * width, width))
    return out


def link_fingerprints(distinct: DataFrame, radius: int = 2, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links (u, v) between the values of distinct (fingerprint) that lead from every value to all in its component."""
    if radius > 2:
        raise ValueError("the shard keys hold for a radius of 2 at most")
    f = F.col("fingerprint")
    pairs = list(combinations(range(4), 2))
    keys = [F.struct(F.lit(i).alias("part"), _packed(f, p, 16).alias("key")) for i, p in enumerate(pairs)]
    keyed = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("s")).select("fingerprint", "s.*")
    counts = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shards = spool(keyed.join(counts, ["part", "key"]), "shards")
    # the 32 bits outside the key, then six of their eight 4-bit blocks
    rest = F.lit(0).cast("long")
    for i, p in enumerate(pairs):
        rest = F.when(F.col("part") == i, _packed(f, tuple(k for k in range(4) if k not in p), 16)).otherwise(rest)
    sixes = list(combinations(range(8), 6))
    finer = [F.struct(F.lit(i + 1).alias("sub"), _packed(F.col("rest"), p, 4).alias("subkey")) for i, p in enumerate(sixes)]
    large = (
        shards.where(F.col("n") > max_shard)
        .withColumn("rest", rest)
        .select("fingerprint", "part", "key", F.explode(F.array(*finer)).alias("s"))
        .select("fingerprint", "part", "key", "s.*")
    )
    small = shards.where(F.col("n") <= max_shard).select(
        "fingerprint", "part", "key", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subkey")
    )

    def tree(shard: pa.Table) -> list[tuple[int, int]]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [(signed(a), signed(b)) for a, b in stars([x & ((1 << 64) - 1) for x in shard["fingerprint"].to_pylist()], radius)]

    # shards whose hashes are equal share a tree, which loses nothing
    shards = small.union(large).select("fingerprint", F.xxhash64("part", "key", "sub", "subkey").alias("g"))
    return by_group(shards, "g", tree, "u long, v long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of docs (doc_id, text): the smallest doc_id that links lead to."""
    marked = spool(fingerprints(docs, words), "fingerprints")
    nodes = spool(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(link_fingerprints(nodes.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    named = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(names, "root").select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


# --- texts of a similarity of 0.8 or more -------------------------------------------------------------------------


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs' doc_id with `name` (md5 of the text), its bytes, `high`, `low` (128-bit SimHash) and `mins` (min-hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, "text"):
                found = [sketch(t, words) for t in texts]
                marks = np.frombuffer(b"".join(m for m, _ in found), ">i8").reshape(-1, 2).astype(np.int64)
                cols = [pa.array([md5(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy())]
                cols.append(pa.array([x for _, x in found], pa.list_(pa.int64())))
                yield pa.record_batch([part.column(0), *cols], ["doc_id", "name", "bytes", "high", "low", "mins"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, name binary, bytes long, high long, low long, mins array<long>")


def _sharded(keyed: DataFrame) -> DataFrame:
    """keyed (node, at, key) with n, for every shard of two or more nodes."""
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(counts, "key")


def candidates(nodes: DataFrame, radius: int, max_shard: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (u, v) between nodes (node, high, low, mins) that lead to every node that may be similar, and the spools that they read."""
    keyed = nodes.select("node", F.posexplode("mins").alias("at", "m")).select("node", "at", F.xxhash64("at", "m").alias("key"))
    first = spool(_sharded(keyed), "shards")
    # nodes whose min-hashes i and j both have large shards meet again by the two together
    hot = first.where(F.col("n") > max_shard).groupBy("node").agg(F.array_sort(F.collect_list("at")).alias("hot"))
    pairs = nodes.select("node", "mins").join(hot, "node").select("node", "mins", "hot", F.posexplode("hot").alias("p", "i"))
    pairs = pairs.select("node", "mins", "i", F.explode(F.slice("hot", F.col("p") + 2, F.size("hot"))).alias("j"))
    both = pairs.select("node", F.lit(-1).alias("at"), F.xxhash64("i", "j", F.get("mins", F.col("i")), F.get("mins", F.col("j"))).alias("key"))
    second = spool(_sharded(both), "shards")

    def tree(shard: pa.Table) -> list[tuple[int, int]]:
        least: dict[int, int] = {}
        high, low = (shard[c].to_numpy().astype(np.uint64).tolist() for c in ("high", "low"))
        values, same = [a << 64 | b for a, b in zip(high, low, strict=True)], []
        for value, node in zip(values, shard["node"].to_pylist(), strict=True):
            if least.setdefault(value, node) != node:
                same.append((node, least[value]))
        return same + [(least[a], least[b]) for a, b in stars(values, radius)]

    small = first.where(F.col("n") <= max_shard).union(second.where(F.col("n") <= max_shard)).select("node", "key")
    links = by_group(small.join(nodes.select("node", "high", "low"), "node"), "key", tree, "u long, v long")
    large = second.where(F.col("n") > max_shard).select("key", "node")
    least = large.groupBy("key").agg(F.min("node").alias("v"))
    return links.union(large.join(least, "key").where("node <> v").select(F.col("node").alias("u"), "v")), [first, second]


class _Sets:
    """Shingle sets of texts, as sorted hashes; the last ones are kept."""

    def __init__(self, words: int, most: int = 4096) -> None:
        self.words, self.most, self.held = words, most, {}

    def of(self, node: int, text: bytes) -> np.ndarray:
        if (found := self.held.get(node)) is None:
            if len(self.held) >= self.most:
                self.held.clear()
            found = np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in shingles(text, self.words)], np.uint64))
            self.held[node] = found
        return found


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets have a Jaccard similarity of SIMILAR or more; two empty sets have."""
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def similar_links(nodes: list[int], marks: np.ndarray, texts: list[bytes], words: int, radius: int, first: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of similar texts that lead from each text to all that similar ones within the radius lead to.

    With `first`, only pairs with one text for which it holds are looked at. marks: two 64-bit halves a text.
    """
    sets = _Sets(words, len(nodes) + 1)
    root, found = np.arange(len(nodes)), []
    for i in range(len(nodes)):
        if first and not first[i]:
            continue
        near = np.bitwise_count(marks ^ marks[i]).sum(axis=1) <= radius
        for j in np.flatnonzero(near if first else near[:i]):
            if root[i] != root[j] and similar(sets.of(nodes[i], texts[i]), sets.of(nodes[j], texts[j])):
                root[root == root[i]] = root[j]
                found.append((nodes[i], nodes[j]))
    return found


def _compare(table: pa.Table, words: int, radius: int, first: str | None = None) -> list[tuple[int, int]]:
    marks = np.stack([table[c].to_numpy().astype(np.uint64) for c in ("high", "low")], 1)
    return similar_links(table["node"].to_pylist(), marks, table["text"].to_pylist(), words, radius, table[first].to_pylist() if first else None)


def _chunks(n: Column, size: Column) -> Column:
    """Chunks of n texts of so many bytes together."""
    return F.greatest(F.lit(1), F.ceil(n / CHUNK), F.ceil(size / CHUNK_BYTES)).cast("int")


def _dealt(node: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(5)), chunks).cast("int")


def _pivot_links(large: DataFrame, words: int, radius: int) -> DataFrame:
    """Links (u, v) of large (root, node, high, low, text) with similar ones among PIVOTS texts of the same root.

    A root's texts are dealt into chunks, and each chunk gets the pivots too.
    """
    order = [F.min_by(F.struct("node", "high", "low", "text"), F.struct(F.xxhash64(F.lit(p), "node"), "node")).alias(f"p{p}") for p in range(PIVOTS)]
    sizes = large.groupBy("root").agg(_chunks(F.count(F.lit(1)), F.sum(F.length("text"))).alias("chunks"), *order)
    sizes = spool(sizes, "pivots")
    cut = sizes.select("root", "chunks")
    all_ = large.join(cut, "root").withColumn("c", _dealt(F.col("node"), F.col("chunks"))).withColumn("first", F.lit(False))
    pivots = sizes.select("root", "chunks", F.explode(F.array_distinct(F.array(*[f"p{p}" for p in range(PIVOTS)]))).alias("p"))
    pivots = pivots.select("root", "chunks", "p.*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")).withColumn("first", F.lit(True))
    columns = ["node", "high", "low", "text", "first", F.xxhash64("root", "c").alias("g")]
    return by_group(all_.select(*columns).union(pivots.select(*columns)), "g", lambda t: _compare(t, words, radius, "first"), "u long, v long")


def _block_links(large: DataFrame, known: DataFrame, words: int, radius: int) -> DataFrame:
    """Links (u, v) of large (root, node, high, low, text) with an end outside of its root's largest component of known (node, part)."""
    named = large.select("root", "node", F.length("text").alias("size")).join(known, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = named.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = sizes.groupBy("root").agg(F.max(F.struct("n", "part", "size")).alias("m"), F.sum("n").alias("all"), F.sum("size").alias("bytes"))
    rest = _chunks((F.col("all") - F.col("m.n")), F.col("bytes") - F.col("m.size"))
    most = spool(most.where(F.col("all") > F.col("m.n")).select("root", F.col("m.part").alias("main"), rest.alias("rest"), _chunks(F.col("all"), F.col("bytes")).alias("chunks")), "rest")
    named = large.join(most, "root").join(known, "node", "left").withColumn("first", F.coalesce("part", "node") != F.col("main"))
    every = named.withColumn("b", _dealt(F.col("node"), F.col("chunks"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).withColumn("first", F.lit(False))
    asked = named.where("first").withColumn("a", _dealt(F.col("node"), F.col("rest"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    columns = ["node", "high", "low", "text", "first", F.xxhash64("root", "a", "b").alias("g")]
    return by_group(every.select(*columns).union(asked.select(*columns)), "g", lambda t: _compare(t, words, radius, "first"), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """doc_id, component_id: documents whose texts are as good as copies have one component.

    Linked: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more, exactly. Candidates
    share one of MIN_HASHES min-hashes, or two where all shards that they share are large, and have SimHashes of 128 bits
    at most `radius` apart (about 19 are expected at 0.8, 64 for unrelated texts). A pair of exactly 0.8 shares none of 16
    min-hashes once in 1.5 * 10^11 cases, fewer than two once in 2.3 * 10^9, and is over 44 bits apart about once in
    6 * 10^7 (for texts of some hundred words and more); more similar pairs are missed more rarely. Texts without words are one text; null ids are no names.
    """
    marked = spool(sketches(docs, words), "sketches")
    nodes = marked.groupBy("name").agg(*[F.first(c).alias(c) for c in ("bytes", "high", "low", "mins")], F.min("doc_id").alias("least"))
    nodes = spool(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links, shards = candidates(nodes, radius, max_shard)
    maybe = components_of_numbers(links)
    for df in shards:
        drop_spool(df)
    maybe = spool(nodes.select("node", "name", "bytes", "high", "low").join(maybe, "node"), "maybe")
    sizes = maybe.groupBy("root").agg((_chunks(F.count(F.lit(1)), F.sum("bytes")) > 1).alias("large"))
    whole = spool(maybe.join(sizes, "root").drop("bytes"), "maybe")
    drop_spool(maybe)
    maybe = whole
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = texts.withColumn("name", F.unhex(F.md5("text"))).join(maybe.select("name"), "name", "left_semi").dropDuplicates(["name"])
    held = spool(maybe.join(texts, "name").select("root", "node", "high", "low", "text", "large"), "texts")
    small = held.where("not large").withColumn("g", F.xxhash64("root"))
    links = by_group(small.drop("root", "large"), "g", lambda t: _compare(t, words, radius), "u long, v long")
    large = held.where("large").drop("large")
    if large.limit(1).count():
        near = spool(_pivot_links(large, words, radius), "near")
        known = components_of_numbers(near).select("node", F.col("root").alias("part"))
        links = links.union(near).union(_block_links(large, known, words, radius))
    roots = components_of_numbers(links)
    drop_spool(held)
    named = nodes.select("node", "name", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.select("name", "root").join(names, "root").select("name", "component_id")
    return marked.select("doc_id", "name").join(of_node, "name").select("doc_id", "component_id")
