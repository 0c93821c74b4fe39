"""Lines that recur across documents, found with a log-template tree, are dropped.

A line recurs as it stands if it is in PLACES_LONG texts (lines of at least LONG tokens) or PLACES_SHORT texts (shorter
ones), copies of one text counting once. Besides, lines recur as a template whose variable field differs: every line is
parsed to a leaf of a fixed-depth tree by its token count and its first DEPTH tokens (numbers count as one token), and in
leaves of several lines a field is masked: all tokens with digits, or one window over the tokens behind the leading ones,
a quarter of the line wide and an eighth apart. What stays is a template if a window leaves at least LONG tokens (or
numbers at most half of the line), if its field takes VARIANTS different values, and if it is in VARIANTS texts: a
boilerplate's field varies while the rest is repeated word for word, prose does not do that. A template is one mask;
lines that different masks share do not make these one. The document with the least id keeps a recurring line or
template, all others lose it, whatever the lines around it.

Copies, which are the near-duplicate operator's work, are texts that share COPY of all tokens of both, line by line, and
what such pairs lead to. Here, and only here, lines count as equal that any mask makes so, and that such steps lead
between, so that copies with a word changed here and there are copies still. Each text is held against eight others at most, those that hold most of its tokens among the first
and the last holders of its lines (in the orders of two hashes); so the copies of a large group are held against the same
ones, and no group is paired up. A copy that resembles none of these is missed, and then loses what it shares; tests
measure how many are.

Plan: one pass turns lines into hashes; only lines of leaves that hold several different lines are masked, found through a
bitmap of leaf hashes whose size follows their number up to 2^BITMAP_BITS bits. Masks are counted in two steps, by line
and then by mask; places are partial sums; dropping is a join on the document. Nothing depends on how many lines a leaf has.

Defined cases: null text stays null with no lines; blank lines are never dropped; a document may end up empty; rows with
equal id and equal text are one document; a null id comes after all others, and its rows are told apart by their text;
a text of any number of lines takes time in proportion; other columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.common import spool
from folio_spark.llm.graph import components

DEPTH = 4
LONG, PLACES_LONG, PLACES_SHORT = 8, 2, 10
#: Values of a template's field, and texts that it is in.
VARIANTS = 10
COPY = 0.8
#: Bits of the largest bitmap of leaves: 16 MB.
BITMAP_BITS = 27
_DIGIT = re.compile(rb"[0-9]")


def _key(text: Column, doc_id: Column) -> Column:
    return F.xxhash64(doc_id, text)


def masked(tokens: list[bytes]) -> list[bytes]:
    """A line's tokens, those with digits as one variable token."""
    return [b"<*>" if _DIGIT.search(t) else t for t in tokens]


def _h(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) >> 1


def leaf(tokens: list[bytes], depth: int = DEPTH) -> int:
    return _h(b"%d " % len(tokens) + b" ".join(masked(tokens[:depth])))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[list[bytes]]]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = batch.column(0).cast(pa.large_binary()).to_pylist()
            yield batch, [[x.split() for x in t.split(b"\n")] if t else [] for t in texts]


def line_hashes(keyed: DataFrame) -> DataFrame:
    """doc_id, k, line_no, n_tokens, leaf, line, size (the text's tokens) of every line of keyed (text, doc_id, k) that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in _rows(batches):
            own, out = [], []
            for i, lines in enumerate(docs):
                size = sum(map(len, lines))
                for n, x in enumerate(lines):
                    if x:
                        own.append(i)
                        out.append((n, len(x), leaf(x), _h(b" ".join(x)), size))
            cols = list(zip(*out, strict=True)) or [()] * 5
            at = pa.array(own, pa.int64())
            yield pa.record_batch([batch.column(1).take(at), batch.column(2).take(at), *[pa.array(c, pa.int64()) for c in cols]], names)

    names = ["doc_id", "k", "line_no", "n_tokens", "leaf", "line", "size"]
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.select("text", "doc_id", "k").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def _bitmap(leaves: DataFrame) -> np.ndarray:
    """A bit for the low bits of each leaf hash, 16 places and more for each leaf as long as the map may grow."""
    n = leaves.count()
    bits = min(BITMAP_BITS, max(20, (16 * n).bit_length()))
    words = leaves.groupBy(F.shiftright(F.col("leaf").bitwiseAND(F.lit((1 << bits) - 1)), 5).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(leaf % 32))")).alias("bits")
    )
    out = np.zeros(1 << (bits - 5), np.uint32)
    rows = words.toPandas()  # one row at most a word of the map
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the fields that are masked in a line of n tokens: a quarter wide, an eighth apart, behind the leading tokens."""
    wide = min(n // 4, n - DEPTH)
    if wide < 1:
        return []
    return [(at, at + wide) for at in [*range(DEPTH, n - wide, max(1, wide // 2)), n - wide]]


def masks(tokens: list[bytes]) -> list[tuple[int, bool]]:
    """Hashes of a line with its numbers masked, and with each of its windows masked too, and whether enough of it stays."""
    plain, found = masked(tokens), []
    n, numbers = len(tokens), sum(t == b"<*>" for t in plain)
    if numbers:
        found.append((_h(b"%d " % n + b" ".join(plain)), numbers * 2 <= n))
    for k, (a, b) in enumerate(windows(n)):
        left, right = plain[:a], plain[b:]
        stays = n - (b - a) - left.count(b"<*>") - right.count(b"<*>")
        found.append((_h(b"%d %d " % (n, k) + b" ".join(left) + b"\n" + b" ".join(right)), stays >= LONG))
    return found


def line_masks(keyed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """line, mask, strong (whether it can be a template): the masks of the different lines whose leaf's bit is set."""
    shared, low = keyed.sparkSession.sparkContext.broadcast(bitmap), len(bitmap) * 32 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for _, docs in _rows(batches):
            found = {}
            for lines in docs:
                for x in lines:
                    if x and bits[(at := leaf(x) & low) >> 5] >> np.uint32(at & 31) & 1:
                        found[_h(b" ".join(x))] = x
            own = [(line, *m) for line, x in found.items() for m in masks(x)]
            cols = list(zip(*own, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["line", "mask", "strong"])

    return keyed.select("text", "doc_id", "k").mapInArrow(run, "line long, mask long, strong boolean")


def templates_of(masked_lines: DataFrame) -> DataFrame:
    """line, template of masked_lines (line, mask, strong): the strong masks that VARIANTS different lines have."""
    each = masked_lines.where("strong").select("line", "mask").distinct()
    often = each.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= VARIANTS).select("mask")
    return each.join(often, "mask").select("line", F.col("mask").alias("template"))


def merged_lines(masked_lines: DataFrame) -> DataFrame:
    """line, like (the least line that shared masks lead to) of masked_lines (line, mask), for lines that share a mask with others."""
    least = masked_lines.groupBy("mask").agg(F.min("line").alias("v"), F.max("line").alias("most")).where("v <> most").select("mask", "v")
    links = masked_lines.join(least, "mask").where("line <> v").select(F.col("line").alias("u"), "v")
    return components(links).select(F.col("node").alias("line"), F.col("root").alias("like"))


#: The holders of a line that its other holders are held against: first and last in two orders.
SIDES = ("a", "b", "c", "d")


def ends_of(lines: DataFrame) -> DataFrame:
    """template and the SIDES of its holders, for lines (template, k) that several texts hold."""
    h = F.xxhash64("k")
    ends = [F.min("k"), F.max("k"), F.min_by("k", h), F.max_by("k", h)]
    return lines.groupBy("template").agg(*[e.alias(c) for e, c in zip(ends, SIDES, strict=True)]).where("a <> b")


def copies(held: DataFrame, ends: DataFrame) -> DataFrame:
    """k, root: the texts that are copies, from held (template, k, tokens, size) and ends (template and its holders SIDES)."""
    held = held.select("template", "k", "tokens", "size")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("r")) for i, c in enumerate(SIDES)])
    near = held.join(ends, "template").select("k", "tokens", "size", F.explode(sides).alias("s")).select("k", "tokens", "size", "s.*").where("r <> k")
    near = near.groupBy("k", "side", "r").agg(F.sum("tokens").alias("n"), F.first("size").alias("size")).where(F.col("n") * 2 >= COPY * F.col("size"))
    pairs = spool(near.select("k", "r").distinct(), "pairs")  # two ends a side at most hold so many of the tokens
    theirs = held.select(F.col("k").alias("r"), "template", F.col("tokens").alias("r_tokens"), F.col("size").alias("r_size"))
    both = pairs.join(held, "k").join(theirs, ["r", "template"]).groupBy("k", "r").agg(
        F.sum(F.least("tokens", "r_tokens")).alias("both"), F.first("size").alias("size"), F.first("r_size").alias("r_size")
    )
    links = both.where(F.col("both") >= COPY * (F.col("size") + F.col("r_size") - F.col("both"))).select(F.col("k").alias("u"), F.col("r").alias("v"))
    return components(links).select(F.col("node").alias("k"), "root")


def recurring(lines: DataFrame, templates: DataFrame, merged: DataFrame) -> DataFrame:
    """Of lines (line_hashes), those to drop: doc_id, k, line_no. templates: templates_of, merged: merged_lines."""
    named = lines.drop("leaf").join(merged, "line", "left").withColumn("template", F.coalesce("like", "line")).drop("like")
    ends = spool(ends_of(named), "ends")
    # equal rows are one document; what only one text holds is neither shared nor recurring
    named = spool(named.join(ends.select("template"), "template").dropDuplicates(["doc_id", "k", "line_no"]), "named")
    held = spool(named.groupBy("template", "k").agg(F.sum("n_tokens").alias("tokens"), F.first("size").alias("size")), "held")
    copied = spool(copies(held, ends), "copied")
    rows = named.select("doc_id", "k", "line_no", "n_tokens", "line")
    both = rows.select(F.lit(False).alias("general"), F.col("line").alias("unit"), "doc_id", "k", "line_no", "n_tokens").union(
        rows.join(templates, "line").select(F.lit(True), "template", "doc_id", "k", "line_no", "n_tokens")
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    counted = both.groupBy("general", "unit", "k").agg(F.max("n_tokens").alias("n"), F.min(order).alias("first")).join(copied, "k", "left")
    counted = counted.groupBy("general", "unit", F.coalesce("root", "k").alias("root")).agg(F.max("n").alias("n"), F.min("first").alias("first"))
    counted = counted.groupBy("general", "unit").agg(F.count(F.lit(1)).alias("places"), F.max("n").alias("n"), F.min("first").alias("first"))
    often = F.col("places") >= F.when(F.col("general"), VARIANTS).when(F.col("n") >= LONG, PLACES_LONG).otherwise(PLACES_SHORT)
    kept = counted.where(often).select("general", "unit", F.col("first.k").alias("fk"))
    return both.join(kept, ["general", "unit"]).where("k <> fk").select("doc_id", "k", "line_no").distinct()


def drop_recurring(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) with recurring lines dropped from text, and n_lines, n_dropped."""
    key = _key(F.col("text"), F.col("doc_id"))
    keyed = docs.select("text", "doc_id", key.alias("k"))
    lines = spool(line_hashes(keyed), "lines")
    several = lines.groupBy("leaf").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("leaf")
    masks_ = spool(line_masks(keyed, _bitmap(spool(several, "leaves"))), "masks")
    found = recurring(lines, spool(templates_of(masks_), "templates"), merged_lines(masks_))
    gone = found.groupBy("doc_id", "k").agg(F.array_sort(F.collect_set("line_no")).alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), F.transform("__gone", lambda i: i.cast("int")).alias("__gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*kept).withColumn("__key", key).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left")
    parts = F.split("text", "\n")
    # the stretches between dropped lines: from one's next line up to the following one
    starts = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda i: i + 1))
    stops = F.concat(F.col("__gone"), F.array(F.size(parts)))
    left = F.array_join(F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(parts, a + 1, b - a))), "\n")
    counts = {
        "n_lines": F.when(F.length("text") > 0, F.size(parts)).otherwise(0).cast("long"),
        "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
    }
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in kept], *[v.alias(k) for k, v in counts.items()])
