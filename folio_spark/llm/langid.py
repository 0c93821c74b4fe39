"""Language ID by interpolated Kneser-Ney character models, one per language, kept in sorted hash arrays.

Learning: one pass counts character 4-grams per language (lower case, everything but letters and marks is one space);
counts are merged inside each task and summed by Spark. Everything else is joins and sums over these counts: lower
orders are continuation counts of the orders above, discounts come from all n-grams that occur once and twice, and each
order is interpolated with the one below. Nothing is pruned, no language is left out, and the tables grow with the corpus.

Prediction: the different 4-grams of the documents are looked up in those tables, order by order, which gives the log
probability of each in every language. Where that table is small (MAX_CELLS numbers), tasks get it as an array sorted by
64-bit hashes, which are one to one, and read it by the hash's leading bits; a larger one is joined with the documents'
4-grams instead, with the same results. The language is the one with the lowest cross-entropy per character. Rejected are
texts without a letter, and texts whose cross-entropy lies too far above that of documents of the predicted language, by
limits that are medians over all learning documents of each.

Defined cases: null text, and text without a letter, is `und` with score 0 and rejected; equal cross-entropies go to
the smaller language name; without any row to learn from everything is `und`; texts longer than PIECE characters are
read in pieces, which changes nothing but memory; characters beyond the basic plane count as one symbol; equal texts get
equal results; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio_spark.llm.common import drop_spool, partitions, spool

ORDER, INDEX_BITS = 4, 22
#: Numbers in a table of log probabilities that is given to every task: 32 MB, and 64 MB of hashes at most.
MAX_CELLS = 1 << 23
#: Standard deviations above a language's usual cross-entropy at which a text is rejected.
FAR = 8.0
#: And so many nats a character besides: text that switches between learned languages, or has names and numbers, stays.
MARGIN = 1.0
PIECE = 1 << 18
UNKNOWN = "und"


def _kind(c: str) -> int:
    """2 for letters, 1 for marks, 0 for the rest."""
    kind = unicodedata.category(c)[0]
    return 2 if kind == "L" else int(kind == "M")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each code point of the basic plane."""
    return np.array([_kind(chr(c)) for c in range(65536)], np.uint8)


def characters(texts: list[str], context: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram keys of every character of the texts, the text's number at each, and whether each text has a letter.

    A key is four 16-bit symbols, the last of them the character itself; 0 stands before the first character. The first
    context[i] characters of text i are what stands before it, and have no keys.
    """
    codes = np.frombuffer(("\0" + "\0".join(t.replace("\0", " ").lower() for t in texts)).encode("utf-32-le", "replace"), np.uint32)
    start = codes == 0
    small = np.minimum(codes, 65535).astype(np.uint16)
    kind = _kinds()[small]
    if (far := codes > 65535).any():
        every, at = np.unique(codes[far], return_inverse=True)
        kind[far] = np.array([_kind(chr(c)) for c in every], np.uint8)[at]
    sign = np.where(kind > 0, small, np.uint16(32))
    sign[start] = 0
    follows = np.empty(len(sign), bool)
    follows[0] = False
    follows[1:] = (sign[1:] == 32) & ((sign[:-1] == 32) | (sign[:-1] == 0))
    keep = ~follows
    sign, start, kind = sign[keep], start[keep], kind[keep]
    number = np.cumsum(start) - 1
    own = ~start
    if context and any(context):
        own &= np.arange(len(sign)) - np.flatnonzero(start)[number] > np.array(context)[number]
    letters = np.bincount(number[own], kind[own] == 2, len(texts)) > 0
    back = [sign]
    for _ in range(ORDER - 1):  # what stands before a start is 0
        before = np.zeros(len(sign), np.uint16)
        before[1:] = back[-1][:-1]
        before[start] = 0
        back.append(before)
    key = back[0].astype(np.uint64)
    for i, b in enumerate(back[1:], 1):
        key |= b.astype(np.uint64) << np.uint64(16 * i)
    return key[own], number[own], letters


def _end(text: str) -> str:
    """The last characters of a text as they count: three or more, the first of them no space."""
    out: list[str] = []
    for c in reversed(text.lower()):
        c = c if _kind(c) else " "
        if c != " " or out[-1:] != [" "]:
            out.append(c)
        if len(out) >= ORDER - 1 and out[-1] != " ":
            break
    return "".join(reversed(out)).lstrip(" ")


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """(row numbers, texts, context) of a batch, PIECE characters at a time; null is an empty text.

    A long text is several, each with the end of the one before it.
    """
    rows, texts, context, size = [], [], [], 0
    for at in range(batch.num_rows):
        text, before = batch.column(column)[at].as_py() or "", ""
        for k in range(0, max(1, len(text)), PIECE):
            part = before + text[k : k + PIECE]
            if rows and size + len(part) > PIECE:
                yield rows, texts, context
                rows, texts, context, size = [], [], [], 0
            rows.append(at)
            texts.append(part)
            context.append(len(before))
            size += len(part)
            if k + PIECE < len(text):
                before = _end(part)
    if rows:
        yield rows, texts, context


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, key, n: the 4-grams of docs (text, lang), merged in each task and summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> list:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return [(keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                [(keys, n)] = merged(parts)
                yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for rows, texts, context in pieces(batch, 0):
                keys, number, _ = characters(texts, context)
                own = np.array([langs[r] for r in rows], object)
                for lang in dict.fromkeys(own):
                    held.setdefault(lang, []).append(np.unique(keys[(own == lang)[number]], return_counts=True))
                    if len(held[lang]) > 16:
                        held[lang] = merged(held[lang])
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2_000_000:
                yield from out()
        yield from out()

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _last(key: Column, order: int) -> Column:
    """The last `order` symbols of a key."""
    return key if order == ORDER else key.bitwiseAND(F.lit((1 << (16 * order)) - 1))


def _context(key: Column) -> Column:
    return F.shiftrightunsigned(key, 16)


class Model:
    """Kneser-Ney models of all languages side by side, as tables.

    chances: order, key, values (the interpolated probability of a seen n-gram's last symbol, an array over langs, null
    where a language has not seen it). rests: order, key (a context), values (what is left for the order below).
    """

    def __init__(self, langs: list[str], symbols: int, chances: DataFrame | None, rests: DataFrame | None) -> None:
        self.langs, self.symbols, self.chances, self.rests = langs, symbols, chances, rests
        self.limits = np.zeros((len(langs), 3))

    def logs_of(self, keys: DataFrame) -> DataFrame:
        """key, logs: the log probability of each key's last symbol in every language, for keys (key), no key twice."""
        nothing = F.array_repeat(F.lit(None).cast("double"), len(self.langs))
        below = None
        for order in range(1, ORDER + 1):
            own = keys if order == ORDER else keys.select(_last(F.col("key"), order).alias("key")).distinct()
            chance = self.chances.where(F.col("order") == order).select("key", F.col("values").alias("chance"))
            rest = self.rests.where(F.col("order") == order).select(F.col("key").alias("context"), F.col("values").alias("rest"))
            own = own.join(chance, "key", "left").withColumn("context", _context(F.col("key"))).join(rest, "context", "left")
            if below is None:
                own = own.withColumn("lower", F.array_repeat(F.lit(1 / self.symbols), len(self.langs)))
            else:
                own = own.withColumn("shorter", _last(F.col("key"), order - 1)).join(below, "shorter")
            unseen = F.zip_with(F.coalesce("rest", nothing), "lower", lambda w, p: F.coalesce(w, F.lit(1.0)) * p)
            values = F.zip_with(F.coalesce("chance", nothing), unseen, lambda p, q: F.coalesce(p, q))
            below = own.select(F.col("key").alias("shorter"), values.alias("lower"))
            if order < ORDER:  # one short plan an order: the driver plans and holds few joins at a time
                below = spool(below, "lower")
        return below.select(F.col("shorter").alias("key"), F.transform("lower", lambda p: F.log(p).cast("float")).alias("logs"))


def train(grams: DataFrame) -> Model:
    """The model of grams (lang, key, n), every 4-gram once a language."""
    orders = {ORDER: spool(grams, "counts")}
    for order in range(ORDER - 1, 0, -1):  # how many different symbols stand before the shorter n-gram
        orders[order] = orders[order + 1].groupBy("lang", _last(F.col("key"), order).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    table = None
    for order, part in orders.items():
        part = part.select(F.lit(order).alias("order"), "lang", "key", "n")
        table = part if table is None else table.union(part)
    table = spool(table, "grams")
    few = lambda k: F.sum((F.col("n") == k).cast("long")).alias(f"n{k}")
    facts = table.groupBy("order", "lang").agg(few(1), few(2)).collect()  # a row for each order of each language
    langs = sorted({r["lang"] for r in facts})
    if not langs:
        return Model([], 1, None, None)
    symbols = table.where("order = 1").select("key").distinct().count() + 1
    rows = [(r["order"], r["lang"], langs.index(r["lang"]), min(0.95, max(0.1, r["n1"] / max(1, r["n1"] + 2 * r["n2"])))) for r in facts]
    discounts = table.sparkSession.createDataFrame(rows, "order int, lang string, no int, discount double")
    table = table.join(F.broadcast(discounts), ["order", "lang"])
    contexts = table.groupBy("order", "no", _context(F.col("key")).alias("context")).agg(
        F.sum("n").alias("total"), (F.first("discount") * F.count(F.lit(1)) / F.sum("n")).alias("rest")
    )
    contexts = spool(contexts, "contexts")
    chances, below, held = None, None, []
    for order in range(1, ORDER + 1):
        part = table.where(F.col("order") == order).withColumn("context", _context(F.col("key")))
        part = part.join(contexts.where(F.col("order") == order).drop("order"), ["no", "context"])
        lower = F.lit(1 / symbols)
        if below is not None:
            part, lower = part.withColumn("shorter", _last(F.col("key"), order - 1)).join(below, ["no", "shorter"]), F.col("lower")
        own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        # one short plan an order, since each needs all below it: in one plan their joins grow with the square of the orders
        part = spool(part.select(F.lit(order).alias("order"), "no", "key", (own + F.col("rest") * lower).alias("value")), "chance")
        held.append(part)
        below = part.select("no", F.col("key").alias("shorter"), F.col("value").alias("lower"))
        chances = part if chances is None else chances.union(part)

    def wide(rows: DataFrame) -> DataFrame:
        """order, key, values from (order, no, key, value)."""
        columns = list(range(len(langs)))
        pivoted = rows.groupBy("order", "key").pivot("no", columns).agg(F.first("value"))
        return pivoted.select("order", "key", F.array(*[F.col(str(c)) for c in columns]).alias("values"))

    rests = contexts.select("order", "no", F.col("context").alias("key"), F.col("rest").alias("value"))
    model = Model(langs, symbols, spool(wide(chances), "chances"), spool(wide(rests), "rests"))
    for part in held:
        drop_spool(part)
    return model


def fit(learn: DataFrame) -> Model:
    """The model of the languages in learn (doc_id, text, lang); rows without lang teach nothing."""
    learn = learn.where("lang is not null and text is not null")
    model = train(count_ngrams(learn))
    if not model.langs:
        # texts without a single character teach nothing either
        return model
    scored = predict(learn.select("doc_id", "text", "lang"), model, ["lang"]).where("lang = lang_pred and n_signs > 0")
    scored = spool(scored.select(F.col("lang").alias("by"), "entropy", "n_signs"), "calibration")
    usual = medians(scored.select("by", F.col("entropy").alias("value")))
    model.limits[:, 0] = [usual.get(lang, math.inf) for lang in model.langs]
    if usual:
        known = learn.sparkSession.createDataFrame(list(usual.items()), "by string, usual double")
        off = F.abs(F.col("entropy") - F.col("usual"))
        both = F.array(F.struct(F.concat(F.lit("off "), "by").alias("by"), off.alias("value")), F.struct(F.concat(F.lit("each "), "by").alias("by"), (off * F.sqrt("n_signs")).alias("value")))
        spread = medians(scored.join(F.broadcast(known), "by").select(F.inline(both)))
        for i, name in enumerate(("off", "each"), 1):
            model.limits[:, i] = [1.4826 * spread.get(f"{name} {lang}", 0) for lang in model.langs]
    return model


def medians(values: DataFrame) -> dict[str, float]:
    """The exact median of each group of values (by, value), of which no task holds a whole one.

    Different values are counted and dealt out in order; sums by partition tell where the middle is, and only there are
    counts summed up value by value. That is three short jobs, however the values are spread.
    """
    counts = values.groupBy("by", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartitionByRange(partitions(values.sparkSession), "by", "value").withColumn("part", F.spark_partition_id())
    counts = spool(counts, "ranked")
    parts = counts.groupBy("by", "part").agg(F.sum("n").alias("inside"))
    parts = parts.withColumn("upto", F.sum("inside").over(Window.partitionBy("by").orderBy("part")))
    parts = parts.withColumn("all", F.sum("inside").over(Window.partitionBy("by")))
    parts = parts.withColumn("k", F.explode(F.array_distinct(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)))))
    middle = parts.where("k < upto and k >= upto - inside").select("by", "part", "k", (F.col("upto") - F.col("inside")).alias("before"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("by", "k").orderBy("value"))
    found = counts.join(F.broadcast(middle), ["by", "part"]).withColumn("upto", upto).where("k < upto and k >= upto - n")
    return {r["by"]: r["median"] for r in found.groupBy("by").agg(F.avg("value").alias("median")).collect()}


class HashArray:
    """Log probabilities by key: sorted 64-bit hashes (an odd factor, so no two keys have the same) and values beside them."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, logs: np.ndarray) -> None:
        hashes = keys.view(np.uint64) * self.FACTOR
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[order]

    def index(self) -> np.ndarray:
        """Where the hashes with each leading INDEX_BITS bits start."""
        top = (self.hashes >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(np.bincount(top, minlength=1 << INDEX_BITS))[:-1]]).astype(np.int32)

    def find(self, keys: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are there."""
        hashes = keys * self.FACTOR
        at = index[(hashes >> np.uint64(64 - INDEX_BITS)).astype(np.int64)]
        todo = np.flatnonzero(self.hashes[at] != hashes)
        while len(todo):
            at[todo] += 1
            todo = todo[self.hashes[at[todo]] != hashes[todo]]
        return self.logs[at]


def _verdicts(langs: list[str], limits: np.ndarray, sums: np.ndarray, signs: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
    """lang_pred, score, entropy, n_signs, rejected from the summed log probabilities of each text."""
    entropy = -sums / np.maximum(signs, 1)[:, None]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(len(best)), best]
    score = np.where(letters, 1 / np.exp((least[:, None] - entropy) * np.minimum(signs, 100)[:, None]).sum(axis=1), 0.0)
    usual, spread, each = (limits[best] if langs else np.zeros((len(best), 3))).T
    with np.errstate(invalid="ignore"):
        far = least > usual + FAR * np.sqrt(spread**2 + each**2 / np.maximum(signs, 1)) + MARGIN
    names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return [pa.array(names, pa.string()), pa.array(score), pa.array(np.where(letters, least, 0.0)), pa.array(signs), pa.array(~letters | far)]


VERDICT = ["lang_pred", "score", "entropy", "n_signs", "rejected"]
VERDICT_TYPES = "lang_pred string, score double, entropy double, n_signs long, rejected boolean"


def predict(docs: DataFrame, model: Model, keep: list[str] = [], max_cells: int = MAX_CELLS) -> DataFrame:  # noqa: B006
    """docs' doc_id and columns `keep` (text may be one), with lang_pred, score, entropy (nats a character), n_signs, rejected."""
    plain = [c for c in keep if c != "text"]
    kept = docs.select("text", "doc_id", *plain)
    shape = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)) + ", " + VERDICT_TYPES
    if model.langs:
        keys = spool(count_ngrams(kept.select("text", F.lit("").alias("lang"))).select("key"), "keys")
        table = spool(model.logs_of(keys), "logs")
        if table.count() * len(model.langs) > max_cells:
            return _joined(kept, model, table, keep, shape)
        rows = table.toArrow()  # max_cells numbers at most
        flat = rows.column("logs").combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.float32)
        array = HashArray(rows.column("key").to_numpy(), flat.reshape(-1, len(model.langs)))
    else:
        array = None
    langs, limits = model.langs, model.limits
    shared = docs.sparkSession.sparkContext.broadcast(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = shared.value
        index = array.index() if array else None
        for batch in batches:
            sums, signs = np.zeros((batch.num_rows, max(1, len(langs)))), np.zeros(batch.num_rows, np.int64)
            letters = np.zeros(batch.num_rows, bool)
            for rows, texts, context in pieces(batch, 0) if langs else []:
                keys, number, has = characters(texts, context)
                logs = array.find(keys, index)
                own = np.stack([np.bincount(number, logs[:, j], len(texts)) for j in range(logs.shape[1])], axis=1)
                np.add.at(sums, rows, own)
                np.add.at(signs, rows, np.bincount(number, minlength=len(texts)))
                np.logical_or.at(letters, rows, has)
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays(own + _verdicts(langs, limits, sums, signs, letters), ["doc_id", *keep, *VERDICT])

    return kept.mapInArrow(run, shape)


def _joined(kept: DataFrame, model: Model, table: DataFrame, keep: list[str], shape: str) -> DataFrame:
    """predict for a table of log probabilities of any size: joined with the documents' 4-grams."""
    docs = spool(kept.withColumn("__at", F.monotonically_increasing_id()), "asked")
    langs, limits = model.langs, model.limits

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """__at, key, n, letters of every text; texts without any have one row without a key."""
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for rows, texts, context in pieces(batch, 0):
                keys, number, has = characters(texts, context)
                at, order = ids[np.array(rows)], np.lexsort((keys, number))
                keys, number = keys[order], number[order]
                new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (number[1:] != number[:-1])])) if len(keys) else np.empty(0, np.int64)
                n = np.diff(np.append(new, len(keys)))
                key, no = keys[new].view(np.int64), number[new]
                cols = [pa.array(np.concatenate([at[no], at])), pa.concat_arrays([pa.array(key), pa.nulls(len(at), pa.int64())])]
                cols += [pa.array(np.concatenate([n, np.zeros(len(at), np.int64)])), pa.array(np.concatenate([has[no], has]))]
                yield pa.record_batch(cols, ["__at", "key", "n", "letters"])

    found = docs.select("text", "__at").mapInArrow(grams, "__at long, key long, n long, letters boolean").join(table, "key", "left")
    sums = [F.coalesce(F.sum(F.col("n") * F.col("logs")[j]), F.lit(0.0)) for j in range(len(langs))]
    summed = found.groupBy("__at").agg(F.array(*sums).alias("__sums"), F.sum("n").alias("__signs"), F.max("letters").alias("__letters"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            sums = np.array(col("__sums").to_pylist(), float).reshape(-1, len(langs))
            signs, letters = col("__signs").to_numpy(), col("__letters").to_numpy(zero_copy_only=False).astype(bool)
            own = [col(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays(own + _verdicts(langs, limits, sums, signs, letters), ["doc_id", *keep, *VERDICT])

    return docs.join(summed, "__at").mapInArrow(decide, shape)
