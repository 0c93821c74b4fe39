"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are dealt into groups of about GROUP by a hash of their number. A group is packed by best fit, longest first; if
it then has more bins than its tokens need, items are moved, exchanged one for one, two for one and one for two between
underfull bins, always making the fuller bin fuller (the sum of squared fills grows), until the group has no more bins
than its tokens need or no exchange between any two bins is left. The least filled bins of each group are opened again
and their pieces meet those of other groups in the next round, which has a sixteenth of the pieces; the last round is
one group of bounded size. So every task holds one group, and the sequences exceed what the tokens need by a bin or so.

Token ids are those of `tokenizers` with the vocabulary's JSON. `tokenizers` encodes 1.1 to 1.7 MB a second on a core,
which alone is over the budget of the check tool; so its vocabulary is handed to a faster merger, for texts on which both
agree by construction: no added token, no white space that the two read differently, no run over LONG_RUN characters.
All other texts are encoded by `tokenizers` itself. Tests hold the two equal.

Defined cases: null text is empty and is one piece of one token (the end mark); equal ids and repeated rows are pieces
of their own; an empty table gives an empty result; very long texts are cut into pieces of the sequence's length, the
first of which may be shorter, and runs of any length are encoded; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm.common import partitions, spool

GROUP = 4096
#: One of so many bins of a group, the least filled ones, is opened again in the next round.
REOPEN = 16
#: Characters of one run, of white space or of anything else, from which `tokenizers` encodes the text.
LONG_RUN = 1000
_LONG = re.compile(r"\s{%d}|\S{%d}" % (LONG_RUN, LONG_RUN))
#: Separators, and signs that only some engines take for white space.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to the ids that `tokenizers` gives with the JSON at path, without special tokens of its own."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    sign = _byte_of_sign()
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks = {bytes(sign[c] for c in token): i for token, i in slow.get_vocab(with_added_tokens=False).items() if token not in added}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if any(a in text for a in added) or _ODD.search(text) or len(text) > LONG_RUN and _LONG.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, capacity: int = 2048, end: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32 (and ids on request).

    A document is its tokens and the end mark; only one longer than capacity is cut, its first piece taking the rest.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end], "<u4")
                    first = len(ids) % capacity or min(capacity, len(ids))
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        part = ids[a:b]
                        rows.append((i, k, a, b - a, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
                own, piece, start, length, crc, ids = zip(*rows, strict=True) if rows else ((),) * 6
                cols = [batch.column(0).take(pa.array(own, pa.int64())), pa.array(piece, pa.int32())]
                cols += [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.record_batch(cols + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, shape)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        left, b = room.pop(at) if at < len(room) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if left > lengths[i]:
            insort(room, (left - lengths[i], b))
    return bins


def _sums(bin_: dict[int, list[int]]) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """Sums of one and of two items of a bin (items by length), with the lengths that make each sum.

    Items of equal length are alike, so a bin has fewer than sqrt(2 * capacity) of them to look at.
    """
    sizes = sorted(bin_)
    ones = {a: (a,) for a in sizes}
    twos = {a + b: (a, b) for x, a in enumerate(sizes) for b in sizes[x:] if a != b or len(bin_[a]) > 1}
    return ones, twos


class _Options:
    """What a bin can give or take back: sums, ascending, and the lengths behind each."""

    def __init__(self, bin_: dict[int, list[int]]) -> None:
        ones, twos = _sums(bin_)
        self.ones, self.twos = np.array(sorted(ones), np.int64), np.array(sorted(twos), np.int64)
        self.lengths = (ones, twos)
        self.few = np.concatenate([[0], self.ones])
        self.all = np.concatenate([self.few, self.twos])


def _gains(given: np.ndarray, back: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The most that each return (`back`, into a bin with `gap`) lets through: the largest given sum that still fits."""
    at = np.searchsorted(given, back + gap, side="right") - 1
    return np.where(at >= 0, given[np.maximum(at, 0)] - back, 0) if len(given) else np.zeros(len(back), np.int64)


def _exchanges(giver: _Options, takers: list[_Options], gaps: np.ndarray) -> list[tuple[int, int, tuple[int, ...], tuple[int, ...]]]:
    """(taker's place, gain, lengths given, lengths returned): the best exchange for each taker that has one."""
    best: dict[int, tuple[int, tuple[int, ...], tuple[int, ...]]] = {}
    for kind, given, backs in ((0, giver.ones, [t.all for t in takers]), (1, giver.twos, [t.few for t in takers])):
        starts = np.cumsum([0] + [len(b) for b in backs[:-1]])
        back = np.concatenate(backs)
        gain = _gains(given, back, np.repeat(gaps, [len(b) for b in backs]))
        most = np.maximum.reduceat(gain, starts)
        for k in np.flatnonzero(most > 0).tolist():
            if k in best and best[k][0] >= most[k]:
                continue
            at = int(starts[k] + np.argmax(gain[starts[k] : starts[k] + len(backs[k])]))
            r = int(back[at])
            ones, twos = takers[k].lengths
            returned = () if at == starts[k] else ones[r] if at - starts[k] < len(takers[k].few) else twos[r]
            best[k] = int(most[k]), giver.lengths[kind][r + int(most[k])], returned
    return [(k, *best[k]) for k in best]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Fewer bins, if exchanges from emptier to fuller bins can empty some.

    Givers are taken from the emptiest on; a giver without an exchange is looked at again only against bins that have
    changed since. So the search ends where the bins are as few as the lengths allow or no exchange between two of them is left.
    """
    need = -(-sum(lengths) // capacity)
    held: list[dict[int, list[int]]] = []
    for b in bins:
        held.append({})
        for i in b:
            held[-1].setdefault(lengths[i], []).append(i)
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    changed, seen = np.zeros(len(bins), np.int64), np.full(len(bins), -1, np.int64)
    options: list[_Options | None] = [None] * len(bins)
    live, clock, moved = len(bins), 0, True

    def move(a: int, b: int, sizes: tuple[int, ...]) -> None:
        for n in sizes:
            held[b].setdefault(n, []).append(held[a][n].pop())
            if not held[a][n]:
                del held[a][n]

    def option(b: int) -> _Options:
        if (found := options[b]) is None:
            found = options[b] = _Options(held[b])
        return found

    while moved and live > need:
        moved = False
        for g in [g for g in np.argsort(fill, kind="stable").tolist() if fill[g]]:
            while live > need and fill[g]:
                takers = np.flatnonzero((fill >= fill[g]) & (fill < capacity) & (fill > 0) & (changed > seen[g]))
                takers = takers[takers != g]
                takers = takers[np.argsort(-fill[takers], kind="stable")]
                seen[g] = clock
                if not len(takers):
                    break
                found = _exchanges(option(g), [option(t) for t in takers.tolist()], capacity - fill[takers])
                if not found:
                    break
                for k, gain, given, returned in sorted(found):
                    if any(len(held[g].get(n, ())) < given.count(n) for n in given):
                        continue  # given to another already
                    t = int(takers[k])
                    move(g, t, given)
                    move(t, g, returned)
                    fill[g] -= gain
                    fill[t] += gain
                    clock += 1
                    changed[t] = changed[g] = clock
                    options[t] = options[g] = None
                    seen[t] = -1
                seen[g], moved = -1, True
            live -= int(not fill[g])
    return [[i for part in b.values() for i in part] for b in held if b]


def _packer(capacity: int, reopen: int):
    """The function that packs one group; the least filled of each `reopen` bins is marked to be packed again."""

    def of_group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "uid"], ascending=[False, True])
        uids, lengths = part["uid"].tolist(), part["length"].tolist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        bins.sort(key=lambda b: (sum(lengths[i] for i in b), b))
        rows = []
        for k, b in enumerate(bins):
            again, at, name = bool(reopen) and k < -(-len(bins) // reopen), 0, min(uids[i] for i in b)
            for i in sorted(b):
                rows.append((uids[i], name, at, lengths[i], again))
                at += lengths[i]
        return pd.DataFrame(rows, columns=["uid", "sequence_id", "offset", "length", "again"])

    return of_group


def pack(items: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """uid, sequence_id, offset of items (uid, length), uid unique. A sequence is named by its least uid."""
    if items.where(F.col("length") > capacity).limit(1).count():
        raise ValueError("an item is longer than the capacity")
    done = items.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = items.where(F.col("length") < capacity).select("uid", "length")
    for round_ in range(64):
        groups = max(1, -(-todo.count() // group))
        reopen = 0 if groups == 1 else REOPEN

        dealt = todo.withColumn("g", F.pmod(F.xxhash64(F.lit(round_), "uid"), F.lit(groups)))
        packed = spool(
            dealt.repartition(min(groups, partitions(items.sparkSession)), "g")  # by number, so that no groups are put together
            .groupBy("g")
            .applyInPandas(_packer(capacity, reopen), "uid long, sequence_id long, offset long, length long, again boolean"),
            "packed",
        )
        done = done.unionByName(packed.where("not again").select("uid", "sequence_id", "offset"))
        todo = packed.where("again").select("uid", "length")
        if groups == 1:
            return done
    raise RuntimeError("rounds of packing did not end")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    pieces = spool(token_pieces(docs, capacity, vocabulary=vocabulary).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("uid", "length"), capacity), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token sequences of packed (sequence_id, offset, ids); a sequence is of bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
