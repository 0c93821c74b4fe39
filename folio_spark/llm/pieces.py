"""SentencePiece encoding that keeps every piece's place in the original text, and decoding.

A text is normalised from left to right: at each place the longest key of the model's compiled character map (a double
array) that is a prefix of the rest is replaced, anything else is copied. Every normalised character keeps the byte of
the source that it came from, so a piece, which is a stretch of normalised characters, is projected to a byte span of
the original. Pieces are merged by score, leftmost first among equals, and characters that the vocabulary lacks become
byte pieces, the last of which carries the character's span.

No piece leads over a white space mark that follows another sign, over a sign that is in no longer piece, or (in many
vocabularies) from a letter to another sign or back. So texts are cut there, and equal cuts are merged once (a memory of
bounded size); that changes no result, only the time.

Plan: one narrow Arrow pass, no shuffle. The model file is read on the driver and broadcast; its size is its vocabulary's
and does not grow with the data.

Defined cases: null text is an empty text, which has the begin and end ids only and decodes to an empty text; texts and
runs of any length are encoded whole, a run without cuts with a heap (n log n); equal ids and rows are rows of their own;
an empty table gives an empty result; other columns are kept only on request and never read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: The sign that stands for white space.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
#: Cuts that are remembered, and the longest of them.
MEMORY, LONGEST = 1 << 19, 48
#: Texts that are encoded at once.
SLICE = 64


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else (8 if key & 7 == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """A compiled character map: a double array over UTF-8 bytes whose values are places of replacements."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.replacements = compiled[4 + size :]
        starts = sorted({chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and self.starts(c)}) if size else []
        #: Characters that some key begins with.
        self.begins = re.compile("[" + "".join(map(re.escape, starts)) + "]") if starts else None

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def starts(self, code: int) -> bool:
        at = self._offset(self.units[0])
        for byte in chr(code).encode():
            at ^= byte
            unit = self.units[at]
            if unit & 0x800000FF != byte:
                return False
            at ^= self._offset(unit)
        return True

    def longest(self, data: bytes, begin: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that data has at begin, and the key's bytes."""
        at, found = self._offset(self.units[0]), None
        for i in range(begin, len(data)):
            at ^= data[i]
            unit = self.units[at]
            if unit & 0x800000FF != data[i]:
                break
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (self.units[at] & 0x7FFFFFFF, i + 1 - begin)
        if not found:
            return None
        return self.replacements[found[0] : self.replacements.index(b"\0", found[0])], found[1]


def byte_starts(data: bytes) -> np.ndarray:
    """The byte at which each character begins, and the number of bytes."""
    if data.isascii():
        return np.arange(len(data) + 1)
    return np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))


class Model:
    """A byte-pair model: normalisation, pieces with scores, ids."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != BPE or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24, 0) or not normalizer.get(5, 1):
            raise ValueError("only byte-pair models with marks before words, without user-defined and unused pieces, are read")
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        self.unknown = self.kinds.index(UNKNOWN)
        self.begin, self.end = signed(trainer.get(41, 1)), signed(trainer.get(42, 2))
        self.dummy, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.charmap = CharMap(normalizer.get(2, b""))
        normal = [(p, s, i) for i, (p, s, k) in enumerate(zip(self.pieces, scores, self.kinds, strict=True)) if k == NORMAL]
        self.id_of, self.cost = {p: i for p, _, i in normal}, {p: -s for p, s, _ in normal}
        bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if trainer.get(35, 0) else None
        #: Bytes of longer characters; those up to 127 are characters by themselves.
        self.byte_of = {i: bytes([b]) for b, i in bytes_.items() if b > 127}
        surface = trainer.get(44, " ⁇ ".encode())
        shown = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda p: surface, CONTROL: lambda p: b"", BYTE: lambda p: b""}
        self.shown = [shown[k](p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        for b, i in bytes_.items():
            self.shown[i] = bytes([b]) if b < 128 else b""
        self.memory: dict[str, bytes] = {}
        self.cuts = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Stretches that no piece leads out of: marks and what follows them, single signs that are in no longer piece."""
        longer = [p for p in self.cost if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            return re.compile(".+", re.DOTALL)
        inside = sorted({c for p in longer for c in p} - {MARK})
        mixed = any(a.isalpha() != b.isalpha() for p in longer for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:], strict=False))
        kinds = [inside] if mixed else [[c for c in inside if c.isalpha()], [c for c in inside if not c.isalpha()]]
        runs = [f"{MARK}*[{''.join(map(re.escape, k))}]+" for k in kinds if k]
        return re.compile("|".join([*runs, f"{MARK}+", "."]), re.DOTALL)

    # --- normalisation ---------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and its end, the byte of the source that it came from."""
        data = text.encode()
        if not self.charmap.begins and not self.squeeze:
            starts = byte_starts(data)
            lead = self.dummy and bool(text)
            return MARK * lead + text.replace(" ", MARK), np.concatenate([starts[:1], starts]) if lead else starts
        out: list[str] = []
        source: list[int] = []
        space = self.squeeze  # whether white space here follows white space
        lead = self.dummy
        for piece, at in self._replaced(text, data):
            if self.squeeze:
                piece, had = piece.lstrip(" ") if space else piece, piece
                if not piece:
                    continue
                space = had.endswith(" ")
            if lead:
                out.append(MARK)
                source.append(at if self.squeeze else 0)
                lead = False
            out.append(piece.replace(" ", MARK))
            source += [at] * len(piece)
        end = len(data)
        found = "".join(out)
        if self.squeeze:
            kept = found.rstrip(MARK)
            if len(kept) < len(found):
                end, found = source[len(kept)], kept
                del source[len(kept) :]
        return found, np.array([*source, end], np.int64)

    def _replaced(self, text: str, data: bytes) -> Iterator[tuple[str, int]]:
        """(replacement, byte of the source) for each longest key, or character that no key begins at."""
        starts = byte_starts(data)
        at, n = 0, len(text)
        begins = self.charmap.begins
        char_of = None
        while at < n:
            found = begins.search(text, at) if begins else None
            until = found.start() if found else n
            for i in range(at, until):
                yield text[i], int(starts[i])
            if until == n:
                return
            begin = int(starts[until])
            if hit := self.charmap.longest(data, begin):
                yield hit[0].decode(), begin
                if char_of is None:
                    char_of = {int(b): i for i, b in enumerate(starts)}
                at = char_of[begin + hit[1]]
            else:
                yield text[until], begin
                at = until + 1

    # --- pieces ----------------------------------------------------------------------------------------------------

    def merged(self, cut: str) -> list[str]:
        """The pieces of a cut: best score first, leftmost among equals, until no two neighbours are a piece."""
        parts, cost = list(cut), self.cost
        n = len(parts)
        if n <= LONGEST:
            return self._merged_short(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(cost[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in cost]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or parts[i] + parts[j] != piece:
                continue
            parts[i], parts[j] = piece, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := piece + parts[k]) in cost:
                    heapq.heappush(heap, (cost[p], i, p))
            if (h := before[i]) >= 0 and (p := parts[h] + piece) in cost:
                heapq.heappush(heap, (cost[p], h, p))
        return [p for p in parts if p]

    def _merged_short(self, parts: list[str]) -> list[str]:
        """The same without a heap: each step looks for the least cost among neighbours."""
        cost, none = self.cost.get, float("inf")
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (low := min(costs)) < none:
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
        return parts

    def _coded(self, cut: str) -> bytes:
        """(id, characters) of each piece of a cut, as pairs of 32-bit integers."""
        out: list[int] = []
        for piece in self.merged(cut):
            found = self.id_of.get(piece)
            if found is not None:
                out += (found, len(piece))
            elif self.byte_ids:
                for byte in piece.encode()[:-1]:
                    out += (self.byte_ids[byte], 0)
                out += (self.byte_ids[piece.encode()[-1]], 1)
            else:
                out += (self.unknown, 1)
        packed = struct.pack(f"<{len(out)}i", *out)
        if len(cut) <= LONGEST:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[cut] = packed
        return packed

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with begin and end, and each one's byte span in the text (empty at its start and end for those two)."""
        normal, source = self.normalise(text)
        known, coded = self.memory.get, self._coded
        pairs = np.frombuffer(b"".join([known(c) or coded(c) for c in self.cuts.findall(normal)]), "<i4").reshape(-1, 2)
        ids, sizes = pairs[:, 0], pairs[:, 1]
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = source[ends - sizes]
        ends = source[ends]
        if self.byte_ids is None and len(ids):  # unknown neighbours are one
            keep = np.append(True, ~((ids[1:] == self.unknown) & (ids[:-1] == self.unknown)))
            last = np.append(np.flatnonzero(keep)[1:] - 1, len(ids) - 1)
            ids, begins, ends = ids[keep], begins[keep], ends[last]
        size = len(text.encode())
        lead, tail = [self.begin] * (self.begin >= 0), [self.end] * (self.end >= 0)
        return (
            np.concatenate([lead, ids, tail]).astype("<u4"),
            np.concatenate([[0] * len(lead), begins, [size] * len(tail)]).astype(np.int64),
            np.concatenate([[0] * len(lead), ends, [size] * len(tail)]).astype(np.int64),
        )

    # --- decoding --------------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces say nothing, the mark before the first piece goes, byte pieces become characters."""
        if any(not 0 <= i < len(self.pieces) for i in ids):
            raise ValueError("an id is outside of the vocabulary")
        shown, byte_of = self.shown, self.byte_of
        out = [shown[i] for i in ids]
        if self.dummy or self.squeeze:
            for k, i in enumerate(ids):  # up to the first mark, or, where white space is squeezed, the first sign
                had = out[k]
                out[k] = had.removeprefix(b" ") if self.kinds[i] == NORMAL else had
                if out[k] or i in byte_of or out[k] != had and not self.squeeze:
                    break
        at = 0
        if not byte_of.keys().isdisjoint(ids):
            while at < len(ids):
                if ids[at] in byte_of:
                    until = at
                    while until < len(ids) and ids[until] in byte_of:
                        until += 1
                    out[at] = _characters(b"".join(byte_of[i] for i in ids[at:until]))
                    at = until
                at += 1
        return b"".join(out).decode()


def _characters(data: bytes) -> bytes:
    """UTF-8 as it is; every byte that is in no character becomes U+FFFD."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError as e:
        return data[: e.start] + "�".encode() + _characters(data[e.start + 1 :]) if len(data) < 256 else _long_characters(data)


def _long_characters(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                data[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            out.append(data[at : at + n])
            at += n
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@lru_cache(2)
def _parsed(data: bytes) -> Model:
    return Model(data)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def shared_model(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The model file's bytes, for every task. path is on the driver's machine; its size is the vocabulary's."""
    with open(path or default_model(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _kept(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """docs' `keep` columns under neutral names, and their shape."""
    plain = docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)])
    return plain, ", ".join(f"__k{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields))


def _mapped(docs: DataFrame, column: str, keep: list[str], run, names: list[str], shape: str) -> DataFrame:
    """docs' keep columns with what run(values) gives for the values of a column, SLICE rows at once."""
    taken = [f"__k{i}" for i in range(len(keep))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                yield pa.record_batch([*batch.columns[1:], *run(batch.column(0).to_pylist())], taken + names)

    plain = docs.select(docs[column].alias("__v"), *[docs[c].alias(n) for c, n in zip(keep, taken, strict=True)])
    kinds = ", ".join([f"{n} {plain.schema[n].dataType.simpleString()}" for n in taken] + [shape])
    return plain.mapInArrow(of, kinds).toDF(*keep, *names)


def encode(docs: DataFrame, keep: list[str], model: Broadcast | None = None) -> DataFrame:
    """docs' keep columns with ids, begins, ends: every piece of `text` and its byte span in it."""
    model = model or shared_model(docs.sparkSession)

    def run(texts: list) -> list[pa.Array]:
        own = _parsed(model.value)
        found = [own.encode(t or "") for t in texts]
        return [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in range(3)]

    return _mapped(docs, "text", keep, run, ["ids", "begins", "ends"], "ids array<long>, begins array<long>, ends array<long>")


def decode(coded: DataFrame, keep: list[str], model: Broadcast | None = None) -> DataFrame:
    """coded's keep columns with text, decoded from ids; null ids are none."""
    model = model or shared_model(coded.sparkSession)

    def run(rows: list) -> list[pa.Array]:
        own = _parsed(model.value)
        return [pa.array([own.decode(x or []) for x in rows], pa.string())]

    return _mapped(coded, "ids", keep, run, ["text"], "text string")


def facts(docs: DataFrame, model: Broadcast | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, n_covered (bytes that spans cover) of docs (doc_id, text).

    What encode() and decode() give, digested in one pass, so that ids need not travel.
    """
    model = model or shared_model(docs.sparkSession)

    def run(texts: list) -> list[pa.Array]:
        own, rows = _parsed(model.value), []
        for t in texts:
            ids, begins, ends = own.encode(t or "")
            spans = np.stack([begins, ends], 1).astype("<u8")
            text = own.decode(ids.tolist())
            rows.append((len(ids), sha256(ids.tobytes()).hexdigest(), sha256(text.encode()).hexdigest(), sha256(spans.tobytes()).hexdigest(), int((ends - begins).sum())))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)]

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "n_covered"]
    return _mapped(docs, "text", ["doc_id"], run, names, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_covered long")
