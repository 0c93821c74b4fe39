"""Toxicity by noisy-channel deobfuscation: suspicious stretches of text are restored, then restored text is scored.

Restoring: a place that looks disguised (signs or digits for letters, letters set apart, letters repeated, look-alike
letters), widened to white space or by WIDE characters, becomes a lattice: each character may stand for some letters, for
itself, for a gap or for nothing, at a channel cost. Viterbi finds the cheapest path under a trigram character model
(interpolated Kneser-Ney), whose counts come from all documents, none left out: its symbols are the letters of the Latin
alphabets up to U+017F, the gap, and one for all other letters, which bounds the table by the cube of 130. Scoring: word stems and words that labelled toxic documents use and others do not, found with
one automaton in the text and in its restored stretches; a logistic curve over the strongest and the summed evidence
gives the score.

Labels are read from learning rows only. Evidence is fitted on at most TOXIC toxic and CLEAN other learning documents,
those with the least digests of their ids. A word counts by how many different words it follows, so that one text that
was copied a thousand times does not make its words look toxic. Every stem of the sample with enough evidence counts.

Defined cases: null text is empty and scores like any text without evidence; equal texts score equally; without
labels of both kinds every score is the share of toxic labels, smoothed; rows whose label is null teach nothing; very
long texts and stretches take time in proportion; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio_spark.llm import langid
from folio_spark.llm.common import digest, spool

TOXIC, CLEAN = 4000, 8000
#: Characters around a disguised place that are restored with it, where no white space is nearer.
WIDE = 40
#: Symbols of the character model besides letters: the start of a text, any letter that is not told apart, the gap.
START, OTHER, GAP = 0, 1, 32
PREFIXES = (4, 5, 6, 7)
#: Standard errors by which a stem's log odds are lowered, and what must remain.
CAUTION, LEAST = 2.0, 1.0

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
#: Cyrillic and Greek letters that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕԁԛӏαεορυικντ", "aeopcyxijsdqlaeopuiknt", strict=True))
#: Characters without width.
UNSEEN = re.compile("[­​-‏⁠﻿]")

_L = r"[^\W\d_]"
_S = r"[0-9@$!|+€]"
DISGUISED = re.compile(
    rf"{_L}{_S}{{1,4}}{_L}|(?<![\w@$!|+€]){_S}{{1,3}}{_L}|{_L}[0-9@$|+€]{{1,3}}(?![\w@$|+€])|({_L})\1\1"
    rf"|(?<!\w){_L}(?:[ .\-_*]{{1,2}}{_L}(?!\w)){{2,}}|[{''.join(ALIKE)}]"
)
WORDS = re.compile(rf"{_L}+")
SPACE = re.compile(r"\s")


def symbol(c: str) -> int:
    """The symbol of a lower-case letter or gap in the character model."""
    code = ord(c)
    return code if c == " " or 97 <= code <= 122 or 0xDF <= code <= 0x17F else OTHER


class CharacterModel:
    """Trigram log probabilities of letters and gaps, interpolated Kneser-Ney, in sorted arrays."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        """keys: three 16-bit symbols each (unsigned, ascending); n: how often each occurs."""
        self.own: list[tuple[np.ndarray, np.ndarray]] = []
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        for order in (3, 2, 1):
            few, more = int((n == 1).sum()), int((n == 2).sum())
            d = min(0.95, max(0.1, few / max(1, few + 2 * more)))
            context, at = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            self.own.append((keys, np.maximum(n - d, 0) / total[at]))
            self.rest.append((context, d * kinds / total))
            keys, n = np.unique(keys & np.uint64((1 << (16 * (order - 1))) - 1), return_counts=True)
        self.floor = 1 / (len(self.own[2][0]) + 1)
        self.known: dict[str, float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        """Log probability of c behind a and b."""
        if (found := self.known.get(a + b + c)) is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            found = self.known[a + b + c] = math.log(self._chance(symbol(a) << 32 | symbol(b) << 16 | symbol(c)))
        return found

    def _chance(self, key: int) -> float:
        p = self.floor
        for i, bits in ((2, 16), (1, 32), (0, 48)):
            part = key & ((1 << bits) - 1)
            p = _value(*self.own[i], part, 0.0) + _value(*self.rest[i], part >> 16, 1.0) * p
        return p


def _value(keys: np.ndarray, values: np.ndarray, wanted: int, missing: float) -> float:
    at = int(np.searchsorted(keys, np.uint64(wanted)))
    return float(values[at]) if at < len(keys) and int(keys[at]) == wanted else missing


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """What each run of equal characters may stand for, with channel costs (lower is likelier)."""
    apart = sum(len(x) for x in WORDS.findall(stretch)) * 2 <= len(stretch) + 1
    out, at = [], 0
    while at < len(stretch):
        c, end = stretch[at], at + 1
        while end < len(stretch) and stretch[end] == c:
            end += 1
        run, at = end - at, end
        if c in ALIKE:
            out.append([(ALIKE[c] * min(run, 2), 0.3), (c * run, 2.0)])
        elif c.isalpha():
            out.append([(c, 0.0)] if run == 1 else [(c, 1.0), (c * 2, 0.0)] if run == 2 else [(c, 0.5), (c * 2, 0.5)])
        elif c in LEET:
            out.append([(x, 0.5) for x in LEET[c]] + [(x * 2, 1.5) for x in LEET[c] if run > 1] + [(" ", 6.0)])
        else:
            out.append([("", 0.2 if apart else 3.0), (" ", 1.0)])
    return out


def restore(stretch: str, model: CharacterModel) -> str:
    """The likeliest reading of a lower-case stretch: Viterbi over its lattice, states being the last two symbols.

    A state keeps its cost and a link to the state before it, so time and memory grow with the stretch.
    """
    states: dict[tuple[str, str], tuple[float, tuple]] = {(" ", " "): (0.0, ())}
    for options in lattice(stretch):
        following: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for emitted, channel in options:
                x, y, total = a, b, cost + channel
                for c in emitted:
                    if c == " " and y == " ":
                        continue
                    total -= model.log(x, y, c)
                    x, y = y, c
                if (x, y) not in following or total < following[x, y][0]:
                    following[x, y] = total, (path, emitted)
        states = following
    _, path = min(((cost - model.log(a, b, " "), path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])
    out = []
    while path:
        path, emitted = path
        out.append(emitted)
    return "".join(reversed(out))


def stretches(text: str) -> Iterator[str]:
    """The disguised-looking stretches of a lower-case text, widened to white space on both sides or by WIDE characters."""
    done = 0
    for m in DISGUISED.finditer(text):
        if m.start() < done:
            continue
        start, least = m.start(), max(done, m.start() - WIDE)
        while start > least and not text[start - 1].isspace():
            start -= 1
        after = SPACE.search(text, m.end(), m.end() + WIDE)
        done = after.start() if after else min(len(text), m.end() + WIDE)
        yield text[start:done]


def restored(text: str, model: CharacterModel, known: dict[str, str]) -> list[str]:
    """Readings of a text's stretches; `known` keeps readings of short stretches seen before."""
    out = []
    for s in stretches(text):
        if (reading := known.get(s)) is None:
            reading = restore(s.strip(".,;:?\"'()[]"), model)
            if len(s) <= 4 * WIDE:
                if len(known) > 100_000:
                    known.clear()
                known[s] = reading
        out.append(reading)
    return out


def plain(text: str | None) -> str:
    text = (text or "").lower()
    return text if text.isascii() else UNSEEN.sub("", text)


def stems(word: str) -> list[str]:
    """A word's features: its beginnings, and itself with a stop after it."""
    return [word[:k] for k in PREFIXES if len(word) > k] + [word + "."]


class Scorer:
    """Weighted stems and words, the character model, and the logistic curve over a document's evidence."""

    def __init__(self, model: CharacterModel | None, weights: dict[str, float], base: float) -> None:
        self.model, self.weights, self.base = model, weights, base
        self.curve = np.array([math.log(base / (1 - base)), 0.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for s, w in self.weights.items():
            bare = s.rstrip(".")
            open_, whole = out.get(bare, (0.0, 0.0))
            out.add_word(bare, (max(open_, w), whole) if s == bare else (open_, max(whole, w)))
        for bare in list(out.keys()):
            out.add_word(bare, (len(bare), *out.get(bare)))
        out.make_automaton()
        return out

    def evidence(self, text: str | None, automaton: ahocorasick.Automaton, known: dict[str, str]) -> tuple[float, float]:
        """The strongest weight found, and the log of the sum over different places' words."""
        if not self.weights:
            return 0.0, 0.0
        text, found = plain(text), {}
        for part in (text, *restored(text, self.model, known)):
            for end, (length, open_, whole) in automaton.iter(part):
                start = end - length + 1
                if start and part[start - 1].isalpha():
                    continue
                weight = max(open_, whole) if end + 1 == len(part) or not part[end + 1].isalpha() else open_
                if weight:
                    stem = part[start : start + PREFIXES[0]]
                    found[stem] = max(found.get(stem, 0.0), weight)
        return (max(found.values()), math.log1p(sum(found.values()))) if found else (0.0, 0.0)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + evidence @ self.curve[1:])))

    def fit_curve(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Newton's method with a small ridge."""
        x = np.column_stack([np.ones(len(evidence)), evidence])
        b = self.curve.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-(x @ b)))
            slope = x.T @ (toxic - p) - 0.01 * b
            b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3), slope)
        self.curve = b


def character_model(docs: DataFrame) -> CharacterModel | None:
    """The trigram model of all texts of docs."""
    grams = langid.count_ngrams(docs.where("text is not null").select("text", F.lit("").alias("lang")))
    key = F.lit(0).cast("long")
    for back in (2, 1, 0):
        code = F.shiftrightunsigned("key", 16 * back).bitwiseAND(F.lit(0xFFFF))
        plain_ = code.isin(START, GAP) | code.between(97, 122) | code.between(0xDF, 0x17F)
        key = F.shiftleft(key, 16).bitwiseOR(F.when(plain_, code).otherwise(OTHER))
    rows = grams.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toPandas()  # fewer than 130^3 rows
    return CharacterModel(rows["key"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64)) if len(rows) else None


def _stem_counts(sample: DataFrame) -> DataFrame:
    """half, stem, toxic, clean (documents with it), after (bits of hashes of the words before it in toxic ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], list[int]] = {}
        for batch in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen: dict[str, int] = {}
                before = ""
                for word in WORDS.findall(plain(text)):
                    bit = 1 << (xxhash.xxh32_intdigest(before) & 63)
                    for s in stems(word):
                        seen[s] = seen.get(s, 0) | bit
                    before = word
                for s, bits in seen.items():
                    c = counts.setdefault((half, s), [0, 0, 0])
                    c[1 - toxic] += 1
                    c[2] |= bits if toxic else 0
        rows = [(*k, a, b, bits - (1 << 64) if bits >> 63 else bits) for k, (a, b, bits) in counts.items()]
        if rows:
            names = ["half", "stem", "toxic", "clean", "after"]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), preserve_index=False)

    shape = "half long, stem string, toxic long, clean long, after long"
    found = sample.select("text", "toxic", "half").mapInArrow(run, shape)
    return found.groupBy("half", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("after").alias("after"))


def _weights(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """The stems with cautious log odds over LEAST, from counts (stem, toxic, clean, after) of a bounded sample."""
    places = -64 * F.log(F.greatest(F.lit(0.01), 1 - F.bit_count("after") / 64))
    toxic, clean = F.least(F.col("toxic").cast("double"), places), F.col("clean")
    odds = F.log((toxic + 0.5) / F.lit(n_toxic + 1.0)) - F.log((clean + 0.5) / F.lit(n_clean + 1.0))
    careful = odds - CAUTION * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    best = counts.withColumn("w", careful).where(F.col("w") > LEAST).orderBy("stem")
    return {r["stem"]: r["w"] for r in best.select("stem", "w").collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs (doc_id, text): all documents, for the character model. labels (doc_id, toxic): learning rows only."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for value, most in ((1, TOXIC), (0, CLEAN)):
        part = labels.where(F.col("toxic") == value).orderBy(digest(F.col("doc_id")), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    picked = picked.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    sample = docs.join(F.broadcast(picked), "doc_id")  # TOXIC + CLEAN rows at most
    n = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    toxic, clean = (sum(v for k, v in n.items() if k[1] == x) for x in (1, 0))
    base = (toxic + 0.5) / (toxic + clean + 1)
    if not toxic or not clean:
        return Scorer(None, {}, base)
    counts = spool(_stem_counts(sample), "stems")
    every = counts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("after").alias("after"))
    model = character_model(docs)
    # the curve is fitted on each half with the weights of the other, or it would trust what is there by chance
    found = []
    for half in (0, 1):
        other = Scorer(model, _weights(counts.where(F.col("half") == half), n.get((half, 1), 0), n.get((half, 0), 0)), base)
        own = _evidence(sample.where(F.col("half") != half), other, ["toxic"])
        found.append(own.select("toxic", "strongest", "summed").toPandas())
    found = pd.concat(found)
    scorer = Scorer(model, _weights(every, toxic, clean), base)
    scorer.fit_curve(found[["strongest", "summed"]].to_numpy(), found["toxic"].to_numpy(np.float64))
    return scorer


def _evidence(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = shared.value, {}
        automaton = scorer.automaton() if scorer.weights else None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = np.array([scorer.evidence(t, automaton, known) for t in batch.column(0).to_pylist()])
                cols = batch.columns[1:] + [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(scorer.score(found))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *keep, "strongest", "summed", "score"])

    kept = docs.select("text", "doc_id", *keep)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{shape}, strongest double, summed double, score double")


def score(docs: DataFrame, scorer: Scorer, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """docs' doc_id and columns `keep` with score and predicted."""
    found = _evidence(docs, scorer, keep)
    return found.select("doc_id", *keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "strongest")


def restored_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, readings: the restored stretches of every text of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, known = shared.value, {}
        for batch in batches:
            found = [restored(plain(t), scorer.model, known) if scorer.model else [] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], ["doc_id", "readings"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "doc_id").mapInArrow(run, f"doc_id {kind}, readings array<string>")
