"""Each operator against brute force or a round trip, with nulls, empty and long texts, ties, repeated rows, no rows."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio_spark.llm import ann, codes, graph, html_main, langid, line_dedup, media, merkle, mixing, packing, pieces, sharding, simhash, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()
TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def docs(spark, rows):
    """(doc_id, text[, source]) as documents, with columns named like the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else None) for r in rows]
    return spark.createDataFrame(full, TEXT).withColumn("score", F.lit("x")).withColumn("size", F.lit(-1))


ODD = [(1, None), (2, ""), (3, "  \n\n "), (4, "one"), (4, "one"), (None, "no id here"), (5, "a " * 30000), (6, "é ü ß 漢字 \U0001f600")]


# --- sharding -----------------------------------------------------------------------------------------------------


def test_shards_are_a_permutation(spark):
    rows = spark.createDataFrame([(i % 50, i) for i in range(1003)] + [(None, 7)] * 40, "a long, b long")
    found = sharding.feistel_shards(rows, ["a", "b"], 7).collect()
    per = defaultdict(list)
    for r in found:
        per[r["shard"]].append(r["slot"])
    sizes = [len(x) for x in per.values()]
    assert sum(sizes) == 1043 and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    again = sharding.feistel_shards(rows.repartition(5), ["a", "b"], 7)
    assert Counter(map(tuple, found)) == Counter(map(tuple, again.collect()))


def test_numbers_follow_digests_and_permute_is_one_to_one(spark):
    rows = spark.createDataFrame([(i,) for i in range(300)], "a long")
    number = {r["a"]: r["row_number"] for r in sharding.number_rows(rows, ["a"], 3).collect()}
    digest = lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest()
    assert [a for a, _ in sorted(number.items(), key=lambda x: x[1])] == sorted(range(300), key=lambda i: (digest(i), i))
    for n in (1, 2, 3, 10, 257, 1000):
        got = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), F.lit(n), 5)).collect()]
        assert sorted(got) == list(range(n))


def test_no_rows_to_shard(spark):
    assert sharding.feistel_shards(spark.createDataFrame([], "a long"), ["a"], 4).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------


def water_fill(sizes, repeats=3):
    """Targets by sharing again and again, as the rule is worded."""
    names = sorted([n for n in sizes if n is not None]) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    left, fixed, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > repeats * sizes[n] + 1e-9]
        if not over:
            return fixed | share
        for n in over:
            fixed[n] = repeats * sizes[n]
            left -= fixed[n]
            open_.discard(n)
    return fixed


def test_targets_and_taken_words(spark):
    rows = [(i, words(i, 20 + i % 90), ["a", "b", "c", "tiny", None][min(4, i % 7)] if i % 7 != 3 or i < 30 else "a") for i in range(900)]
    found = mixing.mix(mixing.sized(docs(spark, rows)), block_words=16).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = water_fill(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 16 * 12
    again = mixing.mix(mixing.sized(docs(spark, rows).repartition(3)), block_words=16).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_blocks_hold_what_is_taken(spark):
    rows = [(i, words(i, 1 + i % 50), "ab"[i % 2]) for i in range(200)]
    sized = mixing.sized(docs(spark, rows))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(sized, block_words=8).collect()}
    blocks = mixing.mix_blocks(sized, block_words=8)
    by_doc = {r["doc_id"]: r["n"] for r in blocks.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert {k: v for k, v in taken.items() if v} == by_doc
    assert max(r["n"] for r in blocks.groupBy("slot").agg(F.sum("n_words").alias("n")).collect()) <= 8


def test_mix_odd_rows(spark):
    found = mixing.mix(mixing.sized(docs(spark, ODD))).collect()
    assert len(found) == len(ODD) and all(r["taken"] == 0 for r in found if r["size"] == 0)
    assert mixing.mix(mixing.sized(docs(spark, []))).count() == 0


# --- SimHash ------------------------------------------------------------------------------------------------------


def fingerprint(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_components_against_all_pairs(spark):
    rows = [(i, words(i // 3, 150) + (" Tail" if i % 3 == 1 else "  TAIL" if i % 3 == 2 else "")) for i in range(60)] + [(r[0] + 1000, r[1]) for r in ODD if r[0]]
    found = {(r["doc_id"], r["fingerprint"] & (2**64 - 1)): r["component_id"] for r in simhash.simhash_components(docs(spark, rows)).collect()}
    values = [fingerprint(t) for _, t in rows]
    roots = brute_components(values, 2)
    least = defaultdict(lambda: 10**9)
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(least[r], i)
    assert found == {(i, v): least[r] for (i, _), v, r in zip(rows, values, roots, strict=True)}


def test_no_link_is_lost_in_cut_shards(spark):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 2**62))
    values = {base} | {base ^ sum(1 << int(b) for b in set(r.integers(0, 64, k))) for k in (1, 2, 3, 4) for _ in range(60)}
    values |= {int(x) for x in r.integers(0, 2**62, 80)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 2, max_shard=8)
    from folio_spark.llm.graph import components

    root = {x["node"]: x["root"] for x in components(links).collect()}
    roots = brute_components([v & (2**64 - 1) for v in signed], 2)
    want, got = defaultdict(set), defaultdict(set)
    for v, i in zip(signed, roots, strict=True):
        want[i].add(v)
        got[root.get(v, v)].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_bk_tree_search():
    r = np.random.default_rng(2)
    values = sorted({int(x) for x in r.integers(0, 2**16, 300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::29]:
        assert {tree.values[i] for i in tree.within(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}


def test_near_duplicates(spark):
    base = [words(i, 300) for i in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:4]):
        w = t.split()
        for k in (60, 200):
            w[k] = "changed"
        rows += [(100 + i, " ".join(w)), (200 + i, t.upper())]
    rows += [(300, None), (301, ""), (302, "short text"), (303, "short text")]
    for most in (simhash.MAX_SHARD, 2):
        found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows), max_shard=most).collect()}
        assert all(found[100 + i] == found[200 + i] == i for i in range(4)) and all(found[i] == i for i in range(8))
        assert found[300] == found[301] == 300 and found[302] == found[303] == 302


def test_near_duplicates_by_exact_similarity(spark):
    r, rows = np.random.default_rng(3), []
    for i in range(150):  # texts of 100 words, the second with its end replaced: similarities of 0.65 to 0.95
        w = [f"w{x}" for x in r.integers(0, 10**6, 100)]
        cut = 80 + i % 20
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:cut] + [f"w{x}" for x in r.integers(0, 10**6, 100 - cut)]))]
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t in rows]
    for i in range(0, 300, 2):
        assert (found[i + 1] == i) == (len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])) and found[i] == i


def test_small_graphs_are_joined_up_like_large_ones(spark, monkeypatch):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(-300, 300, (250, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, None), (5, 5)]
    links = spark.createDataFrame(edges, "u long, v long")
    small = {tuple(x) for x in graph.components_of_numbers(links).collect()}
    monkeypatch.setattr(graph, "FEW", 10)
    assert small == {tuple(x) for x in graph.components_of_numbers(links).collect()} == {tuple(x) for x in graph.components(links).collect()}
    monkeypatch.undo()
    assert graph.components_of_numbers(links.limit(0)).count() == 0


def test_near_duplicates_are_of_sets(spark, monkeypatch):
    """Repeated passages, short texts, unequal lengths, a large group of near copies: always the components of all pairs."""
    r, rows = np.random.default_rng(8), []
    own = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    add = lambda w: rows.append((len(rows), " ".join(w)))
    for again in (0, 10, 200):  # a line that a copy repeats counts once
        w, line = own(300), own(12)
        add(w)
        add(w + line * again)
    for n in (6, 8, 12, 30):  # short texts, and those that are a part of another
        for _ in range(6):
            w = own(n)
            add(w)
            add(w[: n - n // 6])
            add(w + own(n // 5))
    base = own(60)
    for _ in range(60):  # near copies, of each other or only of some
        w = list(base)
        for i in r.integers(0, 60, r.integers(0, 4)):
            w[i] = own(1)[0]
        add(w)
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t in rows]
    want = list(range(len(rows)))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                want[b] = a
    for most, chunk in ((simhash.MAX_SHARD, simhash.CHUNK), (4, 8)):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs(spark, rows), max_shard=most).collect()}
        assert found == {i: root(i) for i in range(len(rows))}


# --- media --------------------------------------------------------------------------------------------------------


def test_text_media_facts(spark):
    found = media.text_media_facts(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by = {(r["doc_id"], r["n_bytes"]): r for r in found}
    for i, text in ODD:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64) if data else bytes(64)
        r = by[i, len(data)]
        assert r["payload_bytes"] == len(padded) and r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        rows = np.frombuffer(padded, np.uint8).reshape(-1, 64)
        stored = io.BytesIO()
        np.save(stored, rows)
        assert r["media_bytes"] == len(stored.getvalue()) and r["media_sha256"] == hashlib.sha256(stored.getvalue()).hexdigest()
        fine = np.kron(rows.astype(float), np.ones((8, 9)))  # a whole number of samples to each of 8 x 9 fields
        means = fine.reshape(8, len(rows), 9, 64).mean(axis=(1, 3)) if len(rows) < 200 else media.resize_area(rows, 8, 9)
        assert r["feature"] == np.packbits(np.diff(means, axis=1) > 1e-3).tobytes().hex()


def test_area_resize_is_a_mean_over_areas():
    r = np.random.default_rng(3)
    image = r.integers(0, 256, (7, 10)).astype(np.uint8)
    fine = np.kron(image.astype(float), np.ones((4 * 1, 3 * 1)))  # 28 x 30: divisible by 4 x 6
    assert np.allclose(media.resize_area(image, 4, 6), fine.reshape(4, 7, 6, 5).mean(axis=(1, 3)))


def test_decoders():
    r = np.random.default_rng(4)
    grey, colour = r.integers(0, 256, (5, 6)).astype(np.uint8), r.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert (media.decode(media.pgm_bytes(grey)) == grey).all()
    assert (media.decode(b"P6\n# note\n6 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2 2 1 4\n0 4\n") == [[0, 255]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    rows = b"".join(colour[i, :, ::-1].tobytes() + b"\0\0" for i in range(4, -1, -1))
    bmp = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (6).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    assert (media.decode(bmp + rows) == colour).all()
    assert media.decode(None) is None and media.decode(b"P5\n9 9\n255\nshort") is None and media.decode(b"GIF89a") is None


@pytest.mark.parametrize(
    "data",
    [
        b"P5 0 0 255\n", b"P5\n0 5\n255\n", b"P2 1 1 255\n999999999999999999999999\n", b"P2 1 1 255\n300\n", b"P2 1 1 255\n-1\n", b"P5 1 1 7\n\xff",
        b"P4 9999999 9999999\n\0", b"P6 99999999999999999999 9 255\n", b"P1 2 2\n1 0\n", b"BM" + bytes(52), b"BM" + b"\xff" * 80, b"P5", b"P3 1 1 255\n1 2 x",
    ],
)
def test_bad_images_give_nulls(spark, data):
    assert media.decode(data) is None
    assert [tuple(r) for r in media.tiles(spark.createDataFrame([(bytearray(data),)], "data binary"), "data", 4, 4).select("tile", "dhash").collect()] == [(None, None)]


def test_tiles(spark):
    image = media.pgm_bytes(np.arange(64, dtype=np.uint8).reshape(8, 8))
    df = spark.createDataFrame([(1, bytearray(image)), (2, None), (3, bytearray(b"no image"))], "tile int, data binary")
    found = {r["dhash"] is not None: r for r in media.tiles(df, "data", 4, 4).collect()}
    assert media.npy_array(bytes(found[True]["tile"])).shape == (4, 4) and found[False]["tile"] is None


# --- language ID --------------------------------------------------------------------------------------------------

LATIN = {"aa": "abcdef", "bb": "ghijkl"}


def spell(lang, seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join("".join(LATIN[lang][i] for i in r.integers(0, 6, 5)) for _ in range(n))


def test_languages(spark):
    rows = [(i, spell(lang, i), lang) for i, lang in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "hm", None)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(learn)
    asked = [(1, spell("aa", 500)), (2, spell("bb", 501)), (3, None), (4, ""), (5, "123 !?"), (6, "ωψχφ " * 200), (7, spell("aa", 502, 30000))]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, asked), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert got[6]["rejected"] and not got[1]["rejected"] and not got[7]["rejected"] and got[3]["rejected"] and got[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())


class PlainModel:
    """Interpolated Kneser-Ney by the textbook, in dictionaries, for one language."""

    def __init__(self, texts, symbols):
        self.counts, self.symbols = {4: Counter()}, symbols
        for t in texts:
            for k in range(3, len(t)):
                self.counts[4][t[k - 3 : k + 1]] += 1
        for order in (3, 2, 1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.discount = {}
        for order, c in self.counts.items():
            once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
            self.discount[order] = min(0.95, max(0.1, once / max(1, once + 2 * twice)))

    def chance(self, gram):
        order = len(gram)
        if not order:
            return 1 / self.symbols
        after = {g: n for g, n in self.counts[order].items() if g[:-1] == gram[:-1]}
        lower = self.chance(gram[1:])
        if not after:
            return lower
        total, d = sum(after.values()), self.discount[order]
        return max(0, after.get(gram, 0) - d) / total + d * len(after) / total * lower


def folded(text):
    """Three starts, then letters and marks in lower case, any others as one blank."""
    import unicodedata

    signs = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    return "\0\0\0" + re.sub(" +", " ", signs).lstrip(" ")


def test_cross_entropies_against_plain_kneser_ney(spark):
    learn = [("aa", "abracadabra, alakazam! Abra 12 cadabra"), ("aa", "banana ananas"), ("bb", "hocus pocus Fidibus"), ("bb", "simsalabim  bim"), ("cc", "été où ça")]
    model = langid.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(learn)], "doc_id long, text string, lang string"))
    symbols = len({c for _, t in learn for c in folded(t)[3:]}) + 1
    plain = {k: PlainModel([folded(t) for lang, t in learn if lang == k], symbols) for k in ("aa", "bb", "cc")}
    asked = ["abra", "xyz hocus", "où", "bim bam 7 bum", "ω", "Banana été"]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, list(enumerate(asked))), model).collect()}
    for i, t in enumerate(asked):
        t = folded(t)
        entropy = {k: -sum(math.log(m.chance(t[j - 3 : j + 1])) for j in range(3, len(t))) / (len(t) - 3) for k, m in plain.items()}
        best = min(entropy, key=lambda k: (entropy[k], k))
        assert got[i]["lang_pred"] == best and got[i]["entropy"] == pytest.approx(entropy[best], abs=1e-5)
    seen = {c for m in plain.values() for c in m.counts[1]} | {"?"}
    assert sum(plain["aa"].chance("ban"[-3:] + c) for c in seen) == pytest.approx(1)


def test_more_than_64_languages_and_tables_of_any_size(spark):
    rows = [(100 * k + i, " ".join(chr(0x4E00 + 40 * k + j) for j in np.random.default_rng(100 * k + i).integers(0, 40, 30)), f"l{k:02}") for k in range(70) for i in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 70
    asked = docs(spark, [(i, t) for i, t, _ in rows] + ODD)
    small, large = (langid.predict(asked, model, ["text"], max_cells=m).collect() for m in (langid.MAX_CELLS, 0))
    assert {(r["doc_id"], r["lang_pred"]) for r in small if r["doc_id"] and r["doc_id"] >= 100} == {(i, k) for i, _, k in rows if i >= 100}
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    for a, b in zip(sorted(small, key=key), sorted(large, key=key), strict=True):
        assert key(a) == key(b) and a["lang_pred"] == b["lang_pred"] and a["rejected"] == b["rejected"] and a["entropy"] == pytest.approx(b["entropy"], abs=1e-4)


def test_language_plans_are_short(spark, monkeypatch):
    """No plan has all orders' joins in it: the driver plans, and broadcasts for, all joins of a plan at once."""
    joins, inner = [], langid.spool

    def spool(df, label):
        joins.append(len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString())))
        return inner(df, label)

    monkeypatch.setattr(langid, "spool", spool)
    langid.fit(spark.createDataFrame([(i, spell("ab"[i % 2] * 2, i), "ab"[i % 2] * 2) for i in range(8)], "doc_id long, text string, lang string"))
    assert 0 < max(joins) <= 3


def test_letters_beyond_the_basic_plane(spark):
    model = langid.fit(spark.createDataFrame([(1, "abc def", "aa")], "doc_id long, text string, lang string"))
    asked = [(1, "\U0001f600\U0001f600 123"), (2, "\U00020000 1"), (3, "\U0001d7d8")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, asked), model).collect()}
    assert got == {1: "und", 2: "aa", 3: "und"}


def test_pieces_change_nothing(monkeypatch):
    import pyarrow as pa

    text = "Ab" + " " * 50 + "cd-ef, " + words(5, 60) + "  1 2 3   " + words(6, 40)
    batch = pa.record_batch([pa.array([text, None, "  ", text[::-1]])], ["text"])

    def keys():
        found = defaultdict(list)
        for rows, texts, context in langid.pieces(batch, 0):
            k, number, _ = langid.characters(texts, context)
            for n, x in zip(number, k, strict=True):
                found[rows[n]].append(int(x))
        return found

    whole = keys()
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "PIECE", size)
        assert keys() == whole


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.predict(docs(spark, [(1, "abc")]), langid.fit(empty)).collect()] == ["und"]


# --- packing ------------------------------------------------------------------------------------------------------


def test_packing_whole_documents(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ODD + [(90, "a <|endoftext|> b"), (91, " " * 3000 + "x"), (92, "\u00a0a\u2003 b")] + [(100 + i, words(i, 5 + 37 * i % 900)) for i in range(60)]
    found = packing.pack_documents(docs(spark, rows), capacity=256).collect()
    want = Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(r["length"] for r in found) / 256) + 1


def test_local_search_empties_bins():
    lengths = [5, 5, 4, 4, 3, 3, 6, 6, 2, 2]
    poor = [[0, 2], [1, 3], [4, 6], [5, 7], [8], [9]]
    better = packing.local_search([b[:] for b in poor], lengths, 10)
    assert sorted(i for b in better for i in b) == list(range(10)) and all(sum(lengths[i] for i in b) <= 10 for b in better) and len(better) <= 5


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    encode, t = packing.encoder(packing.default_vocabulary()), Tokenizer.from_file(packing.default_vocabulary())
    r = np.random.default_rng(6)
    signs = list("ab'sé漢1 2  \n\n\t\r\x0b\xa0 .,!<|>\x1c😀ا") + ["<|endoftext|>", "'ll", "   ", "the", "\u200b", "\u3000", "\ufeff", "İ", "\u0301"]
    for _ in range(5000):
        text = "".join(signs[i] for i in r.integers(0, len(signs), r.integers(0, 16)))
        assert encode(text) == t.encode(text, add_special_tokens=False).ids, text
    for text in (" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, words(3, 1000) + " " * packing.LONG_RUN + words(4, 1000) + "x" * (packing.LONG_RUN - 1)):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def _improving(bins, lengths, capacity):
    """Whether an exchange, one for none, one or two or two for none or one, fills a fuller bin more."""
    from itertools import combinations

    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, giver in enumerate(bins):
        for b, taker in enumerate(bins):
            if a == b or fill[b] < fill[a] or fill[b] == capacity:
                continue
            given = [*combinations(giver, 1), *combinations(giver, 2)]
            back = [(), *combinations(taker, 1), *combinations(taker, 2)]
            for x in given:
                for y in back:
                    if len(x) + len(y) < 4 and 0 < sum(lengths[i] for i in x) - sum(lengths[i] for i in y) <= capacity - fill[b]:
                        return True
    return False


def test_local_search_ends_where_nothing_is_left_to_exchange():
    above = 0
    for seed in range(40):
        lengths = np.random.default_rng(seed).integers(20, 60, 60).tolist()
        bins = packing.local_search(packing.best_fit(lengths, 100), lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(60)) and max(sum(lengths[i] for i in b) for b in bins) <= 100
        if len(bins) > -(-sum(lengths) // 100):
            above += 1
            assert not _improving(bins, lengths, 100)
    assert above


def test_packing_many_groups(spark):
    items = spark.range(3000).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 10).alias("length"))
    found = packing.pack(items, 100, group=200).join(items, "uid")
    per = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    whole = packing.best_fit([r["length"] for r in items.collect()], 100)  # as one group
    assert found.count() == 3000 and all(r["n"] == r["end"] <= 100 for r in per) and len(per) <= 1.04 * len(whole)


# --- toxicity -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scorer(spark):
    rows = []
    for i in range(240):
        w = words(i, 60).split()
        if i % 3 == 0:
            w[i % 50] = ["grumpfel", "blorkig"][i % 2]
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    return toxicity.fit(docs(spark, rows), labels)


def test_disguised_words_are_found(spark, scorer):
    clean = words(900, 60)
    forms = ["grumpfel", "gr0mpfel grumpfel", "GRUMPFEL", "grumpf3l", "g r u m p f e l", "g.r.u.m.p.f.e.l", "grrrumpfel", "blork1g", "b1orkig", "bl0rkig"]
    rows = [(i, clean + " " + f + " " + clean) for i, f in enumerate(forms)] + [(100, clean), (101, None), (102, ""), (103, clean + " price 10 for 3b and a1"), (104, words(7, 20000))]
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), scorer).collect()}
    assert [i for i in range(len(forms)) if not got[i]["predicted"]] == []
    assert all(got[i]["predicted"] == 0 and 0 <= got[i]["score"] <= 1 for i in (100, 101, 102, 103, 104))


def test_lattice_keeps_channel_options():
    assert [o[0][0] for o in toxicity.lattice("a1b")] == ["a", "i", "b"]
    assert list(toxicity.stretches("no 1d10t here, s c u m there")) and not list(toxicity.stretches("plain words, 2021 and 3.5."))


def test_readings_against_all_paths(scorer):
    from itertools import product

    for stretch in ("gr0mp", "b1o", "s.c.u", "a11y", "xx@", "а1b", "00"):
        options, costs = toxicity.lattice(stretch), {}
        for path in product(*options):
            text, cost, x, y = "", 0.0, " ", " "
            for emitted, channel in path:
                cost += channel
                text += emitted
                for c in emitted:
                    if not (c == " " and y == " "):
                        cost -= scorer.model.log(x, y, c)
                        x, y = y, c
            cost -= scorer.model.log(x, y, " ")
            costs[text] = min(cost, costs.get(text, math.inf))
        assert costs[toxicity.restore(stretch, scorer.model)] == pytest.approx(min(costs.values()))


def test_character_model_counts_every_trigram(spark):
    rows = [(i, "".join(chr(97 + (i * k) % 26) for k in range(40)) + "漢字é") for i in range(30)]
    model, want = toxicity.character_model(docs(spark, rows)), Counter()
    for _, t in rows:
        s = [0, 0, 0] + [toxicity.symbol(c) for c in t]
        for k in range(3, len(s)):
            want[s[k - 2] << 32 | s[k - 1] << 16 | s[k]] += 1
    assert dict(zip(model.own[0][0].tolist(), model.own[0][1].tolist(), strict=True)).keys() == want.keys()
    every = {" ", "é", "漢"} | {chr(97 + k) for k in range(26)}
    for a, b in (("a", "b"), (" ", " "), ("é", "漢"), ("q", "q")):
        assert sum(math.exp(model.log(a, b, c)) for c in every) == pytest.approx(1, abs=0.05)


def test_long_stretches_take_time_in_proportion(scorer):
    import time

    for text in ("a1b@" * 100_000, "漢aaa" * 100_000, "a." * 200_000, "x" * 400_000):
        began = time.time()
        toxicity.restored(text, scorer.model, {})
        assert time.time() - began < 20


def test_labels_of_one_kind_only(spark):
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    s = toxicity.fit(docs(spark, [(1, "fine words")]), one)
    assert [r["predicted"] for r in toxicity.score(docs(spark, [(1, "fine words"), (2, None)]), s).collect()] == [0, 0]


# --- HTML ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def blocks():
    return html_main.fit(html_main.LABELLED)


LONG = "This is a sentence of the story, with a comma and some length, so that it reads like prose from a paper. " * 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title &amp; more</h1><p>{LONG}<p>Short   one.<br>Next</article><footer>&copy; x</footer>", ["Title & more", LONG, "Short one. Next"]),
        (f"<body><div id=main class=content><p>{LONG}</p><div class=comments><p>First! I like it, really.</p></div></div><div class=sidebar><p>Read this and that too.</p></div></body>", [LONG]),
        (f"<article><p>{LONG}</p><script>var x='<p>no</p>'</script><!-- <p>no</p> --><form><p>Sign up now</p></form></article>", [LONG]),
        ("", []),
        (None, []),
        ("<script>open", []),
    ],
)
def test_main_text(blocks, page, want):
    assert html_main.main_text(page, blocks) == "\n\n".join(" ".join(w.split()) for w in want)


def test_marginals_are_exact(blocks):
    from itertools import product

    nodes = html_main.parse("<body><nav><a href=/x>x</a></nav><div><p>Some text, here.</p></div></body>")
    score = blocks.unary(html_main.features(nodes, html_main.texts(nodes)))
    weight, mass = np.zeros(len(nodes)), 0.0
    for labels in product((0, 1), repeat=len(nodes)):
        e = sum(score[i] for i in range(len(nodes)) if labels[i]) + sum(blocks.pair[html_main._kind(nodes, i), labels[nodes[i].parent], labels[i]] for i in range(1, len(nodes)))
        mass += math.exp(e)
        weight += math.exp(e) * np.array(labels)
    assert np.allclose(blocks.messages(nodes, score)[0], weight / mass)


def test_given_pages(spark, blocks):
    """All pages of the small table, whose main text is what their article holds, block by block."""
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_main.extract(rows, blocks).collect()}
    for r in rows.collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("<br>", " ", article))
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert got[r["page_id"]] == "\n\n".join(x for x in parts if x)


def test_elements_that_go_unclosed(blocks):
    body = "<article><h1>A title of this page</h1><p>" + words(1, 60) + "</p><p>" + words(2, 50) + "</p></article>"
    want = "\n\n".join(["A title of this page", words(1, 60), words(2, 50)])
    plain = html_main.main_text(f"<body>{body}</body>", blocks)
    assert plain == want
    for before in (
        "<form><input list=x><datalist id=x><option value=a>one<option value=b>two</datalist></form>",
        "<form><select><optgroup label=x><option>one<option>two<optgroup label=y><option>three</select></form>",
        "<form><button>press</form>", "<button>press", "<select><option>one", "<div><template><p>inert text of no page</p></template></div>",
        "<div><button>one<button>two</div>", "<form><select><option>a</form>",
    ):
        assert html_main.main_text(f"<body>{before}{body}</body>", blocks) == want


def test_comments_lists_and_captions(blocks):
    """Comments under a heading that counts them go, whatever they are called; lists of links and captions in an article stay."""
    first, second = words(1, 25) + ".", words(2, 30) + "."
    talk = "<{0} id={1}><h2>{2}</h2><ol><li><p>I do not agree with this at all, sorry.</p></li><li><p>Well said, all of it.</p></li></ol></{0}>"
    plain = "\n\n".join(["The title", first, second])
    for where in ("<main><article>{0}</article>{1}</main>", "<article>{0}</article>{1}", "<main><div>{0}</div>{1}</main>"):
        for name in ("responses", "x1", "voices"):
            for heading in ("2 responses", "12 thoughts", "Voices (2)"):
                page = where.format(f"<h1>The title</h1><p>{first}</p><p>{second}</p>", talk.format("section", name, heading))
                assert html_main.main_text(f"<body><nav><a href=/>x</a></nav>{page}</body>", blocks) == plain
    inner = f"<h1>The title</h1><p>{first}</p><ul><li><a href=/a>First paper on it</a></li><li><a href=/b>Second paper</a></li></ul><p>{second}</p><figure><img src=x><figcaption>A view of the hall</figcaption></figure><p>{first}</p>"
    found = html_main.main_text(f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{inner}</article></body>", blocks)
    assert found == "\n\n".join(["The title", first, "First paper on it", "Second paper", second, "A view of the hall", first])


def test_layouts_that_were_not_learned():
    """Each layout by a model of all others: words found and words wrongly taken, over all of them."""
    every, right, taken, there = html_main.layouts(), 0, 0, 0
    for k in range(len(every)):
        model = html_main.fit([page for i, pages in enumerate(every) if i != k for page in pages], steps=60)
        for page in every[k]:
            nodes = html_main.parse(page)
            want = Counter(" ".join(t for t, y in zip(html_main.texts(nodes), html_main.labels(nodes), strict=True) if y).split())
            got = Counter(html_main.main_text(page, model).split())
            right, taken, there = right + (want & got).total(), taken + got.total(), there + want.total()
    print("words of unseen layouts: precision", right / taken, "recall", right / there)
    assert right >= 0.95 * there
    assert right >= 0.85 * taken and right >= 0.85 * there


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("İ" * 12 + f"<script>var x = 1;</SCRIPT ><p>{LONG}</p>", None),
        (f"<body><article><p>{LONG}</p><p>{LONG}</p></article></body>", LONG + "\n\n" + LONG),
        (f"<p>{LONG}</p><p>{LONG}</p>", LONG + "\n\n" + LONG),
        (LONG * 3, LONG * 3),
        (f"<article><p>{LONG}<math><mi>x</mi></math> and <svg><text>y</text></svg></p><p>{LONG}</p></article>", LONG + "x and y\n\n" + LONG),
    ],
)
def test_text_that_must_not_be_lost(blocks, page, want):
    found = html_main.main_text(page, blocks)
    tidy = lambda t: "\n\n".join(" ".join(x.split()) for x in t.split("\n\n"))
    assert found == tidy(want) if want else tidy(LONG) in found


def test_deep_pages_take_time_in_proportion(blocks):
    import time

    began = time.time()
    for page in ("<div>" * 50_000 + "<p>text", "<ul><li>" * 30_000 + "x", "<table><tr><td>" * 20_000, "<p>a" * 50_000, "</div>" * 100_000):
        html_main.main_text(page, blocks)
    assert time.time() - began < 60


def test_extract_table(spark, blocks):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_main.extract(pages, blocks).collect()}
    assert got[1]["n_chars"] == len(got[1]["text"]) > 0 and got[2]["text"] == "" and got[2]["n_chars"] == 0


# --- lines --------------------------------------------------------------------------------------------------------


def test_recurring_lines(spark):
    passage = words(77, 60)
    note = "Posted on {} by the editors of this very paper for all."
    rows = [(i, f"{words(i, 30)}\n{passage if i in (3, 8, 9) else words(1000 + i, 9)}\n{note.format(2000 + i)}\n\n{words(2000 + i, 12)}") for i in range(12)]
    rows += [(50, rows[5][1]), (51, None), (52, ""), (53, "\n\n")]
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and got[51]["text"] is None and got[53]["text"] == "\n\n" and got[3]["score"] == "x"
    assert passage in got[3]["text"] and passage not in got[8]["text"] and passage not in got[9]["text"]
    assert [i for i in range(12) if "Posted on" in got[i]["text"]] == [0]
    assert all(got[i]["text"].split("\n")[0] == rows[i][1].split("\n")[0] for i in range(12))
    assert words(5, 30) in got[50]["text"]  # a whole copy is no recurrence
    assert line_dedup.drop_recurring(docs(spark, [])).count() == 0


def test_passages_of_several_lines_recur(spark):
    rows, want = [], {}
    for case, (lines, many) in enumerate((n, m) for n in (2, 3, 5) for m in (2, 100)):
        passage = [words(5000 + 10 * case + j, 12) for j in range(lines)]
        for i in range(many):
            own = [words(10_000 + 1000 * case + 2 * i + j, 40) for j in (0, 1)]
            want[len(rows)] = "\n".join([own[0], *(passage if i == 0 else []), own[1]])
            rows.append((len(rows), "\n".join([own[0], *passage, own[1]])))
    text = [words(90_000 + j, 20) for j in range(20)]
    for copy in range(30):  # copies with a line of their own each are no recurrence
        want[len(rows)] = "\n".join([*text[:copy % 20], words(91_000 + copy, 20), *text[copy % 20 + 1 :]])
        rows.append((len(rows), want[len(rows)]))
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(docs(spark, rows)).collect()}
    assert got == want


def _brute_drops(rows):
    """The rule by plain loops, for texts that are no copies: (doc, line number) of what goes."""
    places, values = defaultdict(set), defaultdict(set)
    lines = [(i, n, tuple(x.encode().split())) for i, t in rows for n, x in enumerate(t.split("\n")) if x.split()]
    of = {}
    for i, n, x in lines:
        of[i, n] = [("line", x), *(("mask", m) for m, strong in line_dedup.masks(list(x)) if strong)]
        for name in of[i, n]:
            places[name].add(i)
            values[name].add(x)
    often = {}
    for name, at in places.items():
        if name[0] == "mask":
            often[name] = len(at) >= 10 and len(values[name]) >= 10
        else:
            often[name] = len(at) >= (2 if len(name[1]) >= 8 else 10)
    return {(i, n) for i, n, _ in lines for name in of[i, n] if often[name] and i != min(places[name])}


def test_templates_against_a_plain_rule(spark):
    r = np.random.default_rng(11)
    rows = []
    for i in range(60):
        own = [words(60_000 + 10 * i + j, 14) for j in range(4)]
        own.append(f"this page was last looked at by {WORDS[i % 23]} of the committee for plain records and it stays")
        own.append(f"{'copy' if i % 3 else 'print'} number {i} of {i * 7}")
        own.append(f"the town of {words(70_000 + i, 1)} lies by the river" if i % 2 else words(80_000 + i, 12))
        base = words(300 + i % 7, 13).split()
        for at in r.integers(0, 13, 2):
            base[at] = WORDS[r.integers(0, 23)]
        rows.append((i, "\n".join([*own, " ".join(base)])))
    got = {x["doc_id"]: x["text"].split("\n") for x in line_dedup.drop_recurring(docs(spark, rows)).collect()}
    gone = _brute_drops(rows)
    assert got == {i: [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone] or [""] for i, t in rows}
    assert sum("committee" in " ".join(v) for v in got.values()) == 1 and sum("number" in " ".join(v) for v in got.values()) == 1 + 1


def test_prose_that_looks_alike_stays(spark):
    """Sentences with the same beginning, or that share all but a word in a few texts, are no boilerplate."""
    towns = "Berlin Paris Rome Oslo Vienna Madrid Lisbon Athens".split()
    rows = [(i, f"{words(100 + i, 20)}\nIn the summer of 1999 he moved to {t}\n{words(200 + i, 25)}") for i, t in enumerate(towns)]
    rows += [(20 + i, f"The king of the land {words(400 + i, 9)}\n{words(300 + i, 25)}") for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(docs(spark, rows)).collect()}
    assert got == dict(rows)


@pytest.mark.parametrize("many", [10, 1024, 3000])
def test_templates_do_not_depend_on_the_size_of_a_leaf(spark, many):
    name = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [(i, f"{words(10_000 + i, 40)}\nthe mayor of our town {name(i)} spoke at noon about the weather") for i in range(many)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(docs(spark, rows)).collect()}
    assert [i for i in range(many) if "mayor" in got[i]] == [0]


def test_copies_against_all_pairs(spark):
    """Groups of copies with lines of their own, some lines of which other texts hold too: found pairs are right, and few are missed."""
    r, rows = np.random.default_rng(21), []
    common = [words(95_000 + j, 12) for j in range(30)]
    for g in range(40):
        base = [words(96_000 + 40 * g + j, 10) for j in range(20)]
        for c in range(2 + g % 4):
            x = list(base)
            for at in r.integers(0, 20, r.integers(0, 3)):
                x[at] = words(99_000 + 100 * g + 10 * c + int(at), 10)
            rows.append((len(rows), [*x, *(common[j] for j in r.integers(0, 30, r.integers(0, 2)))]))
    table = docs(spark, [(i, "\n".join(x)) for i, x in rows])
    keyed = table.select("text", "doc_id", F.col("doc_id").alias("k"))
    lines = line_dedup.line_hashes(keyed).withColumnRenamed("line", "template")
    ends = line_dedup.ends_of(lines)
    held = lines.join(ends.select("template"), "template").groupBy("template", "k").agg(F.sum("n_tokens").alias("tokens"), F.first("size").alias("size"))
    got = {x["k"]: x["root"] for x in line_dedup.copies(held, ends).collect()}
    counts = {i: Counter({w: len(w.split()) * n for w, n in Counter(x).items()}) for i, x in rows}
    alike = lambda a, b: (both := (counts[a] & counts[b]).total()) >= 0.8 * (counts[a].total() + counts[b].total() - both)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if alike(a, b)]
    found = sum(a in got and got[a] == got.get(b) for a, b in pairs)
    print("copies: pairs found", found, "of", len(pairs))
    assert found >= 0.98 * len(pairs)


def test_many_dropped_lines_in_one_text(spark):
    lines = [f"{w} stood by the {v} and said nothing of {u}" for w in WORDS[:12] for v in WORDS[:12] for u in WORDS[:12]]
    rows = [(1, "\n".join(lines)), (2, "own line of two\n" + "\n".join(lines * 2) + "\n" + words(5, 50_000))]
    got = {r["doc_id"]: r for r in line_dedup.drop_recurring(docs(spark, rows)).collect()}
    assert got[2]["n_dropped"] == 2 * len(lines) and got[2]["text"] == "own line of two\n" + words(5, 50_000) and got[1]["n_dropped"] == 0


def test_dropped_lines_against_a_plain_rule(spark):
    """Planted passages of one line among clean texts, and copies of whole texts: only the passages go."""
    rows, dropped = [], set()
    for i in range(60):
        rows.append((i, "\n".join([words(40_000 + 3 * i + j, 25) for j in range(3)])))
    for k in range(5):  # a passage of 55 words in two or three texts
        passage = words(50_000 + k, 55)
        for i in range(6 * k, 6 * k + 2 + k % 2):
            rows[i] = (i, rows[i][1] + "\n" + passage)
            dropped |= {(i, passage)} if i != 6 * k else set()
    rows += [(100 + i, rows[i][1]) for i in range(30, 36)]  # copies are no recurrence, but of passages that others have too
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(docs(spark, rows)).collect()}
    lost = {(i, x) for i, t in rows for x in t.split("\n") if x not in got[i].split("\n")}
    assert lost == dropped


# --- nearest neighbours -------------------------------------------------------------------------------------------


def test_neighbours_recall_and_odd_vectors(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 16))
    x = (centres[r.integers(0, 20, 2000)] + 0.3 * r.normal(size=(2000, 16))).astype(np.float32).astype(float)
    x[100:160] = x[100]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None] + [0.0] * 14), (9004, [1.0]), (None, [1.0] * 16), (9050, [float("inf")] * 16)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = ann.search(df, F.col("vec_id") % 50 == 0, k=5, block=256).collect()
    got = defaultdict(list)
    for row in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    assert set(got) == set(range(0, 2000, 50)) and all(len(v) == 5 for v in got.values())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, rows in got.items():
        s = unit @ unit[q]
        s[q] = -9
        hits += sum(score >= np.sort(s)[-5] - 1e-9 for _, score in rows)
        assert all(abs(score - s[i]) < 1e-9 for i, score in rows)
    assert hits >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and [i for i, _ in got[150]] == [100, 101, 102, 103, 104]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], "vec_id long, vector array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.search(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("by", [50, 20])
def test_recall_on_the_given_vectors_with_production_parameters(spark, by):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    x = {r["vec_id"]: np.array(r["vector"], float) for r in vectors.collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    got = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % by == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = sum(len(set(got[q]) & set(sorted((i for i in x if i != q), key=lambda i: (-unit[q] @ unit[i], i))[:5])) for q in x if q % by == 0)
    assert hits >= 0.9 * 5 * len(got) and set(got) == {q for q in x if q % by == 0}
    router = ann.fit(vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector")))
    assert len(router.offsets) > router.probes  # not every part is searched


def test_repeated_rows_lengths_and_large_components(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [1.0, 0.2, 0.0]), (51, [1.0, 0.2, 0.1]), (100, [1e200, 1e200]), (101, [1e-200, 2e-200])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = defaultdict(list)
    for r in sorted(ann.search(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 6)))
    c = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    assert got[0] == [(0, 1.0), (0, 1.0), (1, c([1, 0], [1, 0.1])), (100, c([1, 0], [1, 1])), (101, c([1, 0], [1, 2]))]
    assert got[50] == [(51, c([1, 0.2, 0], [1, 0.2, 0.1]))] and got[100][0] == (101, c([1, 1], [1, 2])) and len(got[100]) == 5


# --- Merkle manifests ---------------------------------------------------------------------------------------------


def plain_manifest(rows, arity):
    """For rows (doc_id, text, source): doc_id and leaf to (subroot, root, proof, tampered leaf folded); all by lists."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, text, source, cut):
        return h(part(i), part(source), part("en"), part(len(text) if text else None), part(text.replace("\n", "") if cut and text else text))

    def climb(level):
        levels = [level]
        while len(level) > 1:
            level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
            levels.append(level)
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = i - i % arity
            yield level[run:i], level[i + 1 : run + arity]
            i //= arity

    groups = defaultdict(list)
    for i, text, source in rows:
        bad = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        groups[source].append(((i is not None, i), leaf(i, text, source, False), leaf(i, text, source, bad)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda x: (x[0][0], x[0][1] or 0, x[1]))
        trees.append(climb([x[1] for x in groups[s]]))
    top = climb([t[-1][0] for t in trees])
    out = Counter()
    for no, s in enumerate(names):
        for k, (key, own, other) in enumerate(groups[s]):
            steps = [*path(trees[no], k), *path(top, no)]
            back = other
            for before, after in steps:
                back = h(*before, back, *after)
            proof = h(*[x for before, after in steps for x in (*before, *after)])
            out[key[1], own, trees[no][-1][0], top[-1][0], proof, back, back == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("arity", [2, 3])
@pytest.mark.parametrize("broadcast", [0, 8 << 20])
def test_manifests_equal_lists(spark, monkeypatch, arity, broadcast):
    monkeypatch.setattr(merkle, "BROADCAST", broadcast)
    rows = [(i, t, "ab"[i % 2] if i else None) for i, t in ODD] + [(7, "a\nb", "lone"), (8, None, None), (-3, "x\n\ny", "é")]
    rows += [(i, f"text {i}\nof it", "hot") for i in range(30)] + [(1000, "same\nrow", "hot")] * 12
    table = docs(spark, [(i, t, s) for i, t, s in rows])
    manifest = merkle.build(merkle.document_leaves(table), arity)
    found = merkle.verify(manifest).select("doc_id", merkle.hexed(F.col("leaf")), merkle.hexed(F.col("subroot")), "root", "proof_sha256", "folded_root", "verified").collect()
    assert Counter(map(tuple, found)) == plain_manifest(rows, arity)
    assert {r["source"]: r["n_rows"] for r in manifest.sources.collect()} == dict(Counter(s for _, _, s in rows))


def test_manifests_of_one_row_and_of_none(spark):
    one = merkle.verify(merkle.build(merkle.document_leaves(docs(spark, [(4, "x", "s")])))).collect()
    assert [(r["folded_root"] == r["root"] == r["subroot"].hex() == r["leaf"].hex(), r["proof_sha256"]) for r in one] == [(True, hashlib.sha256(b"").hexdigest())]
    assert merkle.verify(merkle.build(merkle.document_leaves(docs(spark, [])))).count() == 0


# --- pieces -------------------------------------------------------------------------------------------------------

SIGNS = "abcdefgh  thein\u2581\n\té\u2460日本語\U0001f600\u200b\u3000\x00ﬁ0123.,;e\u0301"


def piece_texts(seed, n):
    r = np.random.default_rng(seed)
    return ["".join(SIGNS[i] for i in r.integers(0, len(SIGNS), r.integers(1, 160))) for _ in range(n)] + [x or "" for _, x in ODD] + ["the" * 3000, "\u2581" * 99, "Ａ\u3000Ｂ"]


def library(data):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def assert_as_library(own, lib, texts):
    for text in texts:
        ids, begins, ends = own.encode(text)
        proto = lib.encode(text, out_type="proto")
        assert ids.tolist() == [lib.bos_id(), *[p.id for p in proto.pieces], lib.eos_id()] == lib.encode(text, add_bos=True, add_eos=True)
        assert list(zip(begins.tolist(), ends.tolist(), strict=True))[1:-1] == [(p.begin, p.end) for p in proto.pieces]
        assert own.decode(ids.tolist()) == lib.decode(ids.tolist())


def test_pieces_equal_the_library():
    data = open(pieces.default_model(), "rb").read()
    own, lib = pieces.Model(data), library(data)
    assert_as_library(own, lib, piece_texts(1, 400))
    r = np.random.default_rng(2)
    for _ in range(800):  # any ids: byte pieces that are no characters, marks, control pieces
        ids = [int(r.integers(0, 300) if r.random() < 0.6 else r.integers(0, 32000)) for _ in range(r.integers(0, 30))]
        assert own.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_character_maps_equal_the_library(squeeze, dummy, fallback):
    """Compiled maps that the library ships, with every way to treat white space and unknown characters."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(pieces.default_model(), "rb").read())
    with open(f"{sentencepiece.__path__[0]}/package_data/nmt_nfkc.bin", "rb") as f:
        model.normalizer_spec.precompiled_charsmap = f.read()
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, dummy
    if not fallback:
        model.trainer_spec.byte_fallback = False
        for piece in model.pieces:
            if piece.type == pieces.BYTE:
                piece.type = pieces.CONTROL
    data = model.SerializeToString()
    own, lib = pieces.Model(data), library(data)
    for text in (texts := piece_texts(3, 150)):
        assert own.normalise(text)[0] == lib.normalize(text)
    assert_as_library(own, lib, texts)


def test_pieces_of_tables(spark):
    table = docs(spark, ODD)
    lib = library(open(pieces.default_model(), "rb").read())
    want = Counter()
    for i, t in ODD:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    found = pieces.facts(table)
    assert Counter(tuple(r)[:4] for r in found.collect()) == want
    assert all(r["n_covered"] == len((t or "").encode()) for r, (_, t) in zip(found.collect(), ODD, strict=True))
    coded = pieces.encode(table.withColumn("ids", F.lit("x")), ["doc_id", "ids", "text"])
    assert coded.columns == ["doc_id", "ids", "text", "ids", "begins", "ends"]
    coded = pieces.encode(table, ["doc_id"])
    assert [r["text"] for r in pieces.decode(coded, ["doc_id"]).collect()] == [t or "" for _, t in ODD]
    assert pieces.facts(docs(spark, [])).count() == 0


# --- vector codes -------------------------------------------------------------------------------------------------


def plain_codes(rows, entries, rounds):
    """rows (vec_id, vector) of usable vectors: codes, errors, codebooks, by comparing everything in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    w = len(x[0]) // 16
    cut = [[v[p * w : (p + 1) * w] for p in range(16)] for v in x]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(16)]
    gap = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda p, v: min(range(len(books[p])), key=lambda e: (gap(v, books[p][e]), e))
    for _ in range(rounds):
        for p in range(16):
            chosen = defaultdict(list)
            for v in cut:
                chosen[near(p, v[p])].append(v[p])
            for e, own in chosen.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes_ = [[near(p, v[p]) for p in range(16)] for v in cut]
    out = Counter((i, "".join(f"{e:02x}" for e in c), sum(gap(v[p], books[p][c[p]]) for p in range(16))) for (i, _), v, c in zip(rows, cut, codes_, strict=True))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("wide", [16, 48])
def test_codes_equal_comparing_everything(spark, monkeypatch, wide):
    monkeypatch.setattr(codes, "BLOCK", 32)
    r = np.random.default_rng(wide)
    centres = r.normal(0, 1, (6, wide))
    rows = [(i, (centres[i % 6] + r.normal(0, 0.1, wide)).astype(np.float32).tolist(), i % 3 or None) for i in range(600)]
    rows += [(700 + i, rows[5][1], 1) for i in range(150)] + [(5, rows[5][1], None), (5, rows[6][1], 7), (None, rows[7][1], 7)]
    odd = [(800, None, 1), (801, [None] * wide, 1), (802, [float("nan")] * wide, 1), (803, [float("inf")] * wide, 1), (804, [0.5], 1), (805, [], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, vector array<float>, label long").withColumn("x", F.lit("clash"))
    found = codes.code_rows(table, entries=20).collect()
    want, digest = plain_codes([(i, v) for i, v, _ in rows], 20, 2)
    assert Counter((x["vec_id"], x["code"], x["error"]) for x in found) == want and {x["codebooks_sha256"] for x in found} == {digest}
    total = sum(x["error"] for x in found)
    assert sum({x["label_error"] for x in found}) == total
    whole = codes.compress(table, entries=20)
    back = {x["row"]: x["vector"] for x in codes.decoded(whole).collect()}
    assert len(back) == len(rows) and all(len(v) == wide for v in back.values())


def test_codes_of_few_vectors_and_of_none(spark):
    shape = "vec_id long, vector array<double>, label int"
    assert codes.code_rows(spark.createDataFrame([(1, None, 2)], shape)).count() == 0
    got = codes.code_rows(spark.createDataFrame([(1, [0.25] * 16, 2), (2, [-0.001] * 16, None)], shape)).collect()
    assert {(x["vec_id"], x["code"], x["error"], x["label_error"]) for x in got} == {(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)}
    with pytest.raises(ValueError):
        codes.code_rows(spark.createDataFrame([(1, [1e9] * 16, 2)], shape))
    with pytest.raises(ValueError):
        codes.code_rows(spark.createDataFrame([(1, [1.0] * 15, 2)], shape))


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_walk_by_single_steps(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = codes.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    r = np.random.default_rng(9)
    for _ in range(200):
        points, entries = r.integers(-40, 40, (20, 3)), r.integers(-40, 40, (15, 3))
        among = codes.shortlist(points.min(0), points.max(0), entries)
        all_ = codes.nearest(points, entries, np.arange(15))
        assert all(np.array_equal(a, b) for a, b in zip(codes.nearest(points, entries, among), all_, strict=True))
