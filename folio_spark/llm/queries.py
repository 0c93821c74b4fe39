"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.llm import ann, codes, html_main, langid, line_dedup, media, merkle, mixing, packing, pieces, sharding, simhash, toxicity
from folio_spark.llm.common import fold, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50, by cosine, over learned partitions."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored NPY tile of a grey image, with facts of what is read back from it."""
    return media.text_media_facts(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by labels of the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), 5) != 0)
    scorer = toxicity.fit(docs, labels)
    return toxicity.score(docs, scorer, ["held_out"]).select("doc_id", "held_out", "score", "predicted")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by block marginals of a model trained on labelled pages of common layouts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract(pages, html_main.fit(html_main.LABELLED))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents, but for its first document."""
    return line_dedup.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by models learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where("not held_out"))
    found = langid.predict(docs, model, ["held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy", "n_signs")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of three-word shingles of every document, and the component of fingerprints at most 2 bits apart."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents, as long as they are together, takes of each document."""
    mixed = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most, in a reproducible shuffle."""
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(bytes_) + 16).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    return sharding.feistel_shards(rows, ["doc_id", "size", "text_crc32"], shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof of every document in a tree per source, and whether a tampered document still leads to the root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    found = merkle.verify(merkle.build(merkle.document_leaves(docs)))
    return found.select(
        "doc_id", merkle.hexed(F.col("leaf")).alias("leaf"), merkle.hexed(F.col("subroot")).alias("subroot"), "root", "proof_sha256", "folded_root", "verified"
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in SentencePiece ids with begin and end, their spans in the text, and what they decode to."""
    return pieces.facts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector, in 16 parts with 64 entries each, after two rounds of exact integer means."""
    return codes.code_rows(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_packing, op3_media, op4_toxicity, op5_html, op6_line_dedup, op7_langid, op8_simhash, op9_mixing, op10_sharding, op11_merkle, op12_pieces, op13_codes)}


#: op9 in SQL: the same levels, digests and running sums, in plain windows over the whole table; what the blocks of a
#: source have of a document is its part of the source's first `words` words.
_MIXING = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
 s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source), w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no, sum(source_size) OVER () AS total FROM s),
 x AS (SELECT *, no % 3 + 1 AS weight, source_size * 3.0 / (no % 3 + 1) AS stop FROM w),
 l AS (SELECT *, (total - coalesce(sum(source_size * 3) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
 t AS (SELECT source, no, source_size, total, least(source_size * 3.0, (SELECT level FROM l WHERE level <= stop ORDER BY stop LIMIT 1) * weight) AS target FROM l),
 p AS (SELECT *, CAST(least(floor(target + 0.5), source_size * 3) AS BIGINT) AS words FROM t),
 o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '11', doc_id, size)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
 SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
  CAST(CASE WHEN source_size > 0 THEN words // source_size * size + greatest(0, least(size, words % source_size - start)) ELSE 0 END AS BIGINT) AS taken FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source"""


#: op11 in SQL: both trees by recursion over levels, every row's steps by joins, and the tampered leaf folded along them.
_MERKLE = """WITH RECURSIVE v AS (SELECT doc_id, coalesce('+' || source, '') AS g,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
   || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS cut,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
   lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc FROM documents),
 w AS (SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || CASE WHEN crc % 2 = 0 THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS tampered FROM v),
 l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM w),
 t AS (SELECT 0 AS k, g, i, n, leaf AS d FROM l UNION ALL SELECT k + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, g, n, i // 3),
 s AS (SELECT g, k AS h, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS no, count(*) OVER () AS n FROM t WHERE n = 1),
 u AS (SELECT 0 AS k, no AS i, n, subroot AS d FROM s UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, n, i // 3),
 p AS (SELECT l.g, l.i, t.k, t.i AS j, t.i = l.i // CAST(pow(3, t.k) AS BIGINT) AS own, t.d FROM l JOIN t ON t.g = l.g AND t.n > 1 AND t.i // 3 = l.i // CAST(pow(3, t.k + 1) AS BIGINT)
  UNION ALL SELECT l.g, l.i, s.h + u.k, u.i, u.i = s.no // CAST(pow(3, u.k) AS BIGINT), u.d FROM l JOIN s ON s.g = l.g JOIN u ON u.n > 1 AND u.i // 3 = s.no // CAST(pow(3, u.k + 1) AS BIGINT)),
 f AS (SELECT g, i, 0 AS k, tampered AS d FROM l
  UNION ALL SELECT f.g, f.i, f.k + 1, sha256(string_agg(CASE WHEN own THEN f.d ELSE p.d END, '' ORDER BY p.j)) FROM f JOIN p ON p.g = f.g AND p.i = f.i AND p.k = f.k GROUP BY f.g, f.i, f.k),
 q AS (SELECT g, i, string_agg(d, '' ORDER BY k, j) AS proof FROM p WHERE NOT own GROUP BY g, i), e AS (SELECT g, i, arg_max(d, k) AS folded_root FROM f GROUP BY g, i)
 SELECT doc_id, leaf, subroot, r.root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.root AS verified
 FROM l JOIN s ON s.g = l.g JOIN e ON e.g = l.g AND e.i = l.i LEFT JOIN q ON q.g = l.g AND q.i = l.i CROSS JOIN (SELECT d AS root FROM u WHERE n = 1) r"""

#: op13 in SQL: every part against every entry in each round. A part's nearest entry is the least of 64 times its distance plus its number.
_CODES = """WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 x AS (SELECT id, p, list_slice(x, p * w + 1, (p + 1) * w) AS x FROM (SELECT id, x, len(x) // 16 AS w, unnest(range(16)) AS p FROM k)),
 c0 AS (SELECT p, id - 1 AS e, x AS c FROM x WHERE id <= 64),
 a1 AS (SELECT id, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM x JOIN c0 USING (p) GROUP BY id, p),
 m1 AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, m % 64 AS e, unnest(range(len(x))) AS i, unnest(x) AS v FROM a1) GROUP BY p, e, i),
 c1 AS (SELECT p, e, coalesce(c1.c, c0.c) AS c FROM c0 LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m1 GROUP BY p, e) c1 USING (p, e)),
 a2 AS (SELECT id, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM x JOIN c1 USING (p) GROUP BY id, p),
 m2 AS (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, m % 64 AS e, unnest(range(len(x))) AS i, unnest(x) AS v FROM a2) GROUP BY p, e, i),
 c2 AS (SELECT p, e, coalesce(c2.c, c1.c) AS c FROM c1 LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m2 GROUP BY p, e) c2 USING (p, e)),
 a3 AS (SELECT id, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM x JOIN c2 USING (p) GROUP BY id, p),
 r AS (SELECT id, string_agg(printf('%02x', CAST(m % 64 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a3 GROUP BY id),
 h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN r USING (id) CROSS JOIN h"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": _MIXING, "op11_merkle": _MERKLE, "op13_codes": _CODES}
