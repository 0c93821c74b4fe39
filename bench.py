"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`search_*` and `d7_search` are searches over indexes that are stored beforehand (`index_build`, `grams_build`, `kinds_build`);
`a4_bm25` and the like store theirs when the first of them needs it, as a service does; `*_1000` and so on are batches of so
many requests. All of them count in the total.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "j4_as_of", "j4_as_of_by_interval", "w3_status_as_of", "d1_diff_versions", "j1_resolve", "j3_lookup_articles", "p15_postings", "a4_bm25",
    "t1_search_topk", "p1_article_key", "w5_rank_hits", "a5_content_hash", "j10_ground", "p4_explode_links", "a9_latency", "j8_extract_citations",
)
BATCHES = (1_000, 10_000, 100_000)


def _timed(run: Callable[[], DataFrame | None]) -> float:
    began = time.time()
    found = run()
    if found is not None:
        found.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def some(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows, over as many partitions as a shuffle has: a limit alone leaves one."""
    return rows.limit(n).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def batches(spark: SparkSession, sf: str) -> dict[str, float]:
    """Seconds for batches of requests (as-of lookup, citations, names, diffs), for storing indexes, and for searches over them."""
    from folio_spark.operators import citations, grams, names, retrieval, versions
    from folio_spark.plans import bindings, citation, temporal
    from folio_spark.plans import names as named
    from folio_spark.plans import retrieval as plans

    seconds = {}
    asked, stored = bindings.requests(spark, sf).cache(), bindings.versions(spark, sf)
    texts = citation._texts(spark, sf).select("doc_id", "text").cache()
    mentions, laws = named._mentions(spark, sf).cache(), named._laws(spark, sf)
    before, after = (temporal._articles_at(spark, sf, day).cache() for day in ("1996-06-01", "1998-06-01"))
    for rows in (asked, texts, mentions, before, after):
        rows.count()
    works = before.select("request_id").union(after.select("request_id")).distinct().cache()
    for n in BATCHES:
        requests, cited, mentioned, compared = (some(rows, n).cache() for rows in (asked, texts, mentions, works))
        for rows in (requests, cited, mentioned, compared):
            rows.count()
        seconds[f"j4_{n}"] = _timed(lambda: versions.as_of(requests, stored))  # noqa: B023
        seconds[f"j8_{n}"] = _timed(lambda: citations.extract_citations(cited))  # noqa: B023
        seconds[f"j1_{n}"] = _timed(lambda: names.resolve(mentioned, laws, names.build_name_index(laws)))  # noqa: B023
        seconds[f"d1_{n}"] = _timed(lambda: versions.diff_versions(*(x.join(compared, "request_id", "left_semi") for x in (before, after))))  # noqa: B023
    articles, corpus = plans._articles(spark, sf), plans._corpus(spark, sf)
    at, index = tempfile.mkdtemp(prefix="folio-bench-"), {}

    def build() -> None:
        index["articles"] = retrieval.store_index(articles, f"{at}/index")

    seconds["index_build"] = _timed(build)
    seconds["grams_build"] = _timed(lambda: index.update(grams=grams.store_grams(articles, f"{at}/grams")))
    seconds["kinds_build"] = _timed(lambda: index.update(kinds=retrieval.store_corpus(corpus, f"{at}/kinds")))
    queries = plans._queries(spark, sf)
    seconds["search_scores"] = _timed(lambda: retrieval.bm25(queries, index["articles"]))
    seconds["search_top10"] = _timed(lambda: plans.ranked(spark, sf, 10, index["articles"]))
    seconds["search_substrings"] = _timed(lambda: retrieval.substring_search(queries, articles, index["grams"]))
    seconds["d7_search"] = _timed(lambda: retrieval.search(plans._named(spark, sf), corpus, index["kinds"], retrieval.Options(limit=10, private=True)))
    return seconds


def main() -> None:
    from folio_spark.plans import registry
    from folio_spark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.queries(), {}
    spark.read.parquet(f"{sf}/orders.parquet").count()  # the first job pays for the start
    for name in HEADLINE:
        seconds[name] = _timed(lambda: queries[name](spark, sf))  # noqa: B023
    seconds |= batches(spark, sf)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
