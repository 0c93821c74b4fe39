"""Versions in time: as-of, status rules, folding, diffs, snapshots."""

import datetime as dt

from pyspark.sql import functions as F

from folio_spark.operators import versions as V

D = dt.date


def test_as_of_ties_and_bounds(spark):
    v = spark.createDataFrame([("w", 1, 1, D(2000, 1, 1), 1), ("w", 2, 2, D(2010, 1, 1), 2), ("w", 3, 3, D(2010, 1, 1), 3), ("w", 4, 4, None, 4)], "work_key string, law_id long, version_id long, start date, ingest_seq long")
    q = spark.createDataFrame([(1, "w", D(1999, 1, 1), None), (2, "w", D(2000, 1, 1), None), (3, "w", D(2011, 1, 1), None), (4, "w", D(2011, 1, 1), 2), (5, "none", D(2011, 1, 1), None)], "request_id int, work_key string, as_of date, law_id long")
    got = {r["request_id"]: r["version_id"] for r in V.as_of(q, v).collect()}
    assert got == {1: None, 2: 1, 3: 3, 4: 2, 5: None}
    by = {r["request_id"]: r["start"] for r in V.as_of_by_interval(q, V.version_intervals(v)).collect()}
    assert by == {1: None, 2: D(2000, 1, 1), 3: D(2010, 1, 1), 4: D(2010, 1, 1), 5: None}


def test_status_rules_in_order(spark):
    today = "2024-01-01"
    cases = [
        (1, "a", D(2025, 1, 1), None, "current", D(2024, 6, 1), "pending_effective"),
        (2, "b", D(2000, 1, 1), None, "current", D(2015, 1, 1), "amended"),
        (3, "b", D(2000, 1, 1), None, "current", D(2005, 1, 1), "current"),
        (4, "c", D(2000, 1, 1), D(2010, 1, 1), "repealed", D(2009, 1, 1), "current"),
        (5, "c", D(2000, 1, 1), D(2010, 1, 1), "repealed", D(2010, 1, 1), "repealed"),
        (6, "c", D(2000, 1, 1), None, "repealed", D(2020, 1, 1), "unknown"),
        (7, "c", D(2000, 1, 1), None, "repealed", D(2024, 1, 1), "repealed"),
        (8, "c", D(2000, 1, 1), None, "unknown", D(2020, 1, 1), "unknown"),
        (9, "c", D(2000, 1, 1), None, "amended", D(2020, 1, 1), "unknown"),
        (10, "c", D(2000, 1, 1), None, "amended", D(2024, 2, 1), "amended"),
        (11, "d", None, None, "current", D(2020, 1, 1), "unknown"),
        (12, "d", None, None, "current", D(2024, 2, 1), "current"),
    ]
    rows = spark.createDataFrame(cases, "id int, work_key string, start date, repealed_at date, status string, as_of date, want string")
    starts = spark.createDataFrame([("a", D(2025, 1, 1)), ("b", D(2000, 1, 1)), ("b", D(2010, 1, 1)), ("c", D(2000, 1, 1))], "work_key string, start date")
    wrong = V.status_as_of(rows, starts, today).where("derived_status <> want").select("id", "derived_status", "want").collect()
    assert wrong == []


def test_diff_and_snapshots(spark):
    a = spark.createDataFrame([(1, "1", "x", None), (1, "2", "y", "p"), (1, "3", "z", None)], "request_id int, number string, text string, part string")
    b = spark.createDataFrame([(1, "1", "x", None), (1, "2", "y", "q"), (1, "4", "z", None)], "request_id int, number string, text string, part string")
    assert {r["number"]: r["change"] for r in V.diff_versions(a, b).collect()} == {"1": "unchanged", "2": "changed", "3": "removed", "4": "added"}
    revisions = spark.createDataFrame([(1, "l", "h", None), (2, "l", "old", ""), (3, "l", "h", '{"id": "m", "articles": []}'), (4, "l", "h", "{bro"), (5, "l", "h", '{"id": "l", "articles": [{"number": "1", "text": "t", "position": 1}]}')], "revision_id int, law_id string, content_hash string, snapshot_json string")
    laws = spark.createDataFrame([("l", "h")], "law_id string, content_hash string")
    articles = spark.createDataFrame([("l", "1", 1, "stored")], "law_id string, number string, position int, text string")
    got = {r["revision_id"]: (r["diagnostic"], r["text"]) for r in V.explode_snapshots(revisions, laws, articles).collect()}
    assert got == {1: ("stored_articles", "stored"), 2: ("snapshot_missing", None), 3: ("snapshot_foreign", None), 4: ("snapshot_corrupt", None), 5: (None, "t")}


def test_content_hash_depends_on_order(spark):
    a = spark.createDataFrame([("x", 1, "1", "a"), ("x", 2, "2", "b"), ("y", 2, "2", "b"), ("y", 1, "1", "a"), ("z", 1, "2", "b"), ("z", 2, "1", "a")], "law_id string, position int, number string, text string")
    h = {r["law_id"]: r["content_hash"] for r in V.content_hash(a.repartition(3)).collect()}
    assert h["x"] == h["y"] != h["z"] and F is not None
