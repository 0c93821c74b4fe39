"""Sync runs with stop rules against a plain loop over pages, and after failures."""

import random

import pytest

from folio_spark.session import exists, scratch
from folio_spark.streaming import sync as Y

SHAPE = "source string, page long, position long, law_id long, content_hash string, metadata_hash string"


def plain(rows, stored, progress, rules):
    """One run by loops: a report a source; stored and progress are brought up to date."""
    out = {}
    for source in sorted({r[0] for r in rows} | set(progress)):
        old = progress.get(source)
        page = old["next_page"] if old and rules.resume else rules.start_page
        stable = old["stable_pages_seen"] if old and rules.resume else 0
        r = {"source": source, "start_page": page, "pages_synced": 0, "rows_seen": 0, "laws_loaded": 0, "laws_skipped": 0, "metadata_refreshed": 0, "last_changed_page": old["last_changed_page"] if old else None}
        while True:
            if rules.max_pages is not None and r["pages_synced"] >= rules.max_pages:
                reason = "max_pages"
                break
            own = sorted((x for x in rows if x[0] == source and x[1] == page), key=lambda x: x[2])
            if not own:
                reason = "no_rows"
                break
            loaded = 0
            for _, _, _, law, content, meta in own:
                if law is None:
                    continue
                was = stored.get((source, law))
                kind = "laws_loaded" if was is None or was[0] != content else "metadata_refreshed" if was[1] != meta else "laws_skipped"
                loaded += kind == "laws_loaded"
                r[kind] += 1
                r["rows_seen"] += 1
                stored[source, law] = (content, meta)
            stable = 0 if loaded else stable + 1
            if loaded:
                r["last_changed_page"] = page
            r["pages_synced"] += 1
            page += 1
            if not loaded and rules.stable_after is not None and stable >= rules.stable_after:
                reason = "stable_pages"
                break
        out[source] = r | {"next_page": page, "stable_pages_seen": stable, "stop_reason": reason}
    progress.update(out)
    return out


def landed(r, sources=4, pages=14):
    rows = []
    for s in range(sources):
        for p in range(1, pages + 1):
            if s == 1 and p == 6:
                continue  # a gap ends a run
            for i in range(r.randrange(1, 4)):
                rows.append((f"s{s}", p, i, r.choice([None, 1, 2, 3, 4]), r.choice("aaaab"), r.choice("mmn")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows, store = landed(r), scratch(spark, "sync")
    pages, stored, progress = spark.createDataFrame(rows, SHAPE), {}, {}
    runs = [Y.Rules(max_pages=3), Y.Rules(stable_after=1), Y.Rules(max_pages=2, stable_after=2), Y.Rules(), Y.Rules(stable_after=2, resume=False), Y.Rules(start_page=5, max_pages=1, resume=False)]
    for rules in runs:
        got = {x["source"]: x.asDict() for x in Y.sync(pages, store, rules).collect()}
        assert got == plain(rows, stored, progress, rules)
        state = {(x["source"], x["law_id"]): (x["content_hash"], x["metadata_hash"]) for x in Y.state_of(spark, store, "bigint").collect()}
        assert state == stored


def test_a_failed_run_leaves_nothing(spark, monkeypatch):
    rows, store = landed(random.Random(7)), scratch(spark, "sync")
    pages, stored, progress = spark.createDataFrame(rows, SHAPE), {}, {}
    Y.sync(pages, store, Y.Rules(max_pages=2))
    plain(rows, stored, progress, Y.Rules(max_pages=2))
    with monkeypatch.context() as m:
        m.setattr(Y, "report", lambda *a: 1 / 0)  # after the rows are written
        with pytest.raises(ZeroDivisionError):
            Y.sync(pages, store, Y.Rules(max_pages=2))
    assert not exists(spark, f"{store}/run-1")
    got = {x["source"]: x.asDict() for x in Y.sync(pages, store, Y.Rules(max_pages=2)).collect()}
    assert got == plain(rows, stored, progress, Y.Rules(max_pages=2))
    with pytest.raises(ValueError):
        Y.Rules(max_pages=0)
