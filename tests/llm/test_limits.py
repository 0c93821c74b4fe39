"""Limits of languages are taken from all that there is to learn from."""

import random

import numpy as np
import pytest

from folio_spark.llm import langid


def test_limits_are_medians_of_all_learning_documents(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcde ") for _ in range(r.randrange(5, 60))) + "a", "aa") for i in range(701)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(learn)
    found = langid.predict(learn, model).toPandas()
    usual = found["entropy"].median()
    off = (found["entropy"] - usual).abs()
    want = [usual, 1.4826 * off.median(), 1.4826 * (off * np.sqrt(found["n_signs"])).median()]
    assert len(found) == 701 and list(model.limits[0]) == pytest.approx(want, rel=1e-9)


def test_medians_take_a_few_jobs_however_values_are_spread(spark):
    r = random.Random(5)
    rows = [("wide", 10.0 ** r.uniform(-300, 300)) for _ in range(3001)] + [("even", float(r.randrange(7))) for _ in range(600)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0)] + [("same", 0.1)] * 501 + [("none", None)] * 3
    values = spark.createDataFrame(rows, "by string, value double").where("value is not null")
    spark.sparkContext.setJobGroup("medians", "medians")
    try:
        got = langid.medians(values)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("medians"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {by: float(np.median([v for k, v in rows if k == by])) for by in ("wide", "even", "one", "two", "same")}
    assert got == pytest.approx(want, rel=1e-12)
    assert jobs <= 12
