"""Histograms and quartiles whose ends no single task gathers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import report


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(4)
    v = rng.lognormal(size=9000)
    rows = [(float(x) if k % 50 else None, bool(k % 3 == 0), float(k % 11) / 100) for k, x in enumerate(v)]
    return rows, spark.createDataFrame(rows, "score double, is_decoy boolean, q_value double")


def gathers(df):
    return "percentile" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_histogram_between_quantiles(table):
    rows, df = table
    out = report.histogram(df, "score", "is_decoy", 20)
    assert not gathers(out)
    v = np.array([r[0] for r in rows if r[0] is not None])
    lo, hi = np.quantile(v, [0.01, 0.99])
    want = {}
    for x, d, _ in rows:
        if x is not None and lo <= x <= hi:
            key = (d, min(int((x - lo) / (hi - lo) * 20), 19))
            want[key] = want.get(key, 0) + 1
    assert {(r["is_decoy"], r["bin"]): r["n"] for r in out.collect()} == want
    assert report.histogram(df.where("score < 0"), "score", "is_decoy").count() == 0
    assert report.histogram(df.withColumn("score", F.lit(1.0)), "score", "is_decoy").count() == 0


def test_quartiles_by_outcome(table):
    rows, df = table
    out = report.by_outcome(df, "score")
    assert not gathers(out)
    kind = lambda d, q: "decoy" if d else "q<=0.01" if q <= 0.01 else "q<=0.05" if q <= 0.05 else "rest"
    got = {r["outcome"]: r for r in out.collect()}
    assert len(got) == 4
    for name, r in got.items():
        v = [x for x, d, q in rows if x is not None and kind(d, q) == name]
        assert r["n"] == len(v)
        np.testing.assert_allclose([r["q1"], r["median"], r["q3"]], np.quantile(v, [0.25, 0.5, 0.75]))
