"""Cuts at an error rate, found by counts, equal those of sorted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import cuts, ordered, scoring


def most(v, h, d, way, fdr):
    order = np.lexsort((d, h, -way * v))
    t, n = (~d[order]).cumsum(), d[order].cumsum()
    return int(t[(n + 1) / np.maximum(t, 1) <= fdr].max(initial=0))


@pytest.mark.parametrize("few", [3, 100_000])
def test_passing_equals_loops(spark, monkeypatch, few):
    monkeypatch.setattr(cuts, "FINER", 16)
    rng = np.random.default_rng(5)
    n = 1500
    decoy = rng.random(n) < 0.3
    x = np.stack([rng.normal(size=n) - decoy, rng.integers(0, 3, n).astype(float), np.where(rng.random(n) < 0.1, np.nan, rng.exponential(size=n)), np.zeros(n)], axis=1)
    h = rng.permutation(n).astype(np.int64) << 40
    df = spark.createDataFrame([(bool(d), [float(a) for a in row], int(k)) for d, row, k in zip(decoy, x, h, strict=True)], "is_decoy boolean, x array<double>, h long").repartition(3)
    for scores in ([(1, 1, None), (3, 1, None)], [(0, 1, 1), (0, -1, 1), (1, 1, 3), (0, 1, 2)]):
        want = {}
        for k, (i, sign, j) in enumerate(scores):
            v = x[:, i] if j is None else x[:, i] + sign * x[:, j]
            real = ~np.isnan(v)
            want.update({(k, way): most(v[real], h[real], decoy[real], way, 0.3) for way in (1, -1)})
        best = max(want.values())
        assert cuts.passing(df, scores, 0.3, few=few) == {k: v for k, v in want.items() if v == best}
        assert cuts.passing(df, scores, 0.3, beaten=best, few=few) == {}


@pytest.mark.parametrize("kind", ["plain", "ties", "one", "none pass"])
@pytest.mark.parametrize("few", [20, 100_000])
def test_targets_within_equal_q_values(spark, kind, few):
    rng = np.random.default_rng(7)
    n = 2000
    decoy = rng.random(n) < (0.3 if kind != "none pass" else 0.9)
    score = {"ties": rng.integers(0, 12, n).astype(float), "one": np.ones(n)}.get(kind, rng.normal(size=n)) - (decoy if kind != "one" else 0)
    df = spark.createDataFrame([(None if k == 7 else k // 2, k % 2, float(s), bool(d)) for k, (s, d) in enumerate(zip(score, decoy, strict=True))], "a int, b int, score double, is_decoy boolean").repartition(3)
    want = {(r["a"], r["b"]) for r in ordered.tdc_q_values(df, "score", F.col("is_decoy"), ["a", "b"]).where("not is_decoy and q_value <= 0.2").collect()}
    found = cuts.targets_within(df, "score", ["a", "b"], 0.2, few)
    if found is None:
        assert few == 20 and kind in ("ties", "one")
        return
    assert found[1] == len(want)
    assert {(r["a"], r["b"]) for r in df.where(found[0]).where("not is_decoy").collect()} == want


def test_scores_that_are_missing_take_the_sorted_way(spark):
    df = spark.createDataFrame([(1, None, False), (2, 1.0, True)], "a int, score double, is_decoy boolean")
    assert cuts.targets_within(df, "score", ["a"], 0.2) is None
    assert cuts.targets_within(df.where("a = 1").limit(0), "score", ["a"], 0.2)[1] == 0


def test_iterations_move_no_rows(spark):
    """Labels were joined to the rows, and scores sorted, in each iteration."""
    rng = np.random.default_rng(1)
    rows = [(k, bool(k % 3 == 0), float(rng.normal() + 2 * (k % 3 > 0)), float(rng.normal())) for k in range(600)]
    df = spark.createDataFrame(rows, "row_id int, is_decoy boolean, good double, noise double").withColumn("x", F.lit("kept"))
    for model in ("lda", "qda", "rbf_svm"):
        out = scoring.semi_supervised(df, ["good", "noise"], ["row_id"], model, max_iter=1, n=12)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert out.columns == [*df.columns, "score"] and out.where("x = 'kept' and score is not null").count() == 600
