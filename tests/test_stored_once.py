"""Semi-supervised scoring stores its rows and their folds, and neither scaled features, scores nor hashes."""

import numpy as np

from massloom.operators import ordered, scoring


def rows_of(spark, n=3000):
    rng = np.random.default_rng(6)
    y = rng.random(n) < 0.4
    x = np.round(rng.normal(size=(n, 3)) + np.where(y, 0, 1.2)[:, None], 6)
    return spark.createDataFrame([(k, bool(d), *map(float, v)) for k, (d, v) in enumerate(zip(y, x, strict=True))], "id long, is_decoy boolean, a double, b double, c double")


def test_only_columns_and_folds_are_stored(spark, monkeypatch):
    held, plain = [], scoring.stored
    monkeypatch.setattr(scoring, "stored", lambda df: held.append(sorted(df.columns)) or plain(df))
    out = scoring.semi_supervised(rows_of(spark), ["a", "b", "c"], ["id"], "lda")
    assert sorted(out.columns) == ["a", "b", "c", "id", "is_decoy", "score"] and out.count() == 3000
    assert held == [["a", "b", "c", "id", "is_decoy"], ["a", "b", "c", "fold", "id", "is_decoy"]]


def test_hashes_are_not_moved_with_the_rows(spark):
    df = rows_of(spark)
    out = ordered.folds(df.repartition(5), ["is_decoy"], ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "md5" not in plan[: plan.index("RepartitionByExpression")].split("Window")[0] and "_md5" not in below
    sizes = {(r["is_decoy"], r["fold"]): r["count"] for r in out.groupBy("is_decoy", "fold").count().collect()}
    assert len(sizes) == 6 and all(max(v for (d, _), v in sizes.items() if d == k) - min(v for (d, _), v in sizes.items() if d == k) <= 1 for k in (True, False))
