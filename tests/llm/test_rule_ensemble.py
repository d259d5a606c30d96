import zlib

import numpy as np
from llm_fixtures import empty, odd, odd_rows

from massloom.llm import op4_rule_ensemble as R


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = R.quality_scores(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    assert all(zlib.crc32(str(r["id"]).encode()) % 3 == 1 for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_compiled_column_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(R.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.4)).astype(float)
    model = R.fit_rules(x, y)
    assert 0 < len(model.rules) < 300
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in R.FEATURES))
    got = [r[0] for r in df.select(model.column()).collect()]
    np.testing.assert_allclose(sorted(got), sorted(model.score(x)), atol=1e-9)


def test_lasso_leaves_noise_out():
    rng = np.random.default_rng(2)
    r = rng.integers(0, 2, (2000, 30)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * r[:, 0] - 2 * r[:, 1])))).astype(float)
    _, w = R.lasso_logistic(r, y, 0.02)
    assert w[0] > 1 and w[1] < -0.5 and (np.abs(w[2:]) < 0.1).all()


def test_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(0, None), (1, 1), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    got = R.quality_scores(odd(spark), labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert R.quality_scores(empty(spark), labels).count() == 0
