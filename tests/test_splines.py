"""The spline from sums against a plain dense solve, and the drift that it takes out."""

import numpy as np
from pyspark.sql import functions as F

from massloom.operators import extraction, splines


def basis(x, low, width, n):
    out = np.zeros((len(x), n))
    for r, v in enumerate(x):
        cell = min(max(int(np.floor((v - low) / width)), 0), n - 4)
        t = (v - low) / width - cell
        out[r, cell : cell + 4] = [(1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6]
    return out


def noisy(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, 5000, n))
    return x, 3 * np.sin(x / 700) + 0.002 * x + rng.normal(0, 0.5, n)


def test_fit_equals_a_plain_solve(spark):
    x, y = noisy()
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    for parts, segments in ((1, 20), (7, 64)):
        s = splines.fit_spline(df.repartition(parts), "x", "y", segments)
        n = segments + 3
        b = basis(x, x.min(), (x.max() - x.min()) / segments, n)
        d = np.diff(np.eye(n), 2, axis=0)
        scores = []
        for weight in 10.0 ** np.arange(-6, 6.1, 0.25) * np.trace(b.T @ b) / np.trace(d.T @ d):
            m = b.T @ b + weight * d.T @ d
            fit = b @ np.linalg.solve(m, b.T @ y)
            scores.append((len(x) * ((y - fit) ** 2).sum() / (len(x) - np.trace(np.linalg.solve(m, b.T @ b))) ** 2, weight, fit))
        _, weight, fit = min(scores, key=lambda e: e[0])
        assert abs(s.penalty / weight - 1) < 1e-6
        got = np.array([r["v"] for r in df.select("x", s.column(F.col("x")).alias("v")).orderBy("x").collect()])
        np.testing.assert_allclose(got, fit, atol=1e-8)
        assert np.abs(got - (3 * np.sin(x / 700) + 0.002 * x)).mean() < 0.15


def test_a_line_is_kept_and_few_rows_give_none(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(50)] + [(None, 1.0), (3.0, None)], "x double, y double")
    s = splines.fit_spline(df, "x", "y", 16)
    assert all(abs(r["v"] - (2 * r["x"] + 1)) < 1e-6 for r in df.where("x is not null").select("x", s.column(F.col("x")).alias("v")).collect())
    assert splines.fit_spline(df.limit(4), "x", "y") is None
    assert splines.fit_spline(spark.createDataFrame([(1.0, float(k)) for k in range(9)], "x double, y double"), "x", "y") is None


def test_drift_is_taken_out_of_errors(spark):
    x, y = noisy(300, 2)
    y[17] += 8
    rows = [(k, float(s), float(p + o)) for k, (s, p) in enumerate(zip(x, y, strict=True)) for o in (-1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "feature_id int, scan double, ppm double")
    z = np.array([r["z"] for r in extraction.drift_zscore(df).orderBy("feature_id").collect()])
    assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9 and z.argmax() == 17
    rest = np.delete(z, 17)
    assert abs(np.corrcoef(rest, np.sin(np.delete(x, 17) / 700))[0, 1]) < 0.2
    assert {r["z"] for r in extraction.drift_zscore(df.where("feature_id < 4")).collect()} == {0.0}
    flat = df.withColumn("ppm", F.lit(2.0))
    assert {r["z"] for r in extraction.drift_zscore(flat).collect()} == {0.0}
