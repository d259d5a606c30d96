"""Ranks, samples and sweeps whose strata may hold all rows, against plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import ordered, scoring


def md5(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def rows(n=3000):
    rng = np.random.default_rng(6)
    return [(k, None if k % 50 == 0 else "big" if rng.random() < 0.8 else f"s{int(rng.integers(4))}") for k in range(n)]


def test_ranks_and_folds_equal_a_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, s string")
    got = {r["id"]: r["fold"] for r in ordered.folds(df.repartition(5), ["s"], ["id"], 3).collect()}
    assert len(got) == len(data)
    for s in {s for _, s in data}:
        for place, k in enumerate(sorted((k for k, t in data if t == s), key=lambda k: md5(42, k))):
            assert got[k] == place % 3


@pytest.mark.parametrize("total", [100, 400, 5000])
def test_quotas_and_top_up(spark, total):
    data = rows()
    need = {"big": 300, "s0": 7, "s1": 100_000}
    df = spark.createDataFrame([(k, s, need.get(s)) for k, s in data], "id int, s string, need int")
    own = set()
    for s, n in need.items():
        own |= set(sorted((k for k, t in data if t == s), key=lambda k: md5(42, k))[:n])
    plain = ordered.stratified_sample(df, ["s"], ["id"], F.coalesce("need", F.lit(0)))
    assert {r["id"] for r in plain.collect()} == own and plain.columns == df.columns
    rest = sorted((k for k, _ in data if k not in own), key=lambda k: md5(42, k))
    got = ordered.sample_with_top_up(df, ["s"], ["id"], F.coalesce("need", F.lit(0)), total).collect()
    assert {r["id"] for r in got} == own | set(rest[: max(0, total - len(own))]) and len(got) == max(len(own), min(total, len(data)))


def test_column_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(9)
    columns = {"a": rng.normal(0, 1, 2001), "b": rng.lognormal(0, 6, 2001), "c": np.repeat(3.0, 2001), "d": rng.integers(0, 3, 2001).astype(float), "e": np.full(2001, np.nan), "f": np.where(rng.random(2001) < 0.3, np.nan, rng.uniform(-1e6, 1e6, 2001))}
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for v in row) for k, row in enumerate(zip(*columns.values(), strict=True))], ", ".join(f"{c} double" for c in columns))
    for share in (0.0, 0.5, 0.77, 1.0):
        for few, bins in ((65_536, 8192), (1, 64)):
            got = ordered.column_quantiles(df, list(columns), share, bins=bins, few=few)
            for c, v in columns.items():
                v = v[~np.isnan(v)]
                assert got[c] is None if not len(v) else np.isclose(got[c], np.percentile(v, 100 * share), rtol=1e-12)


def sweep(values, decoys, hashes, fdr):
    best = d = t = 0
    for _, _, decoy in sorted(zip((-v for v in values), hashes, decoys, strict=True)):
        d, t = d + decoy, t + (not decoy)
        if (d + 1) / max(t, 1) <= fdr:
            best = t
    return best


def test_seed_sweep_and_bounds_equal_loops(spark):
    rng = np.random.default_rng(4)
    n = 2500
    decoys = rng.random(n) < 0.5
    cols = {"good": rng.normal(0, 1, n) + 1.5 * ~decoys, "ties": np.where(decoys, 0.0, rng.integers(0, 2, n)), "few": rng.integers(0, 4, n).astype(float) + (~decoys & (rng.random(n) < 0.2)) * 4, "noise": rng.normal(0, 1, n), "flat": np.zeros(n), "holes": np.where(rng.random(n) < 0.4, np.nan, rng.normal(0, 1, n) - ~decoys)}
    df = spark.createDataFrame([(k, bool(decoys[k]), *(None if np.isnan(c[k]) else float(c[k]) for c in cols.values())) for k in range(n)], "id int, is_decoy boolean, " + ", ".join(f"{c} double" for c in cols))
    hashes = [hashlib.md5(str(k).encode()).hexdigest() for k in range(n)]
    want = {}
    for c, v in cols.items():
        real = np.nonzero(~np.isnan(v))[0]
        for way in (1, -1):
            want[c, way] = sweep(v[real] * way, decoys[real], [hashes[k] for k in real], 0.2)
    got = {(r["feature"], r["direction"]): r["n"] for r in scoring.seed_sweep(df.repartition(3), list(cols), ["id"], 0.2).collect()}
    assert got == want
    assert scoring.best_seed(df, list(cols), ["id"], 0.2) == (*max(want, key=lambda k: want[k]), max(want.values()))
    x = df.select("is_decoy", F.array(*(F.coalesce(c, F.lit(float("nan"))) for c in cols)).alias("x"))
    names = list(cols)
    for (k, way), (sure, most) in scoring.seed_bounds(x, [(k, 1, None) for k in range(len(cols))], 0.2, bins=64).items():
        assert sure <= want[names[k], way] <= most
    for (_, way), (sure, most) in scoring.seed_bounds(x, [(0, -1, 3)], 0.2, bins=256).items():
        assert sure <= sweep((cols["good"] - cols["noise"]) * way, decoys, hashes, 0.2) <= most
