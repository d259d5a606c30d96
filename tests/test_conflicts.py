"""Choices in rounds, and the decoys that rest on them."""

import numpy as np
from pyspark.sql import functions as F

from massloom.functions import chemistry as C
from massloom.operators import conflicts, peptide_table

PROTEIN = "MALPVTALLLLAAGLLAHAAGTSQVQVSTQILHQKPEPTIDEKVFGRCELAAAMKRHGLDNYRTESTVLGTGFLSRAAATESTPEPTIDEK"


def test_rounds_equal_a_sequential_loop(spark):
    rng = np.random.default_rng(2)
    items = [(i, float(rng.integers(0, 40)), int(p)) for i in range(150) for p in {*rng.integers(0, 120, 3)}]
    score = {i: s for i, s, _ in reversed(items)}
    items = [(i, score[i], p) for i, _, p in items]
    used, want = set(), []
    for i in sorted(score, key=lambda i: (-score[i], i)):
        own = {p for j, _, p in items if j == i}
        if not own & used:
            used |= own
            want.append(i)
    df = spark.createDataFrame(items, "item int, score double, place int")
    assert sorted(r["item"] for r in conflicts.best_disjoint(df, "item", "score", ["place"]).collect()) == sorted(want)


def test_first_free_places(spark):
    rng = np.random.default_rng(3)
    ppm, rows = 50.0, []
    for k in range(120):
        rows += [(f"k{k}", t, float(np.round(1000 + rng.uniform(0, 6), 3))) for t in range(4)]
    df = spark.createDataFrame(rows, "key string, _try int, place double")
    order = {r["key"]: (r["h"], r["key"]) for r in df.select("key", F.xxhash64(F.lit("42"), F.col("key")).alias("h")).collect()}
    near = lambda a, b: abs(a - b) <= max(a, b) * ppm / 1e6
    got = {r["key"]: (r["_try"], r["place"]) for r in conflicts.first_free(df, "key", ppm).collect()}
    assert got == {r["key"]: (r["_try"], r["place"]) for r in conflicts.first_free(df.repartition(7), "key", ppm).collect()}
    places = [p for _, p in got.values()]
    assert not any(near(a, b) for i, a in enumerate(places) for b in places[:i])
    # every option before the one taken, and all of those who got none, lie near another's place
    for k in order:
        for _, t, p in (r for r in rows if r[0] == k):
            if k not in got or t < got[k][0]:
                assert any(near(p, q) for j, (_, q) in got.items() if j != k)
    held = spark.createDataFrame([(1000.0 + x / 50,) for x in range(0, 200)], "place double")
    more = conflicts.first_free(df, "key", ppm, held=held).collect()
    assert all(not near(r["place"], 1000.0 + x / 50) for r in more for x in range(200))
    assert conflicts.first_free(df, "key", ppm, relaxed=True).count() == 120
    assert conflicts.first_free(df.limit(0), "key", ppm).count() == 0


def table(spark, n=12):
    rng = np.random.default_rng(1)
    rows = [(f"P{k}", "".join(rng.permutation(list(PROTEIN)))) for k in range(n)]
    t = peptide_table.digest_with_decoys(spark.createDataFrame(rows, "accession string, sequence string"), missed=1, decoys=False)
    f = t.select("mh_mz").distinct().orderBy("mh_mz").toPandas()
    f = spark.createDataFrame([(k, float(m)) for k, m in enumerate(f["mh_mz"])], "feature_idx int, feature_mz double")
    return t, f, peptide_table.match(f, t)


def near(a, b, ppm=20.0):
    return abs(a - b) <= max(a, b) * ppm / 1e6


def test_shifted_decoys_without_snapping_lie_apart(spark):
    t, f, cand = table(spark)
    rows = peptide_table.mz_shift_decoys(cand, f, snap=False, masses=t).collect()
    decoys, top = [r for r in rows if r["is_decoy"]], f.count()
    assert len(decoys) > 0.95 * len({r["peptide"] for r in rows if not r["is_decoy"]})
    assert all(r["decoy_delta_da"] is None for r in rows if not r["is_decoy"])
    mzs = [r["feature_mz"] for r in decoys]
    assert not any(near(a, b) for i, a in enumerate(mzs) for b in mzs[:i])
    known = [r["mh_mz"] for r in t.collect()]
    for r in decoys:
        assert abs(r["feature_mz"] - r["mh_mz"] - r["decoy_delta_da"]) < 1e-9 and 5 <= abs(r["decoy_delta_da"]) <= 20
        assert r["protein"].startswith("DECOY_") and r["ppm_error_abs"] <= 20.0 and r["feature_idx"] >= top
        assert not any(abs(r["feature_mz"] - m) <= m * 20 / 1e6 for m in known)
    assert len({r["feature_idx"] for r in decoys}) == len(decoys)
    again = peptide_table.mz_shift_decoys(cand.repartition(5), f, snap=False, masses=t).where("is_decoy").collect()
    assert sorted((r["peptide"], r["feature_mz"]) for r in again) == sorted((r["peptide"], r["feature_mz"]) for r in decoys)


def test_snapped_decoys_sit_at_features(spark):
    t, f, _ = table(spark)
    grid = spark.range(0, 130_000).select(F.col("id").cast("int").alias("feature_idx"), (700 + F.col("id") / 100).alias("feature_mz"))
    cand = peptide_table.match(grid, t)
    decoys = peptide_table.mz_shift_decoys(cand, grid, masses=t).where("is_decoy").collect()
    assert len(decoys) > 20
    for r in decoys:
        assert abs(r["feature_mz"] - (700 + r["feature_idx"] / 100)) < 1e-9 and 5 - 0.1 <= abs(r["decoy_delta_da"]) <= 20.1
        assert abs(r["mh_mz"] + r["decoy_delta_da"] - r["feature_mz"]) < 1e-9
    one = spark.createDataFrame([(0, t.first()["mh_mz"])], "feature_idx int, feature_mz double")
    assert peptide_table.mz_shift_decoys(peptide_table.match(one, t), one, masses=t).where("is_decoy").count() == 0


def test_substituted_decoys(spark):
    t, _, _ = table(spark)
    targets = {r["peptide"]: r["mh_mz"] for r in t.collect()}
    for n in (1, 2):
        rows = peptide_table.substitution_decoys(t, n).collect()
        assert len(rows) >= 0.95 * len(targets)
        assert not {r["peptide"] for r in rows} & set(targets)
        up = 0
        for r in rows:
            source = [p for p in targets if len(p) == len(r["peptide"]) and sum(a != b for a, b in zip(p, r["peptide"], strict=True)) == n]
            assert source
            p = source[0]
            changed = [k for k, (a, b) in enumerate(zip(p, r["peptide"], strict=True)) if a != b]
            assert all(0 < k < len(p) - 1 and p[k] not in "KR" and r["peptide"][k] not in "KR" for k in changed)
            assert not any(abs(r["mh_mz"] - m) <= m * 20 / 1e6 for m in targets.values())
            up += r["mh_mz"] > targets[p]
        assert 0.3 < up / len(rows) < 0.7
        mzs = sorted(r["mh_mz"] for r in rows)
        assert sum(near(a, b) for a, b in zip(mzs, mzs[1:])) <= 0.1 * len(rows)
    far = peptide_table.substitution_decoys(t, 1, shift_min=30.0).collect()
    assert far and all(min(abs(r["mh_mz"] - m) for p, m in targets.items() if len(p) == len(r["peptide"]) and sum(a != b for a, b in zip(p, r["peptide"], strict=True)) == 1) >= 30 - 1e-6 for r in far)
    assert peptide_table.substitution_decoys(t.where("false")).count() == 0
    dense = C.RESIDUES  # every substitute has a residue above or below it in mass
    assert all(any(dense[x][0] != dense[r][0] for x in peptide_table.SUBSTITUTES) for r in peptide_table.SUBSTITUTES)


def test_crowded_options_meet_only_the_first_of_their_cells(spark, monkeypatch):
    """Of 400 options within 30 ppm few are compared with the others; the choice is the loop's, relative order and all."""
    rng = np.random.default_rng(7)
    rows = [(f"k{k}", 0, float(np.round(1000 + rng.uniform(0, 0.03), 6))) for k in range(400)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "key string, _try int, place double")
    sizes, plain = [], conflicts.near_pairs
    monkeypatch.setattr(conflicts, "near_pairs", lambda a, b, *rest: sizes.append(a.count()) or plain(a, b, *rest))
    got = {r["key"]: r["place"] for r in conflicts.first_free(df, "key", 20.0).collect()}
    order = {r["key"]: (r["h"], r["key"]) for r in df.select("key", F.xxhash64(F.lit("42"), F.col("key")).alias("h")).collect()}
    want = {}
    for key, _, place in sorted(rows, key=lambda r: order[r[0]]):
        if place is None or not any(p is not None and near(place, p) for p in want.values()):
            want[key] = place
    assert got == want and max(sizes) <= 6
