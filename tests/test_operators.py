"""Golden values and invariants of the engine's own operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import chemistry as C
from massloom.operators import extraction, imaging, lcms, ordered, peptide_table, picking, ranges, scoring

PROTEIN = "MKWVTFISLLFLFSSAYSRGVFRRDAHKSEVAHRFKDLGEENFKALVLIAFAQYLQQCPFEDHVKLVNEVTEFAKTCVADESAENCDKSLHTLFGDKLCTVATLR"


def proteins(spark):
    return spark.createDataFrame([("P1", PROTEIN), ("P2", "MAAAAAKPEPTIDERWKPGGGGGGRMRPAAAAAAAK"), ("P3", "")], "accession string, sequence string")


def test_digest_follows_the_trypsin_rule(spark):
    got = {r["peptide"] for r in peptide_table.digest(proteins(spark).where("accession = 'P2'"), 0, 1, 60).collect()}
    assert got == {"MAAAAAKPEPTIDER", "WK", "PGGGGGGR", "MR", "PAAAAAAAK"}


def test_mass_of_a_known_peptide(spark):
    row = spark.createDataFrame([("PEPTIDE",), ("PEPTIDEX",)], "p string").select(C.neutral_mass(F.col("p")).alias("m")).collect()
    assert abs(row[0]["m"] - 799.35998) < 1e-3 and row[1]["m"] is None


def test_isotope_pattern_golden(spark):
    atoms = {"C": F.lit(35), "H": F.lit(64), "N": F.lit(14), "O": F.lit(7), "S": F.lit(0)}
    row = spark.range(1).select(*C.isotope_pattern(atoms)).first()
    np.testing.assert_allclose(list(row), [0.6457, 0.2839, 0.0703], atol=1e-3)


def test_shuffle_keeps_k_and_r_and_all_letters(spark):
    row = C.with_shuffled(proteins(spark).where("accession = 'P1'"), "sequence", F.lit("s"), "m").first()
    assert sorted(row["m"]) == sorted(PROTEIN) and row["m"] != PROTEIN
    assert all((a in "KR") == (b in "KR") and (a not in "KR" or a == b) for a, b in zip(row["m"], PROTEIN, strict=True))


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = sorted(rng.uniform(500, 600, 300).round(4)), sorted(rng.uniform(500, 600, 400).round(4))
    left = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "i int, l double")
    right = spark.createDataFrame([(j, float(x)) for j, x in enumerate(b)], "j int, r double")
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(y - x) <= x * 50 / 1e6}
    for salts in (1, 3):
        assert {(r["i"], r["j"]) for r in ranges.range_join(left, right, "l", "r", ppm=50.0, salts=salts).collect()} == want
    near = {r["i"]: r["j"] for r in ranges.nearest_of_all(left, right, "l", "r", ["i"], "j", 7).collect()}
    assert near == {i: min(range(len(b)), key=lambda j: (abs(b[j] - x), b[j])) for i, x in enumerate(a)}


def test_range_join_has_no_cross_product(spark):
    left, right = spark.range(10).select(F.col("id").cast("double").alias("l")), spark.range(10).select(F.col("id").cast("double").alias("r"))
    plan = ranges.range_join(left, right, "l", "r", ppm=10.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("parts", [1, 32])
def test_tdc_equals_numpy(spark, parts):
    rng = np.random.default_rng(1)
    score, decoy = rng.integers(0, 200, 800).astype(float), rng.random(800) < 0.4
    df = spark.createDataFrame([(i, float(s), bool(d)) for i, (s, d) in enumerate(zip(score, decoy, strict=True))], "row_id int, score double, is_decoy boolean")
    got = {r["row_id"]: r["q_value"] for r in ordered.tdc_q_values(df, "score", F.col("is_decoy"), ["row_id"], ranges=parts).collect()}
    order = np.lexsort((np.arange(800), -score))
    d = np.cumsum(decoy[order])
    t = np.cumsum(~decoy[order])
    q = np.minimum.accumulate(((d + 1) / np.maximum(t, 1))[::-1])[::-1].clip(0, 1)
    np.testing.assert_allclose([got[i] for i in order], q)


def test_weighted_windows_golden(spark):
    peaks = spark.createDataFrame([(100.0, 1.0, 0.80), (100.001, 1.0, 0.85), (200.0, 2.0, 1.20), (300.5, 1.0, 1.0)], "mz double, intensity double, inv_k0 double")
    q = spark.createDataFrame([(100.0,), (200.0,), (250.0,)], "query_mz double")
    got = {r["query_mz"]: r["w"] for r in extraction.weighted_mean(extraction.windows(peaks, q, 25.0), ["query_mz"], "inv_k0", out="w").collect()}
    assert got == {100.0: pytest.approx(0.825), 200.0: pytest.approx(1.2)}


def test_weighted_colocalization_golden(spark):
    pairs = spark.createDataFrame([("A", 100, 200, 0.2), ("A", 100, 300, 0.8), ("A", 200, 300, 0.5)], "protein string, a int, b int, r double")
    w = spark.createDataFrame([(100, 1.0), (200, 4.0), (300, 9.0)], "feature_id int, w double")
    row = imaging.colocalization(pairs, w).where("a = 100").first()
    assert row["protein_colocalization_weighted"] == pytest.approx((2 * 0.2 + 3 * 0.8) / 5)
    assert row["protein_colocalization_top2"] == pytest.approx(0.5)


def test_lattice_statistics_equal_dense_numpy(spark):
    rng = np.random.default_rng(3)
    img = np.where(rng.random((6, 9)) < 0.5, rng.random((6, 9)), 0)
    rows = [(1, int(y), int(x), float(img[y, x])) for y, x in zip(*np.nonzero(img), strict=True)]
    got = imaging.lattice_stats(spark.createDataFrame(rows, "feature_id int, y int, x int, intensity double"), 6, 9).first()
    z, num, sq, w = img - img.mean(), 0.0, 0.0, 0
    for y in range(6):
        for x in range(9):
            for dy, dx in imaging.OFFSETS:
                if 0 <= y + dy < 6 and 0 <= x + dx < 9:
                    num += z[y, x] * z[y + dy, x + dx]
                    sq += (img[y, x] - img[y + dy, x + dx]) ** 2
                    w += 1
    assert got["spatial_morans_i"] == pytest.approx(54 * num / (w * (z**2).sum()))
    assert got["spatial_gearys_c"] == pytest.approx(53 * sq / (2 * w * (z**2).sum()))


def test_deisotoping_keeps_the_first_of_a_falling_chain(spark):
    rows = [(k, 1000 + k * C.NEUTRON, v) for k, v in enumerate((100.0, 95.0, 80.0, 60.0))] + [(9, 1500.0, 10.0)]
    df = spark.createDataFrame(rows, "interval_id int, mz_apex double, apex_intensity double")
    assert {r["interval_id"] for r in extraction.deisotoped(df).collect()} == {0, 9}


def test_peaks_are_picked(spark):
    mz = np.arange(200)
    y = 10 * np.exp(-((mz - 60) ** 2) / 18) + 5 * np.exp(-((mz - 140) ** 2) / 18)
    df = spark.createDataFrame([(int(k), float(500 + k * 0.01), float(v)) for k, v in zip(mz, y, strict=True)], "cell int, mz double, intensity double")
    got = sorted(round(r["mz_apex"], 2) for r in picking.pick_peaks(df, 0.05).collect())
    assert got == [500.6, 501.4]


def test_fragment_angle(spark):
    row = spark.range(1).select(F.expr("array(named_struct('mz', 100D, 'intensity', 1D), named_struct('mz', 200D, 'intensity', 2D), named_struct('mz', 300D, 'intensity', 3D))").alias("p"))
    same = row.select(lcms.fragment_angle(F.col("p"), F.col("p")).alias("a")).first()["a"]
    few = row.select(lcms.fragment_angle(F.col("p"), F.slice("p", 1, 2)).alias("a")).first()["a"]
    assert same["angle"] == pytest.approx(1.0, abs=1e-6) and same["n"] == 3 and few["angle"] == 0


def decoy_table(spark, shift=1.5):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2 == 1, float(rng.normal(0 if i % 2 else shift)), float(rng.normal())) for i in range(600)]
    return spark.createDataFrame(rows, "row_id int, is_decoy boolean, good double, noise double")


@pytest.mark.parametrize("model", ["lda", "qda", "svm", "rbf_svm"])
def test_models_separate_targets_from_decoys(spark, model):
    t = scoring.semi_supervised(decoy_table(spark), ["good", "noise"], ["row_id"], model, init_fdr=0.3, train_fdr=0.3, max_iter=1, n=12).collect()
    good, bad = [r["score"] for r in t if not r["is_decoy"]], [r["score"] for r in t if r["is_decoy"]]
    assert np.mean([a > b for a in good for b in bad]) > 0.75


@pytest.mark.parametrize("model", ["lda", "qda", "svm", "rbf_svm"])
def test_models_separate_targets_from_decoys_by_default_settings(spark, model):
    t = scoring.semi_supervised(decoy_table(spark), ["good", "noise"], ["row_id"], model, init_fdr=0.3, train_fdr=0.3, max_iter=2).collect()
    good, bad = [r["score"] for r in t if not r["is_decoy"]], [r["score"] for r in t if r["is_decoy"]]
    assert np.mean([a > b for a in good for b in bad]) > 0.75


def test_newton_steps_settle_or_warn(spark):
    t = scoring.standardised(decoy_table(spark), ["good", "noise"]).withColumn("label", F.when(F.col("is_decoy"), -1).otherwise(1)).cache()
    fitted = scoring.fit_squared_hinge(t, 2)
    x = np.array([[*r["x"], 1.0] for r in t.collect()])
    y = np.array([r["label"] for r in t.collect()])
    beta = np.append(fitted.weights, fitted.bias)
    on = y * (x @ beta) < 1
    slope = np.append(beta[:2], 1e-6 * beta[2]) - 2 * (x[on].T @ (y[on] * (1 - (y * (x @ beta))[on])))
    assert np.abs(slope).max() < 1e-3
    with pytest.warns(RuntimeWarning, match="not settled"):
        scoring.fit_squared_hinge(t, 2, rounds=1)


def test_model_queries_run_with_the_default_settings(spark, monkeypatch):
    import inspect

    from massloom.plans import queries_scoring

    seen = []
    assert inspect.signature(scoring.semi_supervised).parameters["max_iter"].default == 5
    for name in ("semi_supervised", "two_rounds"):
        monkeypatch.setattr(scoring, name, lambda df, *a, own=inspect.signature(getattr(scoring, name)), **k: (seen.append((own.bind(df, *a, **k).arguments)), df.selectExpr("*", "0d score", "0d score_r1", "0d score_r2", "0d q_value"))[1])
    for name in ("m5_lda", "m6_linear_svm", "m7_gradient_boosting", "m8_rbf_svm", "m9_qda", "m3_m4_m12_two_rounds"):
        getattr(queries_scoring, name)(spark, "/root/testdata/sf0.001")
    assert len(seen) == 6 and all(not {"init_fdr", "train_fdr", "max_iter", "options"} & set(a) for a in seen)


def passing(t, fdr):
    from massloom.operators.ordered import tdc_q_values

    return tdc_q_values(t, "score", F.col("is_decoy"), ["row_id"], out="q").where(f"not is_decoy and q <= {fdr}").count()


def test_weak_seeds_are_sought_in_pairs_and_trees(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        # apart in a - b only
        u, decoy = float(rng.normal(0, 20)), i % 2 == 1
        rows.append((i, decoy, u + (0 if decoy else 3) + float(rng.normal(0, 0.5)), u))
    pair = scoring.standardised(spark.createDataFrame(rows, "row_id int, is_decoy boolean, a double, b double"), ["a", "b"])
    assert scoring.best_seed(pair, ["a", "b"], ["row_id"], 0.05)[2] < 50
    assert passing(scoring.seed_score(pair, ["a", "b"], ["row_id"], 0.05), 0.05) >= 100
    # targets lie in the middle of a, which two cuts find and no ranking of sums
    rows = [(i, i % 2 == 1, float(rng.uniform(-1, 1) * (1 if i % 2 else 0.03)), float(rng.normal())) for i in range(2000)]
    tree = scoring.standardised(spark.createDataFrame(rows, "row_id int, is_decoy boolean, a double, b double"), ["a", "b"])
    assert scoring.best_seed(tree, ["a", "b"], ["row_id"], 0.1)[2] < 50
    assert passing(scoring.seed_score(tree, ["a", "b"], ["row_id"], 0.1), 0.1) >= 500


def test_model_settings_reach_the_models():
    from massloom.plans.config import load
    from massloom.plans.rescore import model_options

    assert model_options(load(model="svm", svm_c=0.3)) == {"c": 0.3}
    assert model_options(load(model="gbt")) == {"trees": 200, "depth": 3, "rate": 0.1}
    assert model_options(load(model="gbt", gbt_n_estimators=7, gbt_max_depth=2, gbt_learning_rate=0.2)) == {"trees": 7, "depth": 2, "rate": 0.2}
    assert model_options(load(model="rbf_svm", rbf_svm_gamma=0.02)) == {"c": 1.0, "gamma": 0.02} and model_options(load()) == {}


def test_lda_weights_equal_numpy(spark):
    t = scoring.standardised(decoy_table(spark), ["good", "noise"]).withColumn("label", F.when(F.col("is_decoy"), -1).otherwise(1))
    fitted = scoring.fit_lda(t, 2)
    x = np.array([r["x"] for r in t.collect()])
    y = np.array([r["label"] for r in t.collect()])

    def shrunk(a):
        a = a - a.mean(0)
        n, p = a.shape
        s = a.T @ a / n
        mu = np.trace(s) / p
        d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
        b2 = min(d2, (((a**2).sum(1) ** 2).mean() - (s**2).sum()) / (p * n))
        return (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p)

    cov = (shrunk(x[y == -1]) + shrunk(x[y == 1])) / 2
    want = np.linalg.solve(cov, x[y == 1].mean(0) - x[y == -1].mean(0))
    np.testing.assert_allclose(fitted.weights, want, rtol=1e-6)


def test_decoy_generators(spark):
    t = peptide_table.digest_with_decoys(proteins(spark), missed=1, decoys=False)
    f = t.select((F.col("mh_mz") * 1.000002).alias("feature_mz")).distinct().withColumn("feature_idx", F.monotonically_increasing_id().cast("int"))
    cand = peptide_table.match(f, t)
    assert cand.where("abs(ppm_error) > 20.1").count() == 0
    shifted = peptide_table.mz_shift_decoys(cand, f, snap=False)
    d = shifted.where("is_decoy").collect()
    assert d and all(5 <= abs(r["decoy_delta_da"]) <= 20 and r["protein"].startswith("DECOY_") for r in d)
    shuffled = peptide_table.mz_shuffle_decoys(cand).collect()
    assert sum(r["is_decoy"] for r in shuffled) == len(shuffled) / 2
    own = {r["peptide"]: r["feature_idx"] for r in shuffled if not r["is_decoy"]}
    assert all(own[r["peptide"]] != r["feature_idx"] for r in shuffled if r["is_decoy"])
    subs = peptide_table.substitution_decoys(t).collect()
    known = {r["peptide"] for r in t.collect()}
    assert subs and not known & {r["peptide"] for r in subs}
    for again in (peptide_table.substitution_decoys(t.repartition(7)),):
        assert sorted(r["peptide"] for r in again.collect()) == sorted(r["peptide"] for r in subs)


def test_decoy_queries_reach_balance_and_keep_missed_cleavages(spark, tmp_path):
    from massloom.plans import queries_chemistry as Q

    texts = [(r["doc_id"], r["text"][:150]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(12).collect()]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    _, f, cand = Q._targets(spark, str(tmp_path))
    assert cand.where(C.missed_cleavages(F.col("peptide")) == 2).count() > 0

    def reached(rows):
        sides = [{}, {}]
        for p, d in {(r["peptide"], r["is_decoy"]) for r in rows}:
            sides[d][len(p)] = sides[d].get(len(p), 0) + 1
        return sum(min(n, sides[1].get(k, 0)) for k, n in sides[0].items()) / sum(sides[0].values())

    full = reached(Q.g8_balanced_shuffle(spark, str(tmp_path)).collect())
    short = reached(peptide_table.balanced_shuffle(Q.proteins(spark, str(tmp_path)), cand, f, rounds=2, block=1).collect())
    assert full > 0.5 and full > 5 * short


def test_kde_pep_falls_with_the_score(spark):
    rows = sorted(scoring.kde_pep(decoy_table(spark, 3.0), "good").collect(), key=lambda r: r["good"])
    assert rows[10]["pep"] > 0.8 and rows[-10]["pep"] < 0.2 and all(0 <= r["pep"] <= 1 for r in rows)


def test_negative_and_null_ppm_are_safe(spark):
    row = spark.range(1).select(C.spectral_angle(F.lit(1.0000001)).alias("a"), C.gravy(F.lit("")).alias("g"), C.missed_cleavages(F.lit("AKPRAK")).alias("m")).first()
    assert math.isclose(row["a"], 1.0) and row["g"] == 0 and row["m"] == 1


def test_feature_groups_reach_over_empty_fine_bins(spark):
    rows = [(p, 1000.0, 1.0) for p in range(5)] + [(p, 1000.0 * (1 + 2.5e-6), 1.0) for p in range(5, 10)] + [(p, 1000.0 * (1 + 9e-6), 1.0) for p in range(3)]
    peaks = spark.createDataFrame(rows, "pixel int, mz double, intensity double")
    found = extraction.merge_bins(extraction.fine_bins(peaks, 5.0), 10, 5.0, 0.6).collect()
    assert [(r["n_pixels"], r["intensity"]) for r in found] == [(10, 10.0)]
    assert abs(found[0]["feature_mz"] - 1000.0 * (1 + 1.25e-6)) < 1e-9


def test_evidence_counts_scans_within_the_time_window_only(spark):
    peaks = "array<struct<mz:double,intensity:double>>"
    mz = 800.4
    cand = spark.createDataFrame([(1, "PEPTIDEK", mz - C.PROTON, mz)], "row_id long, peptide string, mass double, mh_mz double")
    ms1 = spark.createDataFrame([(1, 10.0, [(mz, 5.0)]), (2, 30.0, [(mz, 50.0)])], f"scan_id long, rt double, peaks {peaks}")
    ions = [(200.0 + k, 10.0) for k in range(8)]
    ms2 = spark.createDataFrame([(11, 10.2, mz, 1, ions), (12, 10.1, mz, 1, ions[:7] + [(300.0, 3.0)]), (13, 30.0, mz, 1, ions)], f"scan_id long, rt double, precursor_mz double, charge int, peaks {peaks}")
    spectra = spark.createDataFrame([("PEPTIDEK", ions)], f"peptide string, predicted {peaks}")
    rts = spark.createDataFrame([("PEPTIDEK", 10.0)], "peptide string, rt_pred double")
    theory = spark.createDataFrame([(1, 1.0, 0.5, 0.2)], "row_id long, t0 double, t1 double, t2 double")
    row = lcms.evidence(cand, ms1, ms2, spectra, rts, theory, rt_window=1.0).first()
    assert row["lcms_ms2_n_matches"] == 2
    # the delta is that of the scan with the best angle, not the least one
    assert abs(row["lcms_ms2_rt_delta"] - 0.2) < 1e-9
    assert row["lcms_ms1_n_scans_with_signal"] == 1 and abs(row["lcms_ms1_intensity"] - math.log1p(5.0)) < 1e-9
    none = lcms.evidence(cand, ms1, ms2, spectra, rts, theory, rt_window=0.0).first()
    assert none["lcms_ms1_intensity"] is None and none["lcms_ms2_n_matches"] == 3
