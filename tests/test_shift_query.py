"""Shifted decoys: of the query, and at features as a loop over all tries has them."""

import numpy as np
from pyspark.sql import functions as F

from massloom.operators import peptide_table
from massloom.plans import queries_chemistry as Q

SMALL = "/root/testdata/sf0.001"


def test_the_query_has_decoys_at_features_that_no_target_explains(spark, tmp_path):
    texts = [(r["doc_id"], r["text"][:150]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = Q.g3_mz_shift(spark, str(tmp_path)).collect()
    decoys, known = [r for r in rows if r["is_decoy"]], [r["mh_mz"] for r in Q._digested(spark, str(tmp_path)).collect()]
    assert decoys and len({r["peptide"] for r in decoys}) == len(decoys) and {r["peptide"] for r in decoys} <= {r["peptide"] for r in rows if not r["is_decoy"]}
    for r in decoys:
        assert not any(abs(r["feature_mz"] - m) <= m * 20e-6 for m in known) and 4.8 <= abs(r["decoy_delta_da"]) <= 20.2


def test_snapped_decoys_are_those_of_a_loop(spark):
    rng = np.random.default_rng(4)
    masses = np.round(rng.uniform(900, 930, 300), 4)
    t = spark.createDataFrame([(f"P{k}", f"Q{k % 7}", False, float(m), float(m)) for k, m in enumerate(masses)], "peptide string, protein string, is_decoy boolean, mass double, mh_mz double")
    mz = np.concatenate([masses * (1 + rng.uniform(-1e-5, 1e-5, 300)), np.round(rng.uniform(885, 945, 250), 2)])
    mz = np.concatenate([mz, mz[-20:]])
    f = spark.createDataFrame([(int(k), float(m)) for k, m in zip(rng.permutation(len(mz)), mz, strict=True)], "feature_idx int, feature_mz double")
    rows = peptide_table.mz_shift_decoys(peptide_table.match(f, t), f, masses=t).where("is_decoy").collect()
    got = {r["peptide"]: (r["feature_idx"], r["feature_mz"]) for r in rows}
    sign = F.when((F.xxhash64(F.col("peptide")) + F.col("_try")) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    tries = t.select("peptide", "mh_mz", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("_try")).withColumn("s", F.col("mh_mz") + sign * (5 + peptide_table._unit(F.lit("42"), F.col("peptide"), F.col("_try")) * 15.0))
    held, want = [(m, k) for k, m in {(r["feature_idx"], r["feature_mz"]) for r in f.collect()}], {}
    for r in sorted(tries.collect(), key=lambda r: (r["peptide"], r["_try"])):
        _, place, number = min((abs(m - r["s"]), m, k) for m, k in held)
        if abs(place - r["s"]) <= r["s"] * 50e-6 and not (np.abs(place - masses) <= masses * 20e-6).any():
            want.setdefault(r["peptide"], (number, place))
    assert got == want and len(got) > 250
    assert peptide_table.mz_shift_decoys(peptide_table.match(f, t), f.limit(0), masses=t, best=peptide_table.best_matches(f, t)).where("is_decoy").isEmpty()
