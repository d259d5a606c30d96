"""Numbers of partners and the least of them, without pairs, against the pairs themselves."""

from pyspark.sql import functions as F

from massloom.operators import imaging
from massloom.plans import queries_relational as Q


def test_counts_are_those_of_the_pairs(spark):
    rows = [("big", k) for k in range(300)] + [("big", 0), ("two", 5), ("two", 3), ("one", 7), ("empty", None), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "protein string, feature_id int")
    got = imaging.partner_counts(df)
    want = imaging.partner_pairs(df).groupBy("protein", "a").agg(F.count(F.lit(1)).alias("n_partners"), F.min("b").alias("least_partner"))
    assert got.columns == want.columns and got.count() == want.count() == 302 and got.exceptAll(want).isEmpty()


def test_the_query_makes_no_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imaging, "partner_pairs", None)
    spark.createDataFrame([(1, k) for k in range(50)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {(r["n_partners"], r["least_partner"]) for r in Q.j10_partner_pairs(spark, str(tmp_path)).collect()} == {(49, 0), (49, 1)}


def test_evidence_is_made_once(spark):
    """One join adds flags and novel peptides: the plan reads the evidence and the proteins' targets once."""
    from massloom.operators import peptide_table as P

    proteins = spark.createDataFrame([("A", "MALPVTALLLKAAGLLHAARAGTSQVQVSTR"), ("B", "PEPTIDEPEPTIDEK")], "accession string, sequence string")
    evidence = spark.createDataFrame([("MALPVTALLLK", 1), ("NOVELPEPTIDEK".replace("O", "A"), 2), ("BAD*", 3), (None, 4)], "sequence string, run int")
    out = P.digest_identified(proteins, proteins.where("accession = 'A'").select("accession"), evidence, missed=0)
    rows = {(r["peptide"], r["protein"], r["run"], r["source"]) for r in out.where("not is_decoy").collect()}
    assert rows == {("MALPVTALLLK", "A", 1, "lcms_confirmed"), ("NAVELPEPTIDEK", None, 2, "lcms_confirmed"), ("AAGLLHAAR", "A", None, "protein_digest"), ("AGTSQVQVSTR", "A", None, "protein_digest")}
    assert {(r["source"], r["run"]) for r in out.where("is_decoy").collect()} == {("decoy", None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
