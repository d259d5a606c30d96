"""Readers, sinks, settings and the stream."""

import base64
import io
import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.plans import config
from massloom.sources import readers, sinks


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">sp|P1|X first\nMKA\nAA*\n>plain two\nRRR\n")
    got = {r["accession"]: r["sequence"] for r in readers.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"P1": "MKAAA", "plain": "RRR"}
    kept = readers.only_proteins(readers.read_fasta(spark, str(tmp_path / "a.fasta")), spark.createDataFrame([("tr|P1|Z",)], "accession string"))
    assert [r["accession"] for r in kept.collect()] == ["P1"]


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# c\n700.5\n600.25 # x\n\nbad\n")
    assert [(r[0], r[1]) for r in readers.read_mz_list(spark, str(tmp_path / "m.txt")).orderBy("feature_idx").collect()] == [(0, 600.25), (1, 700.5)]
    (tmp_path / "s.csv").write_text("# c\nm/z;Interval Width;CCS (Å2);Max intensity\n500.1;1;200.5;7\n501.1;1;x;8\n")
    got = readers.read_feature_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["feature_mz"], r["ccs_observed"], r["feature_intensity"]) for r in got] == [(500.1, 200.5, 7.0), (501.1, None, 8.0)]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "c.npz", mzs=np.array([1.0, 2.0]), images=np.array([[[0, 1], [2, 0]], [[0, 0], [0, 3]]], np.float32), extra_m1=np.ones((2, 2, 2), np.float32))
    t = readers.read_npz_images(spark, str(tmp_path / "c.npz"))
    assert t.where("channel = 'images'").count() == 3 and t.where("channel = 'm1'").count() == 8


def test_mzml(spark, tmp_path):
    array = lambda v, kind: f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{kind}"/><binary>{base64.b64encode(np.array(v, "<f8").tobytes()).decode()}</binary></binaryDataArray>'
    one = lambda i, level, ion: f'<spectrum index="{i}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000016" value="120" unitName="second"/>{ion}{array([100, 200], "MS:1000514")}{array([1, 2], "MS:1000515")}</spectrum>'
    ion = '<cvParam accession="MS:1000744" value="500.5"/>'
    (tmp_path / "r.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml">{one(0, 1, "")}{one(1, 2, ion)}{one(2, 2, "")}</mzML>')
    got = readers.read_mzml(spark, str(tmp_path / "r.mzML")).orderBy("scan_id").collect()
    assert [(r["level"], r["rt"], r["precursor_mz"], r["charge"], len(r["peaks"])) for r in got] == [(1, 2.0, None, 2, 2), (2, 2.0, 500.5, 2, 2)]


def test_imzml(spark, tmp_path):
    (tmp_path / "i.ibd").write_bytes(struct.pack("<2d2f", 100.0, 200.0, 1.0, 2.0))
    group = '<referenceableParamGroup id="{}"><cvParam accession="{}"/><cvParam accession="{}"/></referenceableParamGroup>'
    part = '<binaryDataArray><referenceableParamGroupRef ref="{}"/><cvParam accession="IMS:1000102" value="{}"/><cvParam accession="IMS:1000103" value="2"/></binaryDataArray>'
    (tmp_path / "i.imzML").write_text("<mzML>" + group.format("mzArray", "MS:1000514", "MS:1000523") + group.format("intensityArray", "MS:1000515", "MS:1000521") + '<spectrum><cvParam accession="IMS:1000050" value="3"/><cvParam accession="IMS:1000051" value="5"/>' + part.format("mzArray", 0) + part.format("intensityArray", 16) + "</spectrum></mzML>")
    got = readers.read_imzml(spark, str(tmp_path / "i.imzML")).orderBy("mz").collect()
    assert [(r["y"], r["x"], r["mz"], r["intensity"], r["inv_k0"]) for r in got] == [(4, 2, 100.0, 1.0, None), (4, 2, 200.0, 2.0, None)]


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "f.tdf")
    db.execute("CREATE TABLE MaldiFrameInfo (Frame INTEGER, XIndexPos INTEGER, YIndexPos INTEGER)")
    db.execute("INSERT INTO MaldiFrameInfo VALUES (1, 4, 5)")
    db.commit()
    db.close()
    assert [tuple(r) for r in readers.read_frames(spark, str(tmp_path / "f.tdf")).collect()] == [(1, 4, 5)]


def test_identifications(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("PSMId\tscore\tq-value\tposterior_error_prob\tpeptide\tproteinIds\n1\t9\t0.001\t0.01\tK.PEPT[ox]IDEK.A\tsp|P1|X;sp|P2|Y\n2\t8\t0.002\t0.02\tK.PEPTIDEK.A\tsp|P1|X\n3\t1\t0.5\t0.9\tK.BADR.A\tsp|P3|X\n")
    (tmp_path / "q.tsv").write_text("peptide\tretention_time\tprecursor_intensity\tcharge\nK.PEPTIDEK.A\t600\t5\t2\nK.PEPTIDEK.A\t1200\t7\t2\n")
    got = readers.read_identifications(spark, str(tmp_path / "p.tsv"), "percolator", psms=str(tmp_path / "q.tsv")).collect()
    assert [(r["sequence"], r["protein"], r["q_value"], r["rt_mean"], r["lcms_intensity"], r["n_psms"]) for r in got] == [("PEPTIDEK", "P1", 0.001, 15.0, 12.0, 2)]
    (tmp_path / "u.tsv").write_text("peptidoform\tqvalue\tpep\tscore\tis_decoy\tprotein_list\tcharge\nPEPTIDEK/2\t0.001\t0.1\t5\tFalse\tP1\t2\nDECOYK/2\t0.001\t0.1\t5\tTrue\tP1\t2\n")
    assert [r["sequence"] for r in readers.read_identifications(spark, str(tmp_path / "u.tsv"), "psm_utils").collect()] == ["PEPTIDEK"]
    with pytest.raises(ValueError):
        readers.read_identifications(spark, str(tmp_path / "u.tsv"), "psm_utils", fdr=1e-9)
    with pytest.raises(ValueError):
        readers.read_identifications(spark, "x", "other")


def test_mzidentml(spark, tmp_path):
    (tmp_path / "x.mzid").write_text('<M><DBSequence id="d" accession="P1"/><Peptide id="p"><PeptideSequence>PEPK</PeptideSequence></Peptide><PeptideEvidence id="e" dBSequence_ref="d" isDecoy="false"/><SpectrumIdentificationItem peptide_ref="p" chargeState="2"><PeptideEvidenceRef peptideEvidence_ref="e"/><cvParam accession="MS:1002354" value="0.002"/></SpectrumIdentificationItem></M>')
    got = readers.read_identifications(spark, str(tmp_path / "x.mzid"), "mzidentml").collect()
    assert [(r["sequence"], r["protein"], r["q_value"], r["charge"]) for r in got] == [("PEPK", "P1", 0.002, 2)]


def test_msf_reader(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.msf")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE TargetPsms (PeptideID INTEGER, Sequence TEXT, PercolatorqValue REAL, PercolatorSVMScore REAL, Charge INTEGER, RetentionTime REAL);
        CREATE TABLE TargetProteinsTargetPsms (TargetProteinsUniqueSequenceID INTEGER, TargetPsmsPeptideID INTEGER);
        CREATE TABLE TargetProteins (UniqueSequenceID INTEGER, Accession TEXT);
        INSERT INTO TargetPsms VALUES (1, 'PEPK', 0.001, 2.5, 2, 10.5), (2, 'LATEK', 0.5, 0.1, 2, 11.0), (3, 'LONEK', 0.01, 1.0, 3, 12.0), (4, NULL, 0.001, 1.0, 3, 12.0);
        INSERT INTO TargetProteinsTargetPsms VALUES (7, 1), (8, 1);
        INSERT INTO TargetProteins VALUES (7, 'P7'), (8, 'P8');""")
    db.commit()
    db.close()
    got = sorted((r["sequence"], r["protein"], r["q_value"], r["score"], r["charge"], r["rt"]) for r in readers.read_msf(spark, path).fillna("-").collect())
    assert got == [("LONEK", "-", 0.01, 1.0, 3, 12.0), ("PEPK", "P7", 0.001, 2.5, 2, 10.5), ("PEPK", "P8", 0.001, 2.5, 2, 10.5)]
    assert sorted(map(tuple, readers.read_rt_pairs(spark, path).collect())) == [("LONEK", 12.0), ("PEPK", 10.5)]


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"ms": {"svm-c": 2.0, "single-round": True}, "model": "qda"}))
    c = config.load(str(path), single_round=False, ppm_tolerance=None)
    assert (c.svm_c, c.model, c.single_round, c.ppm_tolerance) == (2.0, "qda", False, 20.0)
    with pytest.raises(ValueError):
        config.load(model="x")
    # a settings file written for more than is here loads, and what would mislead is switched off
    with pytest.warns(RuntimeWarning, match="nope"):
        assert config.load(nope=1) == config.Config()
    with pytest.warns(RuntimeWarning, match="switched off"):
        assert not config.load(use_spatial_ranker_features=True).use_spatial_ranker_features
    assert config.resolve_features(["a", "b", "im2deep_ccs_rank"], config.load(decoy_method="mz_shuffle", features_exclude=["b"])) == ["a"]


def test_sinks(spark, tmp_path):
    rows = [("PEPK", "P1", 500.0, False, 1.0, 0.001, True), ("PEPK", "P1", 500.0, False, 1.0, 0.001, True), ("BADK", "ENTRAPMENT_P", 501.0, False, 0.5, 0.04, True)]
    df = spark.createDataFrame(rows, "peptide string, protein string, feature_mz double, is_decoy boolean, reweighted_score double, reweighted_q_value double, is_tdc_winner boolean")
    sinks.write_results(df, str(tmp_path / "o"))
    assert readers.read_tsv(spark, str(tmp_path / "o/peptides")).count() == 1
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "cache"), {"a": 1}, make).count() == 3
    assert len(made) == 1


def test_stream_equals_batch(spark, tmp_path):
    from massloom.streaming import ingest

    rows = [(f"2024-01-01 00:{m:02d}:00", p, 500.0 + p, 1.0) for m in range(20) for p in range(3)]
    df = spark.createDataFrame(rows, "t string, pixel long, mz double, intensity double").select(F.to_timestamp("t").alias("ts"), "pixel", "mz", "intensity")
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.running_histogram(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = ingest.start(stream, str(tmp_path / "out"), str(tmp_path / "chk"))
    q.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = ingest.running_histogram(df)
    done = got.agg(F.max("window.end")).first()[0]
    assert got.count() == batch.where(F.col("window.end") <= F.lit(done)).count() > 0


def test_npz_bytes_need_no_pickle():
    with pytest.raises(ValueError):
        buffer = io.BytesIO()
        np.savez(buffer, a=np.array([{}], dtype=object))
        buffer.seek(0)
        np.load(buffer, allow_pickle=False)["a"]
