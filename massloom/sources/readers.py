"""Readers. Text formats use Spark's own sources; binary and XML ones are parsed on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions.chemistry import bare_accession, bare_sequence
from massloom.operators.lcms import rt_in_minutes
from massloom.sources import spectra


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, header, sequence)."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n", 2)
    header = F.trim(lines[0])
    fields = F.split(F.split(header, r"\s", 2)[0], r"\|")
    accession = F.when(F.size(fields) >= 2, fields[1]).otherwise(fields[0])
    sequence = F.upper(F.regexp_replace(F.coalesce(F.get(lines, 1), F.lit("")), r"[\s*]", ""))
    return raw.select(accession.alias("accession"), header.alias("header"), sequence.alias("sequence"))


def only_proteins(fasta: DataFrame, accessions: DataFrame) -> DataFrame:
    """Proteins whose normalised accession is among the given ones."""
    wanted = accessions.select(bare_accession(F.col("accession")).alias("_a")).distinct()
    return fasta.withColumn("_a", bare_accession(F.col("accession"))).join(wanted, "_a", "left_semi").drop("_a")


def read_mz_list(spark: SparkSession, path: str) -> DataFrame:
    """(feature_idx, feature_mz): one m/z a line, # begins a comment; numbered in order of m/z."""
    from pyspark.sql import Window as W

    v = F.expr("try_cast(trim(split(value, '#')[0]) as double)")
    rows = spark.read.text(path).select(v.alias("feature_mz")).where("feature_mz is not null")
    return rows.select((F.row_number().over(W.orderBy("feature_mz")) - 1).alias("feature_idx"), "feature_mz")


def find_column(columns: list[str], *candidates: str) -> str | None:
    """The first candidate that a column equals, else that one contains, without regard to case."""
    lower = {c.lower(): c for c in columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return next((name for c in candidates for name in columns if c.lower() in name.lower()), None)


def number(col: str) -> Column:
    return F.expr(f"try_cast(`{col}` as double)")


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated feature lists: feature_mz, and ccs and intensity where such columns are; bad cells are NULL."""
    raw = spark.read.option("sep", ";").option("comment", "#").option("header", True).csv(path)
    mz = find_column(raw.columns, "m/z", "mz") or raw.columns[0]
    ccs = next((c for c in raw.columns if "CCS" in c and "Å" in c), None)
    level = next((c for c in raw.columns if "intensity" in c.lower() and "interval" not in c.lower() and "width" not in c.lower()), None)
    out = {"feature_mz": number(mz), "ccs_observed": number(ccs) if ccs else F.lit(None).cast("double"), "feature_intensity": number(level) if level else F.lit(None).cast("double")}
    return raw.select(*(c.alias(n) for n, c in out.items())).where("feature_mz is not null")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).csv(path)


def read_npz_images(spark: SparkSession, path: str) -> DataFrame:
    """(channel, feature_id, feature_mz, y, x, intensity) from NumPy archives with mzs, images and extra_* cubes."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for pdf in batches:
            for content in pdf["content"]:
                archive = np.load(io.BytesIO(content), allow_pickle=False)
                mzs = archive["mzs"]
                for name in archive.files:
                    if name == "images" or name.startswith("extra_"):
                        for k, image in enumerate(archive[name]):
                            y, x = np.nonzero(np.nan_to_num(image) > 0)
                            yield pd.DataFrame({"channel": name.removeprefix("extra_"), "feature_id": np.int32(k), "feature_mz": float(mzs[k]), "y": y.astype(np.int32), "x": x.astype(np.int32), "intensity": image[y, x].astype(np.float32)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "channel string, feature_id int, feature_mz double, y int, x int, intensity float")


def read_mzml(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(scan_id, level, rt, precursor_mz, charge, peaks): centroid arrays, plain or zlib; rt in minutes; charge 2 by default.
    A file is read by ranges of its bytes, by ``parts`` tasks or as many as its size asks for."""
    return spectra.read(spark, spectra.MzMLSource, path, parts)


def read_imzml(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """(pixel, y, x, mz, intensity, inv_k0): an imzML file and the .ibd beside it; coordinates from 0; mobility NULL where there is none.
    Tasks take ranges of the XML and seek their spectra's arrays by offset."""
    return spectra.read(spark, spectra.ImzMLSource, path, parts)


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a query on a SQLite file that Spark can read. The file is opened from a private copy of its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for pdf in batches:
            for content in pdf["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                yield from pd.read_sql_query(sql, db, chunksize=50_000)
                db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(frame, x, y): pixel coordinates of acquired frames in a raw run's SQLite file."""
    return read_sqlite(spark, path, "SELECT Frame AS frame, XIndexPos AS x, YIndexPos AS y FROM MaldiFrameInfo", "frame long, x long, y long")


def read_mzidentml(spark: SparkSession, path: str) -> DataFrame:
    """PSM rows (sequence, peptidoform, protein_list, q_value, pep, score, charge, rt, is_decoy)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for pdf in batches:
            for content in pdf["content"]:
                root = ElementTree.fromstring(content)
                local = lambda e: e.tag.rsplit("}", 1)[-1]
                peptides = {e.get("id"): "".join(x.text or "" for x in e if local(x) == "PeptideSequence") for e in root.iter() if local(e) == "Peptide"}
                accession = {e.get("id"): e.get("accession") for e in root.iter() if local(e) == "DBSequence"}
                found = {e.get("id"): (accession.get(e.get("dBSequence_ref")), e.get("isDecoy") == "true") for e in root.iter() if local(e) == "PeptideEvidence"}
                rows = []
                for s in (e for e in root.iter() if local(e) == "SpectrumIdentificationItem"):
                    terms = {c.get("accession"): c.get("value") for c in s if local(c) == "cvParam"}
                    refs = [found[e.get("peptideEvidence_ref")] for e in s if local(e) == "PeptideEvidenceRef" and e.get("peptideEvidence_ref") in found]
                    real = lambda k: float(terms[k]) if terms.get(k) else None  # noqa: E731, B023
                    seq = peptides.get(s.get("peptide_ref"), "")
                    rows.append((seq, seq, [a for a, _ in refs if a], real("MS:1002354"), real("MS:1002356"), None, int(s.get("chargeState", 0)), None, bool(refs) and all(d for _, d in refs)))
                yield pd.DataFrame(rows, columns=["sequence", "peptidoform", "protein_list", "q_value", "pep", "score", "charge", "rt", "is_decoy"])

    schema = "sequence string, peptidoform string, protein_list array<string>, q_value double, pep double, score double, charge int, rt double, is_decoy boolean"
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def read_percolator(spark: SparkSession, peptides: str, psms: str | None = None, fdr: float = 0.01) -> DataFrame:
    """Identified peptides (sequence, peptidoform, protein, q_value, pep, score, n_psms, charge, rt_mean, lcms_intensity, lcms_ccs)."""
    from pyspark.sql import Window as W

    raw = read_tsv(spark, peptides)
    col = lambda *names: find_column(raw.columns, *names)
    pep, q = col("peptide", "sequence"), col("q-value", "q_value", "qvalue")
    prot, err, score = col("proteinIds", "proteins", "protein"), col("posterior_error_prob", "pep"), col("score")
    null = F.lit(None).cast("double")
    t = raw.select(bare_sequence(F.col(pep)).alias("sequence"), F.col(pep).alias("peptidoform"), (bare_accession(F.split_part(F.col(prot), F.lit(";"), F.lit(1))) if prot else F.lit(None).cast("string")).alias("protein"), number(q).alias("q_value"), (number(err) if err else null).alias("pep"), (number(score) if score else null).alias("score"))
    t = t.where(F.col("q_value") <= fdr).withColumn("_r", F.row_number().over(W.partitionBy("sequence").orderBy("q_value", "peptidoform"))).where("_r = 1").drop("_r")
    t = t.withColumns({"n_psms": F.lit(1).cast("long"), "charge": F.lit(None).cast("int"), "rt_mean": null, "lcms_intensity": null, "lcms_ccs": null})
    if psms is None:
        return t
    p = read_tsv(spark, psms)
    find = lambda *names: find_column(p.columns, *names)
    rt, level, z = find("retention_time", "rt"), find("precursor_intensity", "intensity"), find("charge")
    rows = p.select(bare_sequence(F.col(find("peptide", "sequence"))).alias("sequence"), (number(rt) if rt else null).alias("rt"), (number(level) if level else null).alias("intensity"), (number(z) if z else null).cast("int").alias("charge"))
    agg = rt_in_minutes(rows).groupBy("sequence").agg(F.avg("rt").alias("_rt"), F.sum("intensity").alias("_i"), F.expr("mode(charge, true)").alias("_z"), F.count(F.lit(1)).alias("_n"))
    out = t.join(agg, "sequence", "left")
    return out.withColumns({"rt_mean": F.coalesce("rt_mean", "_rt"), "lcms_intensity": F.coalesce("lcms_intensity", "_i"), "charge": F.coalesce("charge", "_z"), "n_psms": F.coalesce("_n", "n_psms")}).drop("_rt", "_i", "_z", "_n")


#: SQL of identifications in MSF files: a bound FDR, two left joins from spectra to proteins.
MSF_PEPTIDES = """
SELECT psm.Sequence AS sequence, psm.Sequence AS peptidoform, prot.Accession AS protein,
       psm.PercolatorqValue AS q_value, NULL AS pep, psm.PercolatorSVMScore AS score,
       psm.Charge AS charge, psm.RetentionTime AS rt
FROM TargetPsms psm
LEFT JOIN TargetProteinsTargetPsms link ON link.TargetPsmsPeptideID = psm.PeptideID
LEFT JOIN TargetProteins prot ON prot.UniqueSequenceID = link.TargetProteinsUniqueSequenceID
WHERE psm.PercolatorqValue <= {fdr} AND psm.Sequence IS NOT NULL"""


def read_msf(spark: SparkSession, path: str, fdr: float = 0.01, sql: str = MSF_PEPTIDES) -> DataFrame:
    schema = "sequence string, peptidoform string, protein string, q_value double, pep double, score double, charge int, rt double"
    return read_sqlite(spark, path, sql.format(fdr=float(fdr)), schema)


def read_rt_pairs(spark: SparkSession, path: str, fdr: float = 0.01) -> DataFrame:
    """Distinct (sequence, rt) below the FDR, for fitting retention times."""
    return read_msf(spark, path, fdr).select("sequence", "rt").distinct()


def read_psm_table(spark: SparkSession, path: str, fdr: float = 0.01) -> DataFrame:
    """Generic PSM tables in tab-separated form; decoys go; ValueError if the FDR leaves nothing."""
    from massloom.operators.lcms import best_per_sequence, identified

    raw = read_tsv(spark, path)
    find = lambda *names: find_column(raw.columns, *names)
    null = F.lit(None).cast("double")
    num = lambda *names: number(c) if (c := find(*names)) else null
    text = find("peptidoform", "peptide", "sequence")
    decoy = find("is_decoy", "decoy")
    prot = find("protein_list", "proteins", "protein")
    rows = raw.select(bare_sequence(F.regexp_replace(F.col(text), r"/\d+$", "")).alias("sequence"), F.col(text).alias("peptidoform"), (F.col(prot) if prot else F.lit(None).cast("string")).alias("protein"), num("qvalue", "q_value", "q-value").alias("q_value"), num("pep").alias("pep"), num("score").alias("score"), num("charge").cast("int").alias("charge"), num("retention_time", "rt").alias("rt"), num("precursor_intensity", "intensity").alias("intensity"), (F.lower(F.col(decoy)).isin("true", "1") if decoy else F.lit(False)).alias("is_decoy"))
    found = best_per_sequence(identified(rows.where(~F.col("is_decoy")), fdr))
    if found.limit(1).count() == 0:
        raise ValueError("no peptide at this FDR")
    return found


def read_identifications(spark: SparkSession, path: str, kind: str, fdr: float = 0.01, **options) -> DataFrame:
    """By format name: percolator, mzidentml, psm_utils, ms2rescore, msf."""
    from massloom.operators.lcms import best_per_sequence, identified

    if kind == "percolator":
        return read_percolator(spark, path, fdr=fdr, **options)
    if kind in ("psm_utils", "ms2rescore"):
        return read_psm_table(spark, path, fdr)
    if kind == "mzidentml":
        rows = read_mzidentml(spark, path).where("not is_decoy").withColumn("protein", F.get("protein_list", 0)).withColumn("intensity", F.lit(None).cast("double"))
        return best_per_sequence(identified(rows, fdr))
    if kind == "msf":
        return best_per_sequence(read_msf(spark, path, fdr).withColumn("intensity", F.lit(None).cast("double")))
    raise ValueError(f"unknown format {kind!r}")


def digest_bounds(peptides: DataFrame, seq: str = "sequence") -> DataFrame:
    """One row: shortest, longest, and most inner K or R of the identified peptides."""
    s = F.col(seq)
    return peptides.agg(F.min(F.length(s)).alias("min_length"), F.max(F.length(s)).alias("max_length"), F.max(F.regexp_count(F.expr(f"substring({seq}, 1, length({seq}) - 1)"), F.lit("[KR]"))).alias("missed_cleavages"))
