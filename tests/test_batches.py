"""digestion, composition and shuffles over Arrow batches, against plain expressions."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from massloom.functions import chemistry as C
from massloom.operators import peptide_table


def some_sequences():
    rng = np.random.default_rng(3)
    return ["", "K", "KP", "PK", "WKP", "MRPK", "KKRR", "RPWKPMRPAK", *("".join(rng.choice(list("AKRPWMG"), n)) for n in range(1, 80))]


def test_cut_follows_the_rule():
    for seq in some_sequences():
        parts = re.split(C.TRYPSIN, seq)
        want = dict.fromkeys("".join(parts[i : i + m + 1]) for m in range(3) for i in range(len(parts) - m))
        assert C.cut(seq, 2, 0, 99) == list(want)
        assert C.cut(seq, 2, 3, 9) == [x for x in want if 3 <= len(x) <= 9]


def test_digest_in_small_batches(spark):
    rows = [(f"p{k}", seq) for k, seq in enumerate([*some_sequences(), None])]
    df = spark.createDataFrame(rows, "accession string, sequence string")
    want = sorted((a, x) for a, seq in rows if seq for x in C.cut(seq, 2, 7, 30))
    for size in (1, 65_536):
        assert sorted(map(tuple, C.peptides_of(df, "accession", "sequence", rows=size).collect())) == want
    assert sorted(map(tuple, peptide_table.digest(df).collect())) == want


def test_composition_and_gravy(spark):
    rows = [("PEPTIDEK",), ("ACDEFGHIKLMNPQRSTVWY",), ("PEPX",), ("",), (None,), ("ÄK",)]
    df = spark.createDataFrame(rows, "s string")
    plain = df.select("s", C.neutral_mass(F.col("s")).alias("mass"), *(c.alias(n) for n, c in C.atom_counts(F.col("s")).items()))
    key = lambda r: repr(r["s"])
    assert sorted(map(tuple, C.with_composition(df, "s").collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    got = {r["s"]: r["g"] for r in df.select("s", C.gravy(F.col("s")).alias("g")).collect()}
    assert got[None] == got[""] == 0.0 and np.isclose(got["ÄK"], -1.95) and np.isclose(got["PEPTIDEK"], (-1.6 * 2 - 3.5 * 2 - 0.7 + 4.5 - 3.5 - 3.9) / 8), key
    # slices of an array count their own rows only
    assert (C._counted(pa.array(["AAA", "CK", None, "D"]).slice(1, 2)).sum(1) == [2, 0]).all()


def test_hash_of_places_is_sparks(spark):
    seed = spark.sql("select xxhash64('s') as h").first()["h"]
    want = [r["h"] for r in spark.range(50).select(F.xxhash64(F.lit("s"), F.col("id")).alias("h")).collect()]
    assert C._hashed(seed, 50).tolist() == want
