"""Digestion, masses, properties, isotopes and candidates. The letters of documents stand for proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import chemistry as C
from massloom.operators import peptide_table
from massloom.operators.ordered import numbered
from massloom.operators.storage import stored
from massloom.plans.registry import query, table

SEQ_SQL = "regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g')"
PARTS_SQL = f"""
d AS (SELECT doc_id, {SEQ_SQL} AS seq FROM documents),
s AS (SELECT doc_id, list_filter(string_split(replace(replace(replace(replace(regexp_replace(seq, '([KR])', '\\1|', 'g'), 'WK|P', 'WK#P'), 'MR|P', 'MR#P'), '|P', 'P'), '#', '|'), '|'), lambda x: x <> '') AS parts FROM d),
p AS (SELECT DISTINCT doc_id, array_to_string(parts[i + 1 : i + m + 1], '') AS peptide FROM s, (VALUES (0), (1), (2)) v(m), LATERAL (SELECT unnest(range(len(parts) - m)) AS i) z WHERE len(parts) > m),
pep AS (SELECT doc_id, peptide FROM p WHERE length(peptide) BETWEEN 7 AND 30)"""


def count_sql(letters: str, of: str = "peptide") -> str:
    return f"(length({of}) - length(translate({of}, '{letters}', '')))"


MASS_SQL = " + ".join([repr(C.WATER)] + [f"{count_sql(aa)} * CAST({row[0]!r} AS DOUBLE)" for aa, row in C.RESIDUES.items()]).replace(repr(C.WATER), f"CAST({C.WATER!r} AS DOUBLE)", 1)
GRAVY_SQL = "(" + " + ".join(["CAST(0.0 AS DOUBLE)"] + [f"{count_sql(aa)} * CAST({row[6]!r} AS DOUBLE)" for aa, row in C.RESIDUES.items()]) + ") / length(peptide)"
ATOM_SQL = {a: " + ".join([str({"H": 2, "O": 1}.get(a, 0))] + [f"{count_sql(aa)} * {row[1 + k]}" for aa, row in C.RESIDUES.items() if row[1 + k]]) for k, a in enumerate(C.ATOMS)}


def proteins(s: SparkSession, d: str) -> DataFrame:
    letters = F.upper(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[^A-Za-z]", ""))
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.regexp_replace(letters, "[BJOUXZ]", "").alias("sequence"))


def peptides(s: SparkSession, d: str) -> DataFrame:
    return peptide_table.digest(proteins(s, d)).select("peptide").distinct()


@query(f"WITH {PARTS_SQL} SELECT doc_id, count(*) AS n_peptides, CAST(sum(length(peptide)) AS BIGINT) AS residues, min(peptide) AS first_peptide, max(peptide) AS last_peptide FROM pep GROUP BY doc_id")
def p1_g1_digest(s, d):
    t = peptide_table.digest(proteins(s, d))
    return t.groupBy(F.col("protein").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_peptides"), F.sum(F.length("peptide")).alias("residues"), F.min("peptide").alias("first_peptide"), F.max("peptide").alias("last_peptide"))


@query(f"WITH {PARTS_SQL} SELECT DISTINCT peptide, round({MASS_SQL}, 6) AS mass, round({MASS_SQL} + CAST(1.007276 AS DOUBLE), 6) AS mh_mz, CAST({ATOM_SQL['C']} AS INTEGER) AS n_C, CAST({ATOM_SQL['H']} AS INTEGER) AS n_H, CAST({ATOM_SQL['N']} AS INTEGER) AS n_N, CAST({ATOM_SQL['O']} AS INTEGER) AS n_O, CAST({ATOM_SQL['S']} AS INTEGER) AS n_S FROM pep")
def p3_p4_masses(s, d):
    return peptide_table.with_masses(peptides(s, d)).select("peptide", F.round("mass", 6).alias("mass"), F.round("mh_mz", 6).alias("mh_mz"), *(f"n_{a}" for a in C.ATOMS))


@query(f"""WITH {PARTS_SQL} SELECT DISTINCT peptide, length(peptide) AS peptide_length,
len(regexp_extract_all(substr(peptide, 1, length(peptide) - 1), '[KR]')) - len(regexp_extract_all(peptide, '[KR]P')) AS n_missed_cleavages, {count_sql("R")} AS n_arginine, {count_sql("KRH")} AS n_basic_residues, {count_sql("FWY")} AS n_aromatic,
round({GRAVY_SQL}, 6) AS gravy_score, {count_sql("KRH")} - {count_sql("DE")} AS charge_proxy, CAST({count_sql("M")} > 0 AS INTEGER) AS has_oxidized_met, CAST({count_sql("C")} > 0 AS INTEGER) AS has_cys, {count_sql("P")} AS n_proline, round({count_sql("DE")} / length(peptide), 6) AS acidic_residue_density FROM pep""")
def p11_p12_p13_properties(s, d):
    p = F.col("peptide")
    flags = C.property_flags(p)
    t = peptides(s, d).withColumns({"peptide_length": F.length(p), "n_missed_cleavages": C.missed_cleavages(p), **C.ionization(p), **flags})
    return t.withColumn("gravy_score", F.round("gravy_score", 6)).withColumn("acidic_residue_density", F.round("acidic_residue_density", 6))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS mz FROM lineitem), r AS (SELECT unnest([190.0499, 212.0318, 228.0058, 379.0925, 401.0744, 568.1351, 757.1777, 172.0393]) AS ref),
m AS (SELECT mz, round(min(abs(mz - ref) / ref * 1e6), 1) AS chca FROM (SELECT DISTINCT mz FROM x), r GROUP BY mz)
SELECT DISTINCT mz, chca AS chca_cluster_distance_ppm, round(mz * 14.0 / 14.01565 - round_even(mz * 14.0 / 14.01565, 0), 6) AS kendrick_mass_defect, round(mz * 2 - 2 * 1.007276, 6) AS mass2 FROM m
""")
def p6_p8_p19_mz_functions(s, d):
    mz = F.col("mz")
    t = table(s, d, "lineitem").select(F.col("l_extendedprice").alias("mz")).distinct()
    return t.select("mz", F.round(C.chca_distance_ppm(mz), 1).alias("chca_cluster_distance_ppm"), F.round(C.kendrick_mass_defect(mz), 6).alias("kendrick_mass_defect"), F.round(C.mz_to_mass(mz, F.lit(2)), 6).alias("mass2"))


_R = {a: C.ABUNDANCE[k] / (1 - C.ABUNDANCE[k]) for a, k in (("C", "C13"), ("H", "H2"), ("N", "N15"))}
_R["O"] = C.ABUNDANCE["O17"] / (1 - C.ABUNDANCE["O17"] - C.ABUNDANCE["O18"])
_R["S"] = C.ABUNDANCE["S33"] / (1 - C.ABUNDANCE["S33"] - C.ABUNDANCE["S34"])
_R2 = {"O": C.ABUNDANCE["O18"] / (1 - C.ABUNDANCE["O17"] - C.ABUNDANCE["O18"]), "S": C.ABUNDANCE["S34"] / (1 - C.ABUNDANCE["S33"] - C.ABUNDANCE["S34"])}
ISO_SQL = ("(" + " + ".join(f"({ATOM_SQL[a]}) * CAST({r!r} AS DOUBLE)" for a, r in _R.items()) + ") AS a, (" + " + ".join(f"({ATOM_SQL[a]}) * CAST({r * r!r} AS DOUBLE)" for a, r in _R.items()) + ") AS b, (" + " + ".join(f"({ATOM_SQL[a]}) * CAST({r!r} AS DOUBLE)" for a, r in _R2.items()) + ") AS c")


@query(f"WITH {PARTS_SQL}, i AS (SELECT DISTINCT peptide, {ISO_SQL} FROM pep), t AS (SELECT peptide, a, (a * a - b) / 2 + c AS m2 FROM i) SELECT peptide, round(1 / (1 + a + m2), 5) AS m0, round(a / (1 + a + m2), 5) AS m1, round(m2 / (1 + a + m2), 5) AS m2 FROM t")
def p15_isotope_pattern(s, d):
    atoms = {a: F.col(f"n_{a}") for a in C.ATOMS}
    m = C.isotope_pattern(atoms)
    return peptide_table.with_masses(peptides(s, d)).select("peptide", *(F.round(c, 5).alias(f"m{k}") for k, c in enumerate(m)))


def _series(atom: str) -> list[float]:
    """Coefficients of the logarithmic derivative of an element's isotope series, by its definition: k r_k less the products before."""
    heavy = {"C": ["C13"], "H": ["H2"], "N": ["N15"], "O": ["O17", "O18"], "S": ["S33", "S34"]}[atom]
    r = [1.0] + [C.ABUNDANCE[h] / (1 - sum(C.ABUNDANCE[x] for x in heavy)) for h in heavy] + [0.0] * 9
    g = [0.0]
    for k in range(1, 10):
        g.append(k * r[k] - sum(r[i] * g[k - i] for i in range(1, k)))
    return g[1:]


SERIES_SQL = "[" + ", ".join(" + ".join(f"({ATOM_SQL[a]}) * CAST({_series(a)[k]!r} AS DOUBLE)" for a in C.ATOMS) for k in range(9)) + "]"


@query(f"""WITH RECURSIVE {PARTS_SQL}, s0 AS (SELECT DISTINCT peptide, {SERIES_SQL} AS p FROM pep),
q(peptide, p, k, q) AS (SELECT peptide, p, 0, [CAST(1.0 AS DOUBLE)] FROM s0 UNION ALL SELECT peptide, p, k + 1, list_append(q, list_dot_product(p[1:k + 1], list_reverse(q)) / (k + 1)) FROM q WHERE k < 9)
SELECT peptide, {", ".join(f"round(q[{k + 1}] / list_sum(q), 6) AS m{k}" for k in range(10))} FROM q WHERE k = 9""")
def p15_isotope_peaks(s, d):
    atoms = {a: F.col(f"n_{a}") for a in C.ATOMS}
    t = C.with_isotope_distribution(peptide_table.with_masses(peptides(s, d)), atoms, 10, "q")
    return t.select("peptide", *(F.round(F.get("q", k), 6).alias(f"m{k}") for k in range(10)))


@query("""
SELECT p_partkey, CASE WHEN regexp_full_match('sp|' || p_partkey || '|' || p_brand, '(sp|tr|ref)\\|[^|]+.*') THEN split_part('sp|' || p_partkey || '|' || p_brand, '|', 2) END AS accession, upper(regexp_replace(split_part('K.' || replace(p_brand, '#', '') || '[ox]PEP.R', '.', 2), '\\[[^\\]]*\\]', '', 'g')) AS bare FROM part
""")
def p21_p22_normalisation(s, d):
    t = table(s, d, "part")
    header = F.concat(F.lit("sp|"), F.col("p_partkey").cast("string"), F.lit("|"), "p_brand")
    return t.select("p_partkey", C.bare_accession(header).alias("accession"), C.bare_sequence(F.concat(F.lit("K."), F.regexp_replace("p_brand", "#", ""), F.lit("[ox]PEP.R"))).alias("bare"))


@query("""
SELECT event_id, round(18509.8632163405 * 2 * value / 100 / sqrt((user_id + 500) * 2.0 * 28.013 / ((user_id + 500) * 2.0 + 28.013) * 305.0), 5) AS ccs FROM events
""".replace("305.0", repr(31.85 + 273.15)))
def p20_inv_k0_to_ccs(s, d):
    return table(s, d, "events").select("event_id", F.round(C.inv_k0_to_ccs(F.col("value") / 100, (F.col("user_id") + 500).cast("double"), F.lit(2)), 5).alias("ccs"))


@query(f"WITH {PARTS_SQL} SELECT min(length(peptide)) AS min_length, max(length(peptide)) AS max_length, CAST(max(len(regexp_extract_all(substr(peptide, 1, length(peptide) - 1), '[KR]'))) AS INTEGER) AS missed_cleavages FROM pep")
def p23_digest_bounds(s, d):
    from massloom.sources.readers import digest_bounds

    return digest_bounds(peptides(s, d), "peptide")


@query(f"""WITH {PARTS_SQL}, u AS (SELECT DISTINCT peptide FROM pep), m AS (SELECT peptide, {MASS_SQL} + CAST(1.007276 AS DOUBLE) AS mh FROM u), f AS (SELECT DISTINCT l_extendedprice AS feature_mz FROM lineitem WHERE l_extendedprice BETWEEN 500 AND 4000),
c AS (SELECT feature_mz, peptide FROM f JOIN m ON mh BETWEEN feature_mz - feature_mz * 21.0 / 1e6 AND feature_mz + feature_mz * 21.0 / 1e6 WHERE abs(mh - feature_mz) <= feature_mz * 20.0 / 1e6)
SELECT feature_mz, count(*) AS n_candidates, min(peptide) AS first_peptide FROM c GROUP BY feature_mz""")
def g9_match_candidates(s, d):
    f = table(s, d, "lineitem").where("l_extendedprice between 500 and 4000").select(F.col("l_extendedprice").alias("feature_mz")).distinct()
    from massloom.operators.ranges import range_join

    pairs = range_join(f, peptide_table.with_masses(peptides(s, d)).select("peptide", "mh_mz"), "feature_mz", "mh_mz", ppm=20.0)
    return pairs.groupBy("feature_mz").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("peptide").alias("first_peptide"))


# Generators with hashed choices have no SQL; tests hold their invariants.


def _digested(s, d):
    return peptide_table.digest_with_decoys(proteins(s, d), missed=2, decoys=False)


def _targets(s, d, pairs=True):
    """Peptides, features, and all their candidates, or else the best one of each peptide."""
    from massloom.plans.rescore import features_from_masses

    t = stored(_digested(s, d))
    f = features_from_masses(t)
    return t, f, peptide_table.match(f, t) if pairs else peptide_table.best_matches(f, t.select("peptide", "protein", "is_decoy", "mass", "mh_mz"))


def flagship(s, d):
    from massloom.plans.rescore import features_from_masses, simple_winners

    p = proteins(s, d)
    f = features_from_masses(peptide_table.digest_with_decoys(p, missed=0, decoys=False))
    return simple_winners(p, f)


@query()
def rescore_winners(s, d):
    return flagship(s, d)


def envelopes_of(features):
    """Isotope intensities near the usual, moved by a hash: the tables hold none."""
    moved = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col("feature_mz")), F.lit(1000)) / 5000
    return features.select("feature_idx", *((moved(k) + usual).alias(f"env_m{k}") for k, usual in enumerate((0.6, 0.3, 0.1))))


@query()
def rescore_whole(s, d):
    """The whole run with the default settings, isotope envelopes and a prior."""
    from massloom.plans.rescore import features_from_masses, rescore

    p = proteins(s, d)
    f = features_from_masses(peptide_table.digest_with_decoys(p, missed=0, decoys=False))
    out = rescore(p, f, envelopes=envelopes_of(f), lcms_prior=["theo_isotope_cosine"])
    return out.select("feature_idx", "peptide", "protein", "is_decoy", "score_r1", "score_r2", "q_value", "pep", "pep_q_value", "reweighted_score", "reweighted_q_value")


@query()
def p2_g1_shuffled_decoys(s, d):
    t = peptide_table.digest_with_decoys(proteins(s, d), missed=2)
    return t.groupBy("is_decoy", F.length("peptide").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mass"), 3).alias("mean_mass"))


@query()
def g2_identified_digest(s, d):
    p = proteins(s, d)
    ids = p.where("cast(accession as long) % 2 = 0").select("accession")
    seen = peptide_table.digest(p).where(F.xxhash64("peptide") % 10 == 0).groupBy(F.col("peptide").alias("sequence")).agg(F.min("protein").alias("evidence_protein"))
    return peptide_table.digest_identified(p, ids, seen).groupBy("source", "is_decoy").agg(F.count(F.lit(1)).alias("n"))


@query()
def g3_mz_shift(s, d):
    from massloom.plans.rescore import features_from_masses

    t = stored(_digested(s, d))
    # prices are features too, as in g9: without any that no target explains there is no place for a decoy
    prices = table(s, d, "lineitem").where("l_extendedprice between 500 and 4000").select(F.col("l_extendedprice").alias("feature_mz"))
    f = stored(numbered(features_from_masses(t).select("feature_mz").union(prices).distinct(), "feature_mz", "feature_idx"))
    best = stored(peptide_table.best_matches(f, t))
    return peptide_table.mz_shift_decoys(peptide_table.match(f, t), f, masses=t, best=best).select("peptide", "protein", "feature_idx", "feature_mz", "is_decoy", "decoy_delta_da")


@query()
def g4_mz_shuffle(s, d):
    return peptide_table.rotated(_targets(s, d, pairs=False)[2]).select("peptide", "feature_idx", "feature_mz", "is_decoy")


@query()
def g5_substitution(s, d):
    return peptide_table.substitution_decoys(_digested(s, d)).select("peptide", "protein", "is_decoy", "mass")


@query()
def g6_entrapment(s, d):
    t, f, cand = _targets(s, d)
    foreign = proteins(s, d).select("accession", F.reverse("sequence").alias("sequence"))
    return peptide_table.entrapment(foreign, cand, f, masses=peptide_table.best_matches(f, t)).select("peptide", "protein", "feature_idx", "is_decoy")


@query()
def g7_shuffled_entrapment(s, d):
    return peptide_table.shuffled_entrapment(peptide_table.digest(proteins(s, d)).withColumnRenamed("peptide", "sequence")).select("peptide", "protein", "is_decoy", "mass")


@query()
def g8_balanced_shuffle(s, d):
    _, f, cand = _targets(s, d)
    return peptide_table.balanced_shuffle(proteins(s, d), cand, f).select("peptide", "feature_idx", "is_decoy", "n_candidates")


@query()
def g8_paired_shuffle(s, d):
    _, f, cand = _targets(s, d)
    return peptide_table.balanced_shuffle(proteins(s, d), cand, f, by="feature").select("peptide", "feature_idx", "is_decoy", "n_candidates")


@query()
def g10_extra_peptides(s, d):
    t = _digested(s, d)
    more = peptide_table.digest_with_decoys(proteins(s, d).select("accession", F.reverse("sequence").alias("sequence")), missed=2, decoys=False)
    return peptide_table.extra_peptides(t, more).groupBy(F.length("peptide").alias("len")).agg(F.count(F.lit(1)).alias("n"))
