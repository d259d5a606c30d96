"""Digestion, candidate matching and target/decoy generators.

A protein table has accession and sequence; a peptide table has peptide, protein, is_decoy,
mass, mh_mz and atom counts; a candidate table adds the matched feature. Random choices are
hashes of a seed and the row's own key, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.functions import chemistry as C
from massloom.operators.conflicts import first_free
from massloom.operators.ordered import numbered, sample_with_top_up, stratified_sample
from massloom.operators.ranges import between, by_places, nearest_feature, range_join, reference_anti
from massloom.operators.storage import settled, stored

DECOY = "DECOY_"


def with_masses(df: DataFrame, seq: str = "peptide") -> DataFrame:
    """Adds mass, mh_mz and n_C .. n_S; rows with an invalid sequence go."""
    found = C.with_composition(df.where(F.col(seq).rlike(C.VALID)), seq)
    return found.withColumn("mh_mz", C.mh_mz(F.col("mass")))


def digest(proteins: DataFrame, missed: int = 2, shortest: int = 7, longest: int = 30) -> DataFrame:
    """(protein, peptide): each distinct peptide of each protein."""
    return C.peptides_of(proteins, "accession", "sequence", missed, shortest, longest).withColumnRenamed("accession", "protein")


def shuffled_proteins(proteins: DataFrame, accession: Column, seed: Column) -> DataFrame:
    """(accession, sequence) with the sequences shuffled by the seed. It is costly by letter, so
    proteins are dealt out first: files with few row groups would leave it to few tasks."""
    return C.with_shuffled(proteins.repartition("accession"), "sequence", seed, "_mixed_sequence").select(accession.alias("accession"), F.col("_mixed_sequence").alias("sequence"))


def first_protein(peptides: DataFrame, keep: list[str]) -> DataFrame:
    """One row per key: that of the least protein."""
    return peptides.groupBy(*keep).agg(F.min("protein").alias("protein"))


def _shuffled_digest(proteins: DataFrame, missed: int, shortest: int, longest: int, seed: str) -> DataFrame:
    mixed = shuffled_proteins(proteins, F.concat(F.lit(DECOY), "accession"), F.concat(F.lit(seed), F.col("accession")))
    return first_protein(digest(mixed, missed, shortest, longest), ["peptide"]).withColumn("is_decoy", F.lit(True))


def digest_with_decoys(proteins: DataFrame, missed: int = 1, shortest: int = 7, longest: int = 30, decoys: bool = True, seed: str = "42", exclude_targets: bool = True) -> DataFrame:
    """Targets, and decoys from proteins with all but K and R shuffled; decoys equal to a target go."""
    targets = first_protein(digest(proteins, missed, shortest, longest), ["peptide"]).withColumn("is_decoy", F.lit(False))
    if decoys:
        fake = _shuffled_digest(proteins, missed, shortest, longest, seed)
        if exclude_targets:
            fake = fake.join(targets.select("peptide"), "peptide", "left_anti")
        targets = targets.unionByName(fake)
    return with_masses(targets)


def digest_identified(proteins: DataFrame, identified: DataFrame, evidence: DataFrame, missed: int = 2, shortest: int = 7, longest: int = 30, seed: str = "42") -> DataFrame:
    """Digest of identified proteins, labelled protein_digest, lcms_confirmed or decoy, with evidence on targets.

    ``identified``: accession; ``evidence``: sequence and any further columns, one row per sequence.
    Confirmed sequences that the digest lacks are added. Decoys equal to targets stay.
    """
    own = proteins.join(identified.select("accession").distinct(), "accession", "left_semi")
    seen = evidence.dropDuplicates(["sequence"]).withColumnRenamed("sequence", "peptide")
    # one join, so that neither side is made twice: what only the evidence has is added
    targets = first_protein(digest(own, missed, shortest, longest), ["peptide"]).join(seen.withColumn("_seen", F.lit(True)), "peptide", "full_outer").withColumn("is_decoy", F.lit(False))
    out = with_masses(targets).unionByName(with_masses(_shuffled_digest(own, missed, shortest, longest, seed)), allowMissingColumns=True)
    more = [*seen.drop("peptide").columns, "_seen"]
    out = out.select("peptide", "protein", "is_decoy", *(c for c in out.columns if c not in ("peptide", "protein", "is_decoy", *more)), *more)
    return out.withColumn("source", F.when(F.col("is_decoy"), "decoy").when(F.col("_seen"), "lcms_confirmed").otherwise("protein_digest")).drop("_seen")


def match(features: DataFrame, peptides: DataFrame, ppm: float = 20.0, salts: int = 1) -> DataFrame:
    """Candidates: every peptide within ppm of a feature, with errors, counts and Kendrick mass defect."""
    pairs = range_join(features, peptides, "feature_mz", "mh_mz", ppm=ppm, salts=salts)
    out = pairs.withColumn("ppm_error", C.ppm_error(F.col("feature_mz"), F.col("mh_mz"))).withColumn("ppm_error_abs", F.abs("ppm_error")).withColumn("kendrick_mass_defect", C.kendrick_mass_defect(F.col("feature_mz")))
    return with_candidate_counts(out)


def with_candidate_counts(df: DataFrame) -> DataFrame:
    return df.withColumn("n_candidates", F.count(F.lit(1)).over(W.partitionBy("feature_idx"))).withColumn("log_n_candidates", F.log1p("n_candidates"))


def with_protein_counts(cand: DataFrame, full_digest: DataFrame | None = None) -> DataFrame:
    """protein_n_features and protein_tryptic_count; decoys inherit the latter from their protein."""
    per = cand.groupBy("protein").agg(F.count_distinct("feature_idx").alias("protein_n_features"))
    source = full_digest if full_digest is not None else cand.where("not is_decoy")
    tryptic = source.groupBy(F.col("protein").alias("_p")).agg(F.count_distinct("peptide").alias("protein_tryptic_count"))
    out = cand.join(per, "protein", "left").withColumn("_p", F.regexp_replace("protein", f"^{DECOY}", ""))
    return out.join(tryptic, "_p", "left").withColumn("protein_tryptic_count", F.coalesce("protein_tryptic_count", F.lit(0))).drop("_p")


def with_protein_consistency(cand: DataFrame) -> DataFrame:
    """protein_coverage, is_single_peptide_protein, log_protein_n_features, protein_rank and protein_best_ratio."""
    per = cand.groupBy("protein").agg(F.count_distinct("peptide").alias("_n"))
    out = cand.join(per, "protein", "left")
    out = out.withColumn("protein_coverage", F.least(F.lit(1.0), F.col("_n") / F.greatest(F.col("protein_tryptic_count"), F.lit(1)))).withColumn("is_single_peptide_protein", (F.col("_n") == 1).cast("int")).withColumn("log_protein_n_features", F.log1p("protein_n_features"))
    w = W.partitionBy("feature_idx")
    return out.withColumn("protein_rank", F.rank().over(w.orderBy(F.desc("protein_n_features")))).withColumn("protein_best_ratio", F.col("protein_n_features") / F.greatest(F.max("protein_n_features").over(w), F.lit(1))).drop("_n")


def best_matches(features: DataFrame, peptides: DataFrame, ppm: float = 20.0) -> DataFrame:
    """Each peptide with its nearest feature (then the least number): the best of its rows of ``match``, without
    counts of candidates. No pairs are made."""
    kind = features.schema["feature_idx"].dataType
    found = nearest_feature(features, peptides, "feature_mz", "feature_idx", "mh_mz", ppm).withColumn("feature_idx", F.col("feature_idx").cast(kind))
    out = peptides.join(found, "mh_mz")
    if len(features.columns) > 2:
        out = out.join(features.drop("feature_mz"), "feature_idx")
    return out.withColumn("ppm_error", C.ppm_error(F.col("feature_mz"), F.col("mh_mz"))).withColumn("ppm_error_abs", F.abs("ppm_error")).withColumn("kendrick_mass_defect", C.kendrick_mass_defect(F.col("feature_mz")))


def _best_per_peptide(cand: DataFrame) -> DataFrame:
    w = W.partitionBy("peptide").orderBy("ppm_error_abs", "feature_idx", "protein")
    return cand.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _unit(*key) -> Column:
    """A number from 0 up to 1 by hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mz_shift_decoys(targets: DataFrame, features: DataFrame, ppm: float = 20.0, delta_min: float = 5.0, delta_max: float = 20.0, snap_ppm: float = 50.0, tries: int = 50, seed: str = "42", snap: bool = True, masses: DataFrame | None = None, best: DataFrame | None = None) -> DataFrame:
    """Targets and, for each distinct target peptide, a decoy at a shifted m/z.

    Try k shifts the peptide's m/z by a hashed amount with alternating sign. With ``snap`` it goes to
    the nearest feature, if within ``snap_ppm``, which decoys may share; without, the shifted m/z is
    a feature of its own, and no two decoys come within ppm of each other. Places within ppm of
    any target mass (mh_mz of ``masses``, or of the targets) are taken. The first valid try stands.
    ``best``: the best row of each distinct target peptide, where known (``best_matches``).
    """
    best = _best_per_peptide(targets.where("not is_decoy")) if best is None else best
    known = (targets if masses is None else masses).select(F.col("mh_mz").alias("_ref"))
    sign = F.when((F.xxhash64(F.col("peptide")) + F.col("_try")) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    delta = sign * (F.lit(delta_min) + _unit(F.lit(seed), F.col("peptide"), F.col("_try")) * F.lit(delta_max - delta_min))
    table = best.select("peptide", F.col("mh_mz").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_try")).withColumn("shifted", F.col("_own") + delta).where("shifted > 0")
    if snap:
        # a try is valid where its nearest feature is open, of two equally near the lesser: up to the middles between it and those beside it
        every = features.groupBy(F.col("feature_mz").alias("_f")).agg(F.min("feature_idx").alias("_idx"))
        open_ = settled(reference_anti(every, known, "_f", "_ref", ppm))
        places = settled(open_.join(between(open_, every, "_f", "_f", 2.01 * snap_ppm), "_f"))
        found, at = F.col("_place"), F.col("shifted")
        off = F.abs(found - at)
        table = by_places(table, places, "shifted", "_f", snap_ppm, "inner", larger=True).where(off <= at * F.lit(snap_ppm) / F.lit(1e6))
        free = table.where(F.coalesce(off < F.abs(F.col("below") - at), F.lit(True)) & F.coalesce(off <= F.abs(F.col("above") - at), F.lit(True))).withColumnRenamed("_place", "place")
        first = free.groupBy("peptide").agg(F.min(F.struct("_try", "place", "_idx", "_own")).alias("t")).select("peptide", "t.*")
    else:
        free = reference_anti(table.withColumn("place", F.col("shifted")), known, "place", "_ref", ppm)
        first = first_free(free.select("peptide", "_try", "place", "_own"), "peptide", ppm, seed=seed)
        # behind the features' numbers, in order of place
        base = features.agg(F.max("feature_idx")).first()[0]
        first = numbered(first, "place", "_idx").withColumn("_idx", F.col("_idx") + F.lit(0 if base is None else base + 1))
    decoys = best.join(first.select("peptide", "place", "_idx", (F.col("place") - F.col("_own")).alias("decoy_delta_da")), "peptide")
    decoys = decoys.withColumns({"feature_mz": F.col("place"), "feature_idx": F.col("_idx").cast(targets.schema["feature_idx"].dataType), "is_decoy": F.lit(True), "protein": F.concat(F.lit(DECOY), "protein"), "kendrick_mass_defect": C.kendrick_mass_defect(F.col("place"))}).drop("place", "_idx")
    return targets.withColumn("decoy_delta_da", F.lit(None).cast("double")).unionByName(decoys, allowMissingColumns=True)


def mz_shuffle_decoys(targets: DataFrame, shift_share: float = 0.5) -> DataFrame:
    """One target and one decoy per peptide: the decoy sits at the feature of another, by a rotation of the order of masses."""
    return rotated(_best_per_peptide(targets.where("not is_decoy")), shift_share)


def rotated(best: DataFrame, shift_share: float = 0.5) -> DataFrame:
    """``mz_shuffle_decoys`` of the best row of each target peptide."""
    best = stored(best)
    ranked = numbered(best.select("peptide", "mass", "feature_mz", "feature_idx"), "mass", "_k", ties=("peptide",), hold=lambda df: df)
    ranked = stored(ranked.crossJoin(F.broadcast(best.agg(F.count(F.lit(1)).alias("_n")))))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(shift_share)).cast("int"))
    moved = ranked.where("_n > 1").select("peptide", F.pmod(F.col("_k") - step, F.col("_n")).alias("_to"))
    place = ranked.select(F.col("_k").cast("long").alias("_to"), F.col("feature_mz").alias("_fm"), F.col("feature_idx").alias("_fi"))
    decoys = best.join(moved.join(place, "_to"), "peptide").withColumn("feature_mz", F.col("_fm")).withColumn("feature_idx", F.col("_fi")).withColumn("is_decoy", F.lit(True)).withColumn("protein", F.concat(F.lit(DECOY), "protein"))
    return best.unionByName(decoys.select(*best.columns))


#: Residues that substitution puts in, by mass; those of one mass are no change.
SUBSTITUTES = "".join(sorted("ACDEFGHILMNPQSTVWY", key=lambda r: (C.RESIDUES[r][0], r)))


def _substitutions(base: DataFrame, n_residues: int, seed: str, tries: int, relaxed: bool) -> DataFrame:
    """Per peptide and try: the residues that change, the m/z then (``place``), and how far it moved.

    A hashed direction, up or down in mass, holds for a peptide. One substitution tries every inner
    place, in hashed order, with a residue of that direction, then every place with the other one.
    Several take the first places of the order of each try, those without a residue in the direction last.
    """
    mass = lambda r: C.RESIDUES[r][0]
    pools = {r: ["".join(x for x in SUBSTITUTES if side * (mass(x) - mass(r)) > 0) for side in (1, -1)] for r in SUBSTITUTES}
    of = lambda side: F.create_map(*(F.lit(v) for r, p in pools.items() for v in (r, p[side])))
    masses = F.create_map(*(F.lit(v) for r in SUBSTITUTES for v in (r, mass(r))))
    draw = lambda *key: F.abs(F.xxhash64(F.lit(f"{seed}{'r' if relaxed else ''}"), F.col("peptide"), *key))
    rows = base.withColumn("_up", F.pmod(F.xxhash64(F.lit("direction"), F.col("peptide")), F.lit(2)) == 0)
    places = F.filter(F.sequence(F.lit(2), F.greatest(F.length("peptide") - 1, F.lit(2))), lambda i: (i < F.length("peptide")) & ~F.substring("peptide", i, 1).isin("K", "R"))
    rows = rows.withColumn("_places", C.once(places)).where(F.size("_places") >= n_residues)
    if n_residues == 1:
        rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_pass")).select("*", F.explode("_places").alias("_at"))
        rows = rows.withColumn("_try", F.struct("_pass", draw(F.col("_at")).alias("h"), "_at")).withColumn("_chosen", F.array(F.struct("_pass", F.lit(0).cast("long").alias("h"), F.col("_at").alias("at"))))
    else:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_n"))
        lacking = lambda i: F.when(F.col("_up"), F.element_at(of(0), F.substring("peptide", i, 1))).otherwise(F.element_at(of(1), F.substring("peptide", i, 1))) == ""
        order = F.sort_array(F.transform("_places", lambda i: F.struct(F.when(lacking(i), 1).otherwise(0).alias("_pass"), draw(F.col("_n"), i).alias("h"), i.alias("at"))))
        rows = rows.withColumn("_try", F.struct(F.lit(0).alias("_pass"), F.col("_n").cast("long").alias("h"), F.lit(0).alias("_at"))).withColumn("_chosen", C.once(F.slice(order, 1, n_residues)))

    old = lambda c: F.substring("peptide", c["at"], 1)

    def new(c: Column) -> Column:
        pool = F.when(F.col("_up") == (c["_pass"] == 0), F.element_at(of(0), old(c))).otherwise(F.element_at(of(1), old(c)))
        return F.substring(pool, (F.pmod(draw(F.lit("to"), F.struct("_try"), c["at"]), F.greatest(F.length(pool), F.lit(1))) + 1).cast("int"), F.lit(1))

    rows = rows.withColumn("_to", C.once(F.transform("_chosen", lambda c: F.struct(c["at"].alias("at"), new(c).alias("new"), old(c).alias("old")))))
    rows = rows.withColumn("delta", C.once(F.aggregate("_to", F.lit(0.0), lambda d, c: d + F.element_at(masses, c["new"]) - F.element_at(masses, c["old"]))))
    return rows.where(F.col("delta").isNotNull()).select("peptide", "protein", "mh_mz", "_try", "_to", "delta", (F.col("mh_mz") + F.col("delta")).alias("place"))


def _substituted() -> Column:
    """The decoy sequence of a row of ``_substitutions``."""
    return F.aggregate("_to", F.col("peptide"), lambda s, c: F.concat(F.substring(s, F.lit(1), c["at"] - 1), c["new"], F.substring(s, c["at"] + 1, F.length(s))))


def substitution_decoys(targets: DataFrame, n_residues: int = 1, seed: str = "42", tries: int = 40, shift_min: float | None = None, ppm: float = 20.0, collisions: bool = True) -> DataFrame:
    """A decoy for each target peptide: ``n_residues`` inner residues, none of them K or R, become others.

    Tries that shift the m/z by less than ``shift_min`` (or ppm), or to within ppm of a target, fail.
    No two decoys come within ppm of each other; peptides for which that leaves no try get the first
    that avoids the targets alone. Those without any get none. Without ``collisions`` every try that is far enough stands.
    """
    base = targets.where("not is_decoy").select("peptide", "protein", "mass").dropDuplicates(["peptide"]).withColumn("mh_mz", C.mh_mz(F.col("mass")))
    base = stored(base)
    least = F.lit(shift_min) if shift_min is not None else F.col("mh_mz") * F.lit(ppm) / F.lit(1e6)
    found = None
    for relaxed in (False, True):
        left = base if found is None else base.join(found.select("peptide"), "peptide", "left_anti")
        rows = _substitutions(left, n_residues, seed, tries if not relaxed else -(-tries // 2), relaxed).where(F.abs("delta") >= least)
        if collisions:
            rows = reference_anti(rows, base.select(F.col("mh_mz").alias("_ref")), "place", "_ref", ppm)
        more = first_free(rows.select("peptide", "_try", "place", "protein", _substituted().alias("decoy")), "peptide", ppm, relaxed=relaxed or not collisions, seed=seed)
        found = more if found is None else found.unionByName(more)
        if not collisions:
            break
    return with_masses(found.select(F.col("decoy").alias("peptide"), F.concat(F.lit(DECOY), "protein").alias("protein"), F.lit(True).alias("is_decoy")))


def entrapment(foreign: DataFrame, targets: DataFrame, features: DataFrame, ppm: float = 20.0, missed: int = 2, shortest: int = 7, longest: int = 30, masses: DataFrame | None = None) -> DataFrame:
    """Targets and the matches of a foreign proteome's peptides that aren't isobaric with, or equal to, a target
    (equal ones are isobaric). ``masses``: mh_mz of the targets, where known."""
    known = targets if masses is None else masses
    table = reference_anti(with_masses(digest(foreign, missed, shortest, longest)), known.select(F.col("mh_mz").alias("_ref")), "mh_mz", "_ref", ppm)
    table = with_masses(first_protein(table, ["peptide"]).withColumn("is_decoy", F.lit(True)))
    found = match(features, table.withColumn("protein", F.concat(F.lit("ENTRAPMENT_"), "protein")), ppm)
    return targets.unionByName(found, allowMissingColumns=True)


def shuffled_entrapment(evidence: DataFrame, ppm: float = 20.0, missed: int = 2, shortest: int = 7, longest: int = 30, seed: str = "42") -> DataFrame:
    """Per protein, two shuffles of its joined peptides: entrapment targets and their decoys, none exact or isobaric.

    ``evidence``: protein, sequence.
    """
    joined = stored(evidence.groupBy(F.col("protein").alias("accession")).agg(F.array_join(F.array_sort(F.collect_set("sequence")), "").alias("sequence")))
    known = with_masses(evidence.select(F.col("sequence").alias("peptide")).distinct())
    fakes = []
    for tag, prefix, decoy in (("a", "ENTRAPMENT_", False), ("b", "ENTRAPMENT_DECOY_", True)):
        fake = shuffled_proteins(joined, F.concat(F.lit(prefix), "accession"), F.concat(F.lit(seed + tag), F.col("accession")))
        fakes.append(digest(fake, missed, shortest, longest).withColumn("is_decoy", F.lit(decoy)))
    # a peptide of both is a target; those equal to a known one are isobaric with it
    out = reference_anti(with_masses(fakes[0].unionByName(fakes[1])), known.select(F.col("mh_mz").alias("_ref")), "mh_mz", "_ref", ppm)
    return with_masses(out.groupBy("peptide").agg(F.min(F.struct("is_decoy", "protein")).alias("_p")).select("peptide", "_p.protein", "_p.is_decoy"))


def balanced_shuffle(proteins: DataFrame, targets: DataFrame, features: DataFrame, ppm: float = 20.0, rounds: int = 50, block: int = 5, ratio: float = 1.0, by: str = "length", coverage: float = 0.95, missed: int = 2, shortest: int = 7, longest: int = 30, seed: str = "42") -> DataFrame:
    """Decoys from rounds of shuffled proteins, matched, then sampled to as many candidates as the targets have.

    Rounds come in blocks, each stored, so that a later one only adds its own new matches. The next
    block runs while there are fewer decoys than wanted in all, or some length has some but too few
    (``by`` feature: more than 1 - coverage of the target features have none). By length, each gets
    its own number, without filling from other lengths. By feature, each gets its own number as far
    as decoys match it, and what is short in all is topped up from the rest of the pool.
    """
    targets = stored(targets)
    known = targets.where("not is_decoy")
    plain = known.select("peptide").distinct()
    per = known.groupBy(F.length("peptide").alias("_of") if by == "length" else F.col("feature_idx").alias("_of")).agg(F.round(F.count(F.lit(1)) * F.lit(ratio)).cast("long").alias("_need"))
    per = settled(per)
    total = int(known.count() * ratio)
    found = None
    for start in range(0, rounds, block):
        mixed = proteins.withColumn("_round", F.explode(F.sequence(F.lit(start), F.lit(min(rounds, start + block) - 1))))
        mixed = shuffled_proteins(mixed, F.concat(F.lit(DECOY), "accession", F.lit("_r"), F.col("_round").cast("string")), F.concat(F.lit(seed), F.col("accession"), F.col("_round").cast("string")))
        table = first_protein(digest(mixed, missed, shortest, longest), ["peptide"]).withColumn("is_decoy", F.lit(True))
        table = table.join(plain, "peptide", "left_anti")
        table = table if found is None else table.join(found.select("peptide").distinct(), "peptide", "left_anti")
        more = stored(range_join(features, with_masses(table), "feature_mz", "mh_mz", ppm=ppm).withColumn("_of", F.length("peptide") if by == "length" else F.col("feature_idx")))
        found = more if found is None else found.unionByName(more)
        if found.count() < total:
            continue
        have = found.groupBy("_of").agg(F.count(F.lit(1)).alias("_have"))
        if by == "length":
            done = per.join(have, "_of").where("_have < _need").isEmpty()
        else:
            done = per.join(have, "_of", "left_semi").count() >= coverage * per.count()
        if done:
            break
    need = F.coalesce(F.col("_need"), F.lit(0))
    pool = found.join(per, "_of", "left")
    key = ["peptide", "feature_idx"]
    kept = stratified_sample(pool, ["_of"], key, need, seed) if by == "length" else sample_with_top_up(pool, ["_of"], key, need, total, seed)
    out = kept.drop("_of", "_need").withColumn("ppm_error", C.ppm_error(F.col("feature_mz"), F.col("mh_mz"))).withColumn("ppm_error_abs", F.abs("ppm_error")).withColumn("kendrick_mass_defect", C.kendrick_mass_defect(F.col("feature_mz")))
    shared = [c for c in targets.columns if c in out.columns]
    both = targets.unionByName(out.select(*shared), allowMissingColumns=True)
    return with_candidate_counts(both.drop("n_candidates", "log_n_candidates"))


def extra_peptides(table: DataFrame, extra: DataFrame) -> DataFrame:
    """The table and those of ``extra`` whose sequence it lacks."""
    return table.unionByName(extra.join(table.select("peptide").distinct(), "peptide", "left_anti"), allowMissingColumns=True)


def calibration_peptides(cand: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds is_calibration_peptide: targets whose z(-ppm) + z(isotope cosine) is at or above the 1 - share quantile."""
    targets = cand.where("not is_decoy")
    z = lambda c, m, s: F.coalesce(F.try_divide(c - F.col(m), F.col(s)), F.lit(0.0))
    stats = targets.agg(F.avg(-F.col("ppm_error_abs")).alias("_m1"), F.stddev_pop(-F.col("ppm_error_abs")).alias("_s1"), F.avg("theo_isotope_cosine").alias("_m2"), F.stddev_pop("theo_isotope_cosine").alias("_s2"))
    scored = cand.crossJoin(F.broadcast(stats)).withColumn("_z", z(-F.col("ppm_error_abs"), "_m1", "_s1") + z(F.col("theo_isotope_cosine"), "_m2", "_s2"))
    edge = scored.where("not is_decoy").agg(F.percentile("_z", F.lit(1 - share)).alias("_e"))
    return scored.crossJoin(F.broadcast(edge)).withColumn("is_calibration_peptide", ~F.col("is_decoy") & (F.col("_z") >= F.col("_e"))).drop("_m1", "_s1", "_m2", "_s2", "_z", "_e")
