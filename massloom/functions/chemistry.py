"""Chemistry of peptides and ions as column expressions.

Most of it is built-in functions, as Columns. What goes letter by letter (digestion, composition,
shuffles) and long series run over Arrow batches. Missing values are NULL; NaN never leaves these functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Residue, monoisotopic mass, atoms of C, H, N, O, S, Kyte-Doolittle hydropathy.
RESIDUES = {
    "A": (71.03711, 3, 5, 1, 1, 0, 1.8),
    "C": (103.00919, 3, 5, 1, 1, 1, 2.5),
    "D": (115.02694, 4, 5, 1, 3, 0, -3.5),
    "E": (129.04259, 5, 7, 1, 3, 0, -3.5),
    "F": (147.06841, 9, 9, 1, 1, 0, 2.8),
    "G": (57.02146, 2, 3, 1, 1, 0, -0.4),
    "H": (137.05891, 6, 7, 3, 1, 0, -3.2),
    "I": (113.08406, 6, 11, 1, 1, 0, 4.5),
    "K": (128.09496, 6, 12, 2, 1, 0, -3.9),
    "L": (113.08406, 6, 11, 1, 1, 0, 3.8),
    "M": (131.04049, 5, 9, 1, 1, 1, 1.9),
    "N": (114.04293, 4, 6, 2, 2, 0, -3.5),
    "P": (97.05276, 5, 7, 1, 1, 0, -1.6),
    "Q": (128.05858, 5, 8, 2, 2, 0, -3.5),
    "R": (156.10111, 6, 12, 4, 1, 0, -4.5),
    "S": (87.03203, 3, 5, 1, 2, 0, -0.8),
    "T": (101.04768, 4, 7, 1, 2, 0, -0.7),
    "V": (99.06841, 5, 9, 1, 1, 0, 4.2),
    "W": (186.07931, 11, 10, 2, 1, 0, -0.9),
    "Y": (163.06333, 9, 9, 1, 2, 0, -1.3),
}
# Water, proton, and the spacing of isotope peaks.
WATER, PROTON, NEUTRON = 18.010565, 1.007276, 1.003355
# Reference ions of the CHCA matrix, and adduct shifts.
CHCA_IONS = (190.0499, 212.0318, 228.0058, 379.0925, 401.0744, 568.1351, 757.1777, 172.0393)
ADDUCTS = {"na": 21.9819, "k": 37.9559, "chca": 171.0320}
# Averagine atoms per dalton.
AVERAGINE = {"C": 0.04443, "H": 0.06981, "N": 0.01221, "O": 0.01329, "S": 0.00037}
# Monoisotopic masses and natural abundances of the elements.
MONOISOTOPIC = {"C": 12.0, "H": 1.00782503207, "N": 14.0030740048, "O": 15.99491461956, "S": 31.972071}
ABUNDANCE = {"C13": 0.0107, "H2": 0.000115, "N15": 0.00364, "O17": 0.00038, "O18": 0.00205, "S33": 0.0075, "S34": 0.0425}
# Lehninger pKa of side chains and ends, with the sign of the charge.
PKA = {"N_TERM": (9.69, 1), "C_TERM": (2.34, -1), "D": (3.86, -1), "E": (4.25, -1), "C": (8.33, -1), "Y": (10.0, -1), "H": (6.0, 1), "K": (10.5, 1), "R": (12.4, 1)}
#: The published trypsin rule: behind K or R unless P follows, and WK|P, MR|P.
TRYPSIN = r"(?<=[KR])(?=[^P])|(?<=WK)(?=P)|(?<=MR)(?=P)"
VALID = "^[ACDEFGHIKLMNPQRSTVWY]+$"
ATOMS = ("C", "H", "N", "O", "S")
#: Of each byte the number of its residue, or 20.
_CODE = np.full(256, 20)
_CODE[[ord(aa) for aa in RESIDUES]] = np.arange(20)


def once(value: Column) -> Column:
    """The value as an expression that counts as nondeterministic: the optimizer then doesn't copy it
    into lambdas or into filters that it infers and pushes down, where it would run per element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of a sequence are among the letters."""
    rest = F.replace(seq, F.lit(letters), F.lit("")) if len(letters) == 1 else F.translate(seq, letters, "")
    return F.length(seq) - F.length(rest)


def residue_counts(seq: Column) -> dict[str, Column]:
    return {aa: count_of(seq, aa) for aa in RESIDUES}


def _counted(seq: pa.Array) -> np.ndarray:
    """Rows of counts of the residues, in their order, and of all other bytes; NULL as an empty sequence."""
    seq = pa.concat_arrays([seq.cast(pa.string()).fill_null("")])
    n, (_, ends, data) = len(seq), seq.buffers()
    at = np.frombuffer(ends, np.int32)[seq.offset : seq.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    code = _CODE[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.zeros(0, np.int64)
    return np.bincount(np.repeat(np.arange(n) * 21, np.diff(at)) + code, minlength=n * 21).reshape(n, 21)


def _composition(seq: pa.Array) -> pa.Array:
    counts = _counted(seq)
    bad = (counts[:, 20] > 0) | (counts.sum(1) == 0)
    mass = np.full(len(seq), WATER)
    for k, row in enumerate(RESIDUES.values()):
        mass = mass + counts[:, k] * row[0]
    atoms = [counts[:, :20] @ np.array([row[1 + k] for row in RESIDUES.values()]) + {"H": 2, "O": 1}.get(atom, 0) for k, atom in enumerate(ATOMS)]
    return pa.StructArray.from_arrays([pa.array(mass, mask=bad), *(pa.array(x.astype(np.int32), mask=bad) for x in atoms)], names=["mass", *(f"n_{a}" for a in ATOMS)])


def with_composition(df: DataFrame, seq: str) -> DataFrame:
    """Adds mass and n_C .. n_S, NULL for an invalid sequence. Residues are counted once, in Arrow batches; as
    nondeterministic, so that filters on the mass don't count them again."""
    kind = T.StructType([T.StructField("mass", T.DoubleType()), *(T.StructField(f"n_{a}", T.IntegerType()) for a in ATOMS)])
    made = df.withColumn("_made", F.arrow_udf(_composition, kind).asNondeterministic()(F.col(seq)))
    return made.withColumns({c: F.col(f"_made.{c}") for c in ("mass", *(f"n_{a}" for a in ATOMS))}).drop("_made")


def cut(seq: str, missed: int, shortest: int, longest: int) -> list[str]:
    """The distinct tryptic peptides of a sequence, by the rule of ``TRYPSIN``."""
    c = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    k, r, p = (c[:-1] == ord("K")), (c[:-1] == ord("R")), (c[1:] == ord("P"))
    before = np.concatenate([[0], c[:-2]]) if len(c) > 1 else c[:0]
    ends = np.flatnonzero(((k | r) & ~p) | (k & p & (before == ord("W"))) | (r & p & (before == ord("M")))) + 1
    edges = np.concatenate([[0], ends, [len(c)]])
    found: dict[str, None] = {}
    for m in range(missed + 1):
        size = edges[1 + m :] - edges[: max(0, len(edges) - 1 - m)]
        fits = np.flatnonzero((size >= shortest) & (size <= longest))
        found.update(dict.fromkeys(seq[lo:hi] for lo, hi in zip(edges[fits].tolist(), edges[fits + 1 + m].tolist(), strict=True)))
    return list(found)


def peptides_of(df: DataFrame, name: str, seq: str, missed: int = 2, shortest: int = 7, longest: int = 30, rows: int = 65_536) -> DataFrame:
    """(name, peptide): each distinct tryptic peptide of each sequence, in batches of about ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1)):
                own = cut(text.as_py(), missed, shortest, longest) if text.is_valid else []
                at += [i] * len(own)
                found += own
                if len(found) >= rows or (i == len(batch) - 1 and found):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=[name, "peptide"])
                    at, found = [], []

    return df.select(name, seq).mapInArrow(run, T.StructType([df.schema[name], T.StructField("peptide", T.StringType())]))


def _mass(valid: Column, counts: dict[str, Column]) -> Column:
    total = F.lit(WATER)
    for aa, row in RESIDUES.items():
        total = total + counts[aa] * F.lit(row[0])
    return F.when(valid, total)


def _atoms(valid: Column, counts: dict[str, Column]) -> dict[str, Column]:
    out = {}
    for k, atom in enumerate(ATOMS):
        total = F.lit({"H": 2, "O": 1}.get(atom, 0))
        for aa, row in RESIDUES.items():
            if row[1 + k]:
                total = total + counts[aa] * F.lit(row[1 + k])
        out[f"n_{atom}"] = F.when(valid, total).cast("int")
    return out


def neutral_mass(seq: Column) -> Column:
    """Sum of residue masses and water; NULL for a sequence with any other letter."""
    return _mass(seq.rlike(VALID), residue_counts(seq))


def mh_mz(mass: Column) -> Column:
    return mass + F.lit(PROTON)


def atom_counts(seq: Column) -> dict[str, Column]:
    """n_C .. n_S, with the water of the ends; NULL for an invalid sequence."""
    return _atoms(seq.rlike(VALID), residue_counts(seq))


def ppm_error(feature_mz: Column, mh: Column) -> Column:
    """Relative to the peptide."""
    return (feature_mz - mh) / mh * F.lit(1e6)


def kendrick_mass_defect(mz: Column) -> Column:
    km = mz * F.lit(14.0) / F.lit(14.01565)
    return km - F.rint(km)


def averagine_atoms(mass: Column, sulfur: bool = True) -> dict[str, Column]:
    return {a: F.rint(mass * F.lit(c)) if sulfur or a != "S" else F.lit(0.0) for a, c in AVERAGINE.items()}


def mass_defect_residual(mass: Column) -> Column:
    """Fraction of the mass less that of its averagine composition."""
    mono = None
    for a, n in averagine_atoms(mass).items():
        mono = n * F.lit(MONOISOTOPIC[a]) if mono is None else mono + n * F.lit(MONOISOTOPIC[a])
    return (mass - F.floor(mass)) - (mono - F.floor(mono))


def chca_distance_ppm(mz: Column) -> Column:
    return F.array_min(F.array(*(F.abs(mz - F.lit(r)) / F.lit(r) * F.lit(1e6) for r in CHCA_IONS)))


def missed_cleavages(seq: Column) -> Column:
    """K or R inside the sequence that no P follows."""
    return F.regexp_count(seq, F.lit("[KR](?=[^P])"))


def _gravy(seq: pa.Array) -> pa.Array:
    counts = _counted(seq)
    total = np.zeros(len(seq))
    for k, row in enumerate(RESIDUES.values()):
        total = total + counts[:, k] * row[6]
    size = pc.utf8_length(seq).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.divide(total, size, out=np.zeros(len(seq)), where=size > 0))


def gravy(seq: Column) -> Column:
    return F.arrow_udf(_gravy, T.DoubleType())(seq)


def ionization(seq: Column) -> dict[str, Column]:
    """n_arginine, n_basic_residues, n_aromatic, gravy_score, charge_proxy."""
    basic = count_of(seq, "KRH")
    return {"n_arginine": count_of(seq, "R"), "n_basic_residues": basic, "n_aromatic": count_of(seq, "FWY"), "gravy_score": gravy(seq), "charge_proxy": basic - count_of(seq, "DE")}


def property_flags(seq: Column) -> dict[str, Column]:
    """has_oxidized_met, has_cys, n_proline, acidic_residue_density."""
    return {"has_oxidized_met": (count_of(seq, "M") > 0).cast("int"), "has_cys": (count_of(seq, "C") > 0).cast("int"), "n_proline": count_of(seq, "P"), "acidic_residue_density": F.when(F.length(seq) > 0, count_of(seq, "DE") / F.length(seq)).otherwise(F.lit(0.0))}


def isoelectric_point(seq: Column, steps: int = 50) -> Column:
    """Bisection of the net charge over pH 0 to 14."""

    def charge(ph):
        total = F.lit(0.0)
        for key, (pka, sign) in PKA.items():
            n = F.lit(1) if key.endswith("TERM") else count_of(seq, key)
            total = total + n * (F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (ph - F.lit(pka)) * F.lit(float(sign))))) * F.lit(float(sign))
        return total

    halve = lambda s, _: F.struct(F.when(charge((s["lo"] + s["hi"]) / 2) > 0, (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"), F.when(charge((s["lo"] + s["hi"]) / 2) > 0, s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi")), halve, lambda s: (s["lo"] + s["hi"]) / 2)


def isotope_pattern(atoms: dict[str, Column]) -> tuple[Column, Column, Column]:
    """The first three isotope peaks of a composition, with sum 1, in closed form.

    With r1 and r2 the abundances one and two neutrons up, relative to the lightest isotope:
    a = sum n r1, b = sum n r1^2, c = sum n r2, and the peaks are 1, a, (a^2 - b) / 2 + c.
    """
    x = ABUNDANCE
    r1 = {"C": x["C13"] / (1 - x["C13"]), "H": x["H2"] / (1 - x["H2"]), "N": x["N15"] / (1 - x["N15"]), "O": x["O17"] / (1 - x["O17"] - x["O18"]), "S": x["S33"] / (1 - x["S33"] - x["S34"])}
    r2 = {"O": x["O18"] / (1 - x["O17"] - x["O18"]), "S": x["S34"] / (1 - x["S33"] - x["S34"])}
    a = b = c = F.lit(0.0)
    for atom, n in atoms.items():
        a, b = a + n * F.lit(r1[atom]), b + n * F.lit(r1[atom] ** 2)
        if atom in r2:
            c = c + n * F.lit(r2[atom])
    m2 = (a * a - b) / F.lit(2.0) + c
    total = F.lit(1.0) + a + m2
    return F.lit(1.0) / total, a / total, m2 / total


def with_isotope_distribution(df: DataFrame, atoms: dict[str, Column], n: int, out: str) -> DataFrame:
    """Adds the first n isotope peaks of a composition, an array with sum 1.

    The series of all isotopes is the product of the elements' series, each to the power of its
    count. Its logarithmic derivative is the sum of theirs, so with p_i that sum's coefficients the
    peaks follow one from another: q_k = (p_1 q_(k-1) + .. + p_k q_0) / k, with q_0 = 1. Counts may be fractions.
    """
    x = ABUNDANCE
    series = {"C": [x["C13"]], "H": [x["H2"]], "N": [x["N15"]], "O": [x["O17"], x["O18"]], "S": [x["S33"], x["S34"]]}
    table = []
    for atom in atoms:
        r = [v / (1 - sum(series[atom])) for v in series[atom]]
        g: list[float] = []
        for k in range(1, n):
            g.append((k * r[k - 1] if k <= len(r) else 0.0) - sum(r[i - 1] * g[k - i - 1] for i in range(1, min(k - 1, len(r)) + 1)))
        table.append(g)

    def peaks(*counts: pa.Array) -> pa.Array:
        known = [c.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in counts]
        p = [sum((c * g[k] for c, g in zip(known, table, strict=True)), np.zeros(len(known[0]))) for k in range(n - 1)]
        q = [np.ones(len(known[0]))]
        for k in range(1, n):
            q.append(sum((p[i] * q[k - 1 - i] for i in range(k)), np.zeros(len(q[0]))) / k)
        shares = np.stack(q, 1) / sum(q, np.zeros(len(q[0])))[:, None]
        values = pa.array(shares.ravel(), mask=np.isnan(shares).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(q[0]) + 1, dtype=np.int32) * n), values)

    return df.withColumn(out, F.arrow_udf(peaks, T.ArrayType(T.DoubleType())).asNondeterministic()(*atoms.values()))


def cosine3(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Cosine of two short vectors; 0 if either has no length."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    norm = lambda v: F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def isotope_features(theory: tuple[Column, ...], seen: tuple[Column, ...], plain: tuple[Column, ...], rich: tuple[Column, ...], n_s: Column) -> dict[str, Column]:
    """Comparison of an observed envelope (three columns) with theory and with averagine without and with sulfur."""
    total = sum(seen[1:], seen[0])
    chi2 = kl = F.lit(0.0)
    for t, o in zip(theory, seen, strict=True):
        expected = t * total
        chi2 = chi2 + F.when(expected > 0, (o - expected) * (o - expected) / expected).otherwise(0.0)
        p, q = F.greatest(F.try_divide(o, total), F.lit(1e-10)), F.greatest(t, F.lit(1e-10))
        kl = kl + p * F.log(p / q)
    has = total > 0
    ratio = lambda k: F.when((seen[0] > 0) & (theory[0] > 0), F.abs(F.try_divide(seen[k], seen[0]) - F.try_divide(theory[k], theory[0])))
    peak = F.greatest(*seen)
    return {
        "theo_isotope_cosine": F.when(has, cosine3(theory, seen)).otherwise(0.0), "theo_isotope_chi2": F.when(has, chi2), "theo_isotope_kl": F.when(has, kl), "theo_m1_ratio_diff": ratio(1), "theo_m2_ratio_diff": ratio(2),
        "monoisotopic_confidence": F.coalesce(F.try_divide(seen[0], peak), F.lit(0.0)), "averagine_deviation": F.when(has, F.lit(1.0) - cosine3(plain, seen)), "averagine_deviation_sulfur": F.when(has, F.lit(1.0) - cosine3(rich, seen)), "theo_has_sulfur": (n_s > 0).cast("int"),
    }


def spectral_angle(cosine: Column) -> Column:
    return F.lit(1.0) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.lit(math.pi)


def mz_to_mass(mz: Column, charge: Column) -> Column:
    return mz * charge - charge * F.lit(PROTON)


def mass_to_mz(mass: Column, charge: Column) -> Column:
    return (mass + charge * F.lit(PROTON)) / charge


def _ccs_per_inv_k0(mz: Column, charge: Column) -> Column:
    ion = mz * charge
    gas = F.lit(28.013)
    return F.lit(18509.8632163405) * charge / F.sqrt((ion * gas) / (ion + gas) * F.lit(31.85 + 273.15))


def inv_k0_to_ccs(inv_k0: Column, mz: Column, charge: Column) -> Column:
    """Mason-Schamp in nitrogen at 31.85 degrees Celsius."""
    return inv_k0 * _ccs_per_inv_k0(mz, charge)


def ccs_to_inv_k0(ccs: Column, mz: Column, charge: Column) -> Column:
    """The reduced inverse mobility of a collision cross section, under the same conditions."""
    return ccs / _ccs_per_inv_k0(mz, charge)


def bare_sequence(text: Column) -> Column:
    """Without flanks (the second dot field of three) and modifications, in upper case."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"\([^)]*\)", "")
    flanked = plain.rlike(r"^[^.]*\.[^.]+\.[^.]*$")
    return F.upper(F.when(flanked, F.split_part(plain, F.lit("."), F.lit(2))).otherwise(plain))


def bare_accession(header: Column) -> Column:
    """The middle field of sp|X|.., tr|X|.., ref|X|..; else the first word; without a leading >."""
    plain = F.regexp_replace(F.trim(header), "^>", "")
    named = plain.rlike(r"^(sp|tr|ref)\|[^|]+")
    return F.when(named, F.split_part(plain, F.lit("|"), F.lit(2))).otherwise(F.split_part(plain, F.lit(" "), F.lit(1)))


def with_shuffled(df: DataFrame, seq: str, seed: Column, out: str) -> DataFrame:
    """Adds the sequence with K and R in place and the other residues in an order hashed from the seed:
    by the upper 32 bits of Spark's xxhash64 of the seed and a residue's place, then by place. Letters
    beyond Latin-1 become "?"."""
    return df.withColumn(out, F.arrow_udf(_mixed, T.StringType()).asNondeterministic()(F.col(seq), F.xxhash64(seed)))


def _hashed(h: int, n: int) -> np.ndarray:
    """xxhash64 of 0 to n - 1, as Spark goes on from the hash of columns before."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    with np.errstate(over="ignore"):
        x = np.array([h], np.int64).astype(np.uint64) + five + np.uint64(8)
        x = x ^ (turned(np.arange(n, dtype=np.uint64) * two, 31) * one)
        x = turned(x, 27) * one + four
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return (x ^ (x >> np.uint64(32))).astype(np.int64)


def _mixed(seq: pa.Array, seed: pa.Array) -> pa.Array:
    out = []
    for text, h in zip(seq, seed.to_pylist(), strict=True):
        if not text.is_valid:
            out.append(None)
            continue
        c = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)
        c = np.where(c < 256, c, ord("?")).astype(np.uint8)
        free = np.flatnonzero((c != ord("K")) & (c != ord("R")))
        order = free[np.lexsort((free, _hashed(h, len(c))[free] >> 32))]
        mixed = c.copy()
        mixed[free] = c[order]
        out.append(mixed.tobytes().decode("latin-1"))
    return pa.array(out, pa.string())
