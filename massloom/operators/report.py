"""The queries behind reports: curves, histograms, counts by threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.operators.ordered import quantiles
from massloom.operators.storage import settled


def fdr_counts(df: DataFrame, q: str = "q_value", levels: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(fdr, n): targets at or below each level."""
    cells = [F.struct(F.lit(x).alias("fdr"), F.count_if(~F.col("is_decoy") & (F.col(q) <= x)).alias("n")) for x in levels]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("z")).select("z.fdr", "z.n")


def entrapment_counts(df: DataFrame, q: str = "q_value", levels: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(fdr, entrapment, real, fraction): targets by whether their protein is an entrapment one."""
    trap = F.col("protein").startswith("ENTRAPMENT_")
    cells = []
    for x in levels:
        ok = ~F.col("is_decoy") & (F.col(q) <= x)
        n, m = F.count_if(ok & trap), F.count_if(ok & ~trap)
        cells.append(F.struct(F.lit(x).alias("fdr"), n.alias("entrapment"), m.alias("real"), F.coalesce(F.try_divide(n, n + m), F.lit(0.0)).alias("fraction")))
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("z")).select("z.*")


def fdr_curve(df: DataFrame, q: str = "q_value", points: int = 500, top: float = 0.1) -> DataFrame:
    """(fdr, n): targets at or below each of ``points`` levels up to ``top``. q-values are binned to the grid first."""
    cell = F.ceil(F.col(q) / F.lit(top / points)).cast("long")
    hist = df.where(~F.col("is_decoy") & (F.col(q) <= top)).groupBy(F.greatest(cell, F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    grid = df.sparkSession.range(1, points + 1).select(F.col("id").alias("k"))
    run = F.sum(F.coalesce("c", F.lit(0))).over(W.orderBy("k"))
    return grid.join(F.broadcast(hist), "k", "left").select((F.col("k") * F.lit(top / points)).alias("fdr"), run.alias("n"))


def outcome(q: str = "q_value") -> Column:
    """Class of a row by its q-value."""
    return F.when(F.col("is_decoy"), "decoy").when(F.col(q) <= 0.01, "q<=0.01").when(F.col(q) <= 0.05, "q<=0.05").otherwise("rest")


def by_outcome(df: DataFrame, value: str, q: str = "q_value") -> DataFrame:
    """(outcome, n, q1, median, q3): exact quartiles, for which no task keeps a class's values; NaN has no place among them."""
    rows = settled(df.where(F.col(value).isNotNull()).select(outcome(q).alias("outcome"), F.col(value).cast("double").alias("v")))
    sizes = settled(rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
    names, out = ("q1", "median", "q3"), {n: F.lit(None).cast("double") for n in ("q1", "median", "q3")}
    for r in sizes.collect():
        own = F.col("outcome") == r["outcome"]
        for n, edge in zip(names, quantiles(rows.where(own), "v", [0.25, 0.5, 0.75]), strict=True):
            out[n] = F.when(own, F.lit(edge)).otherwise(out[n])
    return sizes.select("outcome", "n", *(out[n].alias(n) for n in names))


def histogram(df: DataFrame, value: str, by: str, bins: int = 50, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(by, bin, n): equal bins between two quantiles of all values; rows beyond them are left out."""
    low, high = (F.lit(e).cast("double") for e in quantiles(df, value, [lo, hi]))
    k = F.least(F.floor((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.where((F.col(value) >= low) & (F.col(value) <= high) & (high > low)).groupBy(by, k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def occupancy(df: DataFrame, group: str = "feature_idx") -> DataFrame:
    """(kind, n): groups with targets and decoys, only targets, only decoys."""
    per = df.groupBy(group).agg(F.bool_or(~F.col("is_decoy")).alias("t"), F.bool_or("is_decoy").alias("d"))
    kind = F.when(F.col("t") & F.col("d"), "contested").when(F.col("t"), "target_only").otherwise("decoy_only")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def competition(df: DataFrame, group: str = "feature_idx") -> DataFrame:
    """(n_targets, n_decoys, n): how many groups have so many of each."""
    per = df.groupBy(group).agg(F.count_if(~F.col("is_decoy")).alias("n_targets"), F.count_if("is_decoy").alias("n_decoys"))
    return per.groupBy("n_targets", "n_decoys").agg(F.count(F.lit(1)).alias("n"))


def pp_curve(df: DataFrame, score: str, points: int = 100) -> DataFrame:
    """(point, target_share, decoy_share): both distributions at equal steps between the ends."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.count_if(~F.col("is_decoy")).alias("_t"), F.count_if("is_decoy").alias("_d"))
    cell = F.greatest(F.lit(0), F.ceil((F.col(score) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * points)).cast("long")
    hist = df.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(cell, F.lit(0)).alias("point"), "_t", "_d").agg(F.count_if(~F.col("is_decoy")).alias("t"), F.count_if("is_decoy").alias("d"))
    w = W.orderBy("point")
    return hist.select("point", F.coalesce(F.try_divide(F.sum("t").over(w), F.col("_t")), F.lit(0.0)).alias("target_share"), F.coalesce(F.try_divide(F.sum("d").over(w), F.col("_d")), F.lit(0.0)).alias("decoy_share"))


def protein_coherence(pairs: DataFrame, same: str = "protein") -> DataFrame:
    """Per protein of (protein, a, b, r): pairs, mean and least r."""
    return pairs.where(F.col("r").isNotNull()).groupBy(same).agg(F.count("r").alias("n_pairs"), F.avg("r").alias("mean_r"), F.min("r").alias("min_r"))


def imputation_diagnostics(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, decoy and target NULL counts and rates, class medians): from one unpivoted pass."""
    stack = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    rows = df.select("is_decoy", F.expr(f"stack({len(features)}, {stack}) as (feature, value)"))
    out = []
    for name, c in (("target", ~F.col("is_decoy")), ("decoy", F.col("is_decoy"))):
        out += [F.count_if(c & F.col("value").isNull()).alias(f"{name}_nulls"), F.avg(F.when(c, F.col("value").isNull().cast("double"))).alias(f"{name}_null_rate"), F.percentile(F.when(c, F.col("value")), F.lit(0.5)).alias(f"{name}_median")]
    return rows.groupBy("feature").agg(*out)


def recall_at(df: DataFrame, truth: DataFrame, q: str = "q_value", levels: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(fdr, found, total): distinct true peptides among targets at each level."""
    own = df.where("not is_decoy").join(truth.select("peptide").distinct(), "peptide", "left_semi").groupBy("peptide").agg(F.min(q).alias("q"))
    total = truth.agg(F.count_distinct("peptide").alias("total"))
    cells = [F.struct(F.lit(x).alias("fdr"), F.count_if(F.col("q") <= x).alias("found")) for x in levels]
    return own.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("z")).select("z.*").crossJoin(F.broadcast(total))


def linear_contributions(df: DataFrame, weights: dict[str, float], key: list[str], top: int = 15) -> DataFrame:
    """(key, feature, contribution, percentile): weight times the distance from the mean, the largest first."""
    means = df.agg(*(F.avg(f).alias(f"_m_{f}") for f in weights))
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), (F.lit(float(w)) * (F.col(f) - F.col(f"_m_{f}"))).alias("contribution"), F.col(f).cast("double").alias("value")) for f, w in weights.items()))
    rows = df.crossJoin(F.broadcast(means)).select(*key, F.explode(cells).alias("z")).select(*key, "z.*")
    rows = rows.withColumn("percentile", F.percent_rank().over(W.partitionBy("feature").orderBy("value")))
    w = W.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), "feature")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r", "value")


def top_intervals(matrix: DataFrame, n: int = 9) -> DataFrame:
    """The n intervals with the highest mean intensity (a report of fixed size)."""
    return matrix.orderBy(F.desc("mean_intensity"), "interval_id").limit(n)
