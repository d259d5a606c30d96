"""Ranks, winners and cumulative error rates.

Cumulative values over all rows are taken in score ranges: each range is a window of its own,
and the ranges' totals, few rows, shift them. So no window puts all rows into one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.operators.storage import settled


def with_group_ranks(df: DataFrame, group: str, value: str, descending: bool = False, rank: str = "rank", ratio: str = "best_ratio", floor: float = 1e-6) -> DataFrame:
    """Rank with gaps within the group, and the group's best value over this one (or the reverse for descending)."""
    v = F.col(value)
    w = W.partitionBy(group)
    best = F.max(v).over(w) if descending else F.min(v).over(w)
    share = v / F.greatest(best, F.lit(1.0)) if descending else v / F.greatest(best, F.lit(floor))
    return df.withColumn(rank, F.rank().over(w.orderBy(v.desc() if descending else v.asc()))).withColumn(ratio, share)


def with_group_zscore(df: DataFrame, group: str, value: str, out: str, rank: str | None = None) -> DataFrame:
    """Sample z-score within the group, 0 for fewer than two rows or no spread; rank ascending, NULL for NULL."""
    w = W.partitionBy(group)
    sd, n = F.stddev_samp(value).over(w), F.count(value).over(w)
    df = df.withColumn(out, F.when(F.col(value).isNotNull(), F.when((n >= 2) & (sd >= 1e-12), (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)))
    return df.withColumn(rank, F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(F.col(value).asc_nulls_last())))) if rank else df


def winners(df: DataFrame, group: str, score: str, ties: list[str], drop_share: float = 0.02) -> DataFrame:
    """The best row of each group; then winners below the ``drop_share`` quantile of winner scores go."""
    w = W.partitionBy(group).orderBy(F.col(score).desc(), *ties)
    best = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if drop_share <= 0:
        return best
    best = settled(best)
    edge = quantiles(best, score, [drop_share])[0]
    return best if edge is None else best.where(F.col(score) >= F.lit(edge))


def _with_range(df: DataFrame, score: str, ranges: int) -> DataFrame:
    """Adds _g: equal scores share a range; range 0 holds the highest scores."""
    edges = sorted(set(df.approxQuantile(score, [k / ranges for k in range(1, ranges)], 0.001))) if ranges > 1 else []
    g = F.lit(0)
    for e in edges:
        g = g + F.when(F.col(score) < e, 1).otherwise(0)
    return df.withColumn("_g", g)


def numbered(df: DataFrame, value: str, out: str, ranges: int = 32, ties: tuple[str, ...] = (), hold: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """Adds the place of each row, from 0, in ascending order of a distinct value (or of a value and ``ties``), without a window over all rows."""
    rows = _with_range(hold(df).withColumn("_v", -F.col(value)), "_v", ranges)
    sums = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("_g", F.coalesce(F.sum("n").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_pn"))
    place = F.row_number().over(W.partitionBy("_g").orderBy(value, *ties)) - 1 + F.col("_pn")
    return rows.join(F.broadcast(sums), "_g").withColumn(out, place.cast("int")).drop("_v", "_g", "_pn")


def tdc_q_values(df: DataFrame, score: str, decoy: Column, ties: list[str], pi0: float = 1.0, out: str = "q_value", ranges: int = 32) -> DataFrame:
    """Target-decoy q-values: (decoys so far + 1) / max(targets so far, 1) * pi0, made monotone from the end, within 0 and 1."""
    rows = _with_range(df.withColumn("_d", decoy.cast("long")), score, ranges)
    order = [F.col(score).desc(), *ties]
    w = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_g").agg(F.sum("_d").alias("d"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("_g", F.coalesce(F.sum("d").over(ahead), F.lit(0)).alias("_pd"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_pn"))
    rows = rows.join(F.broadcast(sums), "_g")
    decoys = F.sum("_d").over(w) + F.col("_pd")
    count = F.count(F.lit(1)).over(w) + F.col("_pn")
    rows = rows.withColumn("_cd", decoys).withColumn("_ct", count - F.col("_cd")).withColumn("_f", (F.col("_cd") + 1) / F.greatest(F.col("_ct"), F.lit(1)) * F.lit(pi0))
    later = W.orderBy("_g").rowsBetween(1, W.unboundedFollowing)
    mins = rows.groupBy("_g").agg(F.min("_f").alias("m")).select("_g", F.min("m").over(later).alias("_later"))
    # read backwards: a frame that begins at the start is linear, one that reaches the end is not
    back = W.partitionBy("_g").orderBy(F.col(score).asc(), *(F.col(t).desc() for t in ties)).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.min("_f").over(back), F.col("_later"))
    return rows.join(F.broadcast(mins), "_g").withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))).drop("_g", "_d", "_pd", "_pn", "_cd", "_ct", "_f", "_later")


def cumulative_mean(df: DataFrame, value: str, ties: list[str], out: str, ranges: int = 32) -> DataFrame:
    """Mean of this and all smaller values, in ascending order (q-values from error probabilities)."""
    rows = _with_range(df.withColumn("_v", -F.col(value)), "_v", ranges)
    w = W.partitionBy("_g").orderBy(value, *ties).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_g").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("_g", F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("_ps"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_pn"))
    mean = (F.sum(value).over(w) + F.col("_ps")) / (F.count(F.lit(1)).over(w) + F.col("_pn"))
    return rows.join(F.broadcast(sums), "_g").withColumn(out, mean).drop("_v", "_g", "_ps", "_pn")


def storey_pi0(df: DataFrame, score: str, decoy: Column, points: int = 20) -> DataFrame:
    """One row, pi0: the least ratio of targets to decoys below any of the pooled quantiles from 5 to 95 %, at most 1."""
    lam = [0.05 + 0.9 * k / (points - 1) for k in range(points)]
    edges = df.agg(F.percentile(score, F.array(*map(F.lit, lam))).alias("e")).select(F.explode("e").alias("edge"))
    counts = df.crossJoin(F.broadcast(edges)).groupBy("edge").agg(F.avg(F.when(~decoy, (F.col(score) <= F.col("edge")).cast("double"))).alias("t"), F.avg(F.when(decoy, (F.col(score) <= F.col("edge")).cast("double"))).alias("d"))
    return counts.agg(F.least(F.lit(1.0), F.coalesce(F.min(F.when(F.col("d") > 0, F.col("t") / F.col("d"))), F.lit(1.0))).alias("pi0"))


def gaussian_pep(df: DataFrame, score: str, decoy: Column, out: str = "pep") -> DataFrame:
    """Posterior error of a two-normal mixture: decoys, and targets above the target median; NULL if either has fewer than 2."""
    s = F.col(score)
    median = df.agg(F.percentile(F.when(~decoy, s), F.lit(0.5)).alias("_med"))
    joined = df.crossJoin(F.broadcast(median))
    high = ~decoy & (s > F.col("_med"))
    stats = joined.agg(F.avg(F.when(decoy, s)).alias("_m0"), F.stddev_pop(F.when(decoy, s)).alias("_s0"), F.avg(F.when(high, s)).alias("_m1"), F.stddev_pop(F.when(high, s)).alias("_s1"), F.avg(decoy.cast("double")).alias("_pi"), F.count(F.when(decoy, 1)).alias("_n0"), F.count(F.when(high, 1)).alias("_n1"))
    pdf = lambda m, sd: F.exp(-F.pow((s - F.col(m)) / F.greatest(F.col(sd), F.lit(1e-9)), 2) / 2) / F.greatest(F.col(sd), F.lit(1e-9))
    f0, f1 = F.col("_pi") * pdf("_m0", "_s0"), (F.lit(1.0) - F.col("_pi")) * pdf("_m1", "_s1")
    pep = F.when((F.col("_n0") >= 2) & (F.col("_n1") >= 2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(f0, f0 + f1))))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, pep).drop("_m0", "_s0", "_m1", "_s1", "_pi", "_n0", "_n1")


def quantiles(df: DataFrame, value: str, shares: list[float], bins: int = 4096, few: int = 4096) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours, NULL and NaN left out; None for no values.

    Each pass counts the values in so many equal bins of the range that holds the wanted place, until a
    range has few values or one: no task sorts or keeps all of them. ``df`` is read once per pass.
    """
    v = F.col(value).cast("double")
    df = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole["n"]:
        return [None] * len(shares)
    found: dict[int, float] = {}

    def search(rows: DataFrame, lo: float, hi: float, n: int, before: int, places: list[int]) -> None:
        if lo == hi or not places:
            found.update({k: lo for k in places})
        elif n <= few:
            held = sorted(r["v"] for r in rows.collect())
            found.update({k: held[k - before] for k in places})
        else:
            # halves first: a range of doubles may be wider than any double
            bin_ = F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * bins), F.lit(bins - 1)).cast("int")
            counts = rows.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for r in sorted(counts, key=lambda r: r["b"]):
                here = [k for k in places if before <= k < before + r["n"]]
                if here:
                    search(rows.where(bin_ == r["b"]), r["lo"], r["hi"], r["n"], before, here)
                before += r["n"]

    at = [q * (whole["n"] - 1) for q in shares]
    search(df, whole["lo"], whole["hi"], whole["n"], 0, sorted({k for a in at for k in (math.floor(a), math.ceil(a))}))
    return [found[math.floor(a)] + (found[math.ceil(a)] - found[math.floor(a)]) * (a - math.floor(a)) if math.floor(a) != math.ceil(a) else found[math.floor(a)] for a in at]


def _numbers(batch: pa.RecordBatch, j: int) -> np.ndarray:
    v = batch.column(j).drop_null().to_numpy(zero_copy_only=False)
    return v[~np.isnan(v)]


def column_ends(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, least and largest value of each column, all of doubles; NULL and NaN left out (then 0, inf, -inf)."""
    width = len(rows.columns)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = np.zeros(width, np.int64), np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            for j in range(width):
                v = _numbers(batch, j)
                if len(v):
                    n[j], lo[j], hi[j] = n[j] + len(v), min(lo[j], v.min()), max(hi[j], v.max())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(n), pa.array(lo), pa.array(hi)], names=["j", "n", "lo", "hi"])

    n, lo, hi = np.zeros(width, np.int64), np.full(width, np.inf), np.full(width, -np.inf)
    for r in rows.mapInArrow(ends, "j int, n long, lo double, hi double").groupBy("j").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        n[r["j"]], lo[r["j"]], hi[r["j"]] = r["n"], r["lo"], r["hi"]
    return n, lo, hi


def column_spread(rows: DataFrame, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column of doubles, NULL and NaN taken as its ``fill``."""
    width = len(rows.columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            n += len(batch)
            for j in range(width):
                v = _numbers(batch, j) - fill[j]
                s[j] += v.sum()
                q[j] += (v * v).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(s), pa.array(q)], names=["j", "n", "s", "q"])

    mean, deviation = np.array(fill, float), np.zeros(width)
    for r in rows.mapInArrow(sums, "j int, n long, s double, q double").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        if r["n"]:
            mean[r["j"]] += r["s"] / r["n"]
            deviation[r["j"]] = math.sqrt(max(0.0, r["q"] / r["n"] - (r["s"] / r["n"]) ** 2))
    return mean, deviation


def column_quantiles(df: DataFrame, columns: list[str], share: float, bins: int = 8192, few: int = 65_536) -> dict[str, float | None]:
    """One exact quantile of each of many columns, as ``quantiles`` has it, in three passes over all of them.

    The first takes ends and numbers, the second counts values in bins that are equal after an inverse
    hyperbolic sine, the third fetches the values of the one or two bins that hold the wanted places; a
    column where these are many is searched on its own.
    """
    df = df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    number, least, most = column_ends(df)
    live = [k for k in range(len(columns)) if number[k] and least[k] < most[k]]
    out: dict[str, float | None] = {c: float(least[k]) if number[k] else None for k, c in enumerate(columns)}
    if not live:
        return out
    low = {k: math.asinh(least[k]) for k in live}
    scale = {k: bins / (math.asinh(most[k]) - low[k]) if math.asinh(most[k]) > low[k] else 0.0 for k in live}

    def placed(values: np.ndarray, k: int) -> np.ndarray:
        return np.minimum((np.arcsinh(values) - low[k]) * scale[k], bins - 1).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(live), bins), np.int64)
        for batch in batches:
            for j, k in enumerate(live):
                held[j] += np.bincount(placed(_numbers(batch, j), k), minlength=bins)
        j, b = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(held[j, b])], names=["j", "b", "n"])

    rows = df.select(*(f"c{k}" for k in live))
    counted = rows.mapInArrow(count, "j int, b int, n long").groupBy("j", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(live), bins), np.int64)
    table[counted.column("j").to_numpy(), counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    upto = table.cumsum(axis=1)
    want, alone = {}, []
    for j, k in enumerate(live):
        at = share * (int(number[k]) - 1)
        first, last = (int(np.searchsorted(upto[j], place, "right")) for place in (math.floor(at), math.ceil(at)))
        if table[j, first] + table[j, last] > few:
            alone.append(k)
        else:
            want[j] = (first, last, at, int(upto[j, first] - table[j, first]))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, (first, last, _, _) in want.items():
                values = _numbers(batch, j)
                b = placed(values, live[j])
                v = values[(b == first) | (b == last)]
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), j, np.int32)), pa.array(v)], names=["j", "v"])

    found = rows.mapInArrow(fetch, "j int, v double").toArrow() if want else None
    for j, (first, last, at, before) in want.items():
        values = np.sort(found.column("v").to_numpy()[found.column("j").to_numpy() == j])
        a = values[math.floor(at) - before]
        # only values of the two bins are here: what lies between them is empty
        b = values[math.ceil(at) - before] if last == first else values[int(table[j, first])]
        out[columns[live[j]]] = float(a + (b - a) * (at - math.floor(at)))
    for k in alone:
        out[columns[k]] = quantiles(rows, f"c{k}", [share])[0]
    return out


def ranked(df: DataFrame, strata: list[str], order: str | Column, ties: list[str], out: str) -> DataFrame:
    """Adds the place of each row in its stratum, from 1, by an md5 (a column, or an expression, which then isn't moved but
    computed again) and the ties. A stratum may hold all rows: they are numbered by the md5's first digits, and these parts' sizes are summed up."""
    rows = df.withColumn("_part", F.substring(order, 1, 3))
    sizes = rows.groupBy(*strata, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*strata).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(c).alias(f"_of_{c}") for c in strata), F.col("_part").alias("_of_part"), before.alias("_before"))
    same = F.col("_part") == F.col("_of_part")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rows = rows.join(sizes, same).drop("_of_part", *(f"_of_{c}" for c in strata))
    if isinstance(order, Column):
        rows = rows.repartition(*strata, "_part")
    place = F.row_number().over(W.partitionBy(*strata, "_part").orderBy(order, *ties)) + F.col("_before")
    return rows.withColumn(out, place).drop("_part", "_before")


def _seeded(seed: str, key: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)))


def stratified_sample(df: DataFrame, strata: list[str], key: list[str], need: Column, seed: str = "42") -> DataFrame:
    """At most ``need`` rows of each stratum, in the order of a seeded md5 of the key; no filling across strata."""
    rows = ranked(df.withColumn("_md5", _seeded(seed, key)), strata, "_md5", key, "_r")
    return rows.where(F.col("_r") <= need).drop("_r", "_md5")


def sample_with_top_up(df: DataFrame, strata: list[str], key: list[str], need: Column, total: int, seed: str = "42") -> DataFrame:
    """As ``stratified_sample``; then, up to ``total`` rows in all, those left over, in the order of the same md5."""
    rows = ranked(df.withColumn("_md5", _seeded(seed, key)), strata, "_md5", key, "_r")
    rows = settled(rows.withColumn("_own", F.coalesce(F.col("_r") <= need, F.lit(False))).drop("_r"))
    short = total - rows.where("_own").count()
    if short <= 0:
        return rows.where("_own").drop("_own", "_md5")
    rest = ranked(rows.where("not _own"), ["_own"], "_md5", key, "_r").where(F.col("_r") <= short)
    return rows.where("_own").unionByName(rest.drop("_r")).drop("_own", "_md5")


def folds(df: DataFrame, strata: list[str], key: list[str], k: int = 3, seed: str = "42", out: str = "fold") -> DataFrame:
    """Stratified folds 0 to k - 1."""
    rows = ranked(df, strata, _seeded(seed, key), key, "_r")
    return rows.withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r")
