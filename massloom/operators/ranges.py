"""Range joins without cross products: bucketed equi-joins with a residual filter.

Spark plans a bare range condition as a nested loop or a Cartesian product. Here the right
side gets one bucket of the logarithm (for parts per million) or of the value (for absolute
tolerances), twice as wide as a window, the left side the one or two buckets that its window reaches
(one and a half on average), and the join is a hash or sort-merge join on the bucket. Bounds are inclusive. Skewed buckets are split by adaptive
execution, or dealt out further with ``salts``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.operators.storage import settled

#: Up to this many rows of places, which mass range and tolerance bound, are broadcast.
FEW_PLACES = 500_000


def _log_bucket(c: Column, width: float) -> Column:
    return F.floor(F.log(c) / F.lit(width)).cast("long")


def range_join(left: DataFrame, right: DataFrame, lcol: str, rcol: str, ppm: float | None = None, tol: float | None = None, salts: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Inner join of rows with |r - l| <= l * ppm / 1e6, or <= tol, and equal ``by`` columns. Other column names must not clash, nor be _b or _salt."""
    l, r = F.col(lcol), F.col(rcol)
    if ppm is not None:
        width = math.log1p(4 * ppm * 1e-6)
        # a little beyond the window, since logarithms are rounded
        share = ppm * 1e-6 * (1 + 1e-6) + 1e-14
        bucket = lambda c: _log_bucket(c, width)
        first, last = bucket(l * F.lit(max(1 - share, 1e-6))), bucket(l * F.lit(1 + share))
        left, right = left.where(l > 0), right.where(r > 0)
        near = F.abs(r - l) <= l * F.lit(ppm) / F.lit(1e6)
    else:
        bucket = lambda c: F.floor(c / F.lit(4 * tol)).cast("long")
        beyond = F.lit(tol * (1 + 1e-6)) + F.abs(l) * F.lit(1e-14)
        first, last = bucket(l - beyond), bucket(l + beyond)
        near = F.abs(r - l) <= F.lit(tol)
    reach = left.where(l.isNotNull()).withColumn("_b", F.explode(F.sequence(first, last)))
    held = right.where(r.isNotNull()).withColumn("_b", bucket(r))
    on = ["_b", *by]
    if salts > 1:
        reach = reach.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        held = held.withColumn("_salt", F.pmod(F.xxhash64(r), F.lit(salts)).cast("int"))
        on.append("_salt")
    return reach.join(held, on).where(near).drop("_b", "_salt")


def range_semi(left: DataFrame, right: DataFrame, lcol: str, rcol: str, key: list[str], **tolerance) -> DataFrame:
    hit = range_join(left.select(*dict.fromkeys([*key, lcol])), right.select(rcol).distinct(), lcol, rcol, **tolerance).select(*key).distinct()
    return left.join(hit, key, "left_semi")


def range_anti(left: DataFrame, right: DataFrame, lcol: str, rcol: str, key: list[str], **tolerance) -> DataFrame:
    """Rows of ``left``, whose ``key`` names them, with nothing of ``right`` in reach."""
    hit = range_join(left.select(*dict.fromkeys([*key, lcol])), right.select(rcol).distinct(), lcol, rcol, **tolerance).select(*key).distinct()
    return left.join(hit, key, "left_anti")


def by_places(left: DataFrame, places: DataFrame, lcol: str, rcol: str, ppm: float, how: str, larger: bool = False) -> DataFrame:
    """Rows of ``left`` with (``how`` left_semi) or without (left_anti) a place within ppm of the place, or of the
    ``larger`` value: no row is copied, and no pairs are made. An inner join adds each such place as _place, and what else is known of it."""
    width, share = math.log1p(4 * ppm * 1e-6), ppm * 1e-6 * (1 + (4e-6 * ppm if larger else 1e-6)) + 1e-14
    r, l = F.col("_place"), F.col(lcol)
    reach = places.where(F.col(rcol) > 0).withColumnRenamed(rcol, "_place")
    reach = reach.withColumn("_at", F.explode(F.sequence(_log_bucket(r * F.lit(max(1 - share, 1e-6)), width), _log_bucket(r * F.lit(1 + share), width))))
    near = F.abs(l - r) <= (F.greatest(l, r) if larger else r) * F.lit(ppm) / F.lit(1e6)
    rows = left.withColumn("_b", F.when(l > 0, _log_bucket(l, width)))
    return rows.join(few(reach), (F.col("_b") == F.col("_at")) & near, how).drop("_b", "_at")


def cell_of(c: Column, ppm: float) -> Column:
    """Number of a cell half as wide as ppm: any two of its values lie within ppm of each other."""
    return _log_bucket(c, math.log1p(ppm * 5e-7))


def ends_of_cells(references: DataFrame, rcol: str, ppm: float) -> DataFrame:
    """(rcol): of the references in each cell half as wide as ppm the least and the largest. Whatever has any
    reference within ppm has one of these: in its own cell all are, and of other cells the nearest is an end."""
    r = F.col(rcol)
    ends = references.where(r > 0).groupBy(cell_of(r, ppm).alias("_c")).agg(F.min(r).alias("lo"), F.max(r).alias("hi"))
    return ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias(rcol))


def few(places: DataFrame) -> DataFrame:
    """Stored places, marked for broadcast if a count finds them few."""
    return F.broadcast(places) if places.limit(FEW_PLACES + 1).count() <= FEW_PLACES else places


def reference_anti(left: DataFrame, references: DataFrame, lcol: str, rcol: str, ppm: float) -> DataFrame:
    """Contamination filter: drops rows within ppm, relative to the reference, of any reference."""
    return by_places(left, settled(ends_of_cells(references, rcol, ppm)), lcol, rcol, ppm, "left_anti")


def in_ranges(of: DataFrame, others: DataFrame, ocol: str, schema: str, ppm: float, judge: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``judge`` of the rows of each range of values, 250 times as wide as ppm, and of all others that these may reach."""
    width, share = math.log1p(250 * ppm * 1e-6), ppm * 1e-6 * (1 + 4e-6 * ppm) + 1e-14
    o, v = F.col(ocol), F.col(of.columns[0])
    reach = others.where(o > 0).withColumn("_b", F.explode(F.sequence(_log_bucket(o * F.lit(max(1 - share, 1e-6)), width), _log_bucket(o * F.lit(1 + share), width))))
    return of.where(v > 0).withColumn("_b", _log_bucket(v, width)).groupBy("_b").cogroup(reach.groupBy("_b")).applyInArrow(judge, schema)


def sorted_by(rows: pa.Table, by: str, *more: str) -> tuple[np.ndarray, ...]:
    held = [rows.column(c).to_numpy() for c in (by, *more)]
    order = np.argsort(held[0], kind="stable")
    return tuple(x[order] for x in held)


def nearest_feature(features: DataFrame, masses: DataFrame, mz: str, number: str, mass: str, ppm: float) -> DataFrame:
    """(mass, mz, number): for each distinct mass, of the features that ``range_join`` by ppm would match with it,
    the nearest, then that of least number. Distinct values meet in sorted ranges, not as pairs."""

    def judge(own: pa.Table, found: pa.Table) -> pa.Table:
        r = own.column(mass).to_numpy()
        l, k = sorted_by(found, mz, number)
        if not len(l) or not len(r):
            return pa.table({mass: pa.array([], pa.float64()), mz: pa.array([], pa.float64()), number: pa.array([], pa.int64())})
        at = np.searchsorted(l, r)
        sides = []
        for there, side in ((at > 0, np.maximum(at - 1, 0)), (at < len(l), np.minimum(at, len(l) - 1))):
            fits = there & (np.abs(r - l[side]) <= l[side] * ppm / 1e6)
            sides.append((side, np.where(fits, np.abs((l[side] - r) / r * 1e6), np.inf)))
        (a, ea), (b, eb) = sides
        best = np.where((eb < ea) | ((eb == ea) & (k[b] < k[a])), b, a)
        fits = np.minimum(ea, eb) < np.inf
        return pa.table({mass: r[fits], mz: l[best[fits]], number: k[best[fits]].astype(np.int64)})

    distinct = features.groupBy(mz).agg(F.min(number).cast("long").alias(number))
    return in_ranges(masses.select(mass).distinct(), distinct, mz, f"{mass} double, {mz} double, {number} long", ppm, judge)


def between(places: DataFrame, values: DataFrame, pcol: str, vcol: str, ppm: float) -> DataFrame:
    """(pcol, below, above): of each distinct place the next lesser and the next larger value, if within ppm of it; NULL or any else."""

    def judge(own: pa.Table, found: pa.Table) -> pa.Table:
        r, (l,) = own.column(pcol).to_numpy(), sorted_by(found, vcol)
        at, upto = np.searchsorted(l, r), np.searchsorted(l, r, "right")
        sides = (at > 0, at - 1), (upto < len(l), upto)
        ends = (pa.array([float(l[k]) if t else None for t, k in zip(there, side, strict=True)], pa.float64()) for there, side in sides)
        return pa.table([own.column(pcol), *ends], names=[pcol, "below", "above"])

    return in_ranges(places.select(pcol).distinct(), values.select(vcol).distinct(), vcol, f"{pcol} double, below double, above double", ppm, judge)


def nearest_mass(features: DataFrame, masses: DataFrame, mz: str, mass: str, n: str, ppm: float) -> DataFrame:
    """(mz, mass, n): for each distinct m/z, of the masses that ``range_join`` by ppm would match with it, the nearest,
    relative to the mass, or two equally near; and how many there are in all, by the masses' numbers ``n``."""

    def judge(own: pa.Table, found: pa.Table) -> pa.Table:
        l = own.column(mz).to_numpy()
        r, count = sorted_by(found, mass, n)
        if not len(l) or not len(r):
            return pa.table({mz: pa.array([], pa.float64()), mass: pa.array([], pa.float64()), n: pa.array([], pa.int64())})
        upto = np.concatenate([[0], np.cumsum(count)])
        reach = l * ppm / 1e6
        fits = lambda k: (k >= 0) & (k < len(r)) & (np.abs(r[np.clip(k, 0, len(r) - 1)] - l) <= reach)
        at = np.searchsorted(r, l)
        lo, hi = np.searchsorted(r, l - reach), np.searchsorted(r, l + reach, "right")
        # rounded bounds may be off by a value or a few
        lo, hi = np.minimum(lo, at), np.maximum(hi, at)
        while (step := fits(lo - 1)).any():
            lo = lo - step
        while (step := (lo < at) & ~fits(lo)).any():
            lo = lo + step
        while (step := fits(hi)).any():
            hi = hi + step
        while (step := (hi > at) & ~fits(hi - 1)).any():
            hi = hi - step
        error = lambda k, there: np.where(there, np.abs((l - r[np.clip(k, 0, len(r) - 1)]) / r[np.clip(k, 0, len(r) - 1)] * 1e6), np.inf)
        below, above = error(at - 1, lo < at), error(at, hi > at)
        first, second = (below <= above) & (lo < at), (above <= below) & (hi > at)
        rows = np.concatenate([np.flatnonzero(first), np.flatnonzero(second)])
        best = np.concatenate([at[first] - 1, at[second]])
        return pa.table({mz: l[rows], mass: r[best], n: (upto[hi] - upto[lo])[rows].astype(np.int64)})

    return in_ranges(features.select(mz).distinct(), masses.select(mass, n), mass, f"{mz} double, {mass} double, {n} long", ppm, judge)


def nearest(left: DataFrame, right: DataFrame, lcol: str, rcol: str, key: list[str], prefer: str = "lower", payload: list[str] | None = None, **tolerance) -> DataFrame:
    """For each left key, the nearest right value in reach: key, lcol, nearest, distance, payload. Ties by value. Only distinct values meet."""
    more = payload or []
    others = right.groupBy(rcol).agg(F.min(F.struct(*more)).alias("_p")) if more else right.select(rcol).distinct()
    pairs = range_join(left.select(lcol).distinct(), others, lcol, rcol, **tolerance)
    tie = F.col(rcol) if prefer == "lower" else -F.col(rcol)
    best = F.min(F.struct(F.abs(F.col(rcol) - F.col(lcol)).alias("d"), tie.alias("t"), *(F.col(f"_p.{p}").alias(p) for p in more)))
    out = pairs.groupBy(lcol).agg(best.alias("m"))
    value = F.col("m.t") if prefer == "lower" else -F.col("m.t")
    out = out.select(lcol, value.alias("nearest"), F.col("m.d").alias("distance"), *(F.col(f"m.{p}").alias(p) for p in more))
    return left.select(*key, lcol).distinct().join(out, lcol).select(*key, lcol, "nearest", "distance", *more)


def nearest_of_all(left: DataFrame, right: DataFrame, lcol: str, rcol: str, key: list[str], rkey: str, buckets: int = 64) -> DataFrame:
    """(key, rkey) of the nearest right row, however far; ties to the lower value, then the lesser rkey.

    Both sides fall into the same value ranges. Within a range, windows give the values before
    and after; across ranges, a small table of their ends does.
    """
    right = right.where(F.col(rcol).isNotNull()).groupBy(F.col(rcol).alias("_v")).agg(F.min(rkey).alias("_k"))
    edges = sorted(set(right.approxQuantile("_v", [k / buckets for k in range(1, buckets)], 0.01)))
    g = F.lit(0)
    for e in edges:
        g = g + F.when(F.col("_v") >= e, 1).otherwise(0)
    right = right.withColumn("_g", g)
    here = F.struct(F.col("_v").alias("v"), F.col("_k").alias("k"))
    both = left.select(*key, F.col(lcol).alias("_v"), F.lit(None).cast(right.schema["_k"].dataType).alias("_k")).withColumn("_g", g)
    both = both.unionByName(right, allowMissingColumns=True).withColumn("_here", F.when(F.col("_k").isNotNull(), here))
    of, ends = W.partitionBy("_g"), W.orderBy("_g")
    # at equal values the right rows come first in both directions
    first = F.col("_k").isNull()
    up = of.orderBy("_v", first).rowsBetween(W.unboundedPreceding, 0)
    down = of.orderBy(F.desc("_v"), first).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_lo", F.last("_here", ignorenulls=True).over(up)).withColumn("_hi", F.last("_here", ignorenulls=True).over(down))
    table = right.groupBy("_g").agg(F.max(here).alias("_max"), F.min(here).alias("_min"))
    every = left.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("_g")).join(table, "_g", "left")
    every = every.select("_g", F.last("_max", ignorenulls=True).over(ends.rowsBetween(W.unboundedPreceding, -1)).alias("_below"), F.first("_min", ignorenulls=True).over(ends.rowsBetween(1, W.unboundedFollowing)).alias("_above"))
    rows = both.where(F.col("_k").isNull()).join(F.broadcast(every), "_g").withColumn("_lo", F.coalesce("_lo", "_below")).withColumn("_hi", F.coalesce("_hi", "_above"))
    up_near = F.col("_hi").isNotNull() & (F.col("_lo").isNull() | (F.col("_hi.v") - F.col("_v") < F.col("_v") - F.col("_lo.v")))
    return rows.select(*key, F.when(up_near, F.col("_hi.k")).otherwise(F.col("_lo.k")).alias(rkey)).where(F.col(rkey).isNotNull())


def band_or_nearest(left: DataFrame, right: DataFrame, lcol: str, rcol: str, key: list[str], rkey: str, tol: float) -> DataFrame:
    """(key, rkey) of all right rows within tol; for a left row without any, the nearest right row."""
    band = range_join(left.select(*key, lcol), right.select(rkey, rcol), lcol, rcol, tol=tol).select(*key, rkey)
    rest = left.select(*key, lcol).join(band.select(*key).distinct(), key, "left_anti")
    return band.unionByName(nearest_of_all(rest, right, lcol, rcol, key, rkey))
