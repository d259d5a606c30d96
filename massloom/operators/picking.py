"""Peak picking and baseline of mean spectra, in ranges of the grid.

A spectrum is sparse rows (cell, mz, intensity) of a grid; a cell without a row has intensity 0. Each task
gets one range of cells and those within a halo of it, and answers for the range's own cells. Every value
of a cell is the same sum in the same order, however the grid is cut, so the result is free of the cuts.
Where a peak's bounds lie beyond the halo, its range is done again with a wider one.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.operators.ordered import numbered
from massloom.operators.storage import settled

#: Cells of a range, and of the halo on either side of it beyond what the filters reach; the halo's growth.
RANGE, HALO, WIDER = 65_536, 1024, 16


def savgol(width: int, order: int) -> list[float]:
    """Weights of Savitzky-Golay smoothing at the centre."""
    h = width // 2
    return np.linalg.pinv(np.vander(np.arange(-h, h + 1), order + 1, increasing=True))[0].tolist()


def smoothed(x: np.ndarray, width: int, order: int, first: bool, last: bool, highest: float) -> np.ndarray:
    """Savitzky-Golay smoothing, not below 0, in whole parts (1e-11) of the spectrum's highest intensity,
    so that rounding makes no peaks or valleys of equal values. At the spectrum's own ends (``first``, ``last``) half a
    width of cells takes the polynomial of the outermost width; at a cut they are left as they are."""
    h, out = width // 2, x.copy()
    inner = len(x) - 2 * h
    out[h : h + inner] = reduce(lambda s, kc: s + kc[1] * x[kc[0] : kc[0] + inner], enumerate(savgol(width, order)), np.zeros(inner))
    at = np.arange(width)
    if first:
        out[:h] = np.polyval(np.polyfit(at, x[:width], order), at[:h])
    if last:
        out[len(x) - h :] = np.polyval(np.polyfit(at, x[-width:], order), at[width - h :])
    least = highest * 1e-11
    return np.maximum(np.rint(out / least) * least, 0.0) if least > 0 else np.zeros(len(x))


def tops(x: np.ndarray) -> np.ndarray:
    """Middles of the runs of equal values that are higher than both neighbours."""
    new = np.r_[0, np.nonzero(np.diff(x))[0] + 1]
    v, end = x[new], np.r_[new[1:], len(x)] - 1
    k = np.nonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]))[0] + 1
    return (new[k] + end[k]) // 2


def crossing(s: np.ndarray, at: int, height: float, way: int) -> tuple[float, bool]:
    """Where s falls below a height, going one way from a peak, between cells; and whether it does. If not,
    the line through the last two cells tells where, or the last one does if it isn't the lower."""
    side = s[at + way :: way]
    under = side < height
    found = bool(under.any())
    here = at + way * ((int(np.argmax(under)) if found else len(side) - 1) + 1)
    if s[here] >= s[here - way]:
        return float(here), found
    return here - way * (height - s[here]) / (s[here - way] - s[here]), found


def _in_ranges(spectrum: DataFrame, keys: tuple[str, ...], halo: int, width: int, todo: DataFrame | None = None) -> DataFrame:
    """The rows with their spectrum's first and last cell and the range (_r) that they serve: one of their
    own, and others whose halo they are in."""
    ends = [F.min("cell").alias("_first"), F.max("cell").alias("_last"), F.min_by("mz", "cell").alias("_mz0"), F.max_by("mz", "cell").alias("_mz1"), F.max("intensity").cast("double").alias("_high")]
    rows = spectrum.select(*keys, "cell", F.col("intensity").cast("double").alias("intensity"))
    rows = rows.join(spectrum.groupBy(*keys).agg(*ends), list(keys)) if keys else rows.crossJoin(F.broadcast(spectrum.agg(*ends)))
    r = F.sequence(F.floor((F.greatest(F.col("cell") - halo, F.col("_first"))) / width), F.floor(F.least(F.col("cell") + halo, F.col("_last")) / width))
    rows = rows.withColumn("_r", F.explode(r))
    return rows if todo is None else rows.join(todo, [*keys, "_r"], "left_semi")


def _dense(pdf: pd.DataFrame, halo: int, width: int) -> tuple[np.ndarray, int, int, int, bool, bool]:
    """Intensities of all cells of a range and its halo; the first cell; the own cells' positions from
    and to; and whether the spectrum begins and ends here."""
    first, last, r = int(pdf["_first"].iloc[0]), int(pdf["_last"].iloc[0]), int(pdf["_r"].iloc[0])
    a, b = max(first, r * width - halo), min(last, (r + 1) * width - 1 + halo)
    x = np.zeros(b - a + 1)
    np.add.at(x, pdf["cell"].to_numpy() - a, pdf["intensity"].to_numpy())
    return x, a, max(first, r * width) - a, min(last, (r + 1) * width - 1) - a + 1, a == first, b == last


def without_baseline(spectrum: DataFrame, half: int, keys: tuple[str, ...] = (), width: int = RANGE) -> DataFrame:
    """Less the baseline, not below 0: the least intensity within ``half`` cells on either side,
    smoothed by a Gaussian of deviation ``half``, cut at four deviations and mirrored at the spectrum's
    ends. Rows (keys, cell, mz, intensity); cells that nothing is left of have none."""
    radius = 4 * half
    halo = half + radius
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / half) ** 2)
    weights /= weights.sum()

    def less(pdf: pd.DataFrame) -> pd.DataFrame:
        x, a, lo, hi, first, last = _dense(pdf, halo, width)
        least = pd.Series(x).rolling(2 * half + 1, center=True, min_periods=1).min().to_numpy()
        padded = np.pad(least, (radius if first else 0, radius if last else 0), "symmetric")
        start = lo if first else lo - radius
        base = np.zeros(hi - lo)
        for k, c in enumerate(weights):
            base += c * padded[start + k : start + k + hi - lo]
        own = np.maximum(x[lo:hi] - base, 0.0)
        at = np.nonzero(own)[0]
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame({**{k: [v] * len(at) for k, v in head.items()}, "cell": at + a + lo, "_v": own[at]})

    kinds = "".join(f"`{k}` {spectrum.schema[k].dataType.simpleString()}, " for k in keys)
    rest = _in_ranges(spectrum, keys, halo, width).groupBy(*keys, "_r").applyInPandas(less, f"{kinds}cell long, _v double")
    return spectrum.select(*keys, "cell", "mz").join(rest, [*keys, "cell"]).withColumnRenamed("_v", "intensity")


def pick_peaks(
    spectrum: DataFrame, prominence: float = 0.01, width: int = 7, order: int = 2, least_ppm: float = 2.0, keys: tuple[str, ...] = (), local_cells: int = 0, picking_height: float = 0.75, edge_ppm: float = 10.0, cells: int = RANGE, halo: int = HALO
) -> DataFrame:
    """Intervals of spectra, one per key: (keys, interval_id, mz_lo, mz_hi, mz_apex, apex_intensity).

    Peaks are local maxima of the smoothed spectrum, at or above ``prominence`` times its highest value,
    or, with ``local_cells``, the highest within that many cells on either side. Bounds are the nearest
    local minima (of a level stretch, its middle); where there is none before the spectrum's end,
    ``edge_ppm`` from the apex, or the end. The apex is the peak's cell, or, with ``picking_height``, the
    middle between the places where the spectrum falls below that part of the peak. Intervals narrower
    than ``least_ppm`` are widened to it about the apex. Keys have no nulls. Spectra of fewer cells than ``width``, or
    without any positive value, have none.
    """
    h = width // 2
    kinds = "".join(f"`{k}` {spectrum.schema[k].dataType.simpleString()}, " for k in keys)
    names = [*keys, "_r", "_open", "cell", "mz_lo", "mz_hi", "mz_apex", "apex_intensity", "_local"]

    def pick(around: int):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame(columns=names)
            x, a, lo, hi, first, last = _dense(pdf, around, cells)
            if len(x) < width:
                return none
            mz0, start = float(pdf["_mz0"].iloc[0]), int(pdf["_first"].iloc[0])
            step = (float(pdf["_mz1"].iloc[0]) - mz0) / (int(pdf["_last"].iloc[0]) - start)
            s = smoothed(x, width, order, first, last, float(pdf["_high"].iloc[0]))
            # what a cut has left unsmoothed goes
            left, right = 0 if first else h, 0 if last else h
            s, a, lo, hi = s[left : len(s) - right], a + left, lo - left, hi - left
            own = tops(s)
            valleys, own = tops(-s), own[(own >= lo) & (own < hi)]
            top = pd.Series(s).rolling(2 * local_cells + 1, center=True, min_periods=1).max().to_numpy() if local_cells else np.zeros(len(s))
            # a level stretch from a cut into the range may be a peak that the cut hides
            level = np.nonzero(np.diff(s))[0]
            hidden = s.max() > 0 and ((not first and (not len(level) or level[0] >= lo) and s[0] > 0) or (not last and (not len(level) or level[-1] + 1 < hi) and s[-1] > 0))
            out, is_open = [], bool(hidden)
            mz = lambda k: mz0 + (a + k - start) * step
            place = lambda v: round((v - mz0) / step + start - a, 9)
            for k in own.tolist():
                apex, sure = float(k), True
                if picking_height > 0:
                    (p, at_p), (q, at_q) = (crossing(s, k, picking_height * s[k], way) for way in (-1, 1))
                    apex, sure = (p + q) / 2, (at_p or first) and (at_q or last)
                n = int(np.searchsorted(valleys, k))
                edge = mz(apex) * edge_ppm * 1e-6
                below, above = n > 0, n < len(valleys)
                is_open = is_open or not (sure and (below or first) and (above or last))
                p = mz(int(valleys[n - 1])) if below else mz(max(0, math.ceil(place(mz(apex) - edge))))
                q = mz(int(valleys[n])) if above else mz(min(len(s) - 1, math.floor(place(mz(apex) + edge))))
                if (q - p) / mz(apex) * 1e6 < least_ppm:
                    p, q = mz(apex) * (1 - least_ppm * 0.5e-6), mz(apex) * (1 + least_ppm * 0.5e-6)
                out.append((a + k, p, q, mz(apex), s[k], top[k]))
            if not out and not is_open:
                return none
            # an open range gives one row, which asks for a wider halo
            out = [(a + lo, 0.0, 0.0, 0.0, 0.0, 0.0)] if is_open else out
            same = [*(pdf[k].iloc[0] for k in keys), pdf["_r"].iloc[0], is_open]
            return pd.DataFrame([(*same, *o) for o in out], columns=names)

        return one

    around, todo, done = max(halo, h + local_cells + 1) + h, None, None
    schema = f"{kinds}_r long, _open boolean, cell long, mz_lo double, mz_hi double, mz_apex double, apex_intensity double, _local double"
    spectrum = settled(spectrum.select(*keys, "cell", "mz", "intensity"))
    while True:
        found = settled(_in_ranges(spectrum, keys, around, cells, todo).groupBy(*keys, "_r").applyInPandas(pick(around), schema))
        closed = found.where("not _open")
        done = closed if done is None else done.unionByName(closed)
        todo = found.where("_open").select(*keys, "_r")
        if todo.isEmpty():
            break
        around *= WIDER
    if local_cells:
        kept = done.where(F.col("apex_intensity") >= F.lit(prominence) * F.col("_local"))
    else:
        highest = done.groupBy(*keys).agg(F.max("apex_intensity").alias("_top"))
        kept = (done.join(highest, list(keys)) if keys else done.crossJoin(F.broadcast(highest))).where(F.col("apex_intensity") >= F.lit(prominence) * F.col("_top"))
    columns = ["cell", "mz_lo", "mz_hi", "mz_apex", "apex_intensity"]
    kept = kept.where("apex_intensity > 0").select(*keys, *columns)
    if keys:
        kept = kept.withColumn("interval_id", F.row_number().over(W.partitionBy(*keys).orderBy("cell")))
    else:
        kept = numbered(kept, "cell", "interval_id").withColumn("interval_id", F.col("interval_id") + 1)
    return kept.select(*keys, F.col("interval_id").cast("int").alias("interval_id"), *columns[1:])
