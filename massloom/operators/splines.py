"""Smoothing by a penalised cubic B-spline, fitted from sums.

Knots are evenly spaced, so a row touches four neighbouring coefficients. The normal equations
are banded, and their entries are sums per knot interval: one grouped pass over the rows, of which
a row per interval reaches the driver. Second differences of the coefficients are penalised;
the weight of the penalty has the least generalised cross-validation error on a grid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weights(t: Column) -> list[Column]:
    """What a place t within its interval gives to its four coefficients."""
    t2, t3 = t * t, t * t * t
    return [(1 - 3 * t + 3 * t2 - t3) / 6, (4 - 6 * t2 + 3 * t3) / 6, (1 + 3 * t + 3 * t2 - 3 * t3) / 6, t3 / 6]


@dataclass
class Spline:
    low: float
    width: float
    coefficients: np.ndarray
    penalty: float

    def place(self, x: Column) -> tuple[Column, Column]:
        u = (x - F.lit(self.low)) / F.lit(self.width)
        cell = F.greatest(F.lit(0), F.least(F.lit(len(self.coefficients) - 4), F.floor(u).cast("int")))
        return cell, u - cell

    def column(self, x: Column) -> Column:
        """The smoothed value at x."""
        cell, t = self.place(x)
        of = F.array(*(F.lit(float(c)) for c in self.coefficients))
        out = F.lit(0.0)
        for k, w in enumerate(_weights(t)):
            out = out + w * F.get(of, cell + k)
        return out


def penalised(a: np.ndarray, b: np.ndarray, yy: float, n: int, penalties: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and penalty of least cross-validation error, from the sums of products a, of products with y, and of y squared."""
    d = np.diff(np.eye(len(a)), 2, axis=0)
    p = d.T @ d
    unit = np.trace(a) / np.trace(p)
    best = (np.inf, None, 0.0)
    for weight in penalties * unit:
        # a coefficient far from all rows hangs on the penalty alone; a trace of the unit matrix keeps the solve regular
        m = a + weight * p + 1e-12 * unit * np.eye(len(a))
        c = np.linalg.solve(m, b)
        free = n - np.trace(np.linalg.solve(m, a))
        if free > 1e-9:
            error = n * max(yy - 2 * c @ b + c @ a @ c, 0.0) / free**2
            best = min(best, (error, c, weight), key=lambda e: e[0])
    return best[1], best[2]


def fit_spline(df: DataFrame, x: str, y: str, segments: int = 64, penalties: np.ndarray | None = None) -> Spline | None:
    """The smoothing spline of y over x; None for fewer than five rows or two places. NULLs are left out."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if n < 5 or low == high:
        return None
    empty = Spline(low, (high - low) / segments, np.zeros(segments + 3), 0.0)
    cell, t = empty.place(F.col("x"))
    rows = rows.select(cell.alias("cell"), t.alias("t"), "y")
    w = _weights(F.col("t"))
    products = [F.sum(w[i] * w[j]).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)]
    sums = rows.groupBy("cell").agg(*products, *(F.sum(w[i] * F.col("y")).alias(f"b{i}") for i in range(4)), F.sum(F.col("y") * F.col("y")).alias("yy")).collect()
    a, b = np.zeros((segments + 3, segments + 3)), np.zeros(segments + 3)
    for r in sums:
        for i in range(4):
            b[r["cell"] + i] += r[f"b{i}"]
            for j in range(i, 4):
                a[r["cell"] + i, r["cell"] + j] += r[f"a{i}{j}"]
                if i != j:
                    a[r["cell"] + j, r["cell"] + i] += r[f"a{i}{j}"]
    grid = 10.0 ** np.arange(-6, 6.1, 0.25) if penalties is None else penalties
    c, weight = penalised(a, b, sum(r["yy"] for r in sums), n, grid)
    return None if c is None else Spline(low, empty.width, c, weight)
