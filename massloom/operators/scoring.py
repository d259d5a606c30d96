"""Semi-supervised target/decoy scoring.

Discriminants need sums of products only, which one distributed pass gives; p by p solves
happen on the driver. Tree models and k-means are Spark ML's.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators.cuts import passing, targets_within
from massloom.operators.ordered import column_ends, column_quantiles, column_spread, folds, quantiles, tdc_q_values, winners
from massloom.operators.storage import settled, stored


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds x: the features as an array, NULL filled by the median, less mean over population deviation; constants 0."""
    medians = column_quantiles(df, features, 0.5)
    fill = np.array([float(medians[f] or 0.0) for f in features])
    mean, deviation = column_spread(df.select(*(F.col(f).cast("double").alias(f"c{k}") for k, f in enumerate(features))), fill)
    filled = lambda k, f: F.coalesce(F.col(f).cast("double"), F.lit(float(fill[k])))
    return df.withColumn("x", F.array(*((filled(k, f) - F.lit(float(mean[k]))) / F.lit(float(deviation[k]) or 1.0) for k, f in enumerate(features))))


def with_interactions(df: DataFrame, features: list[str], top: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds products of all pairs of the top features; returns the longer list too."""
    pairs = [(a, b) for k, a in enumerate(top) for b in top[k + 1 :]]
    return df.withColumns({f"{a}__x__{b}": F.col(a) * F.col(b) for a, b in pairs}), [*features, *(f"{a}__x__{b}" for a, b in pairs)]


@dataclass
class Moments:
    """Of an array column x: number, sums, sums of products, of x times its squared norm, of the squared squared norm."""

    n: int
    s: np.ndarray
    q: np.ndarray
    v: np.ndarray
    r: float

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.s + other.s, self.q + other.q, self.v + other.v, self.r + other.r)

    @property
    def mean(self) -> np.ndarray:
        return self.s / max(self.n, 1)

    @property
    def cov(self) -> np.ndarray:
        return self.q / max(self.n, 1) - np.outer(self.mean, self.mean)

    @property
    def fourth(self) -> float:
        """Mean of the squared squared norm of x less the mean; what Ledoit-Wolf shrinkage needs besides the covariance."""
        m, n = self.mean, max(self.n, 1)
        mm, q = float(m @ m), self.q / n
        return float(self.r / n + 4 * m @ q @ m + mm * mm - 4 * m @ self.v / n + 2 * mm * np.trace(q) - 4 * mm * mm)


def moments_by(df: DataFrame, keys: list[str], p: int, x: str = "x") -> dict[tuple, Moments]:
    """Moments per value of the keys, which are few, from one pass of partial aggregates."""
    cells = [(i, j) for i in range(p) for j in range(i + 1)]
    at = lambda i: F.get(F.col(x), i)
    rows = df.withColumn("_norm", F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b))
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(at(i)).alias(f"s{i}") for i in range(p)), *(F.sum(at(i) * at(j)).alias(f"q{i}_{j}") for i, j in cells)]
    sums += [*(F.sum(at(i) * F.col("_norm")).alias(f"v{i}") for i in range(p)), F.sum(F.col("_norm") * F.col("_norm")).alias("r")]
    out = {}
    for row in rows.groupBy(*keys).agg(*sums).collect():
        q = np.zeros((p, p))
        for i, j in cells:
            q[i, j] = q[j, i] = row[f"q{i}_{j}"] or 0.0
        vector = lambda name: np.array([row[f"{name}{i}"] or 0.0 for i in range(p)])  # noqa: B023, E731
        out[tuple(row[k] for k in keys)] = Moments(row["n"], vector("s"), q, vector("v"), row["r"] or 0.0)
    return out


def summed(parts: list[Moments], p: int) -> Moments:
    return sum(parts, Moments(0, np.zeros(p), np.zeros((p, p)), np.zeros(p), 0.0))


def ledoit_wolf(n: int, cov: np.ndarray, fourth: float) -> np.ndarray:
    """Covariance shrunk towards its mean variance."""
    p = len(cov)
    mu = np.trace(cov) / p
    d2 = (np.sum(cov**2) - p * mu * mu) / p
    b2 = min(d2, max(0.0, (fourth - np.sum(cov**2)) / (p * n)))
    share = b2 / d2 if d2 > 0 else 0.0
    return (1 - share) * cov + share * mu * np.eye(p)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, x: str = "x") -> Column:
        total = F.lit(float(self.bias))
        for k, w in enumerate(self.weights):
            total = total + F.get(F.col(x), k) * F.lit(float(w))
        return total

    def of(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass
class Quadratic:
    """Log posterior odds of two normal classes."""

    means: tuple[np.ndarray, np.ndarray]
    inverses: tuple[np.ndarray, np.ndarray]
    bias: float

    def score(self, x: str = "x") -> Column:
        def distance(k: int) -> Column:
            total = F.lit(0.0)
            p = len(self.means[k])
            for i in range(p):
                di = F.get(F.col(x), i) - F.lit(float(self.means[k][i]))
                for j in range(i + 1):
                    dj = F.get(F.col(x), j) - F.lit(float(self.means[k][j]))
                    total = total + di * dj * F.lit(float(self.inverses[k][i, j]) * (1 if i == j else 2))
            return total

        return F.lit(float(self.bias)) + F.lit(0.5) * (distance(0) - distance(1))

    def of(self, x: np.ndarray) -> np.ndarray:
        far = [np.einsum("ri,ij,rj->r", x - m, inverse, x - m, optimize=True) for m, inverse in zip(self.means, self.inverses, strict=True)]
        return self.bias + 0.5 * (far[0] - far[1])


def lda(classes: dict[int, Moments]) -> Linear:
    """Equal priors, pooled within-class covariance with Ledoit-Wolf shrinkage; classes 1 and -1."""
    if not sum(m.n for m in classes.values()):
        raise ValueError("no labelled rows to learn from")
    means = [classes[k].mean for k in (-1, 1)]
    p = len(means[0])
    cov = np.zeros((p, p))
    for own in classes.values():
        if own.n:
            cov += 0.5 * ledoit_wolf(own.n, own.cov, own.fourth)
    w = np.linalg.solve(cov + 1e-9 * np.eye(p), means[1] - means[0])
    return Linear(w, float(-0.5 * w @ (means[0] + means[1])))


def qda(classes: dict[int, Moments], reg: float = 0.5) -> Quadratic:
    """Covariances mixed with the identity by ``reg``; equal priors."""
    means, inverses, logdet = [], [], []
    for k in (-1, 1):
        own = classes[k]
        cov = (1 - reg) * own.cov * own.n / max(own.n - 1, 1) + reg * np.eye(len(own.s))
        means.append(own.mean)
        inverses.append(np.linalg.inv(cov))
        logdet.append(np.linalg.slogdet(cov)[1])
    return Quadratic((means[0], means[1]), (inverses[0], inverses[1]), 0.5 * (logdet[0] - logdet[1]))


def class_moments(train: DataFrame, p: int) -> dict[int, Moments]:
    found = moments_by(train, ["label"], p)
    return {k: summed([m for (label,), m in found.items() if label == k], p) for k in (-1, 1)}


def fit_lda(train: DataFrame, p: int) -> Linear:
    """``train`` has x and label (1 or -1)."""
    return lda(class_moments(train, p))


def fit_qda(train: DataFrame, p: int) -> Quadratic:
    return qda(class_moments(train, p))


Lift = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.Array, lift: Lift | None = None) -> np.ndarray:
    """Arrays of equal length as rows, lifted if asked."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x if lift is None else lift(x)


def violating(rows: DataFrame, betas: dict[int, np.ndarray], lift: Lift | None = None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For the model of each fold, n, sums of products and sums with the label of the other folds' rows (x, y, fold)
    inside its margin; x is followed by a one.

    Partial sums are by partition in Arrow batches: as column expressions, the thousands of products
    of Fourier features don't compile.
    """
    p1 = len(next(iter(betas.values())))

    def part(batches):
        held = {m: [0.0, np.zeros((p1, p1)), np.zeros(p1)] for m in betas}
        for whole in batches:
            for lo in range(0, len(whole), 4096):
                batch = whole.slice(lo, 4096)
                y, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                x = np.hstack([_matrix(batch.column(0), lift), np.ones((len(y), 1))])
                for m, sums in held.items():
                    on = (fold != m) & (y * (x @ betas[m]) < 1)
                    a = x[on]
                    sums[0] += len(a)
                    sums[1] += a.T @ a
                    sums[2] += a.T @ y[on]
        rows = [np.concatenate([[n], q.ravel(), xy]) for n, q, xy in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["m", "sums"])

    cells = rows.select("x", "y", "fold").mapInArrow(part, "m int, sums array<double>").select("m", F.posexplode("sums").alias("k", "v")).groupBy("m", "k").agg(F.sum("v").alias("v")).collect()
    total = {m: np.zeros(1 + p1 * p1 + p1) for m in betas}
    for r in cells:
        total[r["m"]][r["k"]] = r["v"]
    return {m: (v[0], v[1 : 1 + p1 * p1].reshape(p1, p1), v[1 + p1 * p1 :]) for m, v in total.items()}


def squared_hinges(rows: DataFrame, p: int, models: list[int], c: float = 1.0, rounds: int = 15, lift: Lift | None = None) -> dict[int, Linear]:
    """Linear SVMs with squared hinge loss by Newton steps, each model of the rows (x, y, fold) of other folds;
    a step of all models takes one pass over the rows that violate their margins."""
    betas, open_ = {m: np.zeros(p + 1) for m in models}, list(models)
    ridge = np.eye(p + 1)
    ridge[p, p] = 1e-6
    for _ in range(rounds):
        for m, (n, q, xy) in violating(rows, {m: betas[m] for m in open_}, lift).items():
            new = np.linalg.solve(ridge + 2 * c * q, 2 * c * xy) if n else betas[m]
            if not n or np.abs(new - betas[m]).max() < 1e-6:
                open_.remove(m)
            betas[m] = new
        if not open_:
            break
    else:
        warnings.warn(f"squared hinge: not settled in {rounds} Newton steps", RuntimeWarning, stacklevel=3)
    return {m: Linear(b[:p], float(b[p])) for m, b in betas.items()}


def fit_squared_hinge(train: DataFrame, p: int, c: float = 1.0, rounds: int = 15) -> Linear:
    """The squared hinge model of all rows."""
    rows = train.select("x", F.col("label").cast("double").alias("y"), F.lit(-1).alias("fold"))
    return squared_hinges(rows, p, [0], c, rounds)[0]


def fourier_features(p: int, gamma: float | None = None, n: int = 64, seed: int = 42) -> Lift:
    """Rows to random Fourier features of the RBF kernel: what a linear model on them approximates is a kernel model."""
    rng = np.random.default_rng(seed)
    gamma = 1.0 / p if gamma is None else gamma
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(n, p)), rng.uniform(0, 2 * np.pi, n)
    return lambda x: np.cos(x @ w.T + b) * np.sqrt(2 / n)


def score_in_batches(models: dict[int, Linear | Quadratic], lift: Lift | None = None) -> Column:
    """The score of each row by its fold's model, over Arrow batches: long expressions, which filters repeat, don't compile."""

    def score(x: pa.Array, fold: pa.Array) -> pa.Array:
        found, of = np.full(len(x), np.nan), fold.to_numpy(zero_copy_only=False)
        for lo in range(0, len(x), 4096):
            part, own = _matrix(x.slice(lo, 4096), lift), of[lo : lo + 4096]
            for m, model in models.items():
                on = own == m
                found[lo : lo + 4096][on] = model.of(part[on])
        return pa.array(found)

    return F.arrow_udf(score, "double")(F.col("x"), F.col("fold"))


def fit_and_score(train: DataFrame, test: DataFrame, p: int, model: str = "lda", **options) -> DataFrame:
    """``test`` with a column score from the named model trained on ``train``."""
    if model == "gbt":
        from pyspark.ml.classification import GBTClassifier

        as_vector = lambda d: d.withColumn("_v", array_to_vector("x"))
        tree = GBTClassifier(featuresCol="_v", labelCol="_y", maxIter=options.get("trees", 200), maxDepth=options.get("depth", 3), stepSize=options.get("rate", 0.1), subsamplingRate=0.7, seed=options.get("seed", 42))
        fitted = tree.fit(as_vector(train).withColumn("_y", (F.col("label") == 1).cast("double")))
        return fitted.transform(as_vector(test)).withColumn("score", vector_to_array("rawPrediction")[1]).drop("_v", "rawPrediction", "probability", "prediction")
    fitted = {"lda": fit_lda, "qda": fit_qda, "svm": lambda t, q: fit_squared_hinge(t, q, options.get("c", 1.0))}[model](train, p)
    return test.withColumn("score", fitted.score())


def out_of_fold(df: DataFrame, p: int, model: str, k: int = 3, **options) -> DataFrame:
    """``df`` (fold, x and label) with a score: each fold's from a model of the other folds' labelled rows.
    Rows of label 0 are scored, not learned.

    Discriminants and SVMs of all folds come from the same passes, and their scores are column
    expressions that need no storage; those of trees are stored.
    """
    learned = df.where("label != 0")
    if model in ("lda", "qda", "svm"):
        if model == "svm":
            models = squared_hinges(learned.select("x", F.col("label").cast("double").alias("y"), "fold"), p, list(range(k)), options.get("c", 1.0))
        else:
            found = moments_by(learned, ["fold", "label"], p)
            of = lambda fold, c: summed([m for (f, label), m in found.items() if f != fold and label == c], p)
            models = {fold: {"lda": lda, "qda": qda}[model]({c: of(fold, c) for c in (-1, 1)}) for fold in range(k)}
        if model == "qda":
            return df.withColumn("score", score_in_batches(models))
        score = F.lit(None).cast("double")
        for fold in range(k):
            score = F.when(F.col("fold") == fold, models[fold].score()).otherwise(score)
        return df.withColumn("score", score)
    if model == "rbf_svm":
        n = options.get("n", 64)
        lift = fourier_features(p, options.get("gamma"), n)
        rows = learned.select("x", F.col("label").cast("double").alias("y"), "fold")
        return df.withColumn("score", score_in_batches(squared_hinges(rows, n, list(range(k)), options.get("c", 1.0), lift=lift), lift))
    pool, out = stored(df), None
    for fold in range(k):
        scored = fit_and_score(pool.where((F.col("fold") != fold) & (F.col("label") != 0)), pool.where(F.col("fold") == fold).drop("score"), p, model, **options).select(*df.columns)
        out = scored if out is None else out.unionByName(scored)
    return stored(out)


def labelled(df: DataFrame, positive: Column) -> DataFrame:
    """label: -1 for decoys, 1 for targets that meet the condition, else 0."""
    return df.withColumn("label", F.when(F.col("is_decoy"), -1).when(positive, 1).otherwise(0).cast("tinyint"))


def seed_sweep(df: DataFrame, features: list[str], key: list[str], fdr: float, skip: tuple[str, ...] = (), ranges: int = 32) -> DataFrame:
    """(feature, direction, n): for each feature, both ways, the targets at the FDR if it alone were the score.

    Rows are counted within ranges of a feature's values, between approximate quantiles and at each of
    them; a range of one value, which may be most rows, is split by the hash that orders equal values.
    """
    wide = [f for f in features if f not in skip]
    own = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f)
    hashed = settled(df.select("is_decoy", F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key))).alias("_h"), *map(own, wide)))
    rows = None
    for f, edges in zip(wide, hashed.approxQuantile(wide, [k / ranges for k in range(1, ranges)], 0.002), strict=True):
        place = F.lit(0)
        for e in sorted(set(edges)):
            place = place + F.when(F.col(f) > e, 2).when(F.col(f) >= e, 1).otherwise(0)
        one = hashed.where(F.col(f).isNotNull()).select(F.lit(f).alias("feature"), "is_decoy", "_h", F.col(f).alias("value"), place.alias("_range"))
        rows = one if rows is None else rows.unionByName(one)
    # an odd range is one value
    rows = rows.withColumn("_part", F.when(F.col("_range") % 2 == 1, F.conv(F.substring("_h", 1, 1), 16, 10).cast("int")).otherwise(0))
    from pyspark.sql import Window as W

    # per range: decoys and rows before it and up to its end, both ways
    both = F.explode(F.array(F.lit(1), F.lit(-1))).alias("direction")
    cells = rows.groupBy("feature", "_range", "_part").agg(F.sum(F.col("is_decoy").cast("long")).alias("_d"), F.count(F.lit(1)).alias("_n"))
    cells = settled(cells.select("feature", "_range", "_part", "_d", "_n", both))
    upto = W.partitionBy("feature", "direction").orderBy(F.desc(F.col("_range") * F.col("direction")), "_part").rowsBetween(W.unboundedPreceding, 0)
    cells = cells.select("feature", "direction", "_range", "_part", (F.sum("_d").over(upto) - F.col("_d")).alias("_d0"), (F.sum("_n").over(upto) - F.col("_n")).alias("_n0"), F.sum("_d").over(upto).alias("_d1"), F.sum("_n").over(upto).alias("_n1"))
    # a row passes if it or a later one is within the FDR: so all targets up to the last such row do
    within = lambda d, n, t=None: (F.col(d) + 1) / F.greatest(F.col(n) - F.col(t or d), F.lit(1)) <= fdr
    sure = cells.groupBy("feature", "direction").agg(F.coalesce(F.max(F.when(within("_d1", "_n1"), F.col("_n1") - F.col("_d1"))), F.lit(0)).alias("_sure"))
    sure = settled(sure)
    # only ranges that may end higher are looked into
    open_ = cells.join(F.broadcast(sure), ["feature", "direction"]).where(within("_d0", "_n1", "_d1") & (F.col("_n1") - F.col("_d1") > F.col("_sure"))).select("feature", "direction", "_range", "_part", "_d0", "_n0")
    near = rows.join(F.broadcast(open_), ["feature", "_range", "_part"]).withColumn("s", F.col("value") * F.col("direction"))
    run = W.partitionBy("feature", "direction", "_range", "_part").orderBy(F.desc("s"), "_h", "is_decoy").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_d", F.sum(F.col("is_decoy").cast("long")).over(run) + F.col("_d0")).withColumn("_n", F.count(F.lit(1)).over(run) + F.col("_n0"))
    more = near.groupBy("feature", "direction").agg(F.max(F.when(within("_d", "_n"), F.col("_n") - F.col("_d"))).alias("_more"))
    return sure.join(more, ["feature", "direction"], "left").select("feature", "direction", F.greatest("_sure", F.coalesce("_more", F.lit(0))).alias("n"))


def seed_bounds(table: DataFrame, scores: list[tuple[int, int, int | None]], fdr: float, bins: int = 2048) -> dict[tuple[int, int], tuple[int, int]]:
    """For single entries of the array x, or sums and differences of two (i, sign, j), both ways: (number,
    direction) to the least and the most targets at the FDR that counts in bins of the score allow.
    One pass over the table (is_decoy, x); values that aren't numbers take no part."""
    entries = sorted({k for i, _, j in scores for k in (i, j) if k is not None})
    _, least, most = column_ends(table.select(*(F.get("x", k).alias(f"c{k}") for k in entries)))
    ends = {k: (float(a), float(b)) if a <= b else (0.0, 0.0) for k, a, b in zip(entries, least, most, strict=True)}
    spans = []
    for i, sign, j in scores:
        lo, hi = ends[i]
        if j is not None:
            lo, hi = lo + (ends[j][0] if sign > 0 else -ends[j][1]), hi + (ends[j][1] if sign > 0 else -ends[j][0])
        spans.append((np.arcsinh(lo), bins / max(np.arcsinh(hi) - np.arcsinh(lo), 1e-12)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(scores), 2 * bins), np.int64)
        for batch in (b for b in batches if len(b)):
            decoy = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * bins
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for k, ((i, sign, j), (low, scale)) in enumerate(zip(scores, spans, strict=True)):
                v = x[:, i] if j is None else x[:, i] + sign * x[:, j]
                real = ~np.isnan(v)
                at = np.clip((np.arcsinh(v[real]) - low) * scale, 0, bins - 1).astype(np.int64)
                held[k] += np.bincount(at + decoy[real], minlength=2 * bins)
        k, b = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(held[k, b])], names=["k", "b", "n"])

    found = table.select("is_decoy", "x").mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros((len(scores), 2 * bins), np.int64)
    held[found.column("k").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    out = {}
    for k in range(len(scores)):
        for direction in (1, -1):
            t, d = (part[::-direction].cumsum() for part in (held[k, :bins], held[k, bins:]))
            before = np.concatenate([[0], d[:-1]])
            sure, hoped = (d + 1) / np.maximum(t, 1) <= fdr, (before + 1) / np.maximum(t, 1) <= fdr
            out[k, direction] = (int(t[sure].max(initial=0)), int(t[hoped].max(initial=0)))
    return out


def best_seed(df: DataFrame, features: list[str], key: list[str], fdr: float, skip: tuple[str, ...] = ()) -> tuple[str, int, int]:
    """The feature and direction that pass most targets, and how many, as ``seed_sweep`` has them."""
    wide = [f for f in features if f not in skip]
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in wide))
    found = passing(df.select("is_decoy", x.alias("x"), order_of_equals(key).alias("h")), [(k, 1, None) for k in range(len(wide))], fdr)
    n, name, way = min((-n, wide[k], -way) for (k, way), n in found.items())
    return name, -way, -n


def order_of_equals(key: list[str]) -> Column:
    """The first 60 bits of the key's md5."""
    text = F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key)))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def seed_score(table: DataFrame, features: list[str], key: list[str], fdr: float, least_positives: int = 50, skip: tuple[str, ...] = ()) -> DataFrame:
    """``table`` (with x) and a score: the best feature either way; while fewer than ``least_positives`` targets
    pass, the best sum or difference of two scaled features, then a tree of depth 3, if they pass more."""
    name, way, n = best_seed(table, features, key, fdr, skip)
    score = F.coalesce(F.col(name).cast("double") * way, F.lit(-1e300))
    at = [k for k, f in enumerate(features) if f not in skip]
    _, least, most = column_ends(table.select(*(F.get("x", k).alias(f"c{k}") for k in at)))
    at = [k for k, a, b in zip(at, least, most, strict=True) if a < b]
    pairs = [(i, sign, j) for a, i in enumerate(at) for j in at[a + 1 :] for sign in (1, -1)]
    if n < least_positives and pairs:
        found = passing(table.select("is_decoy", "x", order_of_equals(key).alias("h")), pairs, fdr, n)
        if found:
            n, _, way, k = min((-n, f"_pair{k}", -way, k) for (k, way), n in found.items())
            n, (i, sign, j) = -n, pairs[k]
            score = (F.get("x", i) + sign * F.get("x", j)) * -way
    out = table.withColumn("score", score)
    if n < least_positives and at and out.select("is_decoy").distinct().count() == 2:
        from pyspark.ml.classification import DecisionTreeClassifier

        wide = table.withColumn("_v", array_to_vector(F.array(*(F.get("x", k) for k in at)))).withColumn("_y", (~F.col("is_decoy")).cast("double"))
        tree = DecisionTreeClassifier(featuresCol="_v", labelCol="_y", maxDepth=3, minInstancesPerNode=20, seed=0).fit(wide)
        leaf = tree.transform(wide).withColumn("score", vector_to_array("probability")[1]).drop("_v", "_y", "rawPrediction", "probability", "prediction")
        if best_seed(leaf, ["score"], key, fdr)[2] > n:
            out = leaf
    return out


def semi_supervised(df: DataFrame, features: list[str], key: list[str], model: str = "lda", init_fdr: float = 0.2, train_fdr: float = 0.05, max_iter: int = 5, least_positives: int = 50, start: Column | None = None, skip: tuple[str, ...] = (), **options) -> DataFrame:
    """df with a score. Positives begin as the targets at the FDR by the best seed (or by ``start``),
    then are those at the FDR by the last out-of-fold scores, until their number changes by less than 1 %.

    All columns are stored, then once more with folds; scaled features and scores are expressions of these. An iteration
    counts and sums them in passes that sort and move no rows.
    """
    own = {c: f"_own_{c}" for c in ("x", "fold", "label") if c in df.columns}
    features, key = [own.get(f, f) for f in features], [own.get(c, c) for c in key]
    # folds read the rows twice, so these have to be fixed first
    wide = stored(folds(stored(df.withColumnsRenamed(own)), ["is_decoy"], key))
    columns = [c for c in wide.columns if c not in ("score", "fold")]
    table = standardised(wide, features)
    scored = seed_score(table, features, key, init_fdr, least_positives, skip) if start is None else table.withColumn("score", start)
    scored = scored.select(*columns, "fold", "x", "score")
    before = None
    for _ in range(max_iter):
        fdr = init_fdr if before is None else train_fdr
        found = targets_within(scored, "score", key, fdr)
        if found is None:
            scored = settled(tdc_q_values(scored, "score", F.col("is_decoy"), key, out="_q"))
            found = F.col("_q") <= fdr, scored.where((F.col("_q") <= fdr) & ~F.col("is_decoy")).count()
        positive, n = found
        if n < least_positives:
            edge = quantiles(scored.where("not is_decoy"), "score", [0.8])[0]
            positive = F.col("score") >= F.lit(edge)
            n = max(n, 1)
        if before is not None and abs(n - before) < 0.01 * before:
            break
        before = n
        scored = out_of_fold(labelled(scored, positive).select(*columns, "x", "fold", "label", "score"), len(features), model, **options)
    return scored.select(*columns, "score").withColumnsRenamed({v: k for k, v in own.items()})


def structure_coefficients(df: DataFrame, features: list[str], score: str = "score") -> DataFrame:
    """(feature, r): correlation of each feature with the score; NULL for constants."""
    out = []
    for f in features:
        a, b = F.col(f).cast("double"), F.col(score)
        n, sa, sb = F.count(a), F.sum(a), F.sum(F.when(a.isNotNull(), b))
        saa, sbb, sab = F.sum(a * a), F.sum(F.when(a.isNotNull(), b * b)), F.sum(a * b)
        va, vb = n * saa - sa * sa, n * sbb - sb * sb
        out.append(F.struct(F.lit(f).alias("feature"), F.when((va > 1e-20) & (vb > 1e-20), (n * sab - sa * sb) / F.sqrt(va) / F.sqrt(vb)).alias("r")))
    return df.agg(F.array(*out).alias("a")).select(F.explode("a").alias("z")).select("z.feature", "z.r")


def mean_difference(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, d): difference of target and decoy means over the pooled deviation."""
    out = []
    for f in features:
        t, d = F.when(~F.col("is_decoy"), F.col(f).cast("double")), F.when(F.col("is_decoy"), F.col(f).cast("double"))
        pooled = F.sqrt((F.var_pop(t) + F.var_pop(d)) / 2)
        out.append(F.struct(F.lit(f).alias("feature"), F.coalesce(F.try_divide(F.avg(t) - F.avg(d), F.nullif(pooled, F.lit(0.0))), F.lit(0.0)).alias("d")))
    return df.agg(F.array(*out).alias("a")).select(F.explode("a").alias("z")).select("z.feature", "z.d")


def constant_features(df: DataFrame, features: list[str]) -> list[str]:
    row = df.agg(*((F.coalesce(F.min(f) == F.max(f), F.lit(True))).alias(f) for f in features)).first()
    return [f for f in features if row[f]]


def prior(df: DataFrame, features: list[str], out: str, inverted: tuple[str, ...] = (), null_as_zero: bool = False) -> DataFrame:
    """Mean over features of their min-max scaled values; NULL is left out (or 0); all NULL gives 1."""
    value = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if null_as_zero else F.col(f).cast("double") for f in features}
    ends = df.agg(*(F.min(v).alias(f"lo_{f}") for f, v in value.items()), *(F.max(v).alias(f"hi_{f}") for f, v in value.items()))
    scaled = []
    for f, v in value.items():
        s = F.when(v.isNotNull(), F.coalesce(F.try_divide(v - F.col(f"lo_{f}"), F.nullif(F.col(f"hi_{f}") - F.col(f"lo_{f}"), F.lit(0.0))), F.lit(0.0)))
        scaled.append(F.lit(1.0) - s if f in inverted else s)
    parts = F.filter(F.array(*scaled), lambda x: x.isNotNull())
    mean = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(F.size(parts) > 0, mean).otherwise(1.0)).drop(*(f"{e}_{f}" for e in ("lo", "hi") for f in features))


def reweighted(score: Column, priors: list[tuple[Column, float]]) -> Column:
    for p, w in priors:
        score = score + F.lit(w) * F.log(F.greatest(p, F.lit(1e-12)))
    return score


def filled(df: DataFrame, rules: dict[str, str | float]) -> DataFrame:
    """NULL filled by a constant, or by the column's maximum (col_max) or minimum (col_min)."""
    ends = df.agg(*((F.max(c) if r == "col_max" else F.min(c)).alias(f"_e_{c}") for c, r in rules.items() if isinstance(r, str)), F.lit(0).alias("_e"))
    out = df.crossJoin(F.broadcast(ends))
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_e_{c}") if isinstance(r, str) else F.lit(float(r))) for c, r in rules.items()}).drop("_e", *(f"_e_{c}" for c, r in rules.items() if isinstance(r, str)))


def two_rounds(df: DataFrame, features: list[str], key: list[str], model: str = "lda", group: str = "feature_idx", init_fdr: float = 0.2, train_fdr: float = 0.05, seed_share: float = 0.2, winner_share: float = 0.02, single_round: bool = False, skip: tuple[str, ...] = (), **options) -> DataFrame:
    """Round one scores all candidates; the winners of each feature are scored again, seeded by the
    best ``seed_share`` of targets; q-values are those of round two. Adds score_r1, score_r2, q_value."""
    first = semi_supervised(df, features, key, model, init_fdr, train_fdr, skip=skip, **options).withColumnRenamed("score", "score_r1")
    best = settled(winners(first, group, "score_r1", key, winner_share))
    if single_round:
        second = best.withColumn("score_r2", F.col("score_r1"))
    else:
        used = features
        if model == "qda":
            gaps = {r["feature"]: abs(r["d"]) for r in mean_difference(best, features).collect()}
            middle = float(np.median(list(gaps.values())))
            used = [f for f in features if gaps[f] >= middle] or features
        edge = quantiles(best.where("not is_decoy"), "score_r1", [1 - seed_share])[0]
        start = F.when(F.col("score_r1") >= F.lit(edge), F.col("score_r1") + 1e6).otherwise(F.col("score_r1"))
        second = semi_supervised(best, used, key, model, init_fdr, train_fdr, start=start, skip=skip, **options).withColumnRenamed("score", "score_r2")
    return tdc_q_values(second, "score_r2", F.col("is_decoy"), key)


def kde_pep(df: DataFrame, score: str, out: str = "pep", points: int = 256) -> DataFrame:
    """Posterior error by Gaussian kernel densities (Scott's width) of decoys, and of targets above their
    median, on a grid of scores. The grid is small; each row takes the value of its nearest point."""
    s, d = F.col(score), F.col("is_decoy")
    ends = df.agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.percentile(F.when(~d, s), F.lit(0.5)).alias("med"), F.avg(d.cast("double")).alias("pi")).first()
    if ends["lo"] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    width = (ends["hi"] - ends["lo"]) / (points - 1) or 1.0
    cell = F.round((s - ends["lo"]) / width).cast("int")
    kind = F.when(d, "d").when(s > ends["med"], "t")
    hist = df.select(cell.alias("c"), kind.alias("k"), s.alias("s")).where("k is not null").groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("ss")).collect()
    density = {}
    for k in "dt":
        rows = [r for r in hist if r["k"] == k]
        n = sum(r["n"] for r in rows)
        if n < 2:
            return df.withColumn(out, F.lit(None).cast("double"))
        mean = sum(r["s"] for r in rows) / n
        sd = max((sum(r["ss"] for r in rows) / n - mean**2) * n / (n - 1), 1e-18) ** 0.5
        h = sd * n ** (-0.2) / width
        grid = np.arange(points)[:, None] - np.array([r["c"] for r in rows])[None, :]
        density[k] = (np.exp(-0.5 * (grid / h) ** 2) * np.array([r["n"] for r in rows])).sum(1) / (n * h)
    f0, f1 = ends["pi"] * density["d"], (1 - ends["pi"]) * density["t"]
    pep = np.clip(f0 / np.maximum(f0 + f1, 1e-300), 0, 1)
    return df.withColumn(out, F.get(F.lit([float(v) for v in pep]), F.greatest(F.lit(0), F.least(F.lit(points - 1), cell))))
