"""Quality classifier: a sparse rule ensemble.

Statistics of the text are columns. On a bounded sample of labelled training rows, boosted
small trees are grown; every path from a root to a node becomes a rule, a conjunction of
bounds on statistics; a lasso logistic regression weighs the rules and leaves few of them.
The rules are compiled into one column expression, so every text is scored inside the JVM.

Labels are learned only from rows whose crc32(id as text) mod 3 is not 1. Rows with a null
label, or without one, teach nothing; without both labels the score is the share of label 1,
or 0.5 without any. Null texts are empty. A null id counts as not held out. Repeated rows are
scored once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import crc_mod, cut_lineage, read_table
from massloom.llm.text_stats import with_text_stats

#: Labelled rows that the model is fitted on at most; chosen by the order of a hash of the id.
SAMPLE_ROWS = 20_000
FEATURES = ("word_length", "symbol_share", "upper_share", "distinct_share", "repeat_share", "dup_line_share", "log_words", "words_per_line")


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the statistics of FEATURES."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    s = with_text_stats(own, "_text", ["_id"])
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return s.select(
        F.col("_id").alias("id"), over("word_chars", "n_words").alias("word_length"), over("n_symbols", "word_chars").alias("symbol_share"), over("n_upper", "word_chars").alias("upper_share"), over("n_distinct_words", "n_words").alias("distinct_share"),
        over("n_repeat_words", "n_words").alias("repeat_share"), over("n_dup_lines", "n_lines").alias("dup_line_share"), F.log1p("n_words").alias("log_words"), F.log1p(over("n_words", "n_lines")).alias("words_per_line"),
    )


#: A rule: bounds (feature, is_upper, value) that must all hold; x <= value if is_upper, else x > value.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, names: tuple[str, ...] = FEATURES) -> Column:
        """The same score as one Spark expression."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights, strict=True):
            met = None
            for f, upper, value in rule:
                one = F.col(names[f]) <= float(value) if upper else F.col(names[f]) > float(value)
                met = one if met is None else met & one
            z = z + F.when(met, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    met = np.ones(len(x), bool)
    for f, upper, value in rule:
        met &= x[:, f] <= value if upper else x[:, f] > value
    return met


def _best_split(bins: np.ndarray, grad: np.ndarray, n_bins: int, least: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the split by squared error; bins at or below go left."""
    best = (1e-9, -1, -1)
    total, n = grad.sum(), len(grad)
    for f in range(bins.shape[1]):
        g = np.bincount(bins[:, f], grad, n_bins).cumsum()[:-1]
        c = np.bincount(bins[:, f], minlength=n_bins).cumsum()[:-1]
        ok = (c >= least) & (n - c >= least)
        if ok.any():
            gain = np.where(ok, g**2 / np.maximum(c, 1) + (total - g) ** 2 / np.maximum(n - c, 1) - total**2 / n, 0.0)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), f, k))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, n_bins: int = 64, rate: float = 0.2, share: float = 0.5, seed: int = 7) -> list[Rule]:
    """Rules of every node of gradient-boosted trees, each once."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        chosen = rng.random(len(y)) < share
        front = [((), np.ones(len(y), bool))]
        for level in range(depth):
            following = []
            for rule, here in front:
                fit = here & chosen
                gain, f, k = _best_split(bins[fit], (y - p)[fit], n_bins + 1, 10) if fit.sum() >= 20 else (0, -1, -1)
                if f < 0 or k >= len(edges[f]):
                    if level:
                        z[here] += _step(y[here], p[here], rate)
                    continue
                for upper in (True, False):
                    part = (*[b for b in rule if b[:2] != (f, upper)], (f, upper, float(edges[f][k])))
                    rules[tuple(sorted(part))] = None
                    following.append((part, here & (bins[:, f] <= k if upper else bins[:, f] > k)))
            front = following
        for _, here in front:
            if here.any():
                z[here] += _step(y[here], p[here], rate)
    return list(rules)


def _step(y: np.ndarray, p: np.ndarray, rate: float) -> float:
    return float(np.clip((y - p).sum() / ((p * (1 - p)).sum() + 1.0), -4, 4) * rate) if len(y) else 0.0


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, p = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    v = np.ones(p + 1) / np.sqrt(p + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / (np.linalg.norm(a @ v) ** 2 * 1.05 + 1e-9)
    w = np.zeros(p + 1)
    m, t = w.copy(), 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ m, -30, 30))) - y) / n
        new = m - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleModel:
    """The rule ensemble of a sample; a constant where one label is missing."""
    if len(y) < 40 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return RuleModel(float(np.log(p / (1 - p))), [], [])
    rules = grow_rules(x, y)
    table = np.stack([holds(r, x) for r in rules], 1).astype(np.float64)
    # rules that hold on the same rows are one
    _, first = np.unique(table, axis=1, return_index=True)
    first.sort()
    table, rules = table[:, first], [rules[k] for k in first]
    intercept, w = lasso_logistic(table, y, penalty)
    live = np.nonzero(np.abs(w) > 1e-6)[0]
    return RuleModel(intercept, [rules[k] for k in live], [float(w[k]) for k in live])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, held_out, score, predicted."""
    table = cut_lineage(features(docs, id_col, text_col).withColumn("held_out", F.coalesce(crc_mod(F.col("id"), folds) == held, F.lit(False))))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("_y")).where(F.col("_y").isNotNull() & (F.coalesce(crc_mod(F.col("id"), folds), F.lit(0)) != held))
    sample = table.join(known, "id").orderBy(F.xxhash64(F.col("id").cast("string")), "_y", *FEATURES).limit(sample_rows).select(*FEATURES, "_y")
    got = np.array([tuple(map(float, r)) for r in sample.collect()], float).reshape(-1, len(FEATURES) + 1)
    model = fit_rules(got[:, :-1], got[:, -1])
    scored = table.select("id", "held_out", model.column().alias("score"))
    return scored.select("id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
