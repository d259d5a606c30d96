"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. For every language and source (small
sources of a language together, then small languages together) concentration steps look for
the half of the rows whose covariance determinant is least. They start from four deterministic
estimates: all rows' moments, medians with median deviations, spatial signs, and hyperbolic
tangents of the rows about the medians. In a step, distances to the estimate are binned, and
the bins that hold the nearest ``subset`` of the rows give the next mean and covariance. After
two steps the two starts of least determinant go on, until no determinant falls by a thousandth; the least
one's rows within the 0.975 quantile give the last estimate. A row whose squared Mahalanobis
distance to it exceeds the cutoff is rejected. With half of the rows in the subset, the
estimate holds as long as less than half of a group is junk. All of it is DataFrame
expressions: vectors and products are whole numbers, so the sums are exact in any order; bins
and moments aggregate in part before the shuffle, so a hot source costs no more than others;
covariances are factored by Cholesky's formulas written as columns.

Null texts count as empty (and fail the base rule); very long texts are read whole; null lang
or source is a value of its own; repeated rows count once each, ties fall in one bin; groups
too small for an estimate reject nothing; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.llm.common import at_hand, cut_lineage, in_large_files, read_table, settled
from massloom.llm.text_stats import with_text_stats

#: Units of a transformed statistic per 1.0; the vectors are whole numbers of these.
UNIT = 1024
#: Names, and the least standard deviation that an estimate may have, in transformed units.
STATS = (("x0", 0.08), ("x1", 0.10), ("x2", 0.06), ("x3", 0.12), ("x4", 0.12))
#: Share of rows that a concentration step keeps, and what makes its covariance consistent
#: for normal data in five dimensions.
SUBSET, CONSISTENCY = 0.5, 1.9122
#: The 0.975 quantile of chi-squared with 5 degrees, and the factor for the rows within it.
WITHIN, WITHIN_CONSISTENCY = 12.8325, 1.0555
#: Least squared distance that rejects (the 0.999 quantile), least rows of a group with an estimate of its own, and most steps.
CUTOFF, LEAST_ROWS, STEPS = 20.515, 200, 12
#: Steps from all starts, starts that go on, and the least fall of a log determinant that counts.
FIRST_STEPS, GO_ON, FALL = 2, 2, 1e-3
#: Units of a product of scaled statistics per 1.0.
FINE = float(1 << 20)


def vectors(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics: word length, and shares of symbols, capitals, repeated
    words and repeated lines, drawn towards the usual where a text is short."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    shares = (
        F.log((F.col("word_chars") + F.lit(100.0)) / (n + F.lit(20.0))),
        F.log1p(F.lit(10.0) * F.col("n_symbols") / (chars + F.lit(60.0))),
        F.log1p(F.col("n_upper") / (chars + F.lit(60.0))),
        F.log1p(F.col("n_repeat_words") / (n + F.lit(20.0))),
        F.log1p(F.col("n_dup_lines") / (F.col("n_lines") + F.lit(3.0))),
    )
    return df.withColumns({f"x{k}": F.round(s * UNIT).cast("long") for k, s in enumerate(shares)})


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. to m0.. by the Cholesky factor l00, l10, ..."""
    solved: list[Column] = []
    for i in range(len(STATS)):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        solved.append(rest / F.col(f"l{i}{i}"))
    return solved


def with_distance(df: DataFrame) -> DataFrame:
    for k, y in enumerate(_distance()):
        df = df.withColumn(f"y{k}", y)
    d2 = sum((F.col(f"y{k}") * F.col(f"y{k}") for k in range(1, len(STATS))), F.col("y0") * F.col("y0"))
    return df.withColumn("d2", d2).drop(*(f"y{k}" for k in range(len(STATS))))


def _moments(count: Column) -> dict[str, Column]:
    sums = {f"s{i}": F.sum(f"x{i}") for i in range(len(STATS))}
    return {"n": F.sum(count), **sums, **{f"q{i}{j}": F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in _pairs()}}


def factored(est: DataFrame, keys: list[str]) -> DataFrame:
    """From m0.. and covariances c00, c10, ..: the keys, n, means, Cholesky factor and log determinant."""
    p = len(STATS)
    for j in range(p):
        left = F.col(f"c{j}{j}")
        for k in range(j):
            left = left - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{j}{j}", F.sqrt(F.greatest(left, F.lit(1.0))))
        for i in range(j + 1, p):
            left = F.col(f"c{i}{j}")
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", left / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{j}{j}") for j in range(1, p)), F.log("l00"))
    return est.select(*keys, "n", logdet.alias("logdet"), *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i, j in _pairs()))


def _floored(c: Column, i: int, j: int) -> Column:
    return F.greatest(c, F.lit(0.0)) + F.lit((STATS[i][1] * UNIT) ** 2) if i == j else c


def estimate(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Means and the factor of the covariance times ``scale``, with the floors of STATS added to the variances."""
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(STATS))})
    product = lambda i, j: (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(scale)
    return factored(out.withColumns({f"c{i}{j}": _floored(product(i, j), i, j) for i, j in _pairs()}), keys)


def _half(values: DataFrame, by: str) -> DataFrame:
    """(grp, k, by): the least value of ``by`` that half of the counts c reach."""
    w = W.partitionBy("grp", "k")
    run = F.sum("c").over(w.orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    return values.withColumn("run", run).withColumn("all", F.sum("c").over(w)).where(F.col("run") * 2 >= F.col("all")).groupBy("grp", "k").agg(F.min(by).alias(by))


def centres(sound: DataFrame, rows: int, groups: int) -> DataFrame:
    """Per group, the median d0.. and the scale e0.. (of the median deviation) of each statistic, from counts of its values."""
    p = range(len(STATS))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("v")) for k in p)))
    counts = cut_lineage(sound.select("grp", each.alias("z")).groupBy("grp", F.col("z.k").alias("k"), F.col("z.v").alias("v")).agg(F.count(F.lit(1)).alias("c")), rows)
    middle = _half(counts, "v").withColumnRenamed("v", "middle")
    apart = counts.join(middle, ["grp", "k"]).withColumn("apart", F.abs(F.col("v") - F.col("middle")))
    both = _half(apart, "apart").join(middle, ["grp", "k"])
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    scale = lambda k: F.greatest(of(k, "apart") * 1.4826, F.lit(STATS[k][1] * UNIT))
    return cut_lineage(both.groupBy("grp").agg(*(of(k, "middle").alias(f"d{k}") for k in p), *(scale(k).alias(f"e{k}") for k in p)), groups)


def first_estimates(sound: DataFrame, centre: DataFrame, groups: int) -> DataFrame:
    """(grp, start, n, logdet, means, factor) of the four starts, from one pass over the rows."""
    p = range(len(STATS))
    fine = lambda c: F.sum(F.round(c * FINE).cast("long"))
    rows = sound.join(at_hand(centre, groups), "grp").withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"d{i}")) / F.col(f"e{i}") for i in p})
    far = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in p[1:]), F.col("z0") * F.col("z0"))
    rows = rows.withColumns({"w": F.when(far > 0, 1 / far).otherwise(0.0), **{f"t{i}": F.tanh(f"z{i}") for i in p}})
    signs = {f"a{i}{j}": fine(F.col(f"z{i}") * F.col(f"z{j}") * F.col("w")) for i, j in _pairs()}
    tangents = {**{f"b{i}": fine(F.col(f"t{i}")) for i in p}, **{f"b{i}{j}": fine(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in _pairs()}}
    kept = {**{f"d{i}": F.first(f"d{i}") for i in p}, **{f"e{i}": F.first(f"e{i}") for i in p}}
    sums = rows.groupBy("grp").agg(*(c.alias(k) for k, c in {**_moments(F.lit(1)), **signs, **tangents, **kept}.items()))
    mean = lambda name: F.col(name) / F.col("n") / F.lit(FINE)
    scaled = lambda i, j, c: c * F.col(f"e{i}") * F.col(f"e{j}")
    plain = lambda i, j: F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n"))
    forms = (
        ("mean", plain),
        ("median", lambda i, j: scaled(i, j, F.lit(float(i == j)))),
        ("median", lambda i, j: scaled(i, j, mean(f"a{i}{j}") * len(STATS))),
        ("median", lambda i, j: scaled(i, j, mean(f"b{i}{j}") - mean(f"b{i}") * mean(f"b{j}"))),
    )
    starts = []
    for number, (centre_of, c) in enumerate(forms):
        means = [(F.col(f"s{i}") / F.col("n") if centre_of == "mean" else F.col(f"d{i}").cast("double")).alias(f"m{i}") for i in p]
        starts.append(F.struct(F.lit(number).alias("start"), F.col("n"), *means, *(_floored(c(i, j), i, j).alias(f"c{i}{j}") for i, j in _pairs())))
    return factored(sums.select("grp", F.explode(F.array(*starts)).alias("one")).select("grp", "one.*"), ["grp", "start"])


def concentrate(rows: DataFrame, est: DataFrame, subset: float) -> DataFrame:
    """Moments of the nearest ``subset`` of each group from each start, to whole bins of the distance."""
    near = with_distance(rows.join(est.drop("n", "logdet"), "grp"))
    cells = near.groupBy("grp", "start", F.floor(F.log1p("d2") * 16).cast("int").alias("bin")).agg(*(c.alias(k) for k, c in _moments(F.lit(1)).items()))
    w = W.partitionBy("grp", "start")
    cells = cells.withColumn("below", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1))).withColumn("all", F.sum("n").over(w))
    kept = cells.where(F.coalesce("below", F.lit(0)) < F.col("all") * subset)
    return kept.groupBy("grp", "start").agg(*(F.sum(k).alias(k) for k in _moments(F.lit(1))))


def least_determinants(est: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("grp").orderBy("logdet", "start"))
    return est.withColumn("place", place).where(F.col("place") <= most).drop("place")


def robust_estimates(sound: DataFrame, rows: int, groups: int, subset: float, steps: int) -> DataFrame:
    """(grp, n, means, factor): from rows (grp, x0..) of so many groups."""
    keys = ["grp", "start"]
    est = cut_lineage(first_estimates(sound, centres(sound, 5 * rows, groups), groups), 4 * groups)
    for step in range(1, steps + 1):
        new = estimate(concentrate(sound, at_hand(est, 4 * groups), subset), keys, CONSISTENCY)
        if step == FIRST_STEPS:
            new = least_determinants(new, GO_ON)
        new = new.join(at_hand(est.select(*keys, F.col("logdet").alias("before")), 4 * groups), keys)
        est, seen = settled(new, 4 * groups, fell=F.count_if(F.col("logdet") < F.col("before") - FALL))
        est = est.drop("before")
        if step > FIRST_STEPS and not seen["fell"]:
            break
    best = cut_lineage(least_determinants(est, 1), groups)
    within = with_distance(sound.join(at_hand(best.drop("n", "logdet"), groups), "grp")).where(F.col("d2") <= WITHIN)
    return estimate(within.groupBy("grp").agg(*(c.alias(k) for k, c in _moments(F.lit(1)).items())), ["grp"], WITHIN_CONSISTENCY)


def _with_keys(rows: DataFrame) -> DataFrame:
    """Adds _l and _s, never null: what language and source are called here."""
    key = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    return rows.withColumn("_l", key("lang")).withColumn("_s", key("source"))


def group_names(sound: DataFrame, least: int) -> DataFrame:
    """(_l, _s, grp): language and source, or the small sources of a language, or the small languages."""
    sizes = sound.groupBy("_l", "_s").count()
    sizes = sizes.withColumn("small", F.sum(F.when(F.col("count") < least, F.col("count"))).over(W.partitionBy("_l")))
    name = F.when(F.col("count") >= least, F.concat_ws("\t", F.lit("s"), "_l", "_s")).when(F.col("small") >= least, F.concat_ws("\t", F.lit("l"), "_l")).otherwise(F.lit("all"))
    return sizes.select("_l", "_s", name.alias("grp"))


def _measured(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    own = docs.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), "lang", "source", F.col(text_col).alias("_text"))
    return vectors(with_text_stats(own, "_text", [*(f"_keep_{c}" for c in keep), "lang", "source"]).withColumn("base_failed", failed))


def fit_estimates(rows: DataFrame, subset: float, least_rows: int, steps: int) -> DataFrame:
    """Per (_l, _s): the estimate of its group, as _n, m0.. and l00.."""
    sound = _with_keys(rows.where(~F.col("base_failed"))).select("_l", "_s", *(f"x{i}" for i in range(len(STATS))))
    n = sound.count()
    # a group has least_rows rows, but for the last of small languages
    groups = n // least_rows + 1
    names = cut_lineage(group_names(sound, least_rows), n)
    sound = sound.join(at_hand(names), ["_l", "_s"]).drop("_l", "_s")
    est = robust_estimates(sound, n, groups, subset, steps)
    return cut_lineage(names.join(est, "grp").withColumnRenamed("n", "_n").drop("grp", "logdet"), n)


def quality_verdicts(docs: DataFrame, keep: list[str], text_col: str = "text", cutoff: float = CUTOFF, subset: float = SUBSET, least_rows: int = LEAST_ROWS, steps: int = STEPS, wide: bool = False) -> DataFrame:
    """The columns of ``keep`` and the statistics, base_failed, d2 and kept. ``docs`` has lang and source.

    Every text is measured once. With ``wide``, the columns of ``keep`` hold texts: then the
    steps read a narrow copy of the measured rows, and the result is in partitions of some size.
    """
    rows, seen = settled(_measured(docs, keep, text_col), n=F.count(F.lit(1)), chars=F.sum("word_chars"))
    narrow = rows.select("lang", "source", "base_failed", *(f"x{i}" for i in range(len(STATS))))
    est = fit_estimates(cut_lineage(narrow, 4 * seen["n"]) if wide else narrow, subset, least_rows, steps)
    rows = in_large_files(rows, seen["chars"] or 0) if wide else rows
    last = with_distance(_with_keys(rows).join(at_hand(est), ["_l", "_s"], "left"))
    verdict = ~F.col("base_failed") & ~F.coalesce((F.col("d2") > cutoff) & (F.col("_n") >= least_rows * subset * 0.9), F.lit(False))
    own = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "d2"]
    return last.select(*(F.col(f"_keep_{c}").alias(c) for c in keep), *(c for c in own if c not in keep), verdict.alias("_kept" if "kept" in keep else "kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_verdicts(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
