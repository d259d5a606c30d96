"""Scoring models and whole runs: iterative, so without SQL; tests hold them to known results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massloom.operators import ordered, report, scoring
from massloom.plans.registry import query, table

FEATURES = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "shipped"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _table(s, d) -> DataFrame:
    t = table(s, d, "lineitem").dropDuplicates(KEY)
    return t.withColumn("is_decoy", F.col("l_returnflag") == "R").withColumn("shipped", F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double"))


def _scored(s, d, model: str) -> DataFrame:
    t = scoring.semi_supervised(_table(s, d).select(*KEY, "is_decoy", *FEATURES), FEATURES, KEY, model)
    return t.select(*KEY, "is_decoy", F.round("score", 6).alias("score"))


@query()
def m5_lda(s, d):
    return _scored(s, d, "lda")


@query()
def m6_linear_svm(s, d):
    return _scored(s, d, "svm")


@query()
def m7_gradient_boosting(s, d):
    return _scored(s, d, "gbt")


@query()
def m8_rbf_svm(s, d):
    return _scored(s, d, "rbf_svm")


@query()
def m9_qda(s, d):
    return _scored(s, d, "qda")


@query()
def m3_m4_m12_two_rounds(s, d):
    t = scoring.two_rounds(_table(s, d), FEATURES, KEY, group="l_partkey")
    return t.select(*KEY, "is_decoy", "score_r1", "score_r2", "q_value")


@query()
def m13_kde_pep(s, d):
    e = table(s, d, "events").select("event_id", "value", (F.col("event_type") == "error").alias("is_decoy"))
    return scoring.kde_pep(e, "value").select("event_id", "pep")


@query("""
WITH u AS (SELECT l_returnflag = 'R' AS d, 'l_extendedprice' AS feature, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_returnflag = 'R', 'l_quantity', l_quantity FROM lineitem)
SELECT feature, round((avg(CASE WHEN NOT d THEN v END) - avg(CASE WHEN d THEN v END)) / sqrt((var_pop(CASE WHEN NOT d THEN v END) + var_pop(CASE WHEN d THEN v END)) / 2), 6) AS d FROM u GROUP BY feature
""")
def m9_mean_difference(s, d):
    t = table(s, d, "lineitem").withColumn("is_decoy", F.col("l_returnflag") == "R")
    return scoring.mean_difference(t, ["l_extendedprice", "l_quantity"]).select("feature", F.round("d", 6).alias("d"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label FROM lineitem
""")
def m2_labels(s, d):
    t = table(s, d, "lineitem").withColumn("is_decoy", F.col("l_returnflag") == "R")
    return scoring.labelled(t, F.col("l_quantity") > 25).select(*KEY, "label")


@query("""
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / sd, 5) AS a, round((l_tax - mt) / st, 5) AS b, round(l_quantity * l_tax, 6) AS ab FROM lineitem, s
""")
def m10_standardised(s, d):
    t, _ = scoring.with_interactions(scoring.standardised(table(s, d, "lineitem"), ["l_quantity", "l_tax"]), ["l_quantity", "l_tax"], ["l_quantity", "l_tax"])
    return t.select(*KEY, F.round(F.col("x")[0], 5).alias("a"), F.round(F.col("x")[1], 5).alias("b"), F.round("l_quantity__x__l_tax", 6).alias("ab"))


@query()
def m27_r13_contributions(s, d):
    return report.linear_contributions(table(s, d, "part"), {"p_size": 0.5, "p_retailprice": -0.1}, ["p_partkey"])


@query()
def p36_psm_projection(s, d):
    from massloom.plans.rescore import psm_projection

    t = table(s, d, "part").select(F.col("p_name").alias("peptide"), F.col("p_partkey").alias("feature_idx"), F.col("p_brand").alias("protein"), F.lit(False).alias("is_decoy"), (F.col("p_size") / 10).alias("ppm_error_abs"), "p_retailprice")
    return psm_projection(t, ["ppm_error_abs", "p_retailprice"]).select("peptidoform", "spectrum_id", "score", F.size("features").alias("n_features"))


@query()
def w6_w8_winner_q_values(s, d):
    t = _table(s, d)
    return ordered.tdc_q_values(ordered.winners(t, "l_partkey", "l_extendedprice", KEY), "l_extendedprice", F.col("is_decoy"), KEY).select(*KEY, "q_value")
