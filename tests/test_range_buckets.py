"""Range joins send a row to no more buckets than its window reaches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import ranges


@pytest.mark.parametrize("near", [{"ppm": 20.0}, {"ppm": 1e-4}, {"tol": 0.5}, {"tol": 1e-7}])
def test_bounds_are_inclusive_and_no_pair_is_lost(spark, near):
    rng = np.random.default_rng(2)
    x = rng.uniform(100, 5000, 400)
    reach = x * near["ppm"] / 1e6 if "ppm" in near else np.full(400, near["tol"])
    y = np.concatenate([x + reach * f for f in (-1.01, -1, -0.999, 0, 0.5, 0.999, 1, 1.01)])
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, l double")
    right = spark.createDataFrame([(j, float(v)) for j, v in enumerate(y)], "j int, r double")
    limit = x[:, None] * near["ppm"] / 1e6 if "ppm" in near else near["tol"]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.abs(y[None, :] - x[:, None]) <= limit), strict=True)}
    assert {(r["i"], r["j"]) for r in ranges.range_join(left, right, "l", "r", **near).collect()} == want


@pytest.mark.parametrize("near", [{"ppm": 20.0}, {"tol": 0.5}])
def test_rows_are_copied_to_two_buckets_at_most(spark, near):
    """Every row went to three."""
    left = spark.range(2000).select((F.col("id") * 1.37 + 500).alias("l"))
    right = spark.range(0).select(F.col("id").cast("double").alias("r"))
    plan = ranges.range_join(left, right, "l", "r", **near)._jdf.queryExecution().analyzed()
    copies = 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Generate":
            rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node)
            copies = rows.count()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert 2000 < copies < 3400
