"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Within its source each document stands in a shuffled order (md5 of a seed, its id and text)
and has a virtual finish time: the source's cumulative words, up to and with it, divided by
the source's target. A copy of a later pass over the source adds whole passes to that sum.
All copies, sorted by finish time, are taken until the next would exceed the total budget.

Targets share the budget, all words, by weight; none exceeds ``passes`` times its source.
Cumulative sums are taken within slices of the shuffled order and shifted by the slices'
totals, so that a source with a third of all rows is not one task's work; the cut in the
global order is found in the same way from finely binned finish times.

Null texts have size 0; a null source is a source of its own, last in order. A document of
size 0 takes no words. Repeated rows are documents of their own; rows equal in id and text
may be numbered either way, with equal results. Sources without words get target 0. An
empty table gives no rows. Other columns pass through ``mix_plan`` if named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.llm.common import cut_lineage, in_large_files, read_table, settled, words_of

#: Passes over a source at most; slices of a source's order; bins of finish time per 1.0.
PASSES, SLICES, BINS = 3, 4096, 4096


def source_targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """From (key, source, source_size) rows: weight 1, 2, 3 repeating in code point order, and target.

    The level that shares out all words is found among the sources in order of capacity per
    weight: those below it are full, the others get their weight times the level.
    """
    everything = W.partitionBy(F.lit(0))
    table = sizes.withColumn("weight", (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    table = table.withColumn("cap", F.col("source_size") * passes).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("_t", F.sum("source_size").over(everything))
    order = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    table = table.withColumn("_full", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("_w", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    # the level if this source and all after it stay open: it rises up to the first that it doesn't fill, then falls
    table = table.withColumn("_level", (F.col("_t") - F.coalesce("_full", F.lit(0))) / F.col("_w"))
    level = F.max(F.when(F.col("_level") <= F.col("ratio"), F.col("_level"))).over(everything)
    return table.withColumn("_at", level).select("key", "source", "source_size", "weight", F.when(F.col("ratio") <= F.col("_at"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("_at")).alias("target"))


def _finish_times(rows: DataFrame, passes: int) -> DataFrame:
    """Rows with cum, source_size and target: one finish time for each pass; none for size 0."""
    of = lambda e: (F.col("cum") + e * F.col("source_size")) / F.col("target")
    return rows.withColumn("finish", F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), of)).otherwise(F.array().cast("array<double>")))


def _last_taken(rows: DataFrame, budget: int, passes: int) -> tuple[float, str, int] | None:
    """(finish, order, size) of the last copy that the budget holds, in the order of all copies."""
    copies, spare, low = rows.select("size", "order", F.explode("finish").alias("v")), budget, -1.0
    at, width = F.least(F.col("v"), F.lit(2.0 * passes)), 1.0
    # the bin that crosses the budget, then the finer bin within it
    for _ in range(2):
        width /= BINS
        bins = copies.groupBy(F.floor(at / width).cast("long").alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy(F.lit(0)).orderBy("bin"))
        edge = bins.withColumn("upto", upto).where(F.col("upto") > spare).orderBy("bin").first()
        if edge is None:
            return (float("inf"), "", 0)
        copies, spare = copies.where(F.floor(at / width).cast("long") == edge["bin"]), spare - edge["upto"] + edge["words"]
        low = edge["bin"] * width
    upto = F.sum("size").over(W.partitionBy(F.lit(0)).orderBy("v", "order", "size").rowsBetween(W.unboundedPreceding, 0))
    last = copies.withColumn("upto", upto).where(F.col("upto") <= spare).orderBy(F.desc("upto")).first()
    return (last["v"], last["order"], last["size"]) if last else (low, "", 0)


def mix_plan(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", passes: int = PASSES, seed: str = "mix", suffix: str = "", wide: bool = False) -> DataFrame:
    """The columns of ``keep``, and size, source_size, target, copies and taken of each row, with the
    suffix at their names (for tables that have such names themselves). With ``wide``, ``keep`` holds
    the texts, and the result is in partitions of some size."""
    order = F.md5(F.concat_ws("\u0001", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col)))
    own = [F.col(c).alias(f"_keep_{c}") for c in keep]
    full = docs.select(*own, F.col(source_col).alias("source"), key.alias("key"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), order.alias("order"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))
    full = full.withColumn("slice", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    rows, measures = full.select("source", "key", "size", "order", "slice"), {"n": F.count(F.lit(1)), "words": F.sum("size")}
    if wide:
        rows, measures["bytes"] = full.select(*rows.columns, "bytes"), F.sum("bytes")
    narrow, seen = settled(rows, **measures)
    full = full.drop("bytes")
    sums = narrow.groupBy("key", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), passes).select("key", "source_size", "target")
    before = F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    slices = cut_lineage(sums.select("key", "slice", before.alias("before")).join(targets, "key"), seen["n"])

    def timed(rows: DataFrame) -> DataFrame:
        within = W.partitionBy("key", "slice").orderBy("order", "size").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("own", F.sum("size").over(within)).join(slices, ["key", "slice"])
        return _finish_times(rows.withColumn("cum", F.col("own") + F.col("before")), passes)

    budget = seen["words"] or 0
    v, o, s = _last_taken(timed(narrow.drop("source", "bytes")), budget, passes)
    taken = lambda x: (x < v) | ((x == v) & ((F.col("order") < o) | ((F.col("order") == o) & (F.col("size") <= s))))
    copies = F.size(F.filter("finish", taken)).cast("long")
    out = timed(full).withColumn("copies", copies)
    out = in_large_files(out, seen["bytes"] or 0) if wide else out
    return out.select(*(F.col(f"_keep_{c}").alias(c) for c in keep), *(F.col(c).alias(c + suffix) for c in ("size", "source_size", "target", "copies")), (F.col("copies") * F.col("size")).alias("taken" + suffix))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents"), ["doc_id"]).drop("copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat('mix', chr(1), coalesce(CAST(doc_id AS VARCHAR), ''), chr(1), coalesce(text, ''))) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap,
             CAST(sum(source_size) OVER () AS BIGINT) AS tot FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (tot - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
             / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS lev FROM r),
lv AS (SELECT max(lev) FILTER (WHERE lev <= ratio) AS lev FROM l),
tg AS (SELECT source, source_size, tot, CASE WHEN ratio <= (SELECT lev FROM lv) THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT lev FROM lv) END AS target FROM l),
c AS (SELECT d.doc_id, d.size, d.o, tg.source_size, tg.target, tg.tot, row_number() OVER () AS rid,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source),
k AS (SELECT c.*, (cum + e * source_size) / target AS v FROM c, (VALUES (0), (1), (2)) p(e) WHERE size > 0),
a AS (SELECT rid, sum(size) OVER (ORDER BY v, o, size ROWS UNBOUNDED PRECEDING) AS upto, tot FROM k),
n AS (SELECT rid, count(*) AS copies FROM a WHERE upto <= tot GROUP BY rid)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, c.source_size, c.target, CAST(coalesce(n.copies, 0) * c.size AS BIGINT) AS taken
FROM c LEFT JOIN n USING (rid)
"""
