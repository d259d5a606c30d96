"""Statistics of a text as columns, without any Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.llm.common import once, words_of

SYMBOLS = r"[#*$%&|<>]"


def repeated_words(n_words: Column, starts: Column) -> Column:
    """Words that the windows at these ascending starts cover together, three words each."""
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(F.lit(3), b - a))
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, g: s + g))


def with_text_stats(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and: n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines,
    n_repeat_words, n_distinct_words (long). A null text counts as empty.

    Each step is a projection of its own, and arrays that lambdas read are computed once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = df.select(*keep, F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), once(lines).alias("_lines"), once(words_of(F.col(text_col))).alias("_w"))
    hashes = F.when(F.size("_w") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    b = a.select(
        *keep, "n_symbols", "n_upper", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), once(hashes).alias("_h"),
    )
    done = [*keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_distinct_words"]
    # Only texts with a repeated window are sorted.
    c = b.select(*done, once(F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).alias("_s"))
    twin = lambda j, d: F.coalesce(F.get("_s", j)["h"] == F.get("_s", j + d)["h"], F.lit(False))
    order = F.when(F.size("_s") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("_s") - 1))
    d = c.select(*done, once(F.sort_array(F.transform(F.filter(order, lambda j: twin(j, -1) | twin(j, 1)), lambda j: F.get("_s", j)["i"]))).alias("_p"))
    return d.select(*done, repeated_words(F.col("n_words"), F.col("_p")).cast("long").alias("n_repeat_words"))
