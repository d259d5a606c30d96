"""Fill-in-middle transformation by escaped marker injection, in column expressions only.

A text is cut into units, lines with their ends by default. The characters of the marker are
escaped, ``regexp_replace`` puts the marker behind every unit, its occurrences are counted, two
ranks are drawn from a hash of the seed and the document's id, ``substring_index`` takes what
lies before, between and behind the markers of these ranks, and the parts are unescaped and
joined with sentinels: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm), or ``<S>`` suffix
``<P>`` prefix ``<M>`` middle (spm). A text that is empty or holds a sentinel stays plain, as do
those beyond the rate. ``restored`` turns an output back into its text by the sentinels alone.

No row is shuffled, and a text is handled whole, whatever its length; a text without a line end
is one unit. A null text counts as empty. A null id is hashed as an empty one. Repeated rows are
transformed once each, alike (there are no other ties: draws come from the id alone); an empty
table gives no rows. Columns of ``keep`` pass through; ``suffix`` marks the new columns' names
for tables that have such names themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import once, read_table

#: A unit: a line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of these in the suffix-first form; the draws' seed.
RATE, SPM_RATE, SEED = 100, 50, "7"
#: Behind every unit stands the marker; it and the escape character are escaped in the text.
MARKER, ESCAPE = "\u0001", "\u0002"
FORMS = ("plain", "psm", "spm")


def escaped(text: Column) -> Column:
    """The text without any marker in it."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARKER), F.lit(ESCAPE + "m"))


def unescaped(part: Column) -> Column:
    """What ``escaped`` was given, less the markers put in since."""
    bare = F.replace(part, F.lit(MARKER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "m"), F.lit(MARKER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def draws(id_col: Column, seed: str = SEED) -> Column:
    """Four unsigned 32-bit numbers of an id: the first groups of the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def _between(marked: str, low: str, high: str) -> Column:
    """The units of ranks low + 1 to high of a marked text."""
    # all before the marker of rank ``high``, of which the last high - low units
    return F.when(F.col(high) > F.col(low), F.expr(f"substring_index(substring_index({marked}, '{MARKER}', {high}), '{MARKER}', {low} - {high})")).otherwise(F.lit(""))


def fill_in_middle(
    docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: str = SEED, unit: str = LINES, suffix: str = ""
) -> DataFrame:
    """The columns of ``keep``, and n_units, form, output, prefix, middle and suffix (these three null if plain)."""
    held = [F.col(f"`{c}`").alias(f"_keep_{k}") for k, c in enumerate(keep)]
    names = [f"_keep_{k}" for k in range(len(keep))]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(*held, text.alias("_text"), draws(F.col(f"`{id_col}`"), seed).alias("_h"))
    marked = F.regexp_replace(escaped(F.col("_text")), unit, f"$0{MARKER}")
    rows = rows.select(*names, "_text", "_h", once(marked).alias("_marked"))
    rows = rows.select(*names, "_text", "_h", "_marked", once(F.length("_marked") - F.length(F.replace("_marked", F.lit(MARKER), F.lit("")))).alias("_n"))
    first, second = (F.col("_h")[k] % (F.col("_n") + 1) for k in range(2))
    plain = (F.col("_text") == "") | F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE) | (F.col("_h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h")[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select(*names, "_text", "_marked", "_n", form.alias("_form"), F.least(first, second).cast("int").alias("_a"), F.greatest(first, second).cast("int").alias("_b"), F.lit(0).alias("_0"))
    told = lambda part: once(F.when(F.col("_form") != "plain", unescaped(part)))
    rows = rows.select(*names, "_text", "_n", "_form", told(_between("_marked", "_0", "_a")).alias("_prefix"), told(_between("_marked", "_a", "_b")).alias("_middle"), told(_between("_marked", "_b", "_n")).alias("_suffix"))
    psm = F.concat(F.lit(PREFIX), "_prefix", F.lit(SUFFIX), "_suffix", F.lit(MIDDLE), "_middle")
    spm = F.concat(F.lit(SUFFIX), "_suffix", F.lit(PREFIX), "_prefix", F.lit(MIDDLE), "_middle")
    output = F.when(F.col("_form") == "psm", psm).when(F.col("_form") == "spm", spm).otherwise(F.col("_text"))
    new = {"n_units": F.col("_n").cast("long"), "form": F.col("_form"), "output": once(output), "prefix": F.col("_prefix"), "middle": F.col("_middle"), "suffix": F.col("_suffix")}
    return rows.select(*(F.col(h).alias(c) for h, c in zip(names, keep, strict=True)), *(value.alias(c + suffix) for c, value in new.items()))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its form and sentinels alone."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    # the middle comes last in both forms; only the order of the other two differs
    ahead = lambda mark: F.substring_index(rest, mark, 1)
    behind = lambda mark: F.substr(rest, F.length(ahead(mark)) + len(mark) + 1)
    psm_tail, spm_tail = behind(SUFFIX), behind(PREFIX)
    middle = lambda tail: F.substr(tail, F.length(F.substring_index(tail, MIDDLE, 1)) + len(MIDDLE) + 1)
    psm = F.concat(ahead(SUFFIX), middle(psm_tail), F.substring_index(psm_tail, MIDDLE, 1))
    spm = F.concat(F.substring_index(spm_tail, MIDDLE, 1), middle(spm_tail), ahead(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"), ["doc_id"])
    made = made.withColumn("restored", once(restored(F.col("output"), F.col("form"))))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    chars = lambda c: F.length(c).cast("long")
    return made.select("doc_id", F.col("n_units").alias("n"), "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n,
         CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS r3, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS r4
  FROM d),
f AS (
  SELECT doc_id, t, n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 100 THEN 'plain' WHEN r4 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1:n], '') AS x
  FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m WHEN 'spm' THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
