import hashlib
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_fixtures import empty, odd, odd_rows
from pyspark.sql import functions as F

from massloom.llm.op12_fill_in_middle import ORACLE_SQL, fill_in_middle, op12_fill_in_middle, restored

SF = "/root/testdata/sf0.01"


def brute(doc_id, text, rate=100, spm_rate=50, seed="7"):
    """(n, form, prefix, middle, suffix, output) by slices of a list."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force_and_sql(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in rows:
        n, form, p, m, _, out = brute(d, t)
        want.append((d, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or "")))
    got = sorted(map(tuple, op12_fill_in_middle(spark, SF).collect()))
    assert got == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert sorted(con.execute(ORACLE_SQL).fetchall()) == got
    assert {"psm", "spm"} <= {r[2] for r in got}


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_in_middle(df, ["doc_id", "text"], **kw).withColumn("back", restored(F.col("output"), F.col("form")))
    for r in made.collect():
        assert (r["n_units"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) == brute(r["doc_id"], r["text"], **kw)
        assert r["back"] == (r["text"] or "")


def test_markers_and_sentinels_in_texts(spark):
    pieces = ["\u0001", "\u0002", "\u0002m", "\u0002e", "\u0001\u0002", "<", "<S", "<P", "<M", ">", "\n", "\r\n", "$0", "\\1", "\U0001f600", "é", "<P>", "<S>", "<M>"]
    rows = [(i, f"{a}{b}\n{c}{a}\n{b}") for i, (a, b, c) in enumerate((a, b, c) for a in pieces for b in pieces for c in pieces[::4])]
    check(spark, rows)
    check(spark, rows[:300], rate=40, spm_rate=0, seed="x")
    check(spark, [(1, "\n" * 5000), (2, "x" * 300_000), (3, ("a" * 99 + "\n") * 20_000)])


@pytest.mark.parametrize("spm_rate", [0, 100])
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.sampled_from("ab \n\r\u0001\u0002me<>PSM$\\é日"), max_size=60), min_size=1, max_size=40))
def test_any_text_comes_back(spark, spm_rate, texts):
    check(spark, list(enumerate(texts)), spm_rate=spm_rate)


def test_odd_and_empty_tables(spark):
    df = odd(spark).withColumn("form", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("_text", F.lit("t")).withColumn("_keep_0", F.lit(2))
    got = fill_in_middle(df, df.columns, suffix="_fim")
    assert got.columns[: len(df.columns)] == df.columns
    rows = got.collect()
    assert len(rows) == len(odd_rows()) and all(r["form"] == "mine" and r["a.b"] == 1 and r["_keep_0"] == 2 for r in rows)
    for r in rows:
        assert (r["n_units_fim"], r["form_fim"], r["prefix_fim"], r["middle_fim"], r["suffix_fim"], r["output_fim"]) == brute(r["doc_id"], r["text"])
    assert fill_in_middle(empty(spark), ["doc_id"]).count() == 0
