import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from llm_fixtures import empty, odd, odd_rows
from pyspark.sql import functions as F

from massloom.llm import op13_language_id as op
from massloom.llm.op13_language_id import ContextTrees, PlaceCounts, PlaceTable, identify_languages, learn_trees, lowered, op13_language_id, places

SF = "/root/testdata/sf0.01"


def low(text):
    return pc.utf8_lower(pa.array([text])).to_pylist()[0].encode()


class Brute:
    """One tree by plain dictionaries."""

    def __init__(self, texts, order=4, least=0):
        self.order, self.nodes = order, {}
        for t in texts:
            data = b"\n" * order + low(t)
            for i in range(order, len(data)):
                for k in range(order + 1):
                    node = self.nodes.setdefault(data[i - k : i], {})
                    node[data[i]] = node.get(data[i], 0) + 1
        self.nodes = {c: node for c, node in self.nodes.items() if not c or sum(node.values()) >= least}

    def bits(self, text):
        data, total = b"\n" * self.order + low(text), 0.0
        for i in range(self.order, len(data)):
            for k in range(self.order, -1, -1):
                node = self.nodes.get(data[i - k : i])
                if not node:
                    continue
                n = sum(node.values())
                if data[i] in node:
                    total -= math.log2((2 * node[data[i]] - 1) / (2 * n))
                    break
                total -= math.log2(len(node) / (2 * n))
            else:
                total += 8
        return total


TEXTS = {"aa": ["the cat sat on the mat", "The dog sat", "a", "ÉTÉ the\n\nend"], "bb": ["der hund und die katze", "und der hund\n", ""], "cc": ["zzzz zz z"], "dd": ["the hat", "the und"]}
ASKED = ["the katze", "zz", "und", "x", "ünïcode ŞİŞ 日本語", "the cat " * 200, "\x00\x01a", "Q" * 50]


def trees_of(spark, order=4, cells=1 << 20):
    rows = [(lang, t) for lang, ts in TEXTS.items() for t in ts]
    return learn_trees(spark.createDataFrame(rows, "lang string, text string"), order, cells)


def test_code_lengths_equal_plain_trees(spark, monkeypatch):
    for order in (1, 4):
        trees = trees_of(spark, order)
        assert trees.langs == ["aa", "bb", "cc", "dd"]
        want = np.array([[Brute(ts, order).bits(t) for ts in TEXTS.values()] for t in ASKED])
        for window in (1 << 19, 1, 7):
            monkeypatch.setattr(op, "WINDOW", window)
            assert np.allclose(trees.code_lengths(*lowered(pa.array(ASKED))), want, rtol=1e-5)


def test_rare_contexts_are_left_out_where_the_model_is_bounded(spark):
    trees = trees_of(spark, cells=4 * 60)
    sizes = sum(len(v) - 1 for _, v, _, _ in trees.tables)
    assert 0 < sizes <= 60
    for least in (2, 4, 8, 16, 32):
        want = np.array([[Brute(ts, 4, least).bits(t) for ts in TEXTS.values()] for t in ASKED])
        if np.allclose(trees.code_lengths(*lowered(pa.array(ASKED))), want, rtol=1e-5):
            break
    else:
        raise AssertionError("no power of two fits")


def test_probabilities_of_a_place_sum_to_one(spark):
    # escapes and bytes share one, so those of all bytes after a context can't exceed it
    trees = trees_of(spark)
    for context in (b"the ", b"zzzz", b"\n\n\n\n", b"qqqq"):
        keys = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (np.exp2(trees.logs(keys).astype(float)).sum(axis=0) <= 1 + 1e-5).all()


def test_places_and_counts(monkeypatch):
    texts = ["ab", "", "c", None, "defghi", "x" * 20, "yz"]
    data, starts = lowered(pa.array(texts))
    want = [int.from_bytes((b"\n" * 4 + t.encode())[i : i + 5], "big") for t in texts if t for i in range(len(t))]
    for step in (1, 2, 3, 5, 100):
        got = np.concatenate([places(data, starts, lo, min(lo + step, len(data))) for lo in range(0, len(data), step)])
        assert got.tolist() == want
    monkeypatch.setattr(op, "WINDOW", 3)
    held, out = PlaceCounts(pending=8), []
    out += list(held.add("l", data, starts))
    assert out
    out += list(held.rows())
    seen = {}
    for b in out:
        for k, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            seen[k] = seen.get(k, 0) + n
    assert seen == {k: want.count(k) for k in want}


def test_table():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 50_000).astype(np.uint64))
    table = PlaceTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, 50_000).astype(np.uint64), keys)
    assert (table.find(other) == -1).all()
    assert PlaceTable(keys[:0]).find(keys[:5]).tolist() == [-1] * 5


def test_query_is_right_on_held_out_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_language_id(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert len(right) > 200 and sum(right) >= 0.97 * len(right)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1


def test_labels_of_held_out_rows_and_other_columns_are_never_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a, b = (sorted(map(tuple, identify_languages(d).select("id", "lang_pred", "score").collect())) for d in (docs, other))
    assert a == b


def test_odd_and_empty_tables(spark):
    df = odd(spark).withColumn("bits", F.lit("b")).withColumn("a.b", F.lit(1)).withColumn("held_out", F.lit(1))
    got = identify_languages(df).collect()
    assert len(got) == len(odd_rows())
    letters = {r[0]: bool(r[1]) and any(c.isalpha() for c in r[1]) for r in odd_rows()}
    for r in got:
        assert (r["lang_pred"] == ("en" if letters[r["id"]] else "und")) and (r["score"] == 1.0 if letters[r["id"]] else r["score"] == 0 and r["bits"] is None)
    assert identify_languages(empty(spark)).count() == 0
    unlabelled = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in identify_languages(unlabelled).collect()} == {("und", 0.0)}
    ints = spark.createDataFrame([(1, "abc", 5), (2, "abc", 5), (None, "xyz", 7)], "doc_id int, text string, lang int")
    assert {r["lang_pred"] for r in identify_languages(ints).collect()} == {"5", "7"}


def test_equal_lengths_go_to_the_least_name():
    base = np.full((256, 2), -8, np.float32)
    best, p = op.verdicts(ContextTrees(["a", "b"], base, []), np.array([[3.0, 3.0], [5.0, 4.0], [0.0, 5000.0]]))
    assert best.tolist() == [0, 1, 0] and np.allclose(p, [0.5, 2 / 3, 1.0])
