import math
import re
from collections import Counter

import numpy as np
from llm_fixtures import empty, odd, odd_rows

from massloom.llm import op3_quality_rules as Q

SF = "/root/testdata/sf0.01"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def same_base(r, text):
    want = base(text)
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
    assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert not (r["base_failed"] and r["kept"])


def test_base_statistics_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = Q.op3_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        same_base(r, texts[r["doc_id"]])


def test_odd_and_empty_tables(spark):
    want = sorted((base(r[1]) for r in odd_rows()))
    got = Q.quality_verdicts(odd(spark), ["doc_id"]).collect()
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    wide = Q.quality_verdicts(odd(spark), odd(spark).columns, wide=True)
    assert sorted(r["n_words"] for r in wide.collect()) == [w[0] for w in want]
    assert Q.quality_verdicts(empty(spark), ["doc_id"]).count() == 0


def numpy_mcd(x):
    """The same steps on a matrix of whole-number vectors."""
    floors = np.array([s * Q.UNIT for _, s in Q.STATS])

    def floored(c):
        c = np.array(c, float)
        np.fill_diagonal(c, np.maximum(np.diag(c), 0) + floors**2)
        return c

    def estimate(sub, scale):
        return sub.mean(0), floored((sub.T @ sub / len(sub) - np.outer(sub.mean(0), sub.mean(0))) * scale)

    def d2(m, c):
        return np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)

    def half(v):
        return np.sort(v)[-(-len(v) // 2) - 1]

    med = np.array([half(v) for v in x.T])
    scale = np.maximum([1.4826 * half(v) for v in np.abs(x - med).T], floors)
    z = (x - med) / scale
    far = (z * z).sum(1)
    signs = z / np.sqrt(np.where(far > 0, far, 1))[:, None]
    both = np.outer(scale, scale)
    t = np.tanh(z)
    starts = [estimate(x, 1.0), (med, floored(np.eye(5) * both)), (med, floored(signs.T @ signs / len(x) * 5 * both)), (med, floored((t.T @ t / len(x) - np.outer(t.mean(0), t.mean(0))) * both))]
    logdet = lambda e: np.linalg.slogdet(e[1])[1]
    for step in range(1, Q.STEPS + 1):
        new = []
        for m, c in starts:
            bins = np.floor(np.log1p(d2(m, c)) * 16)
            edge = np.sort(bins)[math.ceil(Q.SUBSET * len(x)) - 1]
            new.append(estimate(x[bins <= edge], Q.CONSISTENCY))
        fell = any(logdet(b) < logdet(a) - 2 * Q.FALL for a, b in zip(starts, new, strict=True))
        starts = sorted(new, key=logdet)[: Q.GO_ON] if step == Q.FIRST_STEPS else new
        if step > Q.FIRST_STEPS and not fell:
            break
    m, c = min(starts, key=logdet)
    return d2(*estimate(x[d2(m, c) <= Q.WITHIN], Q.WITHIN_CONSISTENCY))


def test_distances_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        n = int(rng.integers(60, 300))
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(n)]
        if i % 10 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in Q.quality_verdicts(df, ["doc_id"]).collect()}
    stats = np.array([[got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_upper"], got[i]["n_repeat_words"], got[i]["n_dup_lines"], got[i]["n_lines"]] for i in range(400)], float)
    n, chars, sym, up, rep, dup, lines = stats.T
    x = np.stack([np.log((chars + 100) / (n + 20)), np.log1p(10 * sym / (chars + 60)), np.log1p(up / (chars + 60)), np.log1p(rep / (n + 20)), np.log1p(dup / (lines + 3))], 1)
    x = np.floor(x * Q.UNIT + 0.5)
    np.testing.assert_allclose([got[i]["d2"] for i in range(400)], numpy_mcd(x), rtol=1e-6, atol=1e-6)
    assert not any(got[i]["kept"] for i in range(0, 400, 10))
    assert all(got[i]["kept"] for i in range(400) if i % 10)


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_verdicts(docs, ["doc_id"]).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.002 * n[1, True]
    assert n.get((0, True), 0) <= 0.02 * n[0, False]


def test_a_third_of_a_source_as_one_cluster_of_junk_is_rejected(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        n = int(rng.integers(60, 300))
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(n)]
        if i % 20 < 7:
            words = [w + "#" * int(rng.integers(2, 5)) for w in words]
        rows.append((i, " ".join(words), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in Q.quality_verdicts(df, ["doc_id"]).where("kept").collect()}
    assert not any(i % 20 < 7 for i in kept)
    assert len(kept) >= 0.99 * sum(i % 20 >= 7 for i in range(600))


def test_columns_may_have_any_name(spark):
    rows = [(i, "some words that go on " * 3 + f"w{i}", "en", "s", i, "x", 5) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long, grp string, d2 int")
    got = Q.quality_verdicts(df, df.columns, wide=True)
    assert sorted((r["kept"], r["grp"], r["d2"]) for r in got.collect()) == [(i, "x", 5) for i in range(30)]
