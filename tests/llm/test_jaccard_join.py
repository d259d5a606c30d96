import random
import re
from collections import defaultdict

import numpy as np
from llm_fixtures import empty, odd, odd_rows

from massloom.llm import op6_jaccard_join as J

SF = "/root/testdata/sf0.01"


def shingle_set(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(rows):
    """(links, class) per position, by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a):
                shared[h[b], h[a]] += 1
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return links, [least[root(i)] for i in range(len(rows))]


def compare(found, rows):
    links, classes = brute(rows)
    got = {r["id"]: (r["n_links"], r["class_id"]) for r in found}
    assert len(got) == len(rows)
    assert got == {d: (links[i], classes[i]) for i, (d, _) in enumerate(rows)}


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    compare(J.jaccard_classes(docs).collect(), rows)


def test_large_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base, passage = rng.choices(words, k=200), rng.choices(words, k=40)
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join([*rng.choices(words, k=150), *passage])) for i in range(300)]
    rows += [(2000 + i, "one two three four five six") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    compare(J.jaccard_classes(df, block=64).collect(), rows)
    kept = J.keep_one_of_each_class(df)
    links, classes = brute(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(classes))


def test_pair_links_match_plain_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50))).astype(np.uint64)) for _ in range(40)]
    for n in (5, 40):
        got = J.pair_links(sets[:n], 0.3)
        for i in range(n):
            for j in range(n):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                assert got[i, j] == (i != j and len(a & b) >= 0.3 * len(a | b) - 1e-9)


def test_sketches_estimate_similarity_within_the_margin():
    rng = np.random.default_rng(1)
    for n in (1, 6, 40, 300, 5000):
        for _ in range(20):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = a.copy()
            b[: n // 9] = rng.integers(0, 1 << 62, n // 9)
            pair = np.stack([np.frombuffer(J.sketch(np.unique(x)), np.uint8) for x in (a, b)])
            assert J.alike(pair, J.THRESHOLD - J.MARGIN)[0, 1]
        far = np.stack([np.frombuffer(J.sketch(np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))), np.uint8) for _ in range(2)])
        assert not J.alike(far, 0.5)[0, 1]


def test_odd_and_empty_tables(spark):
    got = J.jaccard_classes(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    ones = [r for r in got if r["id"] in (3, 4) and r["n_shingles"]]
    assert {r["class_id"] for r in ones} == {3} and {r["n_links"] for r in ones} == {3}
    assert all(r["n_links"] == 0 and r["class_id"] == r["id"] for r in got if not r["n_shingles"])
    assert J.jaccard_classes(empty(spark)).count() == 0
    kept = J.keep_one_of_each_class(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sum(r["text"] == "one" for r in kept.collect()) == 1


def test_columns_may_have_any_name(spark):
    rows = [(1, "a b c d e f g", "mine1", "x"), (2, "a b c d e f g", "mine2", "y"), (3, None, "mine3", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_key` string, `of_id` string").withColumnRenamed("of_id", "row")
    assert sorted(map(tuple, J.keep_one_of_each_class(df).collect())) == [rows[0], rows[2]]


def test_a_block_is_bounded_by_its_shingles_too(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=400)
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(400)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 2000)
    compare(J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
