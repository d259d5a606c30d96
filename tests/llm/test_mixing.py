import hashlib
import re

from llm_fixtures import empty, odd, odd_rows

from massloom.llm.op8_mixing import mix_plan, op8_mixing

SF = "/root/testdata/sf0.01"


def brute(rows):
    """(taken in all, targets) by plain loops."""
    docs = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, hashlib.md5(f"mix\1{'' if d is None else d}\1{t or ''}".encode()).hexdigest()) for d, t, s in rows]
    sizes = {}
    for _, n, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total = sum(sizes.values())
    target, open_ = {}, set(names)
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / w for s in open_})
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.discard(s)
    copies = []
    for s in names:
        cum = 0
        for d, n, _, o in sorted((x for x in docs if x[2] == s), key=lambda x: (x[3], x[1])):
            cum += n
            copies += [((cum + e * sizes[s]) / target[s], o, n, d) for e in range(3) if n]
    taken, used = {}, 0
    for _, _, n, d in sorted(copies, key=lambda c: c[:3]):
        if used + n > total:
            break
        used += n
        taken[d] = taken.get(d, 0) + n
    return taken, target, sizes


def test_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    taken, target, sizes = brute(rows)
    got = op8_mixing(spark, SF).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == taken
    source = {d: s for d, _, s in rows}
    for r in got:
        assert abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["taken"] <= 3 * r["size"]
    sums = {}
    for r in got:
        sums[source[r["doc_id"]]] = sums.get(source[r["doc_id"]], 0) + r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(sums[s] - target[s]) <= largest for s in target)


def test_a_full_source_is_taken_three_times(spark):
    rows = [(1, "a b", "big0"), (2, "c d " * 500, "big1"), (3, "e f " * 500, "zz"), (4, None, None), (5, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mix_plan(df, ["doc_id"]).collect()}
    assert got[1] == 6 and got[4] == 0 and got[5] == 3


def test_odd_and_empty_tables(spark):
    got = mix_plan(odd(spark), odd(spark).columns, suffix="_mix").collect()
    assert len(got) == len(odd_rows()) and all(r["size"] in (1, 7) for r in got)
    assert mix_plan(empty(spark), ["doc_id"]).count() == 0


def test_wide_results_are_in_a_partition_for_each_core_at_least(spark):
    from massloom.llm.common import in_large_files

    rows = spark.range(0, 1000, 1, 64)
    assert in_large_files(rows, 0).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert in_large_files(rows, 20 << 24).rdd.getNumPartitions() == 20
