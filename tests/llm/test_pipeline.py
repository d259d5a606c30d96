"""The stages, each held to a plain version on its own input."""

import re

import corpus_pipeline
from llm_fixtures import empty, odd
from test_jaccard_join import brute as jaccard_brute
from test_mixing import brute as mixing_brute
from test_quality_rules import base
from test_secrets import brute as secret_brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == COLUMNS
        seen.append(docs.collect())
    raw, good, single, clean, mixed, pieces = seen

    kept = {r["doc_id"] for r in good}
    for r in raw:
        n, _, _, _, repeated = base(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert r["doc_id"] not in kept
    assert len(kept) > 0.5 * len(raw)

    _, classes = jaccard_brute([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted(set(classes))

    texts = {r["doc_id"]: r["text"] for r in single}
    assert len(clean) == len(single)
    for r in clean:
        assert not secret_brute(r["text"]) and r["n_chars"] == len(r["text"])
        if not secret_brute(texts[r["doc_id"]]) and "[SECRET]" not in r["text"]:
            assert r["text"] == texts[r["doc_id"]]

    taken, _, _ = mixing_brute([(r["doc_id"], r["text"], r["source"]) for r in clean])
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in clean}
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {d: t // size[d] for d, t in taken.items()}

    want = {}
    for r in mixed:
        want.setdefault(r["doc_id"], []).append(r["text"])
    assert {p["doc_id"] for p in pieces} == set(want)
    once = [p for p in pieces if len(want[p["doc_id"]]) == 1]
    assert sum(p["length"] for p in once) == sum({p["doc_id"]: p["doc_tokens"] for p in once}.values())


def test_run_and_odd_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for make in (odd, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, SF)
            assert docs.columns == make(spark).columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        corpus_pipeline.packing(spark, docs, SF).count()


def test_columns_of_any_name_pass_through(spark):
    texts = [" ".join(f"w{i}x{k * (i + 3)}" for k in range(60 if i % 2 else 10)) for i in range(8)]
    rows = [(i, t, "en", "s", 1, i % 3 == 0, i, "m", "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, `a.b` int, `row` string, base_failed string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name == "quality_rules":
            # the stage's own verdict, not the table's column, decides
            assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3, 5, 7]
    assert all(r["a.b"] == r["doc_id"] and r["kept"] == (r["doc_id"] % 3 == 0) and r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert corpus_pipeline.packing(spark, docs, SF).count() > 0
