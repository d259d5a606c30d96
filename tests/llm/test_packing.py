import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from llm_fixtures import empty, odd, odd_rows
from tokenizers import Tokenizer

from massloom.llm.op1_packing import best_fill, op1_packing, pack_documents, power_of_two_cuts
from massloom.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.01"


def plain():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_by_word_ids_equal_whole_text_ids(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()] + [r[1] or "" for r in odd_rows()]
    texts += ["é é ́ á", " wide space", "I'M WE'LL it's", "ΣΑΣ ΣΑΣ.", "a​b"]
    want = plain()
    for text, ids in zip(texts, WordEncoder().encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_best_fill_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = sorted(((rng.randint(1, 30), rng.randint(1, 3)) for _ in range(4)), reverse=True)
        counts = list(dict(counts).items())
        cap = rng.randint(0, 60)
        best, taken = best_fill(counts, cap)
        sums = [s for k in itertools.product(*(range(c + 1) for _, c in counts)) if (s := sum(a * b[0] for a, b in zip(k, counts, strict=True))) <= cap]
        assert best == max(sums) == sum(a * b for a, b in taken)
        assert all(b <= dict(counts)[a] for a, b in taken)


def test_power_of_two_cuts():
    assert power_of_two_cuts(9000, 4096) == [4096, 4096, 512, 256, 32, 8]


def check(rows, texts):
    tokenizer = plain()
    want = {}
    for key, text in texts:
        want.setdefault(key, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert set(by_doc) == set(want)
    for key, docs in want.items():
        expected = sorted((len(d), zlib.crc32(np.asarray(d[r["start"] : r["start"] + r["length"]], "<u4").tobytes()), r["start"]) for d in docs[:1] for r in by_doc[key]) if len(docs) == 1 else None
        if expected is not None:
            assert expected == sorted((r["doc_tokens"], r["ids_crc32"], r["start"]) for r in by_doc[key])
        assert sum(r["length"] for r in by_doc[key]) == sum(map(len, docs))
    return padding


def test_pieces_cover_every_id_once_with_little_padding(spark):
    rows = op1_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert check(rows, docs) <= 0.002 * sum(r["length"] for r in rows)


def test_odd_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = pack_documents(odd(spark)).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, [(r[0], r[1]) for r in odd_rows()])
    assert pack_documents(empty(spark)).count() == 0
