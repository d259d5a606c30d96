import random

import public_tokenizers
from llm_fixtures import empty, odd, odd_rows
from tokenizers import Tokenizer

from massloom.llm import op10_token_counts as T
from massloom.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.01"


def plain(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_tree_follows_random_edits():
    rng, encoder = random.Random(2), WordEncoder()
    pieces = ["word", " ", "\n", "  two three", "éß", "", "x" * 700, " <|endoftext|> ", "it's", "1 2 3 " * 200]
    for _ in range(6):
        text = " ".join(rng.choice(["alpha", "be", "gamma\n", "de,lta"]) for _ in range(rng.randint(0, 400)))
        tree = T.plant(text, encoder)
        for _ in range(40):
            at, n, s = rng.randint(-3, len(text) + 5), rng.choice([0, 1, 7, 300, 2000]), rng.choice(pieces)
            at0 = max(0, min(at, len(text)))
            want = text[:at0] + s + text[at0 + n :]
            text, tree, _ = T.edit(text, tree, at, n, s, encoder)
            assert text == want and tree.chars[1] == len(text)
            assert tree.tokens[1] == plain(text)
            assert all(tree.chars[k] == tree.chars[2 * k] + tree.chars[2 * k + 1] for k in range(1, tree.size))


def test_an_edit_encodes_little():
    encoder = WordEncoder()
    text = "some words " * 5000
    _, _, encoded = T.edit(text, T.plant(text, encoder), 30_000, 3, "new", encoder)
    assert encoded < 4 * T.LEAF_CHARS


def test_query_equals_full_recount(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = T.with_made_edits(T.plant_trees(docs, ["doc_id"]), "doc_id")
    want = {}
    for r in trees.limit(150).collect():
        text = r["_text"]
        before = plain(text)
        for e in r["edits"]:
            text = text[: e["position"]] + e["inserted"] + text[e["position"] + e["deleted"] :]
        want[r["doc_id"]] = (len(r["edits"]), before, plain(text), len(text))
    got = T.op10_token_counts(spark, SF).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: (r["n_edits"], r["tokens_before"], r["tokens_after"], r["chars_after"]) for r in got}
    assert all(by[d] == w for d, w in want.items())


def test_odd_and_empty_tables(spark):
    got = T.apply_edits(T.with_made_edits(T.plant_trees(odd(spark), ["doc_id", "size"]), "doc_id"), ["doc_id", "size"]).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r["tokens_after"] == plain(r["_text"]) == sum(r["leaf_tokens"])
    assert T.apply_edits(T.with_made_edits(T.plant_trees(empty(spark), ["doc_id"]), "doc_id"), ["doc_id"]).count() == 0
