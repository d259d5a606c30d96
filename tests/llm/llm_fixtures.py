"""Small tables with nulls, empty and very long texts, ties, repeats and clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `start` string, grp string, `order` string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


def odd_rows():
    texts = [None, "", " \n\t ", "one", "one", "a b c d e f", "a b c d e f", LONG, "Ünïcode ŞİŞ 's 're <|endoftext|> x", "same same same same same same", "x" * 5000, "line\nline\nline\n\n", "tab\tand\x0bvertical\rreturn", "é" * 40 + " 日本語 テスト 1234"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None, 7, "s", "g", "o") for i, t in enumerate(texts)]
    return [*rows, (None, "no id here", "en", "src1", 1, 1, "", "", ""), (3, "one", "en", "src0", 1, 1, "", "", ""), (3, "one", "en", "src0", 1, 1, "", "", "")]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
