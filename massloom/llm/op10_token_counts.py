"""Edit-aware token counts.

A document's text is cut behind white space into leaves of about ``LEAF_CHARS`` characters.
The tokenizer splits at white space, so tokens of a text are the sum of those of its leaves. A
segment tree holds sums of characters and of tokens over the leaves. An edit (position,
characters to delete, text to insert) descends by characters to the leaves that it touches;
only these are encoded again, and following ones while the region no longer ends in white
space. The new region takes the same leaves where it fits, and the sums above them change; a
region that has outgrown its leaves gets new ones, without encoding any other.

Positions count code points in the text as earlier edits left it, and are clipped to it. Null
texts are empty; null or empty edits change nothing, a null position is 0, null deletions and
insertions are none. Repeated rows are handled once each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import chunks, read_table
from massloom.llm.tokens import WORD_BPE, WordEncoder

LEAF_CHARS, GROWN = 256, 8
_GAP = re.compile(r"[ \n]")


def cut(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Parts of at least ``size`` characters, each up to and with the next white space."""
    parts, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + size - 1)
        end = gap.end() if gap else len(text)
        parts.append(text[at:end])
        at = end
    return parts or [""]


class CountTree:
    """Sums of characters and tokens over leaves."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << (len(chars) - 1).bit_length()
        self.leaves = len(chars)
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last leaf with any; and where it starts."""
        offset = max(0, min(offset, self.chars[1] - 1))
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if offset - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.size
        more_chars, more_tokens = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more_chars
            self.tokens[k] += more_tokens
            k //= 2

    def leaf_lists(self) -> tuple[list[int], list[int]]:
        a, b = self.size, self.size + self.leaves
        return self.chars[a:b], self.tokens[a:b]


def count_tokens(encoder: WordEncoder, texts: list[str]) -> list[int]:
    return [len(x) // 4 for x in encoder.encode(texts)]


def plant(text: str, encoder: WordEncoder) -> CountTree:
    parts = cut(text)
    return CountTree([len(p) for p in parts], count_tokens(encoder, parts))


def edit(text: str, tree: CountTree, position: int, deleted: int, inserted: str, encoder: WordEncoder) -> tuple[str, CountTree, int]:
    """The new text, its tree, and how many characters were encoded."""
    position = max(0, min(position, len(text)))
    end = min(position + max(0, deleted), len(text))
    first, start = tree.find(position)
    last, stop = tree.find(max(position, end - 1))
    stop += tree.chars[tree.size + last]
    region = text[start:position] + inserted + text[end:stop]
    while region and region[-1] not in " \n" and last + 1 < tree.leaves:
        last += 1
        following = tree.chars[tree.size + last]
        region += text[stop : stop + following]
        stop += following
    slots = last - first + 1
    parts = cut(region, max(1, -(-len(region) // slots)))
    text = text[:position] + inserted + text[end:]
    if len(parts) <= slots and max(map(len, parts)) <= GROWN * LEAF_CHARS:
        parts += [""] * (slots - len(parts))
        for leaf, part, tokens in zip(range(first, last + 1), parts, count_tokens(encoder, parts), strict=True):
            tree.put(leaf, len(part), tokens)
    else:
        parts = cut(region)
        chars, tokens = tree.leaf_lists()
        chars[first : last + 1] = [len(p) for p in parts]
        tokens[first : last + 1] = count_tokens(encoder, parts)
        tree = CountTree(chars, tokens)
    return text, tree, len(region)


def plant_trees(docs: DataFrame, keep: list[str], text_col: str = "text", tokenizer: str = WORD_BPE) -> DataFrame:
    """The columns of ``keep``, text, and the leaves of its tree: leaf_chars, leaf_tokens."""
    own = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer)
        for whole in batches:
            for batch in chunks(whole, whole.num_columns - 1, 256):
                parts = [cut(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                flat = iter(count_tokens(encoder, [p for ps in parts for p in ps]))
                of = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[len(p) for p in ps] for ps in parts], of), pa.array([[next(flat) for _ in ps] for ps in parts], of)], names=[*batch.schema.names, "leaf_chars", "leaf_tokens"])

    return own.mapInArrow(build, f"{out}, leaf_chars array<int>, leaf_tokens array<int>")


def apply_edits(trees: DataFrame, keep: list[str], edits_col: str = "edits", tokenizer: str = WORD_BPE) -> DataFrame:
    """What plant_trees gives, with a column of edits, array of struct(position, deleted, inserted):
    the columns of ``keep``, the new _text and leaves, n_edits, tokens_before, tokens_after and encoded_chars."""
    own = trees.select(*keep, "_text", "leaf_chars", "leaf_tokens", F.col(edits_col).alias("_edits"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer)
        for whole in batches:
            for batch in chunks(whole, len(keep), 256):
                out = []
                for text, chars, tokens, edits in zip(*(c.to_pylist() for c in batch.columns[len(keep) :]), strict=True):
                    tree, encoded = CountTree(chars, tokens), 0
                    before = tree.tokens[1]
                    for e in edits or []:
                        text, tree, n = edit(text, tree, e["position"] or 0, e["deleted"] or 0, e["inserted"] or "", encoder)
                        encoded += n
                    out.append((text, *tree.leaf_lists(), len(edits or []), before, tree.tokens[1], encoded))
                types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[*keep, "_text", "leaf_chars", "leaf_tokens", "n_edits", "tokens_before", "tokens_after", "encoded_chars"])

    return own.mapInArrow(change, f"{kept}{', ' if keep else ''}_text string, leaf_chars array<int>, leaf_tokens array<int>, n_edits long, tokens_before long, tokens_after long, encoded_chars long")


def with_made_edits(trees: DataFrame, id_col: str) -> DataFrame:
    """One to four edits per document, made from hashes of its id: places, deletions of up to 39
    characters, and insertions of words, of parts of a word, and of nothing."""
    n = F.greatest(F.length("_text"), F.lit(1))

    def one(j):
        key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), j.cast("string"))
        word = F.substring(F.md5(key), 1, 9)
        text = F.when(j % 3 == 0, F.concat(F.lit(" "), word, F.lit("\n"))).when(j % 3 == 1, word).otherwise(F.lit(""))
        return F.struct(F.pmod(F.xxhash64(key), n).alias("position"), F.pmod(F.xxhash64(key, F.lit("d")), F.lit(40)).alias("deleted"), text.alias("inserted"))

    times = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(4)).cast("int")
    return trees.withColumn("edits", F.transform(F.sequence(F.lit(0), times), one))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = plant_trees(read_table(spark, sf_dir, "documents"), ["doc_id"])
    found = apply_edits(with_made_edits(trees, "doc_id"), ["doc_id"])
    return found.select("doc_id", "n_edits", "tokens_before", "tokens_after", F.length("_text").cast("long").alias("chars_after"), "encoded_chars")
