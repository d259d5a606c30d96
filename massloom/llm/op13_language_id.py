"""Language ID by prediction by partial matching (PPM).

Each language has a variable-order byte context tree: for every context of up to ``ORDER`` bytes,
how often each byte followed it in the training texts. The code of a byte in a context that the
tree holds takes (2c - 1) / 2n of the probability if the byte was seen there c times of n; else
the escape of the context, d / 2n for its d different bytes, is coded and the context loses its
first byte. A context that the tree lacks is shortened without a code. Under the empty context's
escape all 256 bytes are alike. Statistics are frozen, and seen bytes aren't excluded after an
escape, so a text's exact code length is a sum over its places, and the language of the shortest
code wins; equal lengths go to the least name by code point. The score is the posterior
probability of that language if all are alike beforehand.

Training counts cover whole texts of all training rows: places are counted per task, then summed
per language and place, so what is shuffled grows with the different places, and a language or
source with most rows is aggregated before. The trees are broadcast; ``MODEL_CELLS`` bounds them:
contexts seen fewer than the least power of two that fits are left out in all languages at once
(shorter ones then serve; the empty one always stays). Of more than ``MOST_LANGS`` languages
those with most bytes are learned.

Texts are put in lower case first. Languages are learned only from rows with a language whose
crc32(id as text) mod 4 is not 2; a null id counts as not held out. A null text or one without a
letter teaches nothing and is ``und``, score 0; so is any text if nothing was learned. Very
long texts are counted and scored whole, in windows. Repeated rows count and are scored once
each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import crc_mod, cut_lineage, read_table, settled

#: Bytes of a context at most; log-probabilities in the model at most; languages at most.
ORDER, MODEL_CELLS, MOST_LANGS = 4, 1 << 22, 1024
#: Places handled at once; different places that a task holds before it hands them on.
WINDOW, PENDING = 1 << 19, 1 << 21
#: What stands before a text.
BEFORE = 10
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, in lower case, and where each begins (and the last ends)."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    _, offsets, data = low.buffers()
    starts = np.frombuffer(offsets, np.int64)[low.offset : low.offset + len(low) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def places(data: np.ndarray, starts: np.ndarray, lo: int, hi: int, order: int = ORDER) -> np.ndarray:
    """For bytes lo to hi: each with the ``order`` bytes before it in its text, as one number."""
    out = data[lo:hi].astype(np.uint64)
    near = starts[np.searchsorted(starts, lo - order) : np.searchsorted(starts, hi)]
    for j in range(1, order + 1):
        prev = np.full(hi - lo, BEFORE, np.uint64)
        skip = min(max(0, j - lo), hi - lo)
        prev[skip:] = data[lo - j + skip : max(0, hi - j)]
        for t in range(j):
            at = near + t - lo
            prev[at[(at >= 0) & (at < hi - lo)]] = BEFORE
        out |= prev << np.uint64(8 * j)
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.diff(keys, prepend=~keys[:1]))[0]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class PlaceCounts:
    """Counts of places by language, handed on when they are many."""

    def __init__(self, order: int = ORDER, pending: int = PENDING):
        self.order, self.pending, self.held, self.n = order, pending, {}, 0

    def add(self, lang: str, data: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(int(starts[0]), int(starts[-1]), WINDOW):
            keys, counts = np.unique(places(data, starts, lo, min(lo + WINDOW, int(starts[-1])), self.order), return_counts=True)
            self.held.setdefault(lang, []).append((keys, counts))
            self.n += len(keys)
            if self.n > self.pending:
                self._merge()
                if self.n > self.pending // 2:
                    yield from self.rows()

    def _merge(self) -> None:
        self.held = {lang: [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))] for lang, parts in self.held.items()}
        self.n = sum(len(keys) for ((keys, _),) in self.held.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for lang, ((keys, counts),) in self.held.items():
            for lo in range(0, len(keys), 1 << 16):
                k, c = keys[lo : lo + (1 << 16)], counts[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["lang", "place", "n"])
        self.held, self.n = {}, 0


def place_counts(train: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, place, n) over all rows (lang, text): how often each byte followed each context of ``order`` bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PlaceCounts(order)
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                yield from held.add(lang, *lowered(batch.column(1).filter(pc.equal(langs, lang))))
        yield from held.rows()

    return train.select("lang", "text").mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


class PlaceTable:
    """Numbers to rows by open addressing: ``find`` gives row numbers, -1 for absent ones."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys, self.row = np.full(1 << self.bits, _EMPTY), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == _EMPTY
            slot, first = np.unique(at[free], return_index=True)
            took = np.nonzero(free)[0][first]
            self.keys[slot], self.row[slot] = keys[left[took]], left[took]
            stay = np.ones(len(left), bool)
            stay[took] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.row[at], -1)
        open_ = np.nonzero((seen != keys) & (seen != _EMPTY))[0]
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == keys[open_]
            out[open_[hit]] = self.row[at[hit]]
            more = ~hit & (seen != _EMPTY)
            open_, at = open_[more], at[more]
        return out


@dataclass
class ContextTrees:
    """The trees of all languages together. ``base``: log2 of each byte's probability in the empty
    context. For each longer order: a table of places with the log2 of their probability in every
    language, and one of contexts with the log2 of their escape, 0 where a language lacks the context."""

    langs: list[str]
    base: np.ndarray
    tables: list[tuple[PlaceTable, np.ndarray, PlaceTable, np.ndarray]]

    def logs(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """log2 of the probability of each place, one column per language."""
        order = len(self.tables) if order is None else order
        if order == 0:
            return self.base[(keys & np.uint64(255)).astype(np.int64)]
        by_place, values, by_context, escapes = self.tables[order - 1]
        keys = keys & np.uint64((1 << 8 * (order + 1)) - 1)
        row = by_place.find(keys)
        out = values[row]
        lost = np.nonzero(row < 0)[0]
        if len(lost):
            shorter = self.logs(keys[lost], order - 1)
            at = by_context.find(keys[lost] >> np.uint64(8))
            known = at >= 0
            shorter[known] += escapes[at[known]]
            out[lost] = shorter
        return out

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(starts) - 1, len(self.langs)))
        window = max(1 << 12, WINDOW * 4 // max(4, len(self.langs)))
        for lo in range(int(starts[0]), int(starts[-1]), window):
            hi = min(lo + window, int(starts[-1]))
            logs = self.logs(places(data, starts, lo, hi, len(self.tables)))
            a, b = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
            cuts = np.maximum(starts[a:b], lo) - lo
            full = np.nonzero(np.diff(cuts, append=hi - lo) > 0)[0]
            out[a + full] -= np.add.reduceat(logs, cuts[full], axis=0, dtype=np.float64)
        return out


def build_trees(langs: list[str], order: int, lang: np.ndarray, level: np.ndarray, place: np.ndarray, n: np.ndarray) -> ContextTrees:
    """Trees from counts: of a context of ``level`` bytes and the byte behind it (``place``) in a language (by number)."""

    def grid(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        of = level == k
        keys, row = np.unique(place[of], return_inverse=True)
        c = np.zeros((len(keys), len(langs)))
        c[row, lang[of]] = n[of]
        contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, at, c)
        np.add.at(kinds, at, c > 0)
        return keys, c, contexts, at, total, kinds

    with np.errstate(divide="ignore", invalid="ignore"):
        keys, c, _, _, total, kinds = grid(0)
        total, kinds = (x[0] if len(x) else np.zeros(len(langs)) for x in (total, kinds))
        base = np.tile(np.where(total > 0, np.log2(kinds / (2 * total)), 0) - 8, (256, 1))
        base[keys.astype(np.int64)] = np.where(c > 0, np.log2((2 * c - 1) / (2 * total)), base[keys.astype(np.int64)])
        trees = ContextTrees(langs, base, [])
        for k in range(1, order + 1):
            keys, c, contexts, at, total, kinds = grid(k)
            escape = np.where(total > 0, np.log2(kinds / (2 * total)), 0)
            shorter = trees.logs(keys) if len(keys) else np.zeros((0, len(langs)))
            value = np.where(c > 0, np.log2((2 * c - 1) / (2 * total[at])), escape[at] + shorter)
            # a row of zeros at the end stands for absent places, whose number is -1
            trees.tables.append((PlaceTable(keys), np.vstack([value, np.zeros((1, len(langs)))]), PlaceTable(contexts), escape))
    trees.base = base.astype(np.float32)
    trees.tables = [(a, v.astype(np.float32), b, e.astype(np.float32)) for a, v, b, e in trees.tables]
    return trees


def learn_trees(train: DataFrame, order: int = ORDER, cells: int = MODEL_CELLS, most_langs: int = MOST_LANGS) -> ContextTrees:
    """The trees of all rows (lang, text)."""
    counts = cut_lineage(place_counts(train, order))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return ContextTrees([], np.zeros((256, 0), np.float32), [])
    number = F.broadcast(train.sparkSession.createDataFrame(list(enumerate(langs)), "k int, lang string"))
    counts = counts.join(number, "lang").select("k", "place", "n")
    # shorter contexts' counts are sums over the longer ones'
    level = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")
    mask = F.element_at(F.array(*(F.lit((1 << 8 * (j + 1)) - 1) for j in range(order + 1))), F.col("level") + 1)
    levels = counts.select("k", "place", "n", level).groupBy("k", "level", F.col("place").bitwiseAND(mask).alias("place")).agg(F.sum("n").alias("n"))
    levels, seen = settled(levels, n=F.count(F.lit(1)))
    context = F.shiftright("place", 8).alias("context")
    nodes = levels.groupBy("k", "level", context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    nodes = nodes.select("k", "level", "context", "kinds", (F.length(F.bin("total")) - 1).alias("power"))
    rare, room = -1, cells // len(langs)
    if seen["n"] > room:
        of_power = {r["power"]: r["kinds"] for r in nodes.where("level > 0").groupBy("power").agg(F.sum("kinds").alias("kinds")).collect()}
        rare = next(p for p in range(0, 64) if sum(kinds for q, kinds in of_power.items() if q > p) <= room)
        common = nodes.where((F.col("power") > rare) | (F.col("level") == 0)).select("k", "level", "context")
        levels = levels.withColumn("context", context).join(common, ["k", "level", "context"])
    found = levels.select("k", "level", "place", "n").toArrow()
    return build_trees(langs, order, *(found.column(c).to_numpy().astype(t) for c, t in (("k", np.int64), ("level", np.int64), ("place", np.uint64), ("n", np.int64))))


def verdicts(trees: ContextTrees, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the language with the shortest code, and its posterior probability."""
    best = bits.argmin(axis=1)
    lead = bits - bits[np.arange(len(bits)), best][:, None]
    return best, 1 / np.exp2(-lead).sum(axis=1)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, order: int = ORDER, cells: int = MODEL_CELLS, most_langs: int = MOST_LANGS) -> DataFrame:
    """id, held_out, lang_pred, score, and bits: the code length of the text in that language, null if ``und``."""
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    rows = docs.select(key.alias("id"), F.coalesce(crc_mod(key, folds) == held, F.lit(False)).alias("held_out"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    trees = learn_trees(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()), order, cells, most_langs)
    if not trees.langs:
        return rows.select("id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            bits = trees.code_lengths(*lowered(batch.column(2)))
            best, p = verdicts(trees, bits)
            none = np.asarray(pc.is_null(batch.column(2)))
            names = pa.array(["und" if x else trees.langs[k] for k, x in zip(best, none, strict=True)], pa.string())
            least = pa.array(bits.min(axis=1, initial=np.inf), mask=none)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(np.where(none, 0.0, p)), least], names=["id", "held_out", "lang_pred", "score", "bits"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(score, f"id {kind}, held_out boolean, lang_pred string, score double, bits double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
