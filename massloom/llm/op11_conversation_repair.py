"""Conversation structure repair by a rank-compressed dynamic programme.

A conversation's turns are kept, rerolled, deleted, or joined by inserted ones, so that the role
initials read ``(s?(ua)+)?`` at least cost; of the cheapest ways the one with the ASCII-least
string of edit initials (the audit) is taken. A layer of the programme stands behind each turn
and has one entry per last role put out. The step to the next layer is a macro edit: a run of
none to two inserts and one edit of the turn. Written as initials the macros are a prefix-free
code, so audits compare like sequences of macros, and an entry needs no audit: it holds its
cost, the rank of its audit within the layer, and a parent pointer (entry and macro). Audits are
rebuilt backwards from the last layer. As costs and ranks relative to a layer recur, steps are
looked up once they have been worked out.

Turns are range-sorted by conversation and turn, so that a conversation of any size is spread over
partitions. A first pass keeps, for the first and last conversation of each partition only, the layer
from every entry that could come before it (16 costs and ranks); these, at most two per partition, are
chained on the driver, which says with which entries each partition begins and ends. A second
pass reconstructs edits in every partition; it holds the turns of one conversation in one partition.

Defined cases: null roles and texts are one space; a null conversation is one of its own; turns
sort with nulls first, equal ones by role, then by the text's sha256; repeated rows stay repeated,
and all but the first are duplicates. A role whose first character isn't that of the pattern, or
an empty one, can't be kept. An empty table gives no rows; very long texts are handled whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from massloom.llm.common import cut_lineage, read_table, settled

SPACES = " \t\n\x0b\x0c\r"
#: What edits cost, by initial, and what an undeleted truncated turn adds.
COSTS, TRUNCATED = {"D": 4, "I": 3, "K": 0, "R": 3}, 3
#: Faults in the order in which they count.
FAULTS = ("blank", "duplicate", "truncated")
#: Entries of a layer: the last role put out, by initial, empty before any; and the one that comes next.
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Inserts behind the last turn, by entry, that end the pattern.
ENDINGS = {"": 0, "s": 2, "u": 1, "a": 0}
MACROS = sorted(run + edit for run in ("", "I", "II") for edit in "DKR")
#: Bytes of text that a partition of sorted turns is to hold, about; rows at least; bytes of a piece of a long repaired conversation.
PART_BYTES, PART_ROWS, PIECE_BYTES = 32 << 20, 1_000, 1 << 20

#: (start, entry, cost, rank) of every reachable pair.
Layer = tuple[tuple[str, str, int, int], ...]


def beginning(*starts: str) -> Layer:
    return tuple((s, s, 0, 0) for s in starts)


def _ranked(best: dict[tuple[str, str], tuple]) -> Layer:
    """A layer from (cost, audit order, ...) of pairs: orders become dense ranks."""
    ranks = {order: k for k, order in enumerate(sorted({b[1] for b in best.values()}))}
    return tuple((*pair, b[0], ranks[b[1]]) for pair, b in sorted(best.items()))


class Steps:
    """Steps between layers, each worked out once."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, layer: Layer, initial: str, fault: str | None) -> tuple[Layer, int, dict]:
        """The next layer, with its least cost taken off and returned, and each pair's (entry before, macro)."""
        key = (layer, initial, fault)
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]

    @staticmethod
    def _step(layer: Layer, initial: str, fault: str | None) -> tuple[Layer, int, dict]:
        best: dict = {}
        for start, entry, cost, rank in layer:
            for order, macro in enumerate(MACROS):
                at, edit = entry, macro[-1]
                for _ in macro[:-1]:
                    at = AFTER[at]
                if edit == "D":
                    to = at
                elif fault in ("blank", "duplicate") or edit == "K" and initial not in (AFTER[at], "s" if at == "" else None):
                    continue
                else:
                    to = initial if edit == "K" else AFTER[at]
                paid = sum(COSTS[c] for c in macro) + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                option = (cost + paid, (rank, order), entry, macro)
                best[start, to] = min(option, best.get((start, to), option))
        least = min(b[0] for b in best.values())
        best = {pair: (b[0] - least, *b[1:]) for pair, b in best.items()}
        return _ranked(best), least, {pair: b[2:] for pair, b in best.items()}


def ending(layer: Layer) -> str:
    """The entry in which the cheapest, ASCII-least audit ends, for a layer with one start."""
    return min((cost + COSTS["I"] * ENDINGS[entry], rank, ENDINGS[entry], entry) for _, entry, cost, rank in layer)[-1]


def chained(layer: Layer, further: Layer) -> tuple[Layer, dict]:
    """A layer with one start, carried over a part whose layer has all starts; and each entry's entry between."""
    start, best = layer[0][0], {}
    for _, entry, cost, rank in layer:
        for s, to, more, order in further:
            if s == entry:
                option = (cost + more, (rank, order), entry)
                best[start, to] = min(option, best.get((start, to), option))
    return _ranked(best), {to: b[2] for (_, to), b in best.items()}


def edits_of(steps: Steps, turns: list[tuple[str, str | None]], start: str = "", end: str | None = None) -> list[tuple[str, str]]:
    """For each turn (role initial, fault): its macro, and the entry behind it. Without ``end``, the best one."""
    layer, parents = beginning(start), []
    for initial, fault in turns:
        layer, _, back = steps(layer, initial, fault)
        parents.append(back)
    entry, out = ending(layer) if end is None else end, []
    for back in reversed(parents):
        before, macro = back[start, entry]
        out.append((macro, entry))
        entry = before
    return out[::-1]


def sorted_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and fault, sorted, in partitions that each hold a range; reliably stored."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    bare = F.rtrim("text", F.lit(SPACES))
    own = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    rows = rows.select("*", own.alias("own"), F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows, seen = settled(rows, n=F.count(F.lit(1)), size=F.sum(F.octet_length("text") + F.octet_length("role")))
    place = F.struct("turn", "row")
    first = rows.where("own IS NULL OR own <> 'blank'").groupBy("conv", "role", "sha").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("sha").alias("_s"), "first")
    rows = rows.join(first, rows["conv"].eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("sha") == F.col("_s")), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    rows = rows.select("conv", "turn", "role", "text", F.when(F.col("own") == "blank", "blank").when(again, "duplicate").otherwise(F.col("own")).alias("fault"), "sha", "row")
    parts = max(1, (seen["size"] or 0) // PART_BYTES, min(seen["n"] // PART_ROWS, rows.sparkSession.sparkContext.defaultParallelism))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "sha", "row")]
    return cut_lineage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("sha", "row"))


def _mapped(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """mapInArrow by a function from a partition's rows to rows, handed on in batches of some rows or bytes."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in function(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(held) >= 4096 or size > PIECE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Conversations in order, each with its rows; the first column is the conversation."""
    return groupby(rows, key=lambda row: row[0])


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _ends(turns: DataFrame) -> list:
    """Of each partition its first and last conversation: conv, part, the layer from all starts, and the turn and initial of its first and last row."""

    def outline(rows: Iterator[tuple]) -> Iterator[tuple]:
        steps, kept, part = Steps(), [], TaskContext.get().partitionId()
        for conv, run in _runs(rows):
            layer, total, at, initial = beginning(*AFTER), 0, None, None
            for _, at, initial, fault in run:
                layer, paid, _ = steps(layer, initial, fault)
                total += paid
            starts, entries, costs, ranks = zip(*layer, strict=True)
            kept = [*kept[:1], (conv, part, list(starts), list(entries), [c + total for c in costs], list(ranks), at, initial)]
        yield from kept

    schema = f"conv {_kind(turns, 'conv')}, part int, starts array<string>, entries array<string>, costs array<long>, ranks array<int>, turn {_kind(turns, 'turn')}, initial string"
    return sorted(_mapped(turns.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault"), outline, schema).collect(), key=lambda r: r["part"])


def _chains(ends: list) -> dict[int, dict]:
    """For each partition, its border conversations: entry before, entry behind, whether it ends there, and the row before (turn, initial)."""
    out: dict[int, dict] = {}
    for conv, chain in groupby(ends, key=lambda r: r["conv"]):
        layer, backs, chain = beginning(""), [], list(chain)
        for r in chain:
            layer, back = chained(layer, tuple(zip(r["starts"], r["entries"], r["costs"], r["ranks"], strict=True)))
            backs.append(back)
        entry = ending(layer)
        for k in range(len(chain) - 1, -1, -1):
            before = backs[k][entry]
            row = (chain[k - 1]["turn"], chain[k - 1]["initial"]) if k else None
            out.setdefault(chain[k]["part"], {})[conv] = (before, entry, k == len(chain) - 1, row)
            entry = before
    return out


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """All edits, in the order of ``conv``, ``piece``, ``place``: edit (D, I, K, R), role and text behind
    the edit (of a deleted turn: before), turn and fault of the turn (null for inserts), whether it is
    the first of its turn number, whether its role may not follow the one before it, and whether
    it is in a ``border`` conversation, one that other pieces may share. What isn't deleted is the repaired conversation."""
    turns = sorted_turns(rows, conv_col, turn_col, role_col, text_col)
    chains = _chains(_ends(turns))

    def edit(rows: Iterator[tuple]) -> Iterator[tuple]:
        steps, part = Steps(), TaskContext.get().partitionId()
        for conv, run in _runs(rows):
            run, border = list(run), chains.get(part, {}).get(conv)
            entry, end, last, row = border or ("", None, True, None)
            place = count()
            added = lambda entry: (conv, part, next(place), "I", ROLES[entry], "", None, None, False, False, border is not None)  # noqa: B023, E731
            for (_, at, role, text, fault), (macro, to) in zip(run, edits_of(steps, [(r[2][:1], r[4]) for r in run], entry, end), strict=True):
                for _ in macro[:-1]:
                    entry = AFTER[entry]
                    yield added(entry)
                new = at is not None and (row is None or row[0] != at)
                illegal = row is not None and row[1] + role[:1] not in LEGAL
                yield conv, part, next(place), macro[-1], ROLES[to] if macro[-1] == "R" else role, text, at, fault, new, illegal, border is not None
                entry, row = to, (at, role[:1])
            for _ in range(ENDINGS[entry] if last else 0):
                entry = AFTER[entry]
                yield added(entry)

    schema = f"conv {_kind(turns, 'conv')}, piece int, place long, edit string, role string, text string, turn {_kind(turns, 'turn')}, fault string, new_turn boolean, illegal boolean, border boolean"
    return _mapped(turns, edit, schema)


def _span(*values) -> list:
    """Least and largest of what isn't null."""
    seen = [v for v in values if v is not None]
    return [min(seen), max(seen)] if seen else []


COUNTED = ("turns", "blank", "duplicate", "truncated", "illegal", "cost")


def conversation_digests(edits: DataFrame) -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of its
    ``role:text``, newline-joined). Those within a partition are done there; pieces of the others are streamed in order."""
    def outline(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, run in _runs(rows):
            sha, body, lines, size, border = hashlib.sha256(), [], 0, 0, False
            counts, turns, audit, first = [0] * len(COUNTED), [], [], None
            for _, edit, role, text, at, fault, new, illegal, border, piece, place in run:
                first = first or (piece, place)
                audit.append(edit)
                paid = COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                counts = [a + b for a, b in zip(counts, (new, fault == "blank", fault == "duplicate", fault == "truncated", illegal, paid), strict=True)]
                turns = _span(*turns, at)
                if edit != "D":
                    line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                    if border:
                        body.append(line)
                        size += len(line)
                    else:
                        sha.update(b"\n" + line if lines else line)
                    lines += 1
                if border and (size > PIECE_BYTES or len(audit) > PIECE_BYTES):
                    yield conv, *first, True, *counts, *(turns or (None, None)), "".join(audit), None, b"\n".join(body), lines
                    body, lines, size, counts, turns, audit, first = [], 0, 0, [0] * len(COUNTED), [], [], None
            if first:
                yield conv, *first, border, *counts, *(turns or (None, None)), "".join(audit), None if border else sha.hexdigest(), b"\n".join(body) if border else None, lines

    def join(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, run in _runs(rows):
            sha, any_line, counts, turns, audit = hashlib.sha256(), False, [0] * len(COUNTED), [], []
            for _, *more, low, high, edits, body, lines in run:
                counts, turns = [a + b for a, b in zip(counts, more, strict=True)], _span(*turns, low, high)
                audit.append(edits)
                if lines:
                    sha.update(b"\n" + body if any_line else body)
                    any_line = True
            yield conv, *counts, *(turns or (None, None)), "".join(audit), sha.hexdigest()

    turn = _kind(edits, "turn")
    key, numbers = f"conv {_kind(edits, 'conv')}", ", ".join(f"{c} long" for c in COUNTED) + f", low {turn}, high {turn}, audit string"
    shape = ("conv", *COUNTED, "low", "high", "audit")
    pieces = _mapped(edits.select("conv", "edit", "role", "text", "turn", "fault", "new_turn", "illegal", "border", "piece", "place"), outline, f"{key}, piece int, place long, border boolean, {numbers}, sha string, body binary, lines long")
    pieces = cut_lineage(pieces)
    shared = pieces.where("border").repartition("conv").sortWithinPartitions("conv", "piece", "place").select(*shape, "body", "lines")
    done = pieces.where("NOT border").select(*shape, "sha").union(_mapped(shared, join, f"{key}, {numbers}, sha string"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return done.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def damage_draw(conv: Column, turn: Column) -> Column:
    """crc32 of ``conv_id:turn`` mod 20; nulls are one space."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20


def with_made_damage(rows: DataFrame) -> DataFrame:
    """Rows with every fault that the operator knows, by a hash of conversation and turn."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), damage_draw(F.col("conv_id"), F.col("turn")).alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    found = conversation_digests(repair_conversations(with_made_damage(rows)))
    every = rows.select(F.col("conv_id")).distinct()
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").select(
        "conv_id", *(number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


#: The same by whole audit strings: crc32 bit by bit, then one step of the programme per turn.
ORACLE_SQL = r"""
WITH RECURSIVE tb(i, k, c) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM tb WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM tb WHERE k = 8),
keys AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
cr(key, p, c) AS (
  SELECT key, 0, CAST(4294967295 AS BIGINT) FROM keys
  UNION ALL SELECT key, p + 1, xor(t[CAST(xor(c % 256, CAST(ascii(substr(key, p + 1, 1)) AS BIGINT)) AS BIGINT) + 1], c // 256) FROM cr, tab WHERE p < length(key)),
draws AS (SELECT key, xor(c, 4294967295) % 20 AS draw FROM cr WHERE p = length(key)),
damaged AS (
  SELECT c.conv_id, c.turn, CASE draw WHEN 4 THEN 'user' ELSE coalesce(c.role, ' ') END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(c.text, ' '), '.!?', '') ELSE coalesce(c.text, ' ') END AS text, copy
  FROM conversations c JOIN draws ON draws.key = coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(c.turn AS VARCHAR), ' '), (VALUES (1), (2)) v(copy)
  WHERE draw <> 0 AND (copy = 1 OR draw = 3)),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS role_before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
turns AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, left(role_before, 1) || left(role, 1) AS pair,
         CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
-- entries of a layer: before, inserts, entry after them, role texts that they add
ins(e, run, mid, added) AS (VALUES ('', '', '', ''), ('', 'I', 'u', chr(10) || 'user:'), ('', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', '', 's', ''), ('s', 'I', 'u', chr(10) || 'user:'), ('s', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', '', 'u', ''), ('u', 'I', 'a', chr(10) || 'assistant:'), ('a', '', 'a', ''), ('a', 'I', 'u', chr(10) || 'user:')),
edit(mid, kind, goes, role) AS (VALUES ('', 'D', '', ''), ('s', 'D', 's', ''), ('u', 'D', 'u', ''), ('a', 'D', 'a', ''), ('', 'K', 's', ''), ('', 'K', 'u', ''), ('s', 'K', 'u', ''), ('u', 'K', 'a', ''), ('a', 'K', 'u', ''),
  ('', 'R', 'u', 'user'), ('s', 'R', 'u', 'user'), ('u', 'R', 'a', 'assistant'), ('a', 'R', 'u', 'user')),
dp(conv_id, i, e, cost, audit, body) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', '' FROM facts
  UNION ALL
  SELECT conv_id, i, e, cost, audit, body FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, e ORDER BY cost, audit) AS best FROM (
      SELECT t.conv_id, t.i, edit.goes AS e,
             CAST(dp.cost + 3 * length(ins.run) + CASE edit.kind WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit.kind <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT) AS cost,
             dp.audit || ins.run || edit.kind AS audit,
             dp.body || ins.added || CASE edit.kind WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || edit.role || ':' || t.text ELSE chr(10) || t.role || ':' || t.text END AS body
      FROM dp JOIN turns t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.i = dp.i + 1 JOIN ins ON ins.e = dp.e JOIN edit ON edit.mid = ins.mid
      WHERE (edit.kind = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (edit.kind <> 'K' OR edit.goes = t.initial))) WHERE best = 1),
ends(e, run, added) AS (VALUES ('', '', ''), ('s', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('u', 'I', chr(10) || 'assistant:'), ('a', '', '')),
best AS (
  SELECT dp.conv_id, dp.cost + 3 * length(ends.run) AS cost, dp.audit || ends.run AS audit, dp.body || ends.added AS body,
         row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 3 * length(ends.run), dp.audit || ends.run) AS k
  FROM dp JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.i JOIN ends ON ends.e = dp.e),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank, CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.body, 2), '')) AS repaired_sha256
FROM every LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM every.conv_id AND b.k = 1
"""
