"""Secret scans: fixed patterns, and novelty under a primed zstandard compressor.

Three patterns give the base spans. Beyond them, a candidate is a run of 20 or more letters, digits
and marks that begins within ``reach`` characters of a sensitive word, or is glued to it
(``access_key=...``); one without digits has 32 letters in a row or more that don't fall into words by
their case. A candidate is compressed
behind the ``surround`` characters on either side of it, copies of itself left out, by a
compressor that is primed with a dictionary: a fixed list of common words, and the parts of the
corpus's own identifiers and pairs of them, counted over all texts by how many different identifiers they stand
in (so copies of a text add nothing). The bytes that the candidate adds, per character, measure
how little of it these explain. Candidates that add nearly as much as random strings of their
alphabet and length are reported as spans of kind ``novel``. A run of more than 512 characters is
judged as a whole, up to 4096, and in windows of 512, all of them; if any is novel, so is all of the run.

Null texts are empty; long texts are scanned whole, and a secret is reported to its end however
long it is. Offsets are code points; ends are exclusive. Repeated rows are scanned once each,
other columns are ignored (in ``redact_secrets`` passed on), whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import chunks, read_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
#: A text without any of these, in lower case, has no match of ASSIGN.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{19,}")
#: What ties a sensitive word to the rest of its run; a name and its '='.
CANDIDATE_REST = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]*")
TIE, NAME = re.compile(r"[+/_=-]+"), re.compile(r"[A-Za-z0-9+/_-]+=+")
SENSITIVE = re.compile(r"(?:auth|bearer|credential|private|signature|session|access|secret|token|passw|api.?key|\bkey\b)", re.I | re.A)
#: What primes the compressor: words that stand near identifiers in code and settings.
IDENTIFIERS = " ".join(
    "password passwd secret token api_key apikey authorization bearer credential private public signature session access "
    "config settings default value string number boolean function return import export class self this null none true false "
    "https http www com org net html json xml yaml index main test user admin name email address server client database "
    "host port path file version update create delete select insert request response header content type length encoding "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 example localhost".split()
).encode()


#: What a code identifier has and plain words haven't; its characters; its parts; how long it may be.
CODE_MARK, RUN_CHARS, LONGEST = re.compile(r"[a-z][A-Z]|_|[A-Za-z][0-9]"), re.compile(r"[A-Za-z0-9_]*"), 64
PART = re.compile(r"[A-Z]?[a-z]{2,15}|[A-Z]{3,16}(?![a-z])")
#: Parts in the dictionary at most, and identifiers that a part stands in at least.
PARTS, LEAST_RUNS = 4096, 3
#: Characters on either side of a candidate, and behind a sensitive word, that are looked at.
SURROUND, REACH = 2048, 48
#: The part of a random string's bytes that a secret adds at least.
LEAST_SHARE = 0.85


def identifiers(text: str) -> Iterator[str]:
    """Runs of a text that look like identifiers of code; longer ones than LONGEST are none."""
    at = 0
    while m := CODE_MARK.search(text, at):
        start = m.start()
        while start > at and start > m.start() - LONGEST and RUN_CHARS.fullmatch(text[start - 1]):
            start -= 1
        at = RUN_CHARS.match(text, m.start()).end()
        if at - start <= LONGEST:
            yield text[start:at]


def parts_of(run: str) -> Iterator[str]:
    """The words of an identifier, and neighbouring ones together as they stand in it."""
    spans = [m.span() for m in PART.finditer(run)]
    for k, (a, b) in enumerate(spans):
        if b - a > 2:
            yield run[a:b]
        if k:
            yield run[spans[k - 1][0] : b]


def identifier_dictionary(docs: DataFrame, text_col: str = "text", parts: int = PARTS, least_runs: int = LEAST_RUNS) -> bytes:
    """The parts that stand in the most different identifiers of all texts, the commonest last."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 0, 512):
                found = {(p, run) for text in part.column(0).to_pylist() for run in identifiers(text or "") for p in parts_of(run)}
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["part", "run"])

    runs = docs.select(F.col(text_col).alias("text")).mapInArrow(collect, "part string, run string").distinct()
    often = runs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_runs)
    first = often.orderBy(F.desc("n"), "part").limit(parts).collect()
    return " ".join(r["part"] for r in reversed(first)).encode()


class Novelty:
    """Marginal compressed bytes of a string behind its surroundings and the dictionary, per character."""

    def __init__(self, dictionary: bytes = b"", level: int = 3):
        import zstandard

        self.zstandard, self.level, self.known = zstandard, level, IDENTIFIERS + b" " + dictionary + b" "
        self.random_share = lru_cache(4096)(self._random_share)

    def share(self, before: str, candidate: str, after: str = "") -> float:
        before, after = before.replace(candidate, " "), after.replace(candidate, " ")
        context = before.encode("utf-8", "replace")
        primed = self.zstandard.ZstdCompressionDict(self.known + after.encode("utf-8", "replace") + b" " + context, dict_type=self.zstandard.DICT_TYPE_RAWCONTENT)
        tool = self.zstandard.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        without = len(tool.compress(context[-64:]))
        return (len(tool.compress(context[-64:] + candidate.encode())) - without) / max(1, len(candidate))


    def _random_share(self, letters: str, length: int) -> float:
        """The share of a random string of these letters behind the dictionary alone."""
        return self.share("", "".join(random.Random(length).choices(letters, k=length)))

    def is_novel(self, before: str, candidate: str, after: str, least: float) -> bool:
        """Whether a string adds at least this part of what a random one of its letters and length adds."""
        return self.share(before, candidate, after) >= least * self.random_share(written_in(candidate), len(candidate))


#: Alphabets by which a run may be written, smallest first; marks between count as further letters.
ALPHABETS = ("0-9", "0-9A-F", "0-9a-f", "0-9A-Fa-f", "A-Z", "a-z", "A-Z2-7", "a-z2-7", "0-9A-Z", "0-9a-z", "A-Za-z", "0-9A-Za-z")
WRITTEN = tuple((re.compile(f"[{a}+/_=-]+"), "".join(c for c in string.digits + string.ascii_letters if re.match(f"[{a}]", c))) for a in ALPHABETS)
#: Characters of a run that are judged as one, and of each window of a longer run.
MARKS, MEASURED, WINDOW = "+/_-", 4096, 512
#: Letters in a row that a run without digits has at least, and letters of its words by case at most, on average.
LETTERS, WORD_LETTERS, CASE_WORD = re.compile(r"[A-Za-z]{32,}"), 3.5, re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def written_in(run: str) -> str:
    """The letters of the smallest alphabet that a run may be written in, and its marks."""
    return next(letters for a, letters in WRITTEN if a.fullmatch(run)) + "".join(m for m in MARKS if m in run)


def value_start(run: str) -> int:
    """Where the value of a run like name=value begins: behind names, which hold a sensitive word or no digit."""
    at = 0
    while (m := NAME.match(run, at)) and (SENSITIVE.search(m[0]) or not re.search(r"[0-9]", m[0])):
        at = m.end()
    return at


class Runs:
    """The runs of a text; the last one's place is kept, so that a long run is gone through once."""

    def __init__(self, text: str):
        self.text, self.last = text, (0, 0)

    def end(self, at: int) -> int:
        """The end of the run that ``at`` is in."""
        if not self.last[0] <= at < self.last[1]:
            self.last = (at, CANDIDATE_REST.match(self.text, at).end())
        return self.last[1]


def candidates(text: str, at: int, reach: int, runs: Runs) -> Iterator[tuple[int, int]]:
    """(start, end) of runs that begin within reach of ``at``, the end of a sensitive word, names left out.
    Names are looked for in a run's first MEASURED characters."""
    named = lambda a, b: a + value_start(text[a : min(b, a + MEASURED)])
    if (tie := TIE.match(text, at)) and CANDIDATE_REST.match(text, tie.end(), tie.end() + 1):
        # the word is part of a run, which no candidate can start within
        end = runs.end(tie.end())
        if end - (start := named(tie.end(), end)) >= LEAST:
            yield start, end
    here, stop = at, min(len(text), at + reach + LEAST)
    while (c := CANDIDATE.search(text, here, stop)) and c.start() - at <= reach:
        # the search ends soon behind the reach, the run where its characters do
        here = runs.end(c.start())
        start = named(c.start(), here)
        yield start if here - start >= LEAST else c.start(), here


def pieces(a: int, b: int, known: bool) -> Iterator[tuple[int, int]]:
    """What of a run from a to b is judged: all of it, or its beginning, if it is short enough for one
    measure; and windows, unless those of the same run are known."""
    if b - a <= MEASURED or known:
        yield a, min(b, a + MEASURED)
    if b - a > WINDOW and not known:
        edges = [*range(a, b - LEAST, WINDOW), b]
        yield from zip(edges[:-1], edges[1:], strict=True)


def is_mixed(piece: str) -> bool:
    """Whether a piece of a run has digits, or enough letters in a row that their case doesn't make words of."""
    if re.search(r"[0-9]", piece):
        return True
    runs = [m[0] for m in LETTERS.finditer(piece)]
    return any(r.islower() or r.isupper() or len(r) <= WORD_LETTERS * len(CASE_WORD.findall(r)) for r in runs)


def covered(base: list[tuple[int, int, int]], a: int, b: int) -> bool:
    """Whether the base spans, in order of their starts, cover all of a to b."""
    for x, _, y in base:
        if x > a:
            break
        a = max(a, y)
    return a >= b


def find_spans(text: str, novelty: Novelty, reach: int = REACH, surround: int = SURROUND, least_share: float = LEAST_SHARE) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, by start, then kind."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(spans)
    end, judged, seen, runs = 0, 0, set(), Runs(text)
    for m in SENSITIVE.finditer(text):
        # every candidate that begins within reach of a sensitive word, each once
        for a, b in candidates(text, m.end(), reach, runs):
            if a < end or (a, b) in seen:
                continue
            seen.add((a, b))
            if covered(base, a, b):
                continue
            for x, y in pieces(a, b, b == judged):
                if is_mixed(text[x:y]) and novelty.is_novel(text[max(0, x - surround) : x], text[x:y], text[y : y + surround], least_share):
                    end = b
                    spans.append((a, 3, b))
                    break
            else:
                judged = b
    return sorted(set(spans))


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = LEAST_SHARE, reach: int = REACH, surround: int = SURROUND) -> DataFrame:
    """Per row: the id, the found spans as array of struct(kind, start, end, value). ``reach``: characters behind
    a sensitive word within which a candidate begins; ``surround``: those on either side that may explain it."""
    known = identifier_dictionary(docs, text_col)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in find_spans(text, novelty, reach, surround, least_share)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, of)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, spans array<struct<kind: string, start: long, end: long, value: string>>")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", least_share: float = LEAST_SHARE, reach: int = REACH, surround: int = SURROUND) -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by the mark; settings as in ``scan_secrets``."""
    at, known = docs.columns.index(text_col), identifier_dictionary(docs, text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                if text and (spans := find_spans(text, novelty, reach, surround, least_share)):
                    texts[k] = redact(text, spans, mark)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, label), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("novel").alias("n_novel"))
