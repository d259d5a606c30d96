"""Packing by minimum bin slack.

Documents become token ids; whole windows of a long document are sequences at once, and the
remainders wait in a bounded buffer. Each sequence takes the longest remainder that waits, and
a subset-sum over the bits of one integer picks the multiset of further lengths that comes
closest to the capacity; backtracking gives how many of each length. At the end of a
partition the few remainders that no longer fill a window are laid end to end and cut into
sequences whose lengths are powers of two, which need no padding.

Nothing is shuffled: each task packs what it reads, and a lost task does so again with the
same result. Null and empty texts are one closing id long. A null doc_id is kept as it is;
repeated rows are packed once each. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import read_table
from massloom.llm.tokens import CACHE_WORDS, WORD_BPE, WordEncoder


def best_fill(counts: list[tuple[int, int]], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Of (length, count) pairs, the multiset whose sum is nearest to the capacity from below.

    Returns the sum and the (length, times) pairs that make it.
    """
    mask, reach, before = (1 << (capacity + 1)) - 1, 1, []
    for length, count in counts:
        before.append(reach)
        step = 1
        while count > 0 and step * length <= capacity:
            times = min(step, count)
            reach |= (reach << (length * times)) & mask
            count -= times
            step *= 2
        if reach >> capacity & 1:
            break
    left = best = reach.bit_length() - 1
    taken = []
    for (length, _), bits in zip(reversed(counts[: len(before)]), reversed(before), strict=True):
        times = 0
        while not (left - times * length >= 0 and bits >> (left - times * length) & 1):
            times += 1
        if times:
            taken.append((length, times))
            left -= times * length
    return best, taken


class SlackPacker:
    """Fills sequences from a buffer of items (length, payload)."""

    def __init__(self, capacity: int, low: int, high: int):
        self.capacity, self.low, self.high = capacity, low, high
        self.by_length: dict[int, deque] = {}
        self.n = self.total = 0

    def add(self, length: int, item: object) -> None:
        self.by_length.setdefault(length, deque()).append(item)
        self.n += 1
        self.total += length

    def _pop(self, length: int) -> object:
        queue = self.by_length[length]
        item = queue.popleft()
        if not queue:
            del self.by_length[length]
        self.n -= 1
        self.total -= length
        return item

    def fill(self) -> list[object]:
        seed = max(self.by_length)
        items = [self._pop(seed)]
        counts = sorted(((k, len(v)) for k, v in self.by_length.items()), reverse=True)
        for length, times in best_fill([c for c in counts if c[0] <= self.capacity - seed], self.capacity - seed)[1]:
            items += [self._pop(length) for _ in range(times)]
        return items

    def ready(self) -> Iterator[list[object]]:
        while self.n > self.low:
            yield self.fill()

    def rest(self) -> list[object]:
        items = [x for k in sorted(self.by_length, reverse=True) for x in self.by_length[k]]
        self.by_length.clear()
        self.n = self.total = 0
        return items


def power_of_two_cuts(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences for a run of ids: whole windows, then falling powers of two."""
    cuts = [capacity] * (total // capacity)
    left = total % capacity
    return cuts + [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, closing_id: int = 2, tokenizer: str = WORD_BPE, low: int = 256, high: int = 512, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, and the ids as
    little-endian unsigned 32-bit bytes. At most ``high`` remainders wait in a task at a time;
    a worker keeps the ids of at most ``cache_words`` words, for speed only."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    end = closing_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = WordEncoder.of_worker(tokenizer, cache_words), SlackPacker(capacity, low, high)
        next_id = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held, schema = 0, None

        def place(items: list[tuple]) -> None:
            nonlocal next_id, held
            offset = 0
            for key, start, ids, tokens in items:
                rows.append((key, start, len(ids) // 4, tokens, next_id, offset, ids))
                offset += len(ids) // 4
                held += len(ids)
            next_id += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field(id_col, batch.schema.field(0).type), *(pa.field(n, pa.int64()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), pa.field("ids", pa.binary())])
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                keys, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(keys, encoder.encode(texts), strict=True):
                    ids += end
                    tokens = len(ids) // 4
                    whole = tokens - tokens % capacity
                    for start in range(0, whole, capacity):
                        place([(key, start, ids[4 * start : 4 * (start + capacity)], tokens)])
                    if whole < tokens:
                        packer.add(tokens - whole, (key, whole, ids[4 * whole :], tokens))
                    if packer.n >= high:
                        for items in packer.ready():
                            place(items)
                    if held > 8 << 20:
                        yield flush()
        if schema is None:
            return
        tail: list[tuple] = []
        while packer.total >= capacity:
            items = packer.fill()
            if sum(len(x[2]) for x in items) == 4 * capacity:
                place(items)
            else:
                tail += items
        tail += packer.rest()
        cuts = iter(power_of_two_cuts(sum(len(x[2]) for x in tail) // 4, capacity))
        room, items = 0, []
        for key, start, ids, tokens in tail:
            while ids:
                if not room:
                    if items:
                        place(items)
                    room, items = next(cuts), []
                items.append((key, start, ids[: 4 * room], tokens))
                took = len(items[-1][2]) // 4
                start, ids, room = start + took, ids[4 * took :], room - took
        if items:
            place(items)
        yield flush()

    return docs.select(id_col, text_col).mapInArrow(pack, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), cache_words=1 << 20)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
