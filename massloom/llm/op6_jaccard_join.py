"""N-gram Jaccard join by chosen paths.

A text is its set of five-word shingles (of all its words if it has fewer; A-Z in lower case).
Texts with equal sets are one node. In each run a node chooses, by hashes that all nodes
share, shingles with probability ``1 / (threshold * size)`` each, and goes down one path for
each choice; nodes with the same path meet in a bucket. A bucket of more than ``bucket_rows``
nodes is split again by further choices, up to three levels; smaller ones and those that the
last level can't split are leaves, the latter in blocks of bounded size. Runs are repeated until
a pair at the threshold meets with the target probability. In a leaf all pairs are compared by
small sketches (the least hash in each of 128 ranges, a byte each), with a margin of several
standard deviations below the threshold, and those alike are joined to candidate groups. Within
each group all pairs are compared on their whole sets, in blocks again: so links are exact,
and a group of copies gives counts and a spanning forest, not its pairs.

The result has one row per document: its class (the least id among documents that a chain of
links joins, or among copies), and its number of links (documents whose similarity is at
least the threshold, copies included). Empty and null texts have no shingles: each is a class
of its own. Null ids sort before others. Repeated rows count as documents. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.common import cut_lineage, in_large_files, read_table, settled
from massloom.llm.graph import components
from massloom.llm.hashing import WordHasher, mix, shingles

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Choices per node at the levels below the first; nodes of a bucket that need no further split.
BRANCH, BUCKET_ROWS = 2.0, 64
#: Nodes of a block in the exact comparison of a group, their shingles, and nodes of a block in a leaf that can't be split.
BLOCK, BLOCK_SHINGLES, LEAF_BLOCK = 512, 1 << 20, 512
#: Big buckets whose paths are broadcast at most; more are joined by a shuffle.
AT_HAND = 100_000
#: Bytes of a sketch, and how far below the threshold its estimate may be.
SKETCH, MARGIN = 128, 0.17


def runs_needed(threshold: float, recall: float, branch: float = BRANCH) -> int:
    """Runs until two sets at the threshold share a path through all three levels with that probability."""
    shared = 2 * threshold / (1 + threshold)
    lost = math.exp(-shared * branch)
    lost = math.exp(-shared * branch * (1 - lost))
    lost = math.exp(-shared / threshold * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def _choose(x: np.ndarray, parents: np.ndarray, expected: float) -> tuple[np.ndarray, np.ndarray]:
    """For each parent path, the paths of the chosen members; (index of parent, path)."""
    if not len(parents):
        return np.zeros(0, np.int64), parents
    limit = np.uint64(min((1 << 64) - 1, int(expected / len(x) * (1 << 64))))
    found_i, found_p = [], []
    step = max(1, (1 << 20) // len(x))
    for lo in range(0, len(parents), step):
        u = mix(x[None, :] ^ mix(parents[lo : lo + step])[:, None])
        i, j = np.nonzero(u <= limit)
        found_i.append(i + lo)
        found_p.append(mix(u[i, j]))
    return np.concatenate(found_i), np.concatenate(found_p)


def chosen_paths(x: np.ndarray, runs: int, threshold: float, branch: float = BRANCH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, (parent path, path) arrays of a set's chosen paths in all runs."""
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64))
    levels, parents = [], roots
    for expected in (1 / threshold, branch, branch):
        i, paths = _choose(x, parents, expected)
        levels.append((parents[i], paths))
        parents = paths
    return levels


def sketch(x: np.ndarray) -> bytes:
    """A byte for each of SKETCH equal ranges of hashes: of the least in it, 0 if there is none."""
    u = np.sort(mix(x ^ np.uint64(0x5851F42D4C957F2D)))
    bins = (u >> np.uint64(57)).astype(np.int64)
    first = np.nonzero(np.r_[True, bins[1:] != bins[:-1]])[0]
    out = np.zeros(SKETCH, np.uint8)
    out[bins[first]] = (u[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def alike(sketches: np.ndarray, least: float, split: int | None = None) -> np.ndarray:
    """Boolean matrix of the pairs of sketches whose estimated similarity is at least ``least``."""
    n = len(sketches)
    empty = (sketches == 0).astype(np.float32)
    both = empty @ empty.T
    same = np.stack([(sketches == sketches[k]).sum(1) for k in range(n)]) - both
    linked = same >= least * (SKETCH - both)
    np.fill_diagonal(linked, False)
    if split is not None:
        linked[:split, :split] = False
        linked[split:, split:] = False
    return linked


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, recall: float) -> DataFrame:
    """id, key (of the text), node (of the set; null if it is empty), n_shingles, sketch, and paths by level."""
    import xxhash

    repeat = runs_needed(threshold, recall)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    paths = ("l1", "p2", "l2", "p3", "l3")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher.of_worker()
        none = np.zeros(0, np.uint64)
        for whole in batches:
            for lo in range(0, len(whole), 512):
                batch = whole.slice(lo, 512)
                nodes, sizes, sketches, columns = [], [], [], [[] for _ in paths]
                for text in batch.column(2).to_pylist():
                    x = shingles(text, hasher, width)
                    nodes.append(xxhash.xxh128_digest(x.tobytes()) if len(x) else None)
                    sizes.append(len(x))
                    sketches.append(sketch(x) if len(x) else None)
                    (_, a), (bp, b), (cp, c) = chosen_paths(x, repeat, threshold) if len(x) else [(none, none)] * 3
                    for column, value in zip(columns, (a, bp, b, cp, c), strict=True):
                        column.append(value)
                own = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *own, *map(_lists, columns)],
                    names=["id", "key", "node", "n_shingles", "sketch", *paths],
                )

    read = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    lists = ", ".join(f"{p} array<long>" for p in paths)
    return read.mapInArrow(sign, f"id {kind}, key binary, node binary, n_shingles long, sketch binary, {lists}")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _bytes_matrix(column: pa.Array) -> np.ndarray:
    """A column of sketches, without nulls, as rows of bytes."""
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = column.offset
    first = np.frombuffer(column.buffers()[1], np.int32)[at] if len(column) else 0
    return flat[first : first + SKETCH * len(column)].reshape(-1, SKETCH)


def leaf_edges(rows: DataFrame, least: float) -> DataFrame:
    """Rows (path, i, j, block, rid, sketch): spanning edges (a, b) of the pairs that look alike in each group.

    Groups of two are compared together, others one by one; a group has a bounded number of rows.
    """

    def groups(batch: pa.RecordBatch) -> np.ndarray:
        """Where each group begins."""
        path, i, j = (np.asarray(batch.column(c)) for c in range(3))
        return np.nonzero(np.r_[True, (path[1:] != path[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])[0]

    def found(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        i, j, block, rid = (np.asarray(batch.column(c)) for c in range(1, 5))
        sketches, ends = _bytes_matrix(batch.column(5)), np.r_[starts[1:], len(batch)]
        size = ends - starts
        two = starts[(size == 2) & ((i[starts] == j[starts]) | (block[starts] != block[ends - 1]))]
        x, y = sketches[two], sketches[two + 1]
        both = ((x == 0) & (y == 0)).sum(1)
        linked = (x == y).sum(1) - both >= least * (SKETCH - both)
        a, b = [rid[two[linked]]], [rid[two[linked] + 1]]
        for lo, hi in zip(starts[size > 2], ends[size > 2], strict=True):
            order = lo + np.lexsort((rid[lo:hi], block[lo:hi]))
            split = int((block[order] == block[order[0]]).sum()) if i[lo] != j[lo] else None
            roots = spanning(alike(sketches[order], least, split))
            moved = np.nonzero(roots != np.arange(len(order)))[0]
            a.append(rid[order[moved]])
            b.append(rid[order[roots[moved]]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            starts = groups(batch)
            # the last group may go on in the next batch
            rest = batch.slice(starts[-1])
            if len(starts) > 1:
                yield found(batch.slice(0, starts[-1]), starts[:-1])
        if rest is not None:
            yield found(rest, np.zeros(1, np.int64))

    key = ["path", "i", "j"]
    dealt = rows.select(*key, "block", "rid", "sketch").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(compare, "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with blocks (their number) and rid: adds block and, once for each pair of blocks that holds it, i and j."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def candidate_edges(signed: DataFrame, nodes: DataFrame, n_nodes: int, threshold: float, bucket_rows: int = BUCKET_ROWS, leaf_block: int = LEAF_BLOCK) -> DataFrame:
    """Edges (a, b) that join the nodes which met in leaves and look alike.

    The paths of a level are counted with partial sums; big ones are taken out before rows meet,
    so no task gets a big bucket. ``signed`` has the paths of the further levels, which are read
    for the nodes of big buckets only.
    """
    sketches, expected = nodes.select("rid", "sketch"), 16 * n_nodes
    rows, leaves = nodes.select("rid", "sketch", F.explode("l1").alias("path")), []
    for level in (1, 2, 3):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
        sizes, seen = settled(sizes, expected // bucket_rows, n=F.count(F.lit(1)), met=F.sum("n"))
        big = F.broadcast(sizes) if seen["n"] <= AT_HAND else sizes
        rows = rows if level == 1 else rows.join(sketches, "rid")
        small = rows.join(big.select("path"), "path", "left_anti") if seen["n"] else rows
        leaves.append(small.select("path", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), "rid", "sketch"))
        if not seen["n"]:
            break
        if level == 3:
            blocks = big.select("path", F.ceil(F.col("n") / leaf_block).cast("int").alias("blocks"))
            leaves.append(in_blocks(rows.join(blocks, "path")).select("path", "i", "j", "block", "rid", "sketch"))
            break
        within = rows.select("rid", "path").join(big.select("path"), "path", "left_semi")
        p, c = f"p{level + 1}", f"l{level + 1}"
        own = F.filter(F.arrays_zip(F.col(p).alias("p"), F.col(c).alias("c")), lambda z: z["p"] == F.col("path"))
        rows = within.join(signed.select("rid", p, c), "rid").select("rid", F.explode(own).alias("z"))
        expected = int(BRANCH * (seen["met"] or 0))
        rows = cut_lineage(rows.select("rid", F.col("z.c").alias("path")), expected)
    met = leaves[0]
    for more in leaves[1:]:
        met = met.unionByName(more)
    return leaf_edges(met, threshold - MARGIN).distinct()


def pair_links(sets: list[np.ndarray], threshold: float, split: int | None = None) -> np.ndarray:
    """Boolean matrix of the pairs at or above the threshold; with ``split``, only pairs across it."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    inter = np.zeros((n, n), np.float32)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], column[shared]
        new = np.cumsum(count > 1) - 1
        column = new[column]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = max(64, (1 << 22) // n)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            dense = np.zeros((n, width), np.float32)
            dense[owner[a:b], column[a:b] - lo] = 1
            inter += dense @ dense.T
    linked = inter >= threshold * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
    np.fill_diagonal(linked, False)
    if split is not None:
        linked[:split, :split] = False
        linked[split:, split:] = False
    return linked


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each row, the least row that links join it to."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def exact_links(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    """Rows (component, i, j, block, rid, weight, text) in blocks: per node and block pair, its links and a spanning edge."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher.of_worker()
        at, group = None, {}
        out: list[tuple] = []

        def close() -> None:
            members = sorted(group.items(), key=lambda x: (x[1][0], x[0]))
            if len(members) < 2:
                return
            rids, sets = [m[0] for m in members], [m[1][2] for m in members]
            weights = np.array([m[1][1] for m in members], np.int64)
            first = members[0][1][0]
            split = sum(m[1][0] == first for m in members) if at[1] != at[2] else None
            linked = pair_links(sets, threshold, split)
            counts, roots = linked.astype(np.int64) @ weights, spanning(linked)
            out.extend((rids[k], int(counts[k]), rids[roots[k]]) for k in np.nonzero(counts)[0])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "links", "root"])

        for batch in batches:
            for lo in range(0, len(batch), 256):
                for component, i, j, block, rid, weight, text in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    if at != (component, i, j):
                        if at is not None:
                            close()
                        at, group = (component, i, j), {}
                    if rid not in group:
                        group[rid] = (block, weight, shingles(text, hasher, width))
            if len(out) > 10_000:
                yield flush()
        if at is not None:
            close()
        yield flush()

    key = ["component", "i", "j"]
    dealt = rows.select(*key, "block", "rid", "weight", "text").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(compare, "rid long, links long, root long")


def _id_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """id, key of the text, class_node (null without shingles), class_id, n_links, n_shingles."""
    signed = cut_lineage(signatures(docs, id_col, text_col, width, threshold, recall).withColumn("rid", F.monotonically_increasing_id()))
    held = signed.where(F.col("node").isNotNull())
    # equal sets are one node, called by a row of theirs; a null id is less than others
    firsts = held.groupBy("node").agg(F.min("rid").alias("rid"), F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("none"), F.count(F.lit(1)).alias("weight"))
    narrow = held.select("rid", "id", "key", "n_shingles", "sketch", "l1")
    rows = firsts.count()
    nodes = cut_lineage(narrow.join(firsts, "rid"), 4 * rows)
    groups = components(candidate_edges(signed, nodes, rows, threshold), rows)
    facts = nodes.select("rid", "weight", "id", "key", "n_shingles")
    members = groups.withColumnRenamed("node", "rid").join(facts, "rid")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("held"))
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    cand = members.join(sizes, "component").select("component", "rid", "weight", blocks.alias("blocks"), _id_text(F.col("id")).alias("_id"), F.col("key").alias("_key"))
    texts = docs.select(_id_text(F.col(id_col)).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("text"))
    links = cut_lineage(exact_links(in_blocks(texts.join(cand, ["_id", "_key"])), width, threshold))
    classes = components(links.select(F.col("rid").alias("a"), F.col("root").alias("b")), rows).withColumnRenamed("node", "rid")
    counted = links.groupBy("rid").agg(F.sum("links").alias("links"))
    named = nodes.select("rid", "node", "weight", "least", "none").join(classes.join(counted, "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    names = named.groupBy("component").agg(F.min("least").alias("class_least"), F.max("none").alias("class_none"))
    named = named.join(names, "component")
    full = named.select(
        F.col("node").alias("_n"),
        F.col("component").alias("class_node"),
        F.when(~F.col("class_none"), F.col("class_least")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    out = signed.select("id", "key", "node", "n_shingles").join(full, F.col("node") == F.col("_n"), "left")
    class_id = F.when(F.col("_n").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select("id", "key", "class_node", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_shingles")


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class: least id, then least key of the text.
    Rows equal in id and text count as one; texts without shingles all stay. Any column names do."""
    found = cut_lineage(jaccard_classes(docs, id_col, text_col))
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    repeats = found.groupBy("id", "key").count().where("count > 1").limit(1).count()
    own = F.coalesce(F.col("class_node").cast("string"), F.concat_ws(" ", F.lit("-"), F.hex("key"), F.col("id").cast("string")))
    best = found.groupBy(own.alias("own")).agg(F.min(F.struct("id", "key")).alias("best"))
    stay = best.select(_id_text(F.col("best.id")).alias("of_id"), F.col("best.key").alias("of_key"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(_id_text(F.col(id_col)).alias("of_id"), text_key(F.col(text_col)).alias("of_key"), whole.alias("row"))
    rows = rows.join(stay, ["of_id", "of_key"], "left_semi")
    rows = rows.dropDuplicates(["of_id", "of_key"]) if repeats else rows
    return in_large_files(rows, size).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_shingles")
