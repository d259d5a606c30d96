"""Approximate nearest neighbours by a hierarchical k-means tree.

A tree of spherical k-means is fitted on a bounded sample of the vectors and travels to every
task. Each vector belongs to one leaf; every vector is indexed. A query walks the tree best
bin first: a priority queue holds nodes by the cosine of the query to their centres, and the
leaves come out in order. How many leaves a query visits is calibrated: for a bounded number of
queries the exact neighbours are found among all rows, in blocks, and visits are widened until
the mean recall on them reaches ``recall``; if no number of visits below all leaves does, all
are visited. Neighbouring leaves make up regions of bounded size (a leaf with more vectors is
dealt to several); a query travels to a region once, with the leaves that it visits there, and
only the best ``k + 1`` rows of a region come back. Of equal vectors only the ``k + 1`` least
ids can be among the nearest of anything, so only these are compared, and equal queries are
searched once.

Nearness is the cosine in double precision; ties go to the smaller id. Each row whose id is
divisible is a query, and every row but itself a candidate, rows that repeat its id included:
their results then share a query_id. Vectors that are null, empty, zero, of another
length than most, or hold null or non-finite components take no part; neither do null ids as
queries (as candidates they are last among ties). Fewer candidates give fewer rows. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massloom.llm.common import cut_lineage, read_table

#: Vectors that the tree is fitted on at most; children of a node; sampled vectors of a leaf at most.
SAMPLE_ROWS, BRANCH, LEAF_ROWS = 32_768, 8, 512
#: Queries that visits are calibrated on at most, the recall to reach, vectors of a region, queries compared at once.
CALIBRATE, RECALL, REGION_ROWS, ASK_ROWS = 128, 0.97, 16_384, 256


@dataclass
class Node:
    centre: np.ndarray
    children: list[int] = field(default_factory=list)
    leaf: int = -1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """The cluster of each unit vector."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        sums[empty], norms[empty] = x[rng.choice(len(x), int(empty.sum()))], 1.0
        centres = sums / norms[:, None]
    return (x @ centres.T).argmax(1)


class Tree:
    """Nodes by number; node 0 is the root."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_rows: int = LEAF_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        self.nodes = [Node(x.mean(0))]
        self.leaves = 0
        queue = [(0, np.arange(len(x)))]
        while queue:
            at, rows = queue.pop()
            parts = []
            if len(rows) > leaf_rows:
                near = spherical_kmeans(x[rows], branch, rng)
                parts = [p for k in range(branch) if len(p := rows[near == k])]
            if len(parts) < 2:
                self.nodes[at].leaf, self.leaves = self.leaves, self.leaves + 1
                continue
            for p in parts:
                centre = x[p].mean(0)
                norm = np.linalg.norm(centre)
                self.nodes[at].children.append(len(self.nodes))
                queue.append((len(self.nodes), p))
                self.nodes.append(Node(centre / norm if norm > 1e-12 else x[p[0]]))
        self.under = [np.stack([self.nodes[c].centre for c in n.children]) if n.children else None for n in self.nodes]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        at, out, x = [(0, np.arange(len(x)))], np.zeros(len(x), np.int32), unit(x)
        while at:
            node, rows = at.pop()
            if self.under[node] is None:
                out[rows] = self.nodes[node].leaf
                continue
            near = (x[rows] @ self.under[node].T).argmax(1)
            at += [(c, rows[near == k]) for k, c in enumerate(self.nodes[node].children) if (near == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        q, found, heap = unit(query), [], [(-1.0, 0)]
        while heap and len(found) < most:
            _, at = heapq.heappop(heap)
            if self.under[at] is None:
                found.append(self.nodes[at].leaf)
                continue
            for c, s in zip(self.nodes[at].children, self.under[at] @ q, strict=True):
                heapq.heappush(heap, (-float(s), c))
        return found


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector to rows, each row's the same wherever it stands."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def best_of(q: np.ndarray, ids: list, rids: np.ndarray, x: np.ndarray, near: np.ndarray, k: int) -> list[tuple[int, object, float]]:
    """(rid, id, score) of the k best of one query by exact cosine; ``near`` holds cosines right to 1e-9, -inf where there is none."""
    n = min(k, int((near > -np.inf).sum()))
    if not n:
        return []
    edge = np.partition(near, len(near) - n)[len(near) - n]
    rows = np.nonzero(near >= edge - 1e-9)[0]
    key = [(-s, ids[r] is None, ids[r] or 0, int(rids[r]), s, ids[r]) for s, r in zip(cosine(q, x[rows]).tolist(), rows.tolist(), strict=True)]
    return [(rid, i, s) for *_, rid, s, i in heapq.nsmallest(n, key, key=lambda t: t[:4])]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of double): vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(sound).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists, all of the same length, as a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def exact_neighbours(rows: DataFrame, queries: pd.DataFrame, width: int, k: int) -> dict[int, list[int]]:
    """For a few queries (rid, v), the leaves of their k nearest among all rows: each task, then each query, keeps its best."""
    own, q = queries["rid"].to_numpy(), np.array(queries["v"].tolist(), np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in own]
        for batch in batches:
            if not len(batch):
                continue
            rids, ids, leaf = np.asarray(batch.column(0)), batch.column(1).to_pylist(), np.asarray(batch.column(3))
            x = _vectors(batch.column(2), width)
            near = unit(q) @ unit(x).T
            near[own[:, None] == rids[None, :]] = -np.inf
            at = {int(r): int(y) for r, y in zip(rids, leaf, strict=True)}
            for n in range(len(own)):
                more = [(-s, i is None, i or 0, rid, at[rid]) for rid, i, s in best_of(q[n], ids, rids, x, near[n], k)]
                best[n] = heapq.nsmallest(k, best[n] + more)
        out = [(n, *b) for n, found in enumerate(best) for b in found]
        types = (pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=["n", "s", "none", "id", "rid", "leaf"])

    found = rows.select("rid", "id", "v", "leaf").mapInArrow(scan, "n int, s double, none boolean, id long, rid long, leaf int")
    first = F.row_number().over(W.partitionBy("n").orderBy("s", "none", "id", "rid"))
    leaves: dict[int, list[int]] = {n: [] for n in range(len(own))}
    for r in found.withColumn("place", first).where(F.col("place") <= k).select("n", "leaf").collect():
        leaves[r["n"]].append(r["leaf"])
    return leaves


def calibrate(tree: Tree, queries: list[np.ndarray], wanted: dict[int, list[int]], recall: float) -> int:
    """The visits, widened by a fifth at a time, whose mean recall on these queries reaches the target."""
    order = [{leaf: place for place, leaf in enumerate(tree.visits(q, tree.leaves))} for q in queries]
    visits = 1
    while visits < tree.leaves:
        shares = [np.mean([order[n][leaf] < visits for leaf in leaves]) for n, leaves in wanted.items() if leaves]
        if not shares or np.mean(shares) >= recall:
            return visits
        visits = max(visits + 1, visits * 6 // 5)
    return tree.leaves


def regions_of(counts: list[int], most: int) -> tuple[list[int], list[int]]:
    """Per leaf, its first region and its number of regions: leaves in order fill regions of at most ``most`` vectors."""
    first, parts, at, room = [], [], -1, 0
    for n in counts:
        need = max(1, -(-n // most))
        if need > 1 or n > room:
            first.append(at + 1)
            at += need
            room = most - n if need == 1 else 0
        else:
            first.append(at)
            room -= n
        parts.append(need)
    return first, parts


def nearest(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, region_rows: int = REGION_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. Queries: ids divisible by ``every``."""
    rows = usable(table, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sizes["n"]
    rows = rows.where(F.size("v") == width)
    spread = F.xxhash64("id", "v")
    sample = rows.orderBy(spread, "id").limit(sample_rows).select("v").toArrow().column(0).combine_chunks()
    tree = Tree(_vectors(sample, width), leaf_rows=leaf_rows)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaf_of(_vectors(batch.column(1), width)) if len(batch) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "v", "leaf"])

    placed = rows.mapInArrow(place, "id long, v array<double>, leaf int").withColumn("rid", F.monotonically_increasing_id())
    placed = cut_lineage(placed)
    queries = placed.where(F.col("id") % every == 0).select("rid", "id", "v")
    trial = queries.orderBy(spread, "rid").limit(CALIBRATE).toPandas()
    visits = 1
    if len(trial):
        wanted = exact_neighbours(placed, trial, width, k)
        visits = calibrate(tree, [np.asarray(v) for v in trial["v"]], wanted, recall)
    copies = F.row_number().over(W.partitionBy("v").orderBy(F.col("id").asc_nulls_last(), "rid"))
    held = cut_lineage(placed.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("rid", "id", "v", "leaf"))
    # leaves are bounded by the sample, whatever the table's size
    counts = [0] * tree.leaves
    for r in held.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    first, parts = regions_of(counts, region_rows)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                out = []
                for ask, v in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    to: dict[int, list[int]] = {}
                    for leaf in shared.value.visits(np.asarray(v), visits):
                        for region in range(first[leaf], first[leaf] + parts[leaf]):
                            to.setdefault(region, []).append(leaf)
                    out += [(ask, v, region, leaves) for region, leaves in to.items()]
                types = (pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=["rid", "v", "region", "leaves"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, x, xu, ids, rids, cuts = None, [], None, None, [], None, {}

        def close_region() -> None:
            nonlocal x, xu, ids, rids, cuts
            x, leaf = np.concatenate([b[0] for b in kept]), np.concatenate([b[1] for b in kept])
            rids, ids = np.concatenate([b[2] for b in kept]), [i for b in kept for i in b[3]]
            order = np.argsort(leaf, kind="stable")
            x, leaf, rids, ids = x[order], leaf[order], rids[order], [ids[o] for o in order]
            xu, edges = unit(x), np.r_[0, np.nonzero(np.diff(leaf))[0] + 1, len(leaf)]
            cuts = {int(leaf[a]): (a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)}
            kept.clear()

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            asks, q = np.asarray(part.column("rid")), _vectors(part.column("v"), width)
            near, qu = np.full((len(q), len(x)), -np.inf), unit(q)
            visitors: dict[int, list[int]] = {}
            for n, leaves in enumerate(part.column("leaves").to_pylist()):
                for leaf in leaves:
                    visitors.setdefault(leaf, []).append(n)
            for leaf, who in visitors.items():
                if leaf in cuts:
                    a, b = cuts[leaf]
                    near[who, a:b] = qu[who] @ xu[a:b].T
            out = [(int(asks[n]), *b) for n in range(len(q)) for b in best_of(q[n], ids, rids, x, near[n], k + 1)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names=["ask", "rid", "vec_id", "score"])

        for batch in batches:
            region, asking = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8()))
            edges = np.r_[0, np.nonzero((np.diff(region) != 0) | (np.diff(asking) != 0))[0] + 1, len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if region[a] != at:
                    at, x = int(region[a]), None
                    kept.clear()
                if not asking[a]:
                    kept.append((_vectors(part.column("v"), width), np.asarray(part.column("leaf")), np.asarray(part.column("rid")), part.column("id").to_pylist()))
                    continue
                if x is None and kept:
                    close_region()
                for lo in range(0, len(part) if x is not None else 0, ASK_ROWS):
                    yield answer(part.slice(lo, ASK_ROWS))

    of = F.get(F.lit(first), F.col("leaf")) + F.pmod(F.xxhash64("rid"), F.get(F.lit(parts), F.col("leaf")))
    none = F.lit(None)
    here = held.select(of.cast("int").alias("region"), F.lit(False).alias("asking"), "rid", "id", "v", "leaf", none.cast("array<int>").alias("leaves"))
    asks = cut_lineage(queries.groupBy("v").agg(F.min("rid").alias("ask")))
    asked = asks.select("ask", "v").mapInArrow(walk, "rid long, v array<double>, region int, leaves array<int>")
    asked = asked.select("region", F.lit(True).alias("asking"), "rid", none.cast("long").alias("id"), "v", none.cast("int").alias("leaf"), "leaves")
    # the vectors of a region come before its queries, which are answered in blocks
    met = here.unionByName(asked).repartition("region").sortWithinPartitions("region", "asking")
    found = met.mapInArrow(compare, "ask long, rid long, vec_id long, score double")
    nearness = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("rid").asc()]
    best = found.withColumn("place", F.row_number().over(W.partitionBy("ask").orderBy(*nearness))).where(F.col("place") <= k + 1)
    each = queries.join(asks, "v").select(F.col("rid").alias("own"), F.col("id").alias("query_id"), "ask")
    each = each.join(best, "ask").where(F.col("rid") != F.col("own"))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("own").orderBy(*nearness))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
