"""Sharding by size-tiered compaction, in DataFrame operations and file renames only.

A store is a folder of immutable Parquet files, its shards, and of numbered manifests that
list the live ones. Arrivals are appended as small shards. When a size tier (a factor of
``fan_in``) holds ``fan_in`` shards or more, all of them are merged into files of about the
target size, without a shuffle; shards of half the target or more are full and stay. Every
change commits one further manifest by a rename that fails if the number is taken, so readers
see whole versions only, writers don't overwrite each other, and files of a failed attempt
are never live. Shards that a merge replaced are removed once no kept version lists them.

Rows keep all their columns, whatever their names, nulls included; repeated rows stay repeated; an
empty table makes a store without shards. A null id goes to the first arrival.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from massloom.llm.common import ensure_checkpoint_dir, read_table

TARGET_BYTES, FAN_IN, UNIT_BYTES = 64 << 20, 4, 1 << 20


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    merges: int


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, keep_versions: int = 1):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.fan_in, self.keep = target_bytes, fan_in, keep_versions
        jvm = spark.sparkContext._jvm
        self._fs_api = jvm.org.apache.hadoop.fs
        self._path = self._fs_api.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self.folder = self._fs.makeQualified(self._path(self.folder)).toString()
        self._context = self._fs_api.FileContext.getFileContext(self._path(self.folder).toUri(), conf)
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    # versions

    def version(self) -> int:
        """The number of the last committed manifest; 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/manifests/{version:012d}.json"

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Makes ``shards`` version base + 1; fails if another writer has made that version."""
        attempt = self._path(f"{self.folder}/attempts/{uuid.uuid4().hex}")
        out = self._fs.create(attempt)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        rename = getattr(self._fs_api, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.valueOf("NONE")
        self._context.rename(attempt, self._path(self._manifest(base + 1)), none)
        self._vacuum(base + 1)
        return base + 1

    def _vacuum(self, version: int) -> None:
        """Removes what only versions before the kept ones list."""
        old = version - self.keep
        if old < 1 or not self._fs.exists(self._path(self._manifest(old))):
            return
        live = {s.path for v in range(old + 1, version + 1) for s in self.shards(v)}
        for s in self.shards(old):
            if s.path not in live:
                self._fs.delete(self._path(s.path), False)
        self._fs.delete(self._path(self._manifest(old)), False)

    # data

    def _files(self, folder: str, merges: int) -> list[Shard]:
        found, at = [], self._fs.listFiles(self._path(folder), True)
        while at.hasNext():
            s = at.next()
            if s.getPath().getName().startswith("part-") and s.getLen() > 0:
                found.append(Shard(s.getPath().toString(), s.getLen(), merges))
        return sorted(found, key=lambda s: s.path)

    def uri(self, path: str) -> str:
        """The path as _metadata.file_path gives it, with blanks and the like escaped."""
        return self._path(path).toUri().toString()

    def write(self, df: DataFrame, arrival_col: str | None = None) -> list[list[Shard]]:
        """Writes rows as shards that aren't live yet; one list of shards per value of arrival_col."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        if arrival_col is None:
            df.write.parquet(folder)
            return [self._files(folder, 0)]
        df.write.partitionBy(arrival_col).parquet(folder)
        parts = sorted((s.getPath().toString() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()), key=lambda p: int(p.rpartition("=")[2]))
        return [self._files(p, 0) for p in parts]

    def append(self, shards: list[Shard]) -> int:
        base = self.version()
        return self.commit(base, self.shards(base) + shards)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / UNIT_BYTES, self.fan_in)))

    def due(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the lowest tier that holds enough of them to merge."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self, schema) -> int:
        """Merges until no tier is due; returns the version."""
        version = self.version()
        while run := self.due(shards := self.shards(version)):
            files = -(-sum(s.bytes for s in run) // self.target)
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*(s.path for s in run)).coalesce(files).write.parquet(folder)
            gone = {s.path for s in run}
            version = self.commit(version, [s for s in shards if s.path not in gone] + self._files(folder, 1 + max(s.merges for s in run)))
        return version

    def read(self, schema) -> DataFrame:
        paths = [s.path for s in self.shards()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def shard_arrivals(docs: DataFrame, folder: str, id_col: str = "doc_id", arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store of all rows, which arrive in ``arrivals`` parts by a hash of the id and are compacted after each."""
    store = ShardStore(docs.sparkSession, folder, target_bytes)
    arrival, taken = "_arrival", {c.lower() for c in docs.columns}
    while arrival in taken:
        arrival += "_"
    own = docs.withColumn(arrival, F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(arrivals)), F.lit(0)).cast("int"))
    for shards in store.write(own, arrival):
        store.append(shards)
        store.compact(docs.schema)
    return store


def shard_rows(store: ShardStore, schema, id_col: str = "doc_id") -> DataFrame:
    """Per row of the store: its id, and the number, bytes, merges and rows of its shard, and the version."""
    live = store.shards()
    # only the id is read, so that no column of the rows hides the file's own metadata
    ids = store.read(StructType([schema[id_col]])).withColumnRenamed(id_col, "id")
    rows = ids.select("id", F.col("_metadata.file_path").alias("_file")) if live else ids.select("id", F.lit("").alias("_file"))
    # whole paths, as Spark writes them: files of one task share their base name in the folders of all arrivals
    table = store.spark.createDataFrame([(store.uri(s.path), k, s.bytes, s.merges) for k, s in enumerate(live)], "_file string, shard_id int, shard_bytes long, merges int")
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("shard_rows"))
    named = table.join(sizes, "_file")
    return rows.join(F.broadcast(named) if len(live) <= 20_000 else named, "_file").select("id", "shard_id", "shard_bytes", "shard_rows", "merges", F.lit(store.version()).alias("version"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    store = shard_arrivals(docs, f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")
    return shard_rows(store, docs.schema).withColumnRenamed("id", "doc_id")
