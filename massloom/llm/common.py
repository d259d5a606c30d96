"""Helpers that the operators share: word rules, shared storage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
#: Narrow rows that one file of a checkpoint holds, where their number is known.
FILE_ROWS = 100_000
#: Bytes that a file of texts is to have at least, and that the texts of a chunk have at most, unless one alone has more.
FILE_BYTES, CHUNK_BYTES = 16 << 20, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all nodes share, as the session names it. Where none is set, a temporary one
    serves a single machine only; on a cluster that is an error, since no executor would see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="massloom-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def once(value: Column) -> Column:
    """The value as an expression that counts as nondeterministic, so that the optimizer neither
    copies it into lambdas and pushed-down filters nor merges its projection with others."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Reliable checkpoint: later reads survive the loss of executors. Where the number of narrow
    rows is known, they go to no more files than they fill: ``FILE_ROWS`` each."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint(eager=True)


def settled(df: DataFrame, rows: int | None = None, **measures: Column) -> tuple[DataFrame, dict]:
    """The table with its lineage cut, and the measures over its rows, taken while it is written."""
    seen = Observation()
    first, *more = [value.alias(name) for name, value in measures.items()]
    return cut_lineage(df.observe(seen, first, *more), rows), seen.get


def in_large_files(df: DataFrame, size: int, least: int = FILE_BYTES) -> DataFrame:
    """The table in no more partitions than its size in bytes fills, though in one for each core if it
    has them, for tables that are written next."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, size // least))


def chunks(batch: pa.RecordBatch, column: int, rows: int, most_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in its order, of at most so many rows and so many bytes of texts; a longer text is one alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most_bytes, side="right"))
        end = max(at + 1, min(fits, at + rows, len(batch)))
        yield batch.slice(at, end - at)
        at = end


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def at_hand(table: DataFrame, rows: int | None = None, most_rows: int = 20_000) -> DataFrame:
    """A table of statistics by group, marked for broadcast if it is small by the known bound of its
    rows, or else by a count; if not, as it is, for a shuffled join."""
    small = rows is not None and rows <= most_rows or table.limit(most_rows + 1).count() <= most_rows
    return F.broadcast(table) if small else table
