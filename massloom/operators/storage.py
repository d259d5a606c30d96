"""Reliable storage between steps, in the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names. Where none is set, a temporary one serves a single machine
    only; on a cluster that is an error, since no executor would see it."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="massloom-")
    context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: what reads it plans and computes nothing of what came before again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same by a written table, for wide tables of which later steps read few columns."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
