"""Sinks: tables of matches and peptides, entrapment counts, images, cached statistics."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators.report import entrapment_counts

PEPTIDE_COLUMNS = ["peptide", "protein", "feature_mz", "is_decoy", "reweighted_score", "reweighted_q_value"]


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def peptide_report(result: DataFrame, fdr: float = 0.01) -> DataFrame:
    """Winners at the FDR, decoys among them marked, without repeats."""
    cols = [c for c in PEPTIDE_COLUMNS if c in result.columns]
    return result.where(F.col("is_tdc_winner") & (F.col("reweighted_q_value") <= fdr)).select(*cols).distinct().orderBy("reweighted_q_value", "peptide")


def write_results(result: DataFrame, folder: str) -> None:
    write_tsv(result, f"{folder}/matches")
    write_tsv(peptide_report(result), f"{folder}/peptides")
    write_tsv(entrapment_counts(result, "reweighted_q_value"), f"{folder}/entrapment")


def write_images(images: DataFrame, path: str) -> None:
    """Long images by channel."""
    images.write.mode("overwrite").partitionBy("channel").parquet(path)


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under a hash of the key, made and stored if it is absent or unreadable.

    Spark's writers commit a folder by a marker when it is whole.
    """
    path = f"{folder.rstrip('/')}/{hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # absent or corrupt: PySpark's own errors only
        if type(e).__module__.split(".")[0] not in ("pyspark", "py4j"):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
