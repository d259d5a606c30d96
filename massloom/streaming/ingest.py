"""Streaming ingest of pixel spectra, an extension: sums that merge are kept per window of arrival.

The batch operators need no stream; this lets an acquisition be watched while it runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_histogram(peaks: DataFrame, ppm_bin: float = 5.0, time: str = "ts", window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Rows (ts, pixel, mz, intensity) as a stream: per window and m/z bin, pixels (approximate), intensity and moment.

    Late rows are taken until the watermark passes the window. The same function runs on a batch.
    """
    width = math.log1p(ppm_bin / 4 * 1e-6)
    table = peaks.withWatermark(time, late) if peaks.isStreaming else peaks
    return table.where("mz > 0").groupBy(F.window(time, window), F.floor(F.log("mz") / width).cast("long").alias("bin")).agg(F.approx_count_distinct("pixel").alias("n_pixels"), F.sum("intensity").alias("intensity"), F.sum(F.col("mz") * F.col("intensity")).alias("moment"))


def merged_totals(windows: DataFrame) -> DataFrame:
    """Sums over windows, for the parts that merge exactly."""
    return windows.groupBy("bin").agg(F.sum("intensity").alias("intensity"), F.sum("moment").alias("moment"))


def start(stream: DataFrame, path: str, checkpoint: str):
    """Appends finished windows to Parquet; exactly once by the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
