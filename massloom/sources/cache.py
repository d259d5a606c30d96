"""A cache of extractions: tables that a run derives once for each content of inputs and settings.

An entry is a Parquet folder, named by a hash of the extraction's name, its settings and the content of its input
tables. It is written beside and published by a rename that fails if the entry is there, so
readers see whole entries only, and of two writers one wins and both read the same. Entries don't
expire; delete the folder to free them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.operators.extraction import ion_images, isotope_means


def fingerprint(table: DataFrame) -> str:
    """Equal for tables of the same columns and rows, in any order: names, types, the number of rows, and sums over
    two hashes of each row, taken in one pass. Columns are told apart by place and nulls are counted by column."""
    named = [F.col(f"`{c}`") for c in table.columns]
    # the hashes pass nulls over: which columns are null is hashed with the values
    empty = F.concat_ws("", *(F.isnull(c).cast("int").cast("string") for c in named))
    whole = lambda seed: F.sum(F.xxhash64(F.lit(seed), empty, *named).cast("decimal(38,0)"))
    seen = table.agg(F.count(F.lit(1)), whole(1), whole(2)).first()
    return hashlib.sha256(json.dumps([table.schema.simpleString(), *map(str, seen)]).encode()).hexdigest()


class ExtractionCache:
    def __init__(self, spark: SparkSession, folder: str):
        """``folder`` has to be on storage that all nodes share."""
        self.spark = spark
        api = spark.sparkContext._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = api.Path
        self._fs = api.Path(folder).getFileSystem(conf)
        self.folder = self._fs.makeQualified(api.Path(folder)).toString().rstrip("/")
        self._context = api.FileContext.getFileContext(api.Path(self.folder).toUri(), conf)
        self._none = spark.sparkContext._gateway.new_array(getattr(api, "Options$Rename"), 1)
        self._none[0] = getattr(api, "Options$Rename").valueOf("NONE")
        self._fs.mkdirs(api.Path(self.folder))

    def key(self, name: str, settings: dict, inputs: dict[str, DataFrame]) -> str:
        known = {"name": name, "settings": settings, "inputs": {k: fingerprint(v) for k, v in inputs.items()}}
        return f"{name}-{hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()}"

    def get(self, name: str, settings: dict, inputs: dict[str, DataFrame], extract: Callable[[], DataFrame]) -> DataFrame:
        """The entry, read; ``extract`` is called if there is none. Settings are what JSON can hold."""
        entry = f"{self.folder}/{self.key(name, settings, inputs)}"
        if not self._fs.exists(self._path(entry)):
            attempt = f"{self.folder}/_attempts/{uuid.uuid4().hex}"
            extract().write.parquet(attempt)
            try:
                self._context.rename(self._path(attempt), self._path(entry), self._none)
            except Py4JJavaError:
                # another writer was first: its entry holds the same rows
                if not self._fs.exists(self._path(entry)):
                    raise
                self._fs.delete(self._path(attempt), True)
        return self.spark.read.parquet(entry)

    def images(self, peaks: DataFrame, features: DataFrame, ppm: float = 20.0) -> DataFrame:
        """``ion_images``, extracted once."""
        return self.get("images", {"ppm": ppm}, {"peaks": peaks, "features": features}, lambda: ion_images(peaks, features, ppm))

    def isotopes(self, peaks: DataFrame, features: DataFrame, ppm: float, n_pixels: int) -> DataFrame:
        """``isotope_means``, extracted once."""
        return self.get("isotopes", {"ppm": ppm, "n_pixels": n_pixels}, {"peaks": peaks, "features": features}, lambda: isotope_means(peaks, features, ppm, n_pixels))
