"""Spectra of mzML and imzML files, read by ranges of bytes.

A Python data source whose partitions are byte ranges of the XML text: a task looks for the spectra that
begin in its range and parses these alone, so a file of any size is read by many tasks and none holds
it. For imzML the task then seeks each spectrum's arrays in the .ibd file by their offsets. Paths are local
or on storage that all nodes mount, or URIs of a file system that Arrow opens (hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import glob
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of XML, and of binary data, that a partition is to have about.
XML_BYTES, DATA_BYTES = 32 << 20, 64 << 20
_OPEN, _CLOSE = re.compile(rb"<spectrum[\s>]"), b"</spectrum>"
# Terms of the formats' controlled vocabularies.
TYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}
MZ, INTENSITY, ZLIB = "MS:1000514", "MS:1000515", "MS:1000574"
LEVEL, START_TIME, SELECTED_MZ, CHARGE = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000041"
OFFSET, LENGTH, ENCODED, X, Y = "IMS:1000102", "IMS:1000103", "IMS:1000104", "IMS:1000050", "IMS:1000051"


def _remote(path: str):
    """(file system, path) for a URI that isn't of local files."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _local(path: str) -> str | None:
    return path.removeprefix("file://") if "://" not in path or path.startswith("file:") else None


def opened(path: str) -> BinaryIO:
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    fs, at = _remote(path)
    return fs.open_input_file(at)


def size_of(path: str) -> int:
    local = _local(path)
    if local is not None:
        return os.path.getsize(local)
    fs, at = _remote(path)
    return fs.get_file_info(at).size


def files_of(path: str, suffix: str) -> list[str]:
    """The file, those of a folder with the suffix, or those that a local pattern names."""
    local = _local(path)
    if local is not None:
        found = sorted(glob.glob(os.path.join(local, f"*{suffix}"))) if os.path.isdir(local) else sorted(glob.glob(local)) or [local]
        return [p for p in found if os.path.exists(p)] or _missing(path)
    from pyarrow.fs import FileSelector, FileType

    fs, at = _remote(path)
    info = fs.get_file_info(at)
    if info.type == FileType.Directory:
        scheme = path.split("://")[0]
        return sorted(f"{scheme}://{i.path}" for i in fs.get_file_info(FileSelector(at)) if i.path.endswith(suffix))
    return [path] if info.type == FileType.File else _missing(path)


def _missing(path: str):
    raise FileNotFoundError(path)


def spectrum_elements(f: BinaryIO, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The spectrum elements that begin at a byte from start up to end."""
    f.seek(start)
    base, held = start, b""
    while True:
        m = _OPEN.search(held)
        if m is None:
            # a tag may be cut by the end of what is held
            cut = max(0, len(held) - 16)
            base, held = base + cut, held[cut:]
            more = f.read(step) if base < end else b""
            if not more:
                return
            held += more
            continue
        if base + m.start() >= end:
            return
        stop = held.find(_CLOSE, m.end())
        while stop < 0:
            more = f.read(step)
            if not more:
                return
            seen = max(m.end(), len(held) - len(_CLOSE))
            held += more
            stop = held.find(_CLOSE, seen)
        stop += len(_CLOSE)
        yield held[m.start() : stop]
        base, held = base + stop, held[stop:]


def header_groups(f: BinaryIO, step: int = 1 << 20) -> dict[str, set[str]]:
    """Parameter groups by id, with the terms that they hold: all that stands before the first spectrum."""
    f.seek(0)
    head = b""
    while not _OPEN.search(head):
        more = f.read(step)
        if not more:
            break
        head += more
    m = _OPEN.search(head)
    out = {}
    for text in re.findall(rb"<referenceableParamGroup\s.*?</referenceableParamGroup>", head[: m.start()] if m else head, re.DOTALL):
        e = ElementTree.fromstring(text)
        out[e.get("id", "")] = {c.get("accession", "") for c in e}
    return out


def _terms(e: ElementTree.Element) -> dict[str, ElementTree.Element]:
    return {c.get("accession", ""): c for c in e.iter("cvParam")}


def _array_terms(b: ElementTree.Element, groups: dict[str, set[str]]) -> tuple[set[str], str]:
    """All terms of an array, its own and those of its groups, and these groups' ids."""
    refs = [r.get("ref", "") for r in b.iter("referenceableParamGroupRef")]
    return set(_terms(b)).union(*(groups.get(r, set()) for r in refs)), " ".join(refs).lower()


def mzml_rows(f: BinaryIO, start: int, end: int) -> Iterator[tuple]:
    """(scan_id, level, rt, precursor_mz, charge, mz, intensity) of the spectra that begin in the range."""
    groups = header_groups(f)
    for text in spectrum_elements(f, start, end):
        e = ElementTree.fromstring(text)
        terms, arrays = _terms(e), {}
        for b in e.iter("binaryDataArray"):
            own, _ = _array_terms(b, groups)
            raw = base64.b64decode(b.findtext("binary") or "")
            raw = zlib.decompress(raw) if ZLIB in own and raw else raw
            arrays["mz" if MZ in own else "intensity" if INTENSITY in own else "other"] = np.frombuffer(raw, next((TYPES[t] for t in TYPES if t in own), "<f4")).astype(float)
        mz, level = arrays.get("mz", np.zeros(0)), int(terms[LEVEL].get("value", 1)) if LEVEL in terms else 1
        rt, ion, z = (terms.get(t) for t in (START_TIME, SELECTED_MZ, CHARGE))
        if not len(mz) or level == 2 and ion is None:
            continue
        minutes = float(rt.get("value")) / (60 if rt.get("unitName") == "second" else 1) if rt is not None else None
        charge = int(z.get("value")) if z is not None and int(z.get("value")) > 0 else 2
        yield int(e.get("index", 0)), level, minutes, float(ion.get("value")) if ion is not None else None, charge, mz, arrays["intensity"]


def imzml_rows(f: BinaryIO, data: BinaryIO, start: int, end: int) -> Iterator[tuple]:
    """(pixel, y, x, mz, intensity, inv_k0 or None) of the spectra that begin in the range; coordinates from 0."""
    groups = header_groups(f)
    for text in spectrum_elements(f, start, end):
        e = ElementTree.fromstring(text)
        at, parts = _terms(e), {}
        for b in e.iter("binaryDataArray"):
            own, names = _array_terms(b, groups)
            role = "mobility" if "mobility" in names else "mz" if MZ in own else "intensity" if INTENSITY in own else None
            if role is None:
                continue
            where, kind = _terms(b), np.dtype(next((TYPES[t] for t in TYPES if t in own), "<f4"))
            n = int(where[LENGTH].get("value"))
            data.seek(int(where[OFFSET].get("value")))
            raw = data.read(int(where[ENCODED].get("value")) if ZLIB in own else n * kind.itemsize)
            parts[role] = np.frombuffer(zlib.decompress(raw) if ZLIB in own else raw, kind, n).astype(float)
        if len(parts.get("mz", ())):
            yield int(e.get("index", 0)), int(at[Y].get("value")) - 1, int(at[X].get("value")) - 1, parts["mz"], parts["intensity"], parts.get("mobility")


@dataclass
class XmlRange(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, parts: int | None):
        self.kind, self.path, self.parts = kind, path, parts

    def partitions(self) -> list[XmlRange]:
        out = []
        for path in files_of(self.path, ".mzML" if self.kind == "mzml" else ".imzML"):
            size = size_of(path)
            data = size_of(ibd_of(path)) if self.kind == "imzml" else 0
            n = max(1, self.parts or max(size // XML_BYTES, data // DATA_BYTES))
            out += [XmlRange(path, size * k // n, size * (k + 1) // n) for k in range(n)]
        return out

    def read(self, partition: XmlRange) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            if self.kind == "mzml":
                peak = pa.struct([("mz", pa.float64()), ("intensity", pa.float64())])
                for scan, level, rt, ion, charge, mz, v in mzml_rows(f, partition.start, partition.end):
                    peaks = pa.ListArray.from_arrays(pa.array([0, len(mz)], pa.int32()), pa.StructArray.from_arrays([pa.array(mz), pa.array(v)], fields=list(peak)))
                    yield pa.RecordBatch.from_arrays([pa.array([scan], pa.int32()), pa.array([level], pa.int32()), pa.array([rt], pa.float64()), pa.array([ion], pa.float64()), pa.array([charge], pa.int32()), peaks], names=["scan_id", "level", "rt", "precursor_mz", "charge", "peaks"])
                return
            with opened(ibd_of(partition.path)) as data:
                for pixel, y, x, mz, v, k0 in imzml_rows(f, data, partition.start, partition.end):
                    n = len(mz)
                    fixed = [pa.array(np.full(n, c, t)) for c, t in ((pixel, np.int64), (y, np.int32), (x, np.int32))]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(mz), pa.array(v), pa.nulls(n, pa.float64()) if k0 is None else pa.array(k0)], names=["pixel", "y", "x", "mz", "intensity", "inv_k0"])


def ibd_of(path: str) -> str:
    return f"{path.rsplit('.', 1)[0]}.ibd"


class MzMLSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "massloom_mzml"

    def schema(self) -> str:
        return "scan_id int, level int, rt double, precursor_mz double, charge int, peaks array<struct<mz: double, intensity: double>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader("mzml", self.options["path"], int(self.options["parts"]) if "parts" in self.options else None)


class ImzMLSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "massloom_imzml"

    def schema(self) -> str:
        return "pixel long, y int, x int, mz double, intensity double, inv_k0 double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader("imzml", self.options["path"], int(self.options["parts"]) if "parts" in self.options else None)


def read(spark: SparkSession, source: type[DataSource], path: str, parts: int | None = None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path)
    return (reader if parts is None else reader.option("parts", str(parts))).load()
