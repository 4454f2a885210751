"""ABIF traces: a reader for one file's bytes, a table of tags, a data source, and channels."""
from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DYE_NAMES, WAVELENGTHS

MAGIC = b"ABIF"
_ENTRY = struct.Struct(">4siHHiii")
#: Element types of the format and how numpy reads them.
NUMBERS = {1: ">u1", 2: "S1", 3: ">u2", 4: ">i2", 5: ">i4", 7: ">f4", 8: ">f8", 13: ">u1"}
_DATE, _TIME, _PASCAL, _C = 10, 11, 18, 19
#: Channels: where the dye's name and the data of each lie.
CHANNELS = ((1, 1), (2, 2), (3, 3), (4, 4), (5, 105))


class AbifError(ValueError):
    pass


def _value(kind: int, count: int, raw: bytes) -> Any:
    if kind == 2:
        return raw.decode("latin-1")
    if kind == _PASCAL:
        return raw[1 : 1 + raw[0]].decode("latin-1") if raw else ""
    if kind == _C:
        return raw.split(b"\0", 1)[0].decode("latin-1")
    if kind == _DATE:
        return struct.unpack_from(">hBB", raw)
    if kind == _TIME:
        return struct.unpack_from(">BBBB", raw)
    if kind in NUMBERS:
        return np.frombuffer(raw, NUMBERS[kind], min(count, len(raw) // np.dtype(NUMBERS[kind]).itemsize)).astype(float)
    return raw  # user types stay bytes


def read_tags(data: bytes) -> dict[tuple[str, int], tuple[int, Any]]:
    """(tag, number) to (element type, value) of all entries of a file.

    The header's own entry tells where the directory lies. Values of up to four bytes stand in the entry itself.
    """
    if data[:4] != MAGIC:
        raise AbifError("not an ABIF file")
    _, _, _, size, entries, _, start = _ENTRY.unpack_from(data, 6)
    out = {}
    for i in range(entries):
        at = start + i * size
        if at + 28 > len(data):
            raise AbifError("the directory is cut short")
        tag, number, kind, _, count, length, offset = _ENTRY.unpack_from(data, at)
        begin = at + 20 if length <= 4 else offset
        if begin < 0 or begin + length > len(data):
            raise AbifError(f"{tag!r} {number} lies outside the file")
        out[(tag.decode("latin-1"), number)] = (kind, _value(kind, count, data[begin : begin + length]))
    return out


def write_tags(tags: dict[tuple[str, int], tuple[int, Any]]) -> bytes:
    """A file of these tags, as read_tags reads it."""
    body, entries = b"", []
    for (tag, number), (kind, value) in tags.items():
        if kind in (2, _C, _PASCAL):
            text = value.encode("latin-1")
            raw = bytes([len(text)]) + text if kind == _PASCAL else text + b"\0" * (kind == _C)
            count, width = len(raw), 1
        elif kind in (_DATE, _TIME):
            raw = struct.pack(">hBB" if kind == _DATE else ">BBBB", *value)
            count, width = 1, 4
        else:
            array = np.asarray(value).astype(NUMBERS[kind])
            raw, count, width = array.tobytes(), len(array), array.itemsize
        at = 128 + len(body)
        entries.append((tag.encode(), number, kind, width, count, len(raw), raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">i", at)))
        body += raw if len(raw) > 4 else b""
    directory = b"".join(struct.pack(">4siHHii", *e[:6]) + e[6] + b"\0" * 4 for e in entries)
    head = MAGIC + struct.pack(">H", 101) + struct.pack(">4siHHiii", b"tdir", 1, 1023, 28, len(entries), len(directory), 128 + len(body)) + b"\0" * 4
    return head.ljust(128, b"\0") + body + directory


_TAGS = "path string, tag string, number int, kind int, text string, numbers array<double>, bytes binary"


def _rows(path: str, data: bytes) -> list[tuple]:
    rows = []
    for (tag, number), (kind, value) in read_tags(data).items():
        text = value if isinstance(value, str) else None
        numbers = list(map(float, value)) if isinstance(value, (np.ndarray, tuple)) else None
        rows.append((path, tag, number, kind, text, numbers, value if isinstance(value, bytes) else None))
    return rows


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _TAGS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            yield pd.DataFrame(_rows(path, bytes(content)), columns=names)


def read_abif(spark: SparkSession, path: str, pattern: str = "*.fsa") -> DataFrame:
    """One row a tag of all matching files below path, through Spark's own file reader, so any store it knows will do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parse_files(files)


def parse_files(files: DataFrame) -> DataFrame:
    """Tags of files given as (path, content). A damaged file fails the job; filter with readable() first to leave it out."""
    return files.select("path", "content").mapInPandas(_parsed, _TAGS)


def readable(files: DataFrame) -> DataFrame:
    """Adds problem: why a file (path, content) cannot be read, null if it can."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    read_tags(bytes(content))
                    out.append(None)
                except (AbifError, struct.error) as e:
                    out.append(str(e) or "cut short")
            yield pd.DataFrame({"path": batch["path"], "problem": out})

    return files.select("path", "content").mapInPandas(check, "path string, problem string")


def tag(tags: DataFrame, name: str) -> DataFrame:
    """Rows of one entry, named by four letters and a number, as DATA1."""
    return tags.where((F.col("tag") == name[:4]) & (F.col("number") == int(name[4:])))


def run_starts(tags: DataFrame) -> DataFrame:
    """(path, started) from the entries of the run's first date and time."""
    parts = tags.where("number = 1 and tag in ('RUND', 'RUNT')").groupBy("path").agg(F.max(F.when(F.col("tag") == "RUND", F.col("numbers"))).alias("d"), F.max(F.when(F.col("tag") == "RUNT", F.col("numbers"))).alias("t"))
    return parts.select("path", _started())


def _started() -> Column:
    whole = lambda c, i: F.get(c, F.lit(i)).cast("int")
    return F.make_timestamp_ntz(whole("d", 0), whole("d", 1), whole("d", 2), whole("t", 0), whole("t", 1), F.get("t", F.lit(2))).alias("started")


def channels(tags: DataFrame) -> DataFrame:
    """(path, channel, dye, wavelength, raw): channels whose dye and data a file has; other names of dyes are brought to one."""
    pairs = F.when(F.col("tag") == "DyeN", F.col("number")).when(F.col("tag") == "DyeW", F.col("number"))
    place = F.when(F.col("tag") == "DATA", F.when(F.col("number") == 105, 5).otherwise(F.col("number"))).otherwise(pairs)
    wanted = tags.where("(tag in ('DyeN', 'DyeW') and number between 1 and 5) or (tag = 'DATA' and (number between 1 and 4 or number = 105))").withColumn("channel", place)
    own = wanted.groupBy("path", "channel").agg(F.max(F.when(F.col("tag") == "DyeN", F.col("text"))).alias("dye"), F.max(F.when(F.col("tag") == "DyeW", F.get("numbers", F.lit(0)))).alias("wavelength"), F.max(F.when(F.col("tag") == "DATA", F.col("numbers"))).alias("raw"))
    return _known(own).select("path", "channel", "dye", _wavelength(), "raw")


def _known(own: DataFrame) -> DataFrame:
    return own.where("dye is not null and raw is not null").replace(DYE_NAMES, subset=["dye"])


def _wavelength() -> Column:
    usual = F.create_map(*[F.lit(x) for pair in WAVELENGTHS.items() for x in pair])
    return F.coalesce(F.col("wavelength").cast("int"), F.try_element_at(usual, F.col("dye"))).alias("wavelength")


def _file_channels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "channel", "dye", "wavelength", "raw", "d", "t"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            tags = {k: v for k, (_, v) in read_tags(bytes(content)).items()}
            numbers = lambda *k: list(map(float, v)) if isinstance(v := tags.get(k), (np.ndarray, tuple)) else None  # noqa: E731, B023
            dye = {i: v if isinstance(v := tags.get(("DyeN", i)), str) else None for i, _ in CHANNELS}
            rows = [(path, i, dye[i], (numbers("DyeW", i) or [None])[0], numbers("DATA", at), numbers("RUND", 1), numbers("RUNT", 1)) for i, at in CHANNELS]
            yield pd.DataFrame(rows, columns=names)


def file_channels(files: DataFrame) -> DataFrame:
    """As channels, with started, of files (path, content): a file is whole in itself, so no tag or array of numbers is moved."""
    own = files.select("path", "content").mapInPandas(_file_channels, "path string, channel int, dye string, wavelength double, raw array<double>, d array<double>, t array<double>")
    return _known(own).select("path", "channel", "dye", _wavelength(), "raw", _started())


def assays(channels_: DataFrame) -> DataFrame:
    """Channels with assay_id and channel_id, hashes of the path and of the channel's place in it."""
    return channels_.withColumn("assay_id", F.xxhash64("path")).withColumn("channel_id", F.xxhash64("path", "channel"))


def fresh(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, modificationTime) that a cache of channels does not hold as new as they are."""
    return files.join(cache.select("path", F.col("modificationTime").alias("_m")).distinct(), "path", "left").where("_m is null or _m < modificationTime").drop("_m")


def trace_columns(channels_: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """(path, rtime, one column a name) of each file's channels, as long as the shortest; columns gives the dye and the array of each name.

    A file's arrays meet in one row before they become rows of ticks, so what is moved is a file's channels and never a tick.
    """
    used = sorted({c for _, c in columns.values()})
    arrays = {n: F.first(F.when(F.col("dye") == dye, F.col(c)), ignorenulls=True) for n, (dye, c) in columns.items()}
    size = F.least(*(F.size(c) for c in used)) if len(used) > 1 else F.size(used[0])
    files = channels_.groupBy("path").agg(F.min(size).alias("_n"), *(a.alias(n) for n, a in arrays.items()))
    ticks = F.arrays_zip(*(F.coalesce(F.col(n), F.array().cast("array<double>")).alias(n) for n in columns))
    rows = files.where("_n > 0").select("path", F.posexplode(F.slice(ticks, F.lit(1), F.col("_n"))).alias("rtime", "_t"))
    return rows.select("path", "rtime", *(F.col("_t")[n].alias(n) for n in columns))


def trace_rows(channels_: DataFrame, column: str = "raw") -> DataFrame:
    """(path, rtime, one column a dye) of each file's channels, as long as the shortest."""
    return trace_columns(channels_, {dye: (dye, column) for dye in WAVELENGTHS})


def register(spark: SparkSession) -> None:
    """Makes spark.read.format('abif').load(folder) known, for folders that every executor can open."""
    import os

    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class File(InputPartition):
        def __init__(self, path: str):
            self.path = path

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self) -> list[InputPartition]:
            found = [os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if f.lower().endswith((".fsa", ".ab1"))] if os.path.isdir(self.path) else [self.path]
            return [File(p) for p in sorted(found)]

        def read(self, partition: File) -> Iterator[tuple]:
            with open(partition.path, "rb") as f:
                yield from _rows(partition.path, f.read())

    class Abif(DataSource):
        @classmethod
        def name(cls) -> str:
            return "abif"

        def schema(self) -> str:
            return _TAGS

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"])

    spark.dataSource.register(Abif)
