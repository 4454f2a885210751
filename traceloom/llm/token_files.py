"""Token ids in binary shards whose document boundaries are Elias-Fano coded."""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, durable, new_path, small_batches
from .tokens import encoder

MAGIC = b"TLIDS\x00\x01\x00"
_HEAD = struct.Struct("<8sqqqqqqB")
SAMPLE = 256
SHARD_IDS = 8_000_000


class EliasFano:
    """A non-decreasing sequence below a universe, in about n * (2 + log2(universe / n)) bits.

    Low halves are packed; high halves are unary in a bit vector, of which every SAMPLE-th one's position is kept in 32 bits.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.bits, self.low, self.high, self.marks = n, bits, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<qBqqq", self.n, self.bits, len(self.low), len(self.high), len(self.marks)) + self.low.tobytes() + self.high.tobytes() + self.marks.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high, marks = struct.unpack_from("<qBqqq", data, at)
        at += struct.calcsize("<qBqqq")
        parts = []
        for kind, size in (("u1", low), ("u1", high), ("<u4", marks)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(n, bits, *parts), at

    def _low(self, i: int) -> int:
        first = i * self.bits
        part = int.from_bytes(self.low[first // 8 : (first + self.bits + 7) // 8].tobytes(), "little")
        return (part >> first % 8) & ((1 << self.bits) - 1)

    def select(self, at: np.ndarray) -> np.ndarray:
        """The values at these ascending places: only the bytes between their marks are read."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return at
        first, last = int(at[0]) // SAMPLE, int(at[-1]) // SAMPLE
        begin = int(self.marks[first])
        end = int(self.marks[last + 1]) if last + 1 < len(self.marks) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little"))
        ones = ones[ones >= begin % 8][at - first * SAMPLE] + begin // 8 * 8
        low = np.zeros(len(at), np.int64)
        if self.bits:
            bit = at[:, None] * self.bits + np.arange(self.bits)
            low = (self.low[bit >> 3] >> (bit & 7) & 1).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        return ((ones - at) << self.bits) | low

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        if not self.bits:
            return high.astype(np.int64)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.int64)
        return (high.astype(np.int64) << self.bits) | low @ (1 << np.arange(self.bits, dtype=np.int64))


class Shard:
    """One file: header, Elias-Fano document ids (from the least) and ends, then the concatenated ids and a closing line feed."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.partition, self.number, self.n_docs, self.n_ids, self.n_null, self.least, self.width = _HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.names, at = EliasFano.from_bytes(view, _HEAD.size)
        self.ends, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view, f"<u{self.width}", self.n_ids, at)
        if len(data) != at + self.n_ids * self.width + 1 or data[-1:] != b"\n":
            raise ValueError("a token shard is cut short")

    def document(self, i: int) -> np.ndarray:
        return next(self.documents(i, i + 1))[1]

    def documents(self, first: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first id, ids) of the documents first .. stop - 1."""
        ends = self.ends.select(np.arange(max(0, first - 1), stop))
        starts = ends[:-1] if first else np.concatenate([[0], ends[:-1]])
        for a, b in zip(starts.tolist(), ends[-len(starts) :].tolist(), strict=True):
            yield a, self.ids[a:b]

    @staticmethod
    def build(partition: int, number: int, doc_ids: list[int | None], parts: list[bytes], width: int) -> bytes:
        known = [x for x in doc_ids if x is not None]
        least = min(known, default=0)
        """parts: the ids of each document, width bytes each."""
        ends = np.cumsum([len(x) // width for x in parts])
        head = _HEAD.pack(MAGIC, partition, number, len(doc_ids), int(ends[-1]), len(doc_ids) - len(known), least, width)
        names = np.array(known, np.int64).astype(np.uint64) - np.uint64(least & (1 << 64) - 1) if known else np.zeros(0)
        return head + EliasFano.encode(names).to_bytes() + EliasFano.encode(ends).to_bytes() + b"".join(parts)


def _shards(path: str, end: int, shard_ids: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, here, number = encoder(path), TaskContext.get().partitionId(), 0
    kind = "<u2" if max(enc.vocabulary, end + 1) <= 65536 else "<u4"
    stop = np.array([end], kind).tobytes()
    names: list[int | None] = []
    parts: list[bytes] = []
    size = 0
    for batch in batches:
        for name, ids in zip(column(batch, "doc_id").to_pylist(), enc.raw(column(batch, "text")), strict=True):
            names.append(name)
            parts.append(ids.astype(kind).tobytes() + stop)
            size += len(ids) + 1
            if size >= shard_ids:
                yield pa.RecordBatch.from_pydict({"blob": pa.array([Shard.build(here, number, names, parts, int(kind[2]))], pa.binary())})
                names, parts, size, number = [], [], 0, number + 1
    if names:
        yield pa.RecordBatch.from_pydict({"blob": pa.array([Shard.build(here, number, names, parts, int(kind[2]))], pa.binary())})


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write whole texts as token shards in ascending doc_id order, through Spark's own committer.

    Null texts are empty; null ids come first; rows that share an id are ordered by the text's hash. A text is never split over
    files. An empty table leaves a folder without shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    blobs = ordered.mapInArrow(lambda b: _shards(tokenizer, end_id, shard_ids, b), "blob binary")
    blobs.select(F.col("blob").cast("string")).write.option("maxRecordsPerFile", 1).text(out)


_DOC = "place long, doc_id long, local long, n_tokens long, ids_crc32 long"
_DOCS = f"partition long, number long, doc struct<{_DOC.replace(' ', ':').replace(',:', ',')}>"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents found by select, some thousand at a time."""
    for batch in batches:
        for data in column(batch, "content"):
            shard = Shard(data.as_py())
            for at in range(0, shard.n_docs, 4096):
                stop = min(at + 4096, shard.n_docs)
                found = [(a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for a, x in shard.documents(at, stop)]
                names = shard.names.select(np.arange(max(at, shard.n_null), stop) - shard.n_null).astype(np.uint64) + np.uint64(shard.least & (1 << 64) - 1)
                names = [None] * (stop - at - len(names)) + names.astype(np.int64).tolist()
                kinds = [x.split()[0] for x in _DOC.split(", ")]
                doc = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (range(at, stop), names, *zip(*found, strict=True))], kinds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(stop - at, shard.partition)), pa.array(np.full(stop - at, shard.number)), doc], ["partition", "number", "doc"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards; start counts all ids before it over all shards."""
    small_batches(spark)
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = durable(files.mapInArrow(_documents, _DOCS))  # each file is read once
    totals = rows.groupBy("partition", "number").agg(F.sum("doc.n_tokens").alias("n"))

    def earlier(*keys: str, by: list[str]) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # files inside their write task, then one row for each write task
    tasks = totals.groupBy("partition").agg(F.sum("n").alias("n")).select("partition", earlier("partition", by=[]).alias("whole"))
    before = totals.select("partition", "number", earlier("number", by=["partition"]).alias("own")).join(tasks, "partition").select("partition", "number", (F.col("whole") + F.col("own")).alias("before"))
    return rows.join(before, ["partition", "number"]).select("doc.doc_id", (F.col("before") + F.col("doc.local")).alias("start"), "doc.n_tokens", "doc.ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 10: byte-level ids of all documents, written in the shard format and read back."""
    import public_tokenizers

    out = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_files(spark, out)
