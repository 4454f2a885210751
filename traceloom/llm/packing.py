"""Best-fit packing: few-document length patterns fitted to the length histogram by non-negative least squares."""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, durable, small_batches
from .tokens import encoder

CLASSES = 64


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson)."""
    ata, atb = a.T @ a, a.T @ b
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, np.abs(atb).max(initial=0))
    for _ in range(rounds):
        grad = np.where(on, -np.inf, atb - ata @ x)
        if grad.max(initial=-np.inf) <= tol:
            break
        on[int(grad.argmax())] = True
        while True:
            idx = np.flatnonzero(on)
            s = np.linalg.lstsq(ata[np.ix_(idx, idx)], atb[idx], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[idx] = s
                break
            low = s <= 0
            step = (x[idx][low] / np.maximum(x[idx][low] - s[low], 1e-300)).min()
            x[idx] += step * (s - x[idx])
            x[x < 1e-12] = 0
            on &= x > 0
            if not on.any():
                return x
    return x


def patterns(classes: int, most: int = 3) -> list[tuple[int, ...]]:
    """Every way to fill `classes` with at most `most` parts, the largest first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, parts: tuple[int, ...]) -> None:
        if not left:
            out.append(parts)
        elif len(parts) < most:
            for p in range(min(left, top), 0, -1):
                grow(left - p, p, (*parts, p))

    grow(classes, classes, ())
    return out


def pack_histogram(counts: dict[int, int], size: int, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths of one sequence, how many such sequences) that together use up the histogram.

    Lengths round up to classes of size / classes; repeat counts of the patterns that fill a sequence exactly are fitted to
    the class histogram, rounded down and filled with real lengths, the longest first. Then each remaining length, from the
    longest, goes to the sequences with the least room that it fits, or to new ones. Work depends on the number of different
    lengths and groups, not on the number of documents.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= size for n in left):
        raise ValueError("lengths must be from 1 to the sequence size")
    width = -(-size // classes)
    of = {c: sorted((n for n in left if -(-n // width) == c), reverse=True) for c in range(1, classes + 1)}
    have = np.array([sum(left[n] for n in of[c]) for c in range(1, classes + 1)], float)
    ways = patterns(classes)
    a = np.zeros((classes, len(ways)))
    for j, way in enumerate(ways):
        for c in way:
            a[c - 1, j] += 1
    # long documents have few partners, so their misfit weighs more
    weight = np.sqrt(np.arange(1, classes + 1) / classes)
    fit = np.floor(nnls(a * weight[:, None], have * weight) + 1e-6).astype(np.int64)
    groups: list[tuple[tuple[int, ...], int]] = []
    for j in np.argsort([-max(w) for w in ways], kind="stable"):
        want = int(fit[j])
        while want > 0:
            parts, take, used = [], want, {}
            for c in ways[j]:
                n = next((n for n in of[c] if left.get(n, 0) > used.get(n, 0)), None)
                if n is None:
                    break
                parts.append(n)
                used[n] = used.get(n, 0) + 1
            if len(parts) < len(ways[j]):
                break
            take = min(want, *(left[n] // k for n, k in used.items()))
            for n, k in used.items():
                left[n] -= k * take
            groups.append((tuple(parts), take))
            want -= take
    rooms: dict[int, list[list]] = {}
    for parts, c in groups:
        rooms.setdefault(size - sum(parts), []).append([parts, c])
    for n in sorted(left, reverse=True):
        rest = left[n]
        for room in sorted(r for r in rooms if r >= n):
            while rest and rooms[room]:
                group = rooms[room][-1]
                each = min(room // n, max(1, rest // group[1]))
                take = min(rest // each, group[1])
                group[1] -= take
                if not group[1]:
                    rooms[room].pop()
                rooms.setdefault(room - each * n, []).append([group[0] + (n,) * each, take])
                rest -= take * each
            if not rooms[room]:
                del rooms[room]
            if not rest:
                break
        if rest:
            each = size // n
            if full := rest // each:
                rooms.setdefault(size - each * n, []).append([(n,) * each, full])
            if rest % each:
                rooms.setdefault(size - rest % each * n, []).append([(n,) * (rest % each), 1])
    return [(tuple(parts), c) for found in rooms.values() for parts, c in found]


def placements(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: where runs of ranks start, the first sequence of each run, and the offset inside its sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for parts, count in groups:
        offset = 0
        for n in parts:
            out.setdefault(n, []).append((used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        first += count
    return {n: tuple(np.array(x, np.int64).T) for n, x in out.items()}


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, key = encoder(path), TaskContext.get().partitionId() << 40
    stop = np.array([end], "<u4").tobytes()
    for batch in batches:
        rows = []
        for name, ids in zip(column(batch, "doc_id").to_pylist(), enc.raw(column(batch, "text")), strict=True):
            raw = ids.tobytes() + stop
            for k, at in enumerate(range(0, len(raw), 4 * size)):
                piece = raw[at : at + 4 * size]
                rows.append((name, k, at // 4, len(piece) // 4, zlib.crc32(piece), key))
                key += 1
        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "key")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], list(names))


def _numbered(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of this task and the place of each piece among those of its length in this task."""
    here, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for batch in batches:
        length = column(batch, "length").to_numpy()
        order = np.argsort(length, kind="stable")
        own = length[order]
        nth = np.empty(len(own), np.int64)
        nth[order] = np.arange(len(own)) - np.searchsorted(own, own, "left") + seen[own]
        seen += np.bincount(own, minlength=size + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), here)), pa.array(nth)], [*batch.schema.names, "task", "nth"])


def _tallied(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pieces of each length a task has."""
    seen, task = np.zeros(size + 1, np.int64), 0
    for batch in batches:
        seen += np.bincount(column(batch, "length").to_numpy(), minlength=size + 1)
        task = column(batch, "task").to_numpy().max(initial=task)
    length = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(length), task)), pa.array(length), pa.array(seen[length])], ["task", "length", "n"])


def _placed(size: int, plan: dict, keys: np.ndarray, before: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, task, nth = (column(batch, c).to_numpy() for c in ("length", "task", "nth"))
        rank = before[np.searchsorted(keys, task * (size + 1) + length)] + nth
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            starts, firsts, offsets = plan[int(n)]
            run = np.searchsorted(starts, rank[at], "right") - 1
            sequence[at], offset[at] = firsts[run] + rank[at] - starts[run], offsets[run]
        keep = [x.split()[0] for x in _PIECE.split(", ")]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are dealt out by ranges of length, and among equal lengths by a hash, so a task has few lengths and a length that
    most pieces have is spread. A piece finds its place from its rank among pieces of its length: those in earlier tasks and
    those before it in its own. What reaches the driver are the counts of lengths in tasks, at most one for each length and
    one more for each task. Null and empty texts are pieces of the end id alone; repeated rows are packed each for itself;
    null ids stay null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pieces = durable(rows.mapInArrow(partial(_pieces, tokenizer, end_id, size), f"{_PIECE}, key long"))
    dealt = pieces.repartitionByRange("length", F.xxhash64("key")).drop("key")
    dealt = durable(dealt.mapInArrow(partial(_numbered, size), f"{_PIECE}, task long, nth long"))
    tally = dealt.mapInArrow(partial(_tallied, size), "task long, length long, n long").toArrow()
    task, length, n = (tally.column(c).to_numpy() for c in ("task", "length", "n"))
    order = np.lexsort((task, length))
    task, length, n = task[order], length[order], n[order]
    run = np.cumsum(n) - n
    before = run - run[np.searchsorted(length, length, "left")]
    keys = task * (size + 1) + length
    order = np.argsort(keys)
    plan = placements(pack_histogram({int(x): int(n[length == x].sum()) for x in np.unique(length)}, size))
    return dealt.mapInArrow(partial(_placed, size, plan, keys[order], before[order]), f"{_PIECE}, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 9: all documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
