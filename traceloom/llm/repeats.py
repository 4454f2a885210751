"""Exact repeats of long byte strings: content-chosen anchors bring equal strings together, enhanced suffix arrays tell them apart."""
import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, durable, small_batches, texts

#: Bytes of a string that counts when it repeats, and of the anchor that is chosen in it.
LEAST, ANCHOR = 200, 40
#: Bytes scanned together; bytes of contexts of one suffix array; variants of one anchor that fit into one.
SCAN, SUFFIXES, VARIANTS = 1 << 20, 1 << 19, 2048
_SPOT = (1 << 21) - 1
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SCAN + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Hashes of any substrings of a buffer from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def anchors(pieces: list[bytes], least: int = LEAST, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(piece, first, span, anchor hash) of runs of windows that share an anchor.

    The anchor of a window of `least` bytes is its leftmost `size`-gram of least hash, so equal windows have equal anchors at
    equal distances. A run holds the windows first .. first + span of a piece; its context is the bytes they cover.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if len(data) < least:
        return empty
    hashes = Prefixes(data)
    at = np.arange(len(data) - size + 1)
    grams = _mix(hashes.of(at, at + size))
    low = (grams & ~np.uint64(_SPOT)) | at.astype(np.uint64)
    width, have = least - size + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    spot = (low & np.uint64(_SPOT)).astype(np.int64)
    ends = np.cumsum(lengths)
    piece = np.repeat(np.arange(len(pieces)), lengths)[: len(spot)]
    whole = np.arange(len(spot)) + least <= ends[piece]
    idx = np.flatnonzero(whole)
    if not len(idx):
        return empty
    new = np.ones(len(idx), bool)
    new[1:] = (np.diff(idx) > 1) | (np.diff(spot[idx]) != 0) | (np.diff(piece[idx]) != 0)
    begin = np.flatnonzero(new)
    first = idx[begin]
    last = idx[np.append(begin[1:], len(idx)) - 1]
    span, anchor = last - first, spot[first]
    own = piece[first]
    return own, first - (ends - lengths)[own], span, grams[anchor]


def _digest16(raw: bytes) -> bytes:
    """128 bits of a cryptographic hash: equal ones stand for equal bytes."""
    return hashlib.blake2b(raw, digest_size=16).digest()


def _longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


_RUN = "h long, ctx long, more long, d long, k long, first long, span int"


def _scanned(least: int, whole: bool, scan: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of all runs; if whole, with a digest of the context and the place of each."""
    step = scan - least

    def flush(pieces: list[bytes], where: list[tuple[int, int, int]]) -> pa.RecordBatch:
        piece, first, span, h = anchors(pieces, least)
        anchor = pa.array(h.view(np.int64))
        if not whole:
            return pa.RecordBatch.from_arrays([anchor], ["h"])
        d, k, base = (np.array(x, np.int64) for x in zip(*where, strict=True))
        context = _longs([_digest16(pieces[p][a:b]) for p, a, b in zip(piece.tolist(), first.tolist(), (first + span + least).tolist(), strict=True)])
        return pa.RecordBatch.from_arrays([anchor, *context, *map(pa.array, (d[piece], k[piece], base[piece] + first, span.astype(np.int32)))], [x.split()[0] for x in _RUN.split(", ")])

    for batch in batches:
        pieces: list[bytes] = []
        where: list[tuple[int, int, int]] = []
        size = 0
        for d, k, text in zip(column(batch, "d").to_pylist(), column(batch, "k").to_pylist(), texts(batch), strict=True):
            raw = text.encode()
            for at in range(0, max(1, len(raw) - least + 1), step):
                part = raw[at : at + scan - 1] if len(raw) > scan - 1 else raw
                if len(part) < least:
                    continue
                if size + len(part) > scan:
                    yield flush(pieces, where)
                    pieces, where, size = [], [], 0
                pieces.append(part)
                where.append((d, k, at))
                size += len(part)
        if pieces:
            yield flush(pieces, where)


class SuffixArray:
    """Suffixes of a buffer sorted by their first bytes (at least `depth` of them), with common-prefix lengths cut at borders.

    left[i] bytes remain from place i to its border (the end of its context); no common prefix reaches over one.
    """

    def __init__(self, data: np.ndarray, left: np.ndarray, depth: int):
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = key << np.uint64(8) | padded[i : n + i]
        ranks = [np.unique(key, return_inverse=True)[1].astype(np.int64)]
        size = 8
        while size < depth:
            nxt = np.zeros(n, np.int64)
            nxt[: max(0, n - size)] = ranks[-1][size:] + 1
            ranks.append(np.unique(ranks[-1] * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64))
            size *= 2
        self.data, self.left = data, left
        self.order = np.argsort(ranks[-1], kind="stable")
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(max(0, n - 1), np.int64)
        for r in reversed(ranks):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            same = (a + common < n) & (b + common < n) & (r[x] == r[y])
            common += np.where(same, size, 0)
            size //= 2
        for _ in range(7):
            x, y = a + common, b + common
            inside = (x < n) & (y < n)
            common += inside & (data[np.minimum(x, n - 1)] == data[np.minimum(y, n - 1)])
        #: common[i]: of the suffixes at order[i] and order[i + 1].
        self.common = np.minimum(common, np.minimum(left[a], left[b]))

    def intervals(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first, last) of every maximal repeat: an interval of the common-prefix tree, all of whose places in order share
        `length` bytes, `least` or more, and before which not the same byte stands everywhere (a border differs from everything).

        What a scan with a stack finds one after another is found for all places at once: the nearest smaller common prefix on
        each side, by jumps from one candidate to its own candidate, bounds the interval that opens and closes there.
        """
        common = np.where(self.common >= least, self.common, 0)
        at = np.flatnonzero(common)
        if not len(at):
            return at, at, at
        n = len(common)
        lower = []
        for value in (common, common[::-1]):
            padded = np.append(value, -1)
            near = np.arange(-1, n)  # of place i: i - 1; the last stands for "none" and is smaller than all
            todo = np.flatnonzero(value)
            while len(todo):
                todo = todo[padded[near[todo]] >= value[todo]]
                near[todo] = near[near[todo]]
            lower.append(near[:n])
        first, last = lower[0][at] + 1, n - 1 - lower[1][n - 1 - at]
        keep = np.unique(first * (n + 1) + last, return_index=True)[1]
        length, first, last = common[at][keep], first[keep], last[keep]
        place = self.order
        border = (place == 0) | (self.left[place - 1] != self.left[place] + 1)
        byte = self.data[place - 1]
        changes = np.cumsum(np.concatenate([[0], (byte[1:] != byte[:-1]) | border[1:] | border[:-1]]))
        diverse = changes[last] > changes[first]
        return length[diverse], first[diverse], last[diverse]

    def maximal_repeats(self, least: int) -> list[tuple[int, np.ndarray]]:
        """(length, places) of every maximal repeat of `least` bytes or more, with all its occurrences."""
        return [(int(n), self.order[a : b + 1]) for n, a, b in zip(*self.intervals(least), strict=True)]

    def covered(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) of all occurrences of maximal repeats; of groups that hold the same place, that of the longest.

        The longest group of each place is spread from two blocks of a power of two that cover its interval, from large blocks to small.
        """
        length, first, last = self.intervals(least)
        best = np.zeros(len(self.order), np.int64)
        if not len(length):
            return self.order[:0], best[:0]
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        for k in range(int(level.max()), -1, -1):
            own = level == k
            np.maximum.at(best, first[own], length[own])
            np.maximum.at(best, last[own] - (1 << k) + 1, length[own])
            if k:
                half = 1 << (k - 1)
                best[half:] = np.maximum(best[half:], best[:-half])
        hit = best > 0
        return self.order[hit], best[hit]


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of contexts with a byte after each that UTF-8 never has, what is left from each place, and the starts."""
    data = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes - 1, sizes) - np.arange(len(data))
    return data, left, starts


def _runs(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    begin = np.flatnonzero(new)
    return start[begin], stop[np.append(begin[1:], len(start)) - 1] if len(start) else stop


_COVER = "d long, k long, a long, b long"


def _told_apart(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts arrive sorted by anchor; whole anchors go into one suffix array."""
    rows: list[tuple] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch | None:
        parts = [r[4] for r in rows]
        data, left, starts = _joined(parts)
        place, length = SuffixArray(data, left, 512).covered(least)
        if not len(place):
            return None
        own = np.searchsorted(starts, place, "right") - 1
        # shift contexts apart so that runs of one never meet the next one's
        a, b = _runs(place + own, place + own + length)
        ctx = np.searchsorted(starts + np.arange(len(starts)), a, "right") - 1
        only = np.array([r[5] for r in rows], bool)[ctx]
        ctx, a, b = ctx[only], a[only], b[only]
        base = np.array([r[3] for r in rows], np.int64)[ctx] - starts[ctx] - ctx
        return pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in rows], np.int64)[ctx]), pa.array(np.array([r[2] for r in rows], np.int64)[ctx]), pa.array(a + base), pa.array(b + base)], ["d", "k", "a", "b"])

    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in ("h", "d", "k", "first", "context", "only")), strict=True):
            if row[0] != last and size >= SUFFIXES:
                if (out := flush()) is not None:
                    yield out
                rows, size = [], 0
            last = row[0]
            rows.append(row)
            size += len(row[4]) + 1
    if rows and (out := flush()) is not None:
        yield out


def _windows(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each context, with a digest of its bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            context = column(part, "context").to_pylist()
            place = [range(len(x) - least + 1) for x in context]
            one, two = _longs([_digest16(x[i : i + least]) for x, own in zip(context, place, strict=True) for i in own])
            own = np.repeat(np.arange(len(context)), [*map(len, place)])
            d, k, first, only = (column(part, c).to_numpy(zero_copy_only=False)[own] for c in ("d", "k", "first", "only"))
            yield pa.RecordBatch.from_arrays([one, two, pa.array(d), pa.array(k), pa.array(first + np.concatenate([np.arange(len(x)) for x in place])), pa.array(only)], ["w1", "w2", "d", "k", "a", "only"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = [squeeze.compress(x.encode()) for x in texts(batch)]
        yield pa.RecordBatch.from_arrays([column(batch, "d"), column(batch, "k"), column(batch, "doc_id"), pa.array(z, pa.binary())], ["d", "k", "doc_id", "z"])


def _cut_out(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for z, spots in zip(column(batch, "z").to_pylist(), column(batch, "spots").to_pylist(), strict=True):
            raw = open_.decompress(z)
            out += [(s["h"], s["d"], s["k"], s["first"], raw[s["first"] : s["first"] + s["span"] + least], s["only"]) for s in spots]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["h", "d", "k", "first", "context", "only"])


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text", F.col("doc_id").isNull()).alias("k"))


def _contexts(docs: DataFrame, least: int, scan: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs whose whole context repeats (d, k, first, span); contexts that vary at their anchor, in few and in many variants."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    small_batches(spark)
    whole_texts = keyed.select("d", "k", "text")
    again = durable(whole_texts.mapInArrow(partial(_scanned, least, False, scan), "h long").groupBy("h").count().where("count > 1").select("h"))
    # both sides are plain exchanges, so an anchor that a third of all runs share is split over tasks
    some = durable(whole_texts.mapInArrow(partial(_scanned, least, True, scan), _RUN).join(again, "h", "left_semi"))
    spot = F.struct("d", "k", "first", "span")
    kinds = durable(some.groupBy("h", "ctx", "more").agg(F.count("*").alias("n"), F.min(spot).alias("spot")))
    whole = some.join(kinds.where("n > 1").select("h", "ctx", "more"), ["h", "ctx", "more"], "left_semi").select("d", "k", "first", "span")
    varied = kinds.groupBy("h").agg(F.count("*").alias("variants"), F.min("n").alias("fewest")).where("variants > 1 and fewest = 1").select("h", "variants")
    # a context stands for all its copies; which of them is read does not matter
    spots = kinds.join(varied, "h").select(F.col("spot.d").alias("d"), F.col("spot.k").alias("k"), F.struct("h", "spot.d", "spot.k", "spot.first", "spot.span", (F.col("n") == 1).alias("only"), (F.col("variants") > VARIANTS).alias("many")).alias("s"))
    by_doc = spots.groupBy("d", "k").agg(F.collect_list("s").alias("spots"))
    texts_ = keyed.mapInArrow(_packed, "d long, k long, doc_id long, z binary")
    one_each = texts_.select("d", "k", "z").join(by_doc, ["d", "k"])
    cut = []
    for chosen in (lambda x: ~x["many"], lambda x: x["many"]):
        own = one_each.select("z", F.filter("spots", chosen).alias("spots")).where("size(spots) > 0")
        cut.append(own.mapInArrow(partial(_cut_out, least), "h long, d long, k long, first long, context binary, only boolean"))
    return whole, cut[0], cut[1]


def repeated_spans(docs: DataFrame, least: int = LEAST, scan: int = SCAN) -> DataFrame:
    """(d, k, a, b): bytes of texts covered by strings of `least` bytes that start at two places or more; spans may overlap.

    d and k name a row as _keyed does. Equal windows share an anchor. Where a run's whole context repeats (by a 128-bit
    cryptographic digest of its bytes), all of it is covered. Contexts that vary at one anchor meet in enhanced suffix arrays,
    whole anchors together, whose interval trees give the maximal repeats with all their occurrences. The variants of an
    anchor that has more than VARIANTS are dealt over tasks: their windows meet by the same kind of digest, are counted and
    never gathered. Both ways cover the same bytes.
    """
    whole, few, many = _contexts(docs, least, scan)
    small_batches(docs.sparkSession)
    told = few.repartition("h").sortWithinPartitions("h").mapInArrow(partial(_told_apart, least), _COVER)
    windows = many.mapInArrow(partial(_windows, least), "w1 long, w2 long, d long, k long, a long, only boolean")
    counted = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    hashed = windows.where("only").join(counted, ["w1", "w2"], "left_semi").select("d", "k", "a", (F.col("a") + least).alias("b"))
    return whole.select("d", "k", F.col("first").alias("a"), (F.col("first") + F.col("span") + least).alias("b")).unionByName(told).unionByName(hashed)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for name, z, spans in zip(column(batch, "doc_id").to_pylist(), column(batch, "z").to_pylist(), column(batch, "spans").to_pylist(), strict=True):
            raw = open_.decompress(z)
            if spans:
                a, b = _runs(*(np.array([s[c] for s in spans], np.int64) for c in ("a", "b")))
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                out.append((name, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
            else:
                out.append((name, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
        kinds = (*[pa.int64()] * 4, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, least: int = LEAST, scan: int = SCAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    Null texts are empty; texts shorter than `least` lose nothing; repeated rows are places of their own, so they lose all of a
    text long enough; null ids are rows like others; an empty table gives no rows. scan bounds the bytes that a task looks at together.
    """
    spans = durable(repeated_spans(docs, least, scan)).groupBy("d", "k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    small_batches(docs.sparkSession)
    packed = _keyed(docs).mapInArrow(_packed, "d long, k long, doc_id long, z binary")
    return packed.join(spans, ["d", "k"], "left").select("doc_id", "z", "spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 7: what is left of every document without its repeated strings of 200 bytes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
