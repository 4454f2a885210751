"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample."""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, durable, small_batches, texts

#: Buckets of the n-gram models; labelled documents that the target model and the threshold are fitted on, at most.
BUCKETS, LABELLED = 1 << 14, 20_000
#: Nats of the mean log ratio that weigh as much as one unit of Gumbel noise.
TEMPERATURE = 0.01
#: N-grams of neutral text that are added to each text, so that a few odd words do not condemn a short one.
PRIOR = 32
#: Bytes of text scanned together; words back at which a repeated word still counts as one.
SCAN, BACK = 1 << 20, 8
#: Keys are held as integers of this many steps a unit; levels of the search for the k-th key, each of so many parts.
STEPS, PARTS, LEVELS = 1 << 32, 1 << 12, 5
_HALF = 1 << 59

_ODD = np.random.default_rng(515).integers(1, 1 << 62, 4096, dtype=np.uint64) | np.uint64(1)


def _classes() -> np.ndarray:
    """One class for capitals, small letters (all that is not ASCII too) and digits; other bytes are their own."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


_WHITE = re.compile(rb"[\x20\t-\r]")
_CLASS, _SPACE = _classes(), np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(77).integers(1, 1 << 62, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, dtype=np.uint64, out=total[1:])
    return total[stop] - total[start]


def _hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each data[start:stop], by the place of each byte inside it."""
    size = stop - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(start, size) + place
    values = _mix(_BYTE[data[at]] * _ODD[np.minimum(place, len(_ODD) - 1)] + place.astype(np.uint64))
    ends = np.cumsum(size)
    return _mix(_sums(values, ends - size, ends))


def features(raw: list[bytes], known: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of these texts, four to a word; the first `known` words of each only stand before others.

    The n-grams are the word, the word and the one before it, the shapes of both (runs of one character class count once),
    and how many words back, up to BACK, the same word stands. Words are parted by ASCII white space; no n-gram crosses the end of a text.
    """
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    inside = np.concatenate([[False], ~space])
    start = np.flatnonzero(~inside[:-1] & inside[1:])
    stop = np.flatnonzero(inside[:-1] & ~inside[1:])
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    doc = np.searchsorted(np.cumsum(sizes), start, "right")
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _hashed(data, start, stop)
    kind = _CLASS[data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[start] = True
    seen = np.concatenate([[0], np.cumsum(first)])
    shape = _hashed(kind[first], seen[start], seen[stop])
    same = np.zeros(len(word), bool)
    same[1:] = doc[1:] == doc[:-1]
    last = lambda x: np.where(same, np.concatenate([x[:1], x[:-1]]), np.uint64(1))
    back = np.zeros(len(word), np.uint64)
    for d in range(min(BACK, len(word) - 1), 0, -1):
        hit = np.flatnonzero((word[d:] == word[:-d]) & (doc[d:] == doc[:-d])) + d
        back[hit] = d
    grams = [word, _mix(last(word)) + word, _mix(last(shape) + np.uint64(3)) + shape, back + np.uint64(11)]
    bucket = np.stack([_mix(g + _ODD[i]) % np.uint64(BUCKETS // 4) + np.uint64(i * (BUCKETS // 4)) for i, g in enumerate(grams)])
    new = np.arange(len(doc)) - np.searchsorted(doc, doc, "left") >= np.broadcast_to(known, len(raw))[doc]
    return np.tile(doc[new], 4), bucket.astype(np.int64)[:, new].ravel()


def _chunks(rows: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, their places in rows, words known before), of about SCAN bytes together.

    A longer text comes in pieces, parted at white space, each after the last BACK words before it, so its n-grams are those
    of the whole.
    """
    parts: list[bytes] = []
    own: list[int] = []
    known: list[int] = []
    size = 0
    for i, raw in enumerate(rows):
        at, before = 0, []
        while True:
            stop = len(raw)
            if stop - at > SCAN:
                stop = max(raw.rfind(b" ", at, at + SCAN), raw.rfind(b"\n", at, at + SCAN)) + 1
                if stop <= at:
                    gap = _WHITE.search(raw, at + SCAN)
                    stop = gap.end() if gap else len(raw)
            if parts and size + stop - at > SCAN:
                yield parts, np.array(own), np.array(known)
                parts, own, known, size = [], [], [], 0
            piece = raw[at:stop]
            parts.append(b" ".join([*before, piece]))
            own.append(i)
            known.append(len(before))
            size += stop - at
            at = stop
            if at >= len(raw):
                break
            before = [*before, *piece.rsplit(None, BACK)[-BACK:]][-BACK:]
    if parts:
        yield parts, np.array(own), np.array(known)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's n-grams: of all documents, and of the target documents."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        raw = [x.encode() for x in texts(batch)]
        target = column(batch, "target").to_numpy(zero_copy_only=False)
        for parts, own, known in _chunks(raw):
            doc, bucket = features(parts, known)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            counts[1] += np.bincount(bucket[target[own[doc]]], minlength=BUCKETS)
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"])


def scores(raw: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of target to raw text over a text's n-grams and PRIOR neutral ones; 0 for a text without words."""
    total, n = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
    for parts, own, known in _chunks(raw):
        doc, bucket = features(parts, known)
        np.add.at(total, own, np.bincount(doc, ratio[bucket], minlength=len(own)))
        np.add.at(n, own, np.bincount(doc, minlength=len(own)))
    return total / (n + PRIOR)


def _scored(ratio: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = scores([x.encode() for x in texts(batch, "_text")], ratio)
        keep = [i for i, name in enumerate(batch.schema.names) if name != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(score)], [*(batch.schema.names[i] for i in keep), "_score"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target's share of each bucket over raw text's; each kind of n-gram is a model of its own, smoothed by one."""
    out = np.zeros(BUCKETS)
    part = BUCKETS // 4
    for i in range(4):
        own = slice(i * part, (i + 1) * part)
        out[own] = np.log((target[own] + 1) / (target[own].sum() + part)) - np.log((raw[own] + 1) / (raw[own].sum() + part))
    return out


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score that errs least, the errors of both kinds taken as shares, half way to the nearest scores on each side."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    let = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    wrong = lost + let
    best = np.flatnonzero(wrong == wrong.min())
    return float(cuts[best[len(best) // 2]])


class Model(NamedTuple):
    ratio: np.ndarray
    threshold: float


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled documents, by a hash of their ids: (label_id, good, held)."""
    known = labels.where("doc_id is not null and quality is not null")
    own = known.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") > 0).alias("good"))
    return own.orderBy(F.xxhash64(F.lit("labelled"), "label_id"), "label_id").limit(most).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "label_id"), F.lit(4)) == 0)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """The model of raw text counts all of docs; target model and threshold come from at most `most` labelled documents.

    Three quarters of the good ones train the target model; the rest, and all bad ones of that rest, place the threshold. Per
    task one row a bucket is sent, so what reaches the driver is BUCKETS rows. Without good labels nothing is rejected.
    """
    small_batches(docs.sparkSession)
    sample = durable(_sample(labels, most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most `most` ids of 8 bytes
    marked = rows.join(F.broadcast(sample.where("good and not held").select(F.col("label_id").alias("doc_id"), F.lit(True).alias("hit"))), "doc_id", "left").select("text", F.coalesce("hit", F.lit(False)).alias("target"))
    counted = marked.mapInArrow(_counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    ratio = log_ratio(raw, target) if target.any() else np.zeros(BUCKETS)
    held = rows.join(F.broadcast(sample.where("held").select(F.col("label_id").alias("doc_id"), "good")), "doc_id").select("doc_id", "good", F.col("text").alias("_text"))
    # one row for each held label, however many rows have its id
    found = held.mapInArrow(partial(_scored_text, ratio), "doc_id long, good boolean, score double").groupBy("doc_id", "good").agg(F.avg("score").alias("score")).collect()
    good, bad = (np.array([r.score for r in found if r.good == g]) for g in (True, False))
    return Model(ratio, best_threshold(good, bad))


def _scored_text(ratio: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "good"), pa.array(scores([x.encode() for x in texts(batch, "_text")], ratio))], ["doc_id", "good", "score"])


def kth_key(keys: DataFrame, k: int) -> int | None:
    """The k-th greatest of the long column `key`, by LEVELS counts over PARTS of what is left of its range."""
    if k <= 0:
        return None
    low, width = -_HALF, 2 * _HALF
    for _ in range(LEVELS):
        width //= PARTS
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= low + width * PARTS - 1))
        counts = {int(r.part): r.n for r in inside.groupBy(F.floor((F.col("key") - low) / width).alias("part")).agg(F.count("*").alias("n")).collect()}
        for part in sorted(counts, reverse=True):
            if counts[part] >= k:
                break
            k -= counts[part]
        else:
            return None
        low += part * width
        if width <= 1:
            break
    return low


def _weighted(docs: DataFrame, model: Model, temperature: float, seed: str, keep: list[str]) -> DataFrame:
    """Columns c0, c1, ... for those named in keep, then score and key of every row of docs."""
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "_id", "_text"), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("_noise", -F.log(-F.log(u))).drop("_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    scored = rows.mapInArrow(partial(_scored, model.ratio), f"{kinds}, _score double")
    base = F.lit(0.0) if model.threshold == -np.inf else (F.col("_score") - F.lit(model.threshold)) / F.lit(temperature)
    weight = base + F.col("_noise")
    return scored.select(*(f"c{i}" for i in range(len(keep))), F.col("_score").alias("score"), weight.alias("weight"), F.floor(weight * STEPS).cast("long").alias("key"))


def _least_key(weighted: DataFrame, model: Model) -> int:
    """The key of the last document of the sample: as many as there are documents whose score passes."""
    k = weighted.where(F.col("score") > F.lit(model.threshold)).count()
    found = kth_key(weighted.select("key"), k)
    return _HALF if found is None else found


def score_documents(docs: DataFrame, labels: DataFrame, most: int = LABELLED, temperature: float = TEMPERATURE, seed: str = "gumbel") -> DataFrame:
    """doc_id, score, weight, kept of every row of docs.

    score is the mean log ratio of target to raw text over the n-grams of the whole text, drawn to 0 by PRIOR n-grams. The
    sample's size k is the number of documents whose score passes the threshold. The k documents of the greatest
    weight = (score - threshold) / temperature + Gumbel noise are kept; the noise comes from doc_id and the text, so reruns
    agree. Rows whose weights tie with the k-th (repeated rows) are all kept. Null and empty texts have no n-grams: score 0.
    Null ids have no label. Without good labels nothing is rejected. Other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, labels, most)
    weighted = durable(_weighted(docs, model, temperature, seed, ["doc_id"]))
    return weighted.select(F.col("c0").cast("long").alias("doc_id"), "score", "weight", (F.col("key") >= _least_key(weighted, model)).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, most: int = LABELLED, temperature: float = TEMPERATURE, seed: str = "gumbel") -> DataFrame:
    """The rows of docs that score_documents keeps, with the columns of docs.

    Only the weights are kept in the shared folder; texts are read and scored again, which costs less than writing them.
    """
    model = fit(docs, labels, most)
    least = _least_key(durable(_weighted(docs, model, temperature, seed, []).select("score", "key")), model)
    kept = _weighted(docs, model, temperature, seed, docs.columns).where(F.col("key") >= least)
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 5: score and decision for every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
