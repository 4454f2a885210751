"""Held-out accuracy, the k-th key against sorting, and odd tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty
from traceloom.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    out = quality.score_documents(docs, seen).join(labels.where("doc_id % 3 = 0"), "doc_id")
    rates = {r.quality: r.kept for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert rates[1] > 0.97 and rates[0] < 0.1


def test_rows_kept_are_those_scored_as_kept(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    want = {r.doc_id for r in quality.score_documents(docs, labels).where("kept").collect()}
    kept = quality.resample(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    # k is the number of documents that pass, before noise
    model = quality.fit(docs, labels)
    assert quality.score_documents(docs, labels).where(F.col("score") > model.threshold).count() == len(want)


@pytest.mark.parametrize("k", [1, 2, 7, 50, 100])
def test_kth_key(spark, k):
    values = np.random.default_rng(k).integers(-(1 << 50), 1 << 50, 100)
    values[:20] = values[0]
    df = spark.createDataFrame([(int(v),) for v in values], "key long")
    assert quality.kth_key(df, k) == sorted(values.tolist(), reverse=True)[k - 1]
    assert quality.kth_key(df, 0) is None and quality.kth_key(df, 101) is None


def test_features_do_not_cross_texts():
    both = quality.features([b"a b", b"b c"])
    for i, raw in enumerate((b"a b", b"b c")):
        alone = quality.features([raw])
        assert sorted(both[1][both[0] == i].tolist()) == sorted(alone[1].tolist())
    assert len(quality.features([b"", b" "])[0]) == 0


@pytest.mark.parametrize("scan", [8, 64, 300])
def test_long_texts_in_pieces_have_the_n_grams_of_the_whole(monkeypatch, scan):
    text = b" ".join(b"word%d" % (i % 23 if i % 5 else i) for i in range(400)) + b"\n" + b"long" * 60 + b" end, word1 word1"
    rows = [text, b"x", b"", b"a  b\n\nc " * 50]
    want = quality.features(rows)
    monkeypatch.setattr(quality, "SCAN", scan)
    got, pieces = [], 0
    for parts, own, known in quality._chunks(rows):
        doc, bucket = quality.features(parts, known)
        got += list(zip(own[doc].tolist(), bucket.tolist(), strict=True))
        pieces += len(parts)
    assert sorted(got) == sorted(zip(want[0].tolist(), want[1].tolist(), strict=True)) and pieces > 8


MASK = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & MASK
    return x ^ x >> 29


def slow_hash(word):
    odd = quality._ODD.tolist()
    return mix(sum(mix(int(quality._BYTE[b]) * odd[min(i, len(odd) - 1)] + i & MASK) for i, b in enumerate(word)) & MASK)


def slow_features(raw):
    """The four n-grams of each word, one word after another."""
    words, part, out = raw.split(), quality.BUCKETS // 4, []
    shape = lambda w: bytes(c for i, c in enumerate(quality._CLASS[list(w)].tolist()) if not i or c != quality._CLASS[w[i - 1]])
    for i, w in enumerate(words):
        last, last_shape = (slow_hash(words[i - 1]), slow_hash(shape(words[i - 1]))) if i else (1, 1)
        back = next((d for d in range(1, quality.BACK + 1) if d <= i and words[i - d] == w), 0)
        grams = [slow_hash(w), mix(last) + slow_hash(w), mix(last_shape + 3) + slow_hash(shape(w)), back + 11]
        out += [mix(g + int(quality._ODD[j]) & MASK) % part + j * part for j, g in enumerate(grams)]
    return out


def test_against_plain_loops(spark):
    """Counts, ratios, scores, threshold and kept rows, all by loops and sorting; only the noise comes from the engine."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 220 or doc_id % 10 = 0").limit(220)
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("")})).cache()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").join(docs.select("doc_id"), "doc_id").cache()
    rows = {r.doc_id: (r.text or "", r.u) for r in docs.select("doc_id", "text", ((F.pmod(F.xxhash64(F.lit("gumbel"), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()}
    split = {r.doc_id: (r.quality > 0, r.held) for r in labels.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id").cast("long")), F.lit(4)) == 0).collect()}
    grams = {d: slow_features(t.encode()) for d, (t, _) in rows.items()}
    raw, target = (np.zeros(quality.BUCKETS) for _ in range(2))
    for d, own in grams.items():
        for g in own:
            raw[g] += 1
            target[g] += split.get(d) == (True, False)
    part, score = quality.BUCKETS // 4, {}
    share = lambda counts, g: (counts[g] + 1) / (counts[g // part * part : g // part * part + part].sum() + part)
    for d, own in grams.items():
        score[d] = sum(np.log(share(target, g) / share(raw, g)) for g in own) / (len(own) + quality.PRIOR)
    held = {d: good for d, (good, out) in split.items() if out}
    ordered = sorted(score[d] for d in held)
    cuts = [ordered[0] - 1, *((a + b) / 2 for a, b in zip(ordered[:-1], ordered[1:], strict=True))]
    good, bad = ([score[d] for d, g in held.items() if g == want] for want in (True, False))
    wrong = [sum(x < c for x in good) / len(good) + sum(x >= c for x in bad) / len(bad) for c in cuts]
    best = [i for i, w in enumerate(wrong) if w <= min(wrong) + 1e-12]
    threshold = cuts[best[len(best) // 2]]
    weight = {d: (score[d] - threshold) / quality.TEMPERATURE - np.log(-np.log(u)) for d, (_, u) in rows.items()}
    kept = set(sorted(weight, key=weight.get, reverse=True)[: sum(x > threshold for x in score.values())])
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert set(got) == set(rows)
    for d, r in got.items():
        assert r.score == pytest.approx(score[d], abs=1e-9) and r.weight == pytest.approx(weight[d], abs=1e-5) and r.kept == (d in kept)


def test_odd_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, 0), (10, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs, labels)
    assert out.count() == docs.count() and out.where("doc_id in (1, 2, 3) and score <> 0").count() == 0
    assert quality.score_documents(docs, labels.limit(0)).where("not kept").count() == 0
    assert quality.score_documents(empty(spark), labels).count() == 0 and quality.resample(empty(spark), labels).count() == 0
    kept = quality.resample(docs, labels)
    assert kept.columns == docs.columns
