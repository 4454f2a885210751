"""Fingerprints and components against pairwise brute force; near groups against exact shingle similarity."""
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tests.llm.helpers import documents, empty, rng, words
from traceloom.llm import simhash


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    hs = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, linked):
    n, root = len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def _check(spark, rows):
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    own = slow_components(rows, lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    least = {}
    for (d, _, _), r in zip(rows, own, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted((repr(d), f"{f:016x}", repr(least[r])) for (d, _, _), f, r in zip(rows, fps, own, strict=True))
    assert sorted((repr(r.doc_id), f"{r.fp % (1 << 64):016x}", repr(r.component_id)) for r in got) == want
    chosen = [r for r in got if r.chosen]
    assert len({(r.doc_id, r.k) for r in chosen}) == len(set(own))


def test_odd_rows(spark):
    from tests.llm.helpers import ODD

    _check(spark, ODD)


def test_many_near_texts(spark):
    r = rng(4)
    base = [words(r, 60) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    for i in range(300):
        w = r.choice(base).split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
        rows.append((1000 + i, " ".join(w), "s"))
    _check(spark, rows)


@pytest.mark.parametrize("spread", [1, 5, 64])
def test_tree_finds_all_links(spark, spread):
    own = np.random.default_rng(spread)
    centres = own.integers(0, 1 << 63, 400, dtype=np.uint64)
    points = centres.copy()
    for _ in range(spread if spread < 64 else 8):
        points = np.unique(np.concatenate([points, points[own.integers(0, len(points), 300)] ^ (np.uint64(1) << own.integers(0, 64, 300, dtype=np.uint64))]))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {r.fp: r.root for r in simhash.hamming_components(df).collect()}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    label = np.arange(len(points))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    for root in np.unique(label):
        own_points = points[label == root].view(np.int64).tolist()
        assert len({got.get(p, p) for p in own_points}) == 1
    assert len({got.get(int(p), int(p)) for p in points.view(np.int64)}) == len(np.unique(label))


def test_one_of_each_near_group_stays(spark):
    r = rng(9)
    rows, groups = [], []
    for g in range(40):
        original = words(r, 150).split()
        ids = [g * 100]
        rows.append((g * 100, " ".join(original), "s"))
        for e in range(g % 6):
            w = list(original)
            for _ in range(3):
                w[r.randrange(len(w))] = f"new{r.randrange(999)}"
            rows.append((g * 100 + e + 1, " ".join(w), "s"))
            ids.append(g * 100 + e + 1)
        groups.append(ids)
    rows += [(9000 + i, words(r, 80), "s") for i in range(40)]
    docs = documents(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {x.doc_id for x in kept.collect()}
    assert all(len(ids & set(g)) == 1 and min(g) in ids for g in groups)
    assert all(9000 + i in ids for i in range(40))


def _whole(spark, texts):
    """keep_one against all pairs: one text of each class stays, that of the least id."""
    fps = [simhash.fingerprint(t) for t in texts]
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) or {t.lower()} for t in texts]

    def linked(i, j):
        return bin(fps[i] ^ fps[j]).count("1") <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])

    root = slow_components(texts, linked)
    want = {min(i for i, x in enumerate(root) if x == r) for r in set(root)}
    got = [x.doc_id for x in simhash.keep_one(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want, (len(set(got) - want), len(want - set(got)))


def test_near_copies_that_share_a_passage(spark):
    r = rng(21)
    passage, texts = words(r, 120).split(), []
    for _ in range(150):
        own = words(r, 40).split()
        copy = list(own)
        copy[r.randrange(36, 40)] = "edited"
        texts += [" ".join(own[:20] + passage + own[20:]), " ".join(copy[:20] + passage + copy[20:])]
    _whole(spark, texts)


@pytest.mark.parametrize("often", [1, 5])
def test_frequent_shingles_are_spread(spark, monkeypatch, often):
    """The way of shingles that many texts share gives the same groups, here with every shingle, or most, and blocks of few texts."""
    monkeypatch.setattr(simhash, "SHARE", 1)
    r = rng(31)
    base, texts = words(r, 60).split(), []
    for i in range(70):
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(60)] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [words(r, 50) for _ in range(10)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(dict.fromkeys(texts))])
    got, want = ({x.doc_id for x in simhash.near_groups(docs, often=n).where("chosen").collect()} for n in (often, 10**6))
    assert got == want and len(got) < len(texts) - 20


@pytest.mark.parametrize("seed", range(6))
def test_rows_of_shared_shingles(seed):
    import pyarrow as pa

    own = np.random.default_rng(seed)
    s = np.sort(own.integers(0, 40 + 60 * (seed % 3), 120)).astype(np.int32)
    p, k, n = np.arange(120, dtype=np.int32), own.integers(0, 10**9, 120), np.full(120, 9, np.int32)
    cuts = np.unique([0, 120, *own.integers(0, 121, seed * 8)])
    batches = [pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (s, p, k, n)], ["s", "p", "k", "n"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    got = [(r["s"], r["p"], r["k"], r["hub"], r["hub_p"]) for b in simhash._grouped(iter(batches)) for r in b.to_pylist()]
    first, size = {}, {}
    for i, x in enumerate(s.tolist()):
        first.setdefault(x, i)
        size[x] = size.get(x, 0) + 1
    assert got == [(x, int(p[i]), int(k[i]), int(k[first[x]]), int(p[first[x]])) for i, x in enumerate(s.tolist()) if size[x] > 1]


def test_near_copies_of_short_texts(spark):
    r = rng(22)
    texts = ["", " \n", "one two", "One  two", "one two three four five"]
    for n in [5, 6, 8, 9, 10, 11, 12, 15, 20, 30, 45, 60] * 8:
        w = words(r, n).split()
        texts += [" ".join(w), " ".join(["edited", *w[1:]]), " ".join([*w, "added"]), " ".join(w[:-1])]
    _whole(spark, texts)


def test_chains_and_many_texts_of_one_passage(spark):
    r = rng(23)
    passage, texts = words(r, 90), []
    for _ in range(40):
        texts += [passage + " " + words(r, 8), passage + " " + words(r, 40)]
    w = words(r, 100).split()
    for i in range(0, 60, 3):
        w[i] = "step"
        texts.append(" ".join(w))
    _whole(spark, texts)


def test_edges(spark):
    assert simhash.simhash_groups(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0
    rows = [(None, "same words in here", "s"), (4, "same words in here", "s"), (4, "same words in here", "s"), (9, None, "s"), (8, "", "s"), (None, "alone without id", "s")]
    kept = [(x.doc_id, x.text) for x in simhash.keep_one(documents(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(4, "same words in here"), (4, "same words in here"), (8, ""), (None, "alone without id")], key=repr)


def test_similarity():
    assert simhash.jaccard("a b c d e f", "A b c d e f") == 1 and simhash.jaccard("a b", "a b c") == 0 and simhash.jaccard("", " ") == 1
    assert simhash.jaccard("a b c d e f", "a b c d e g") == pytest.approx(1 / 3)


def test_table_against_all_pairs(spark):
    """The documents of a table: every pair that shares four fifths of its shingles, or differs in three bits, by looking at all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    fps = np.array([simhash.fingerprint(texts[i]) for i in ids], np.uint64)
    sets, where = {}, {}
    for i in ids:
        w = texts[i].encode().translate(simhash._LOWER).split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, i in enumerate(ids):
        common = {}
        for s in sets[i]:
            for j in where[s]:
                common[j] = common.get(j, 0) + 1
        near = {ids[y] for y in np.flatnonzero(np.bitwise_count(fps ^ fps[x]) <= 3).tolist()}
        near |= {j for j, c in common.items() if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c)}
        for j in near:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r.doc_id for r in simhash.keep_one(docs).collect()}
    want = {i for i in ids if find(i) == i}
    assert got == want and len(want) < len(ids)
