"""Links and components against all pairs, hot groups in blocks, and odd vectors."""
import numpy as np
import pytest

from traceloom.llm import embeddings


def slow(rows, least=0.98):
    """(vec_id, n_links, component, kept) by comparing all pairs."""
    n = len(rows)
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max()) if g else None for g, (_, v, _) in zip(ok, rows, strict=True)]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least_of = {}
    for i in range(n):
        least_of[find(i)] = min(least_of.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least_of[find(i)], rows[i][0] == least_of[find(i)]) for i in range(n))


_SCHEMA = "vec_id long, embedding array<float>, label int"


def check(spark, rows):
    got = embeddings.link_embeddings(spark.createDataFrame(rows, _SCHEMA)).select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == slow(rows)


def _near(rng, base, size):
    v = base + rng.normal(0, size, len(base)) * np.linalg.norm(base) / len(base) ** 0.5
    return v.astype(np.float32).tolist()


def test_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    rows = [(i, _near(rng, centres[i % 12], 0.08), i % 3) for i in range(500)] + [(1000 + i, rng.normal(size=64).astype(np.float32).tolist(), 0) for i in range(200)]
    check(spark, rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, each alone: at least nine of ten are found, none below it."""
    rng = np.random.default_rng(5)
    rows, want = [], 0
    for i in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        cos = 0.981 if i % 2 else 0.975
        want += i % 2
        c = cos * a + (1 - cos**2) ** 0.5 * b / np.linalg.norm(b)
        rows += [(2 * i, a.astype(np.float32).tolist(), i), (2 * i + 1, c.astype(np.float32).tolist(), i)]
    got = embeddings.link_embeddings(spark.createDataFrame(rows, _SCHEMA)).where("n_links > 0").collect()
    assert all(r.vec_id // 2 % 2 for r in got) and len(got) / 2 >= 0.9 * want


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    rows = [(i, _near(rng, centre, 0.02), 1) for i in range(300)] + [(900 + i, rows_, 1) for i, rows_ in enumerate([_near(rng, centre, 0.0)] * 40)]
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    check(spark, rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    one = [1.0, 0.0]
    rows = [(1, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, one, 2), (11, [1.0, 0.0, 0.0], 1), (12, [1e30, 0.0], 1), (13, [1e-30, 1e-33], 1), (14, [-1.0, 0.0], 1)]
    check(spark, rows)
    got = embeddings.link_embeddings(spark.createDataFrame([(None, one, 1), (5, one, 1), (5, one, 1)], _SCHEMA)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in got) == [(-1, 2, 5), (5, 2, 5), (5, 2, 5)]
    assert embeddings.link_embeddings(spark.createDataFrame([], _SCHEMA)).count() == 0


def test_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = embeddings.op6_embedding_near_dedup(spark, "/root/testdata/sf0.001").select("vec_id", "n_links", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == slow(rows)


def test_steps_share_a_bucket_as_the_width_says():
    h = embeddings.PStable(8, tables=200, projections=1, width=1.0)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 8))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(200, 8))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    assert (h.keys(a) == h.keys(b)).mean() == pytest.approx(0.84, abs=0.02)


def test_columns_with_names_used_inside(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    rows = [(i, _near(rng, np.ones(16), 0.05 if i % 2 else 2.0), i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows, _SCHEMA).withColumns({c: F.lit("x") for c in ("cid", "n", "t", "bucket", "k1", "fine", "kept", "links", "dim", "root")})
    got = embeddings.link_embeddings(docs)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and sorted(map(tuple, got.collect())) == slow(rows)
