"""Targets by hand, the mix against its SQL, and bounds of what is taken."""
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, duck, empty
from traceloom.llm import mixing


def slow_targets(sizes, most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5, "c": 7}, {"a": 0, "b": 4}, {"x": 3}, {"a": 1, "b": 1, "c": 1, "d": 1000, "e": 2, None: 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in mixing.op2_source_mixing(spark, folder).collect())
    assert got == sorted(duck(folder, "documents").sql(mixing.OP2_SQL).fetchall())


def test_near_the_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "big" if i % 3 else ("s" if i % 2 else None)) for i in range(3000)]
    out = mixing.mix_sources(documents(spark, rows)).cache()
    assert out.where("taken > 3 * size or taken % size <> 0").count() == 0
    for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) <= 50
    again = mixing.mix_sources(documents(spark, rows)).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.select("doc_id", "taken").collect()))


def test_odd_rows(spark):
    docs = documents(spark)
    out = mixing.mix_sources(docs)
    assert out.count() == docs.count()
    assert out.where("size = 0 and taken > 0").count() == 0
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_documents_come_as_often_as_taken(spark):
    docs = documents(spark)
    want = sum(r.taken // r.size for r in mixing.mix_sources(docs).collect() if r.size)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.count() == want


def test_table_is_near_its_targets(spark):
    """Each source comes within a thousandth of its target, and longer documents of a source come more often."""
    out = mixing.op2_source_mixing(spark, "/root/testdata/sf0.1").cache()
    for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert r.target * 0.999 <= r.taken <= r.target
    part = out.where("size > 0 and target > 1.2 * source_size and target < 1.8 * source_size").withColumn("long", F.col("size") >= 256)
    mean = {r.long: r.m for r in part.groupBy("long").agg(F.avg(F.col("taken") / F.col("size")).alias("m")).collect()}
    assert not mean or mean[True] > mean[False]
