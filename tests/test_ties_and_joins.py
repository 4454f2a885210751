"""Ties of a cell, and joins of few keys and many rows."""
from pyspark.sql import functions as F

from traceloom.operators import bins, tables, views


def test_tied_alleles_come_by_rank(spark):
    rows = [(1, 1, 5, 100.0, 50.0, 9), (1, 1, 7, 101.0, 50.0, 3), (1, 1, 2, 99.0, 80.0, 20), (1, 1, 8, 98.0, 50.0, 3)]
    own = spark.createDataFrame(rows, "marker_id int, sample_id int, value int, size double, height double, allele_id int")
    assert views.genotypes(own, [1]).first().m1 == [2, 8, 7, 5]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_channels_are_broadcast(spark):
    limits = spark.createDataFrame([(1, 5.0, 45.0), (2, 5.0, 45.0)], "marker_id int, min_size double, max_size double")
    own = spark.createDataFrame([(1, b, float(b), b - 0.5, b + 0.5) for b in (10, 20)] + [(2, 30, 30.0, 29.5, 30.5)], "marker_id int, bin int, mean double, p25 double, p75 double")
    peaks = spark.range(60).select(F.lit(1).alias("channel_id"), F.col("id").cast("double").alias("size"), F.lit("called").alias("type"))
    out = bins.bin_channels(peaks, spark.createDataFrame([(1, 1), (1, 2)], "channel_id int, marker_id int"), own, limits)
    assert out.count() == 120 and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_last_table_of_a_cascade_is_read_once(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "a long")
    b = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "b long, a long")
    c = spark.createDataFrame([(10, "x"), (20, "y"), (20, "z"), (None, "n")], "b long, v string")
    out = tables.cascade({"a": a, "b": b, "c": c}, spark.createDataFrame([(1,)], "a long"), [("a", "a", "a"), ("b", "b", "a"), ("c", "b", "b")])
    assert {k: sorted(map(str, (r[-1] for r in df.collect()))) for k, df in out.items()} == {"a": ["2", "3"], "b": ["2"], "c": ["n", "y", "z"]}
    assert _plan(out["c"]).count("Join") == 3
