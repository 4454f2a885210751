"""Permutation tests: rounds are made in tasks, with the same shuffles as windows over rows of each round would give."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from traceloom import catalog
from traceloom.catalog import MARKERS
from traceloom.functions import hashes
from traceloom.operators import comparisons, distance, views
from traceloom.operators.core import AlleleFilter, allele_frame

from .conftest import DATA

ROUNDS = 30


@pytest.fixture(scope="module")
def frame(spark):
    own = allele_frame(catalog.alleles(spark, DATA), AlleleFilter(rel_threshold=0.2, peak_types=None), catalog.samples(spark, DATA))
    return own.where("label in ('ECONOMY', 'PROMO', 'SMALL')").cache()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_are_those_of_spark(spark):
    ids = [0, 1, -1, 7, 2**31 - 1, -(2**31), 123456]
    df = spark.createDataFrame([(i,) for i in ids], "i int").select(F.xxhash64(F.lit(1), F.lit(3), "i").alias("a"), F.xxhash64(F.lit(1), F.col("i").cast("long") * 3000000019).alias("b"))
    got = hashes.xxhash64(1, 3, np.array(ids, np.int32)).tolist(), hashes.xxhash64(1, np.array(ids, np.int64) * 3000000019).tolist()
    assert got == ([r.a for r in df.collect()], [r.b for r in df.collect()])


def test_association_as_by_rows(frame):
    genotypes = views.complete_genotypes(frame, MARKERS)
    assert "xxhash64" not in plan(comparisons.association_test(frame, MARKERS))  # no row of a round
    real = {r.label: r["index"] for r in distance.association_of(genotypes, len(MARKERS)).collect()}
    cells = genotypes.select("label", F.posexplode("genotype").alias("locus", "value"), "sample_id").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))))
    row = F.row_number().over(Window.partitionBy("label", "round", "locus").orderBy(F.xxhash64(F.lit(1), "round", "locus", "sample_id")))
    mixed = cells.withColumn("row", row).groupBy("label", "round", "row").agg(F.array_sort(F.collect_list(F.struct("locus", "value"))).alias("g"))
    made = mixed.select(F.concat_ws("|", "label", "round").alias("label"), F.transform("g", lambda x: x["value"]).alias("genotype"))
    hits = dict.fromkeys(real, 1)
    for r in distance.association_of(made, len(MARKERS)).collect():
        label = r.label.split("|")[0]
        hits[label] += r["index"] >= real[label] - 1e-12
    got = {r.label: (r["index"], r.p) for r in comparisons.association_test(frame, MARKERS, ROUNDS).collect()}
    assert got == {label: (pytest.approx(real[label]), pytest.approx(hits[label] / (ROUNDS + 1))) for label in real}


def test_association_of_equal_genotypes_and_small_sets(spark):
    rows = [("same", s, m, 5) for s in range(4) for m in (1, 2, 3)] + [("two", s, m, s) for s in (10, 11) for m in (1, 2, 3)]
    rows += [("own", s, m, s) for s in (20, 21, 22, 23) for m in (1, 2, 3)]
    own = spark.createDataFrame([(*r, 1.0) for r in rows], "label string, sample_id long, marker_id int, value int, height double")
    got = {r.label: (r.n, r["index"], r.p) for r in comparisons.association_test(own, (1, 2, 3), 9).collect()}
    # no pair of values ever differs, or all pairs differ at all loci however they are dealt: there is no index
    assert got == {"same": (4, None, 0.1), "own": (4, None, 0.1)}


def test_divisions_as_by_rows(frame):
    top = views.dominant(frame).select("label", "sample_id", "marker_id", "value")
    assert "xxhash64" not in plan(comparisons.fst_permutations(frame))  # no row of a round
    got = {tuple(r) for r in comparisons._divisions(top, 3, 1).collect()}
    rows = top.collect()
    held = {}
    for r in rows:
        held.setdefault(r.label, {}).setdefault(r.sample_id, []).append((r.marker_id, r.value))
    want, labels = {}, sorted(held)
    for i, a in enumerate(labels):
        for b in labels[i + 1 :]:
            ids = np.array(sorted([*held[a], *held[b]]), np.int64)
            for k in range(4):
                order = ids[np.argsort(hashes.xxhash64(1, k, ids))].tolist()
                first = set(order[: len(held[a])]) if k else set(held[a])
                for s in order:
                    for cell in held[a].get(s) or held[b][s]:
                        key = (a, b, k, "1" if s in first else "2", *cell)
                        want[key] = want.get(key, 0) + 1
    assert got == {(*k, n) for k, n in want.items()}


def test_fst_of_both_sets_as_they_are(frame):
    real = {(r.set1, r.set2): r.fst for r in distance.pairwise_fst(frame).collect()}
    got = {(r.set1, r.set2): r.fst for r in comparisons.fst_permutations(frame, 4).collect()}
    assert len(got) == 3 and got == pytest.approx(real)


def test_missing_values_and_ids_of_text(spark):
    rows = [("ab"[i % 2], f"s{i}", m, None if i == 3 else i % 3) for i in range(12) for m in (1, 2)]
    own = spark.createDataFrame([(*r, 1.0) for r in rows], "label string, sample_id string, marker_id int, value int, height double")
    counted = comparisons._divisions(views.dominant(own), 5, 1).groupBy("round", "marker_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.isnull("value"), F.col("n"))).alias("missing")).collect()
    assert len(counted) == 12 and all((r.n, r.missing) == (12, 1) for r in counted)
    assert comparisons.fst_permutations(own, 5).first().fst == pytest.approx(distance.pairwise_fst(own).first().fst)
