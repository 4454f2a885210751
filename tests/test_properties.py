"""Laws that hold on any data, on the smallest tables."""
import pytest
from pyspark.sql import functions as F

from traceloom import catalog
from traceloom.catalog import MARKERS
from traceloom.operators import bins, comparisons, distance, sets, statistics, tables, views
from traceloom.operators.core import AlleleFilter, allele_frame
from traceloom.plans.query import Query
from traceloom.sources import exports

from .conftest import DATA


@pytest.fixture(scope="module")
def frame(spark):
    return allele_frame(catalog.alleles(spark, DATA), AlleleFilter(rel_threshold=0.2, peak_types=None), catalog.samples(spark, DATA)).cache()


@pytest.mark.parametrize("name", ["abs_threshold", "rel_threshold", "stutter_ratio"])
def test_stricter_filters_keep_less(spark, name):
    rows = catalog.alleles(spark, DATA)
    steps = {"abs_threshold": (1000.0, 20000.0, 60000.0), "rel_threshold": (0.1, 0.5, 0.9), "stutter_ratio": (0.1, 0.5, 0.9)}[name]
    sizes = [allele_frame(rows, AlleleFilter(**{"peak_types": None, "rel_threshold": 0.05, name: v})).count() for v in steps]
    assert sizes == sorted(sizes, reverse=True)


def test_frequencies_add_up(frame):
    sums = statistics.allele_summary(frame, samples=True).groupBy("label", "marker_id").agg(F.sum("freq").alias("f"), F.sum(F.size("sample_ids")).alias("n"), F.max("total_alleles").alias("t")).collect()
    assert all(r.f == pytest.approx(1) and r.n == r.t for r in sums)


def test_heterozygosity_is_a_share(frame):
    assert statistics.heterozygosity(frame).where("he < 0 or he > 1.0000001").count() == 0


def test_distances(frame):
    g = views.complete_genotypes(frame, MARKERS)
    few = g.orderBy("sample_id").limit(25)
    ids, _, m = distance.distance_matrix(few)
    assert (m == m.T).all() and (m.diagonal() == 0).all() and m.max() <= 1
    long = {(r.i, r.j): r.d for r in distance.pairwise(few).collect()}
    assert len(long) == len(ids) * (len(ids) - 1) // 2
    place = {s: i for i, s in enumerate(ids)}
    assert all(d == pytest.approx(m[place[i], place[j]]) for (i, j), d in long.items())
    with pytest.raises(ValueError):
        distance.distance_matrix(g, most=3)


def test_association_counts_all_pairs(frame):
    g = views.complete_genotypes(frame, MARKERS)
    got = {r.label: (r.n, r.s, r.q) for r in distance.difference_counts(g).collect()}
    own = {}
    for r in g.collect():
        own.setdefault(r.label, []).append(r.genotype)
    for label, rows in own.items():
        d = [sum(a != b for a, b in zip(x, y, strict=True)) for x in rows for y in rows]
        assert got[label] == (len(rows), sum(d), sum(v * v for v in d))


def test_assignment_is_idempotent(spark):
    own = spark.createDataFrame([(1, b, float(b), b - 0.5, b + 0.5) for b in range(100, 130, 3)], "marker_id int, bin int, mean double, p25 double, p75 double")
    sizes = spark.range(90, 140).select(F.lit(1).alias("marker_id"), (F.col("id") + 0.3).alias("size"))
    once = bins.assign_bins(sizes, own)
    again = bins.assign_bins(once.select("marker_id", F.col("bin").cast("double").alias("size")), own)
    assert sorted(r.bin for r in again.collect()) == sorted(r.bin for r in once.collect())


def test_permutations_are_repeatable(spark, frame):
    own = frame.where("label in ('ECONOMY', 'PROMO')")
    one, two = ([tuple(r) for r in comparisons.fst_permutations(own, 8, seed=3).collect()] for _ in range(2))
    assert [r[3] for r in one] == [r[3] for r in two] and one[0][2] == pytest.approx(two[0][2]) and 0 < one[0][3] <= 1
    for r in comparisons.jost_bootstrap(own, 20).collect():
        assert r.low <= r.d <= r.high
    same = own.withColumn("label", F.when(F.col("sample_id") % 2 == 0, "a").otherwise("b"))
    assert comparisons.compare_infection(same)["p"] > 0.001 and comparisons.compare_heterozygosity(same.where("label = 'a'"))["p"] is None


def test_modes_of_a_query(spark):
    spec = {"selector": {"X": [{"query": "PROMO[label]"}], "Y": [{"query": "LARGE[label]"}]}, "filter": {"abs_threshold": 30000.0, "rel_threshold": 0.9, "rel_cutoff": 0, "sample_qual_threshold": 0.3, "marker_qual_threshold": 0.0, "peak_types": None, "markers": "m1, m2,m3"}}
    own = catalog.catalog(spark, DATA)
    sizes = {}
    for mode in "NMSU":
        q = Query(spec | {"filter": spec["filter"] | {"sample_filtering": mode}}, own)
        assert q.markers == [1, 2, 3]
        sizes[mode] = q.filtered_sample_sets.count()
    assert sizes["N"] >= sizes["S"] >= sizes["M"] > 0 and sizes["N"] >= sizes["U"] > 0
    with pytest.raises(ValueError):
        Query({"selector": [], "filter": spec["filter"], "other": 1}, own)
    summary = Query(spec, own).sample_summary("mlgt").collect()
    assert all(r.initial >= r.filtered >= r.complete for r in summary)


def test_exports_are_written(spark, frame, tmp_path):
    own = catalog.catalog(spark, DATA)
    for form in exports.FORMATS:
        exports.export(frame, own.samples, own.markers, MARKERS, str(tmp_path / form), form)
        assert spark.read.text(str(tmp_path / form)).count() > 5
    with pytest.raises(KeyError):
        exports.export(frame, own.samples, own.markers, MARKERS, str(tmp_path / "x"), "none")


def test_refine_hook_and_restriction(spark):
    own = catalog.samples(spark, DATA)
    picked = sets.select_samples(own, {"a": [{"batch": "Brand#1"}], "b": [{"batch": "Brand#2"}]}, refine=lambda df, spec: df.where("sample_id % 2 = 0"))
    assert picked.where("sample_id % 2 = 1").count() == 0 and {r.label for r in picked.collect()} <= {"a", "b"}
    assert sets.restrict(picked, own.where("sample_id < 0")).count() == 0


def test_tables(spark):
    old = spark.createDataFrame([("Ab", 1, "x"), ("c", 2, None)], "code string, n int, t string")
    new = spark.createDataFrame([("aB", None, "y"), ("d", 9, "z")], "code string, n int, t string")
    assert sorted(map(tuple, tables.upsert(old, new, ["code"], fold=["code"]).collect())) == [("Ab", 1, "y"), ("c", 2, None), ("d", 9, "z")]
    with pytest.raises(KeyError):
        tables.require_codes(old, ["AB", "nobody"])
    assert tables.require_codes(old, ["AB"]).count() == 1 and tables.by_code(old).count() == 2
    revisions = spark.createDataFrame([(1, 10), (1, 12), (2, 11)], "channel_id int, alleleset_id int")
    assert sorted(r.alleleset_id for r in tables.latest_revisions(revisions).collect()) == [11, 12]
    moved = tables.reassign_marker(spark.createDataFrame([(1, 5), (2, 5)], "assay_id int, marker_id int"), 5, 6, spark.createDataFrame([(1,)], "assay_id int"))
    assert sorted(map(tuple, moved.collect())) == [(1, 6), (2, 5)]
