"""Hand-computed cells of the core query, and rules at their edges."""
import pytest
from pyspark.sql import functions as F

from traceloom.operators import quality, sets, statistics, views
from traceloom.operators.core import AlleleFilter, allele_frame

CELL = [(100.0, 1000.0), (103.0, 400.0), (97.5, 90.0), (150.0, 20.0)]
_ALLELES = "marker_id int, sample_id int, value int, size double, height double, assay_id int, allele_id int, type string"


def cells(spark, rows):
    """Alleles from (marker, sample, size, height)."""
    return spark.createDataFrame([(m, s, round(x), x, h, 1, i, "bin") for i, (m, s, x, h) in enumerate(rows)], _ALLELES)


def one(spark, **params):
    out = allele_frame(cells(spark, [(1, 1, x, h) for x, h in CELL]), AlleleFilter(**params))
    return sorted((r.height, r.rank) for r in out.collect())


@pytest.mark.parametrize(
    ("params", "kept"),
    [
        ({}, [(20.0, -1), (90.0, -1), (400.0, -1), (1000.0, -1)]),
        ({"abs_threshold": 50.0, "rel_threshold": 0.2}, [(400.0, 2), (1000.0, 1)]),
        ({"abs_threshold": 400.0, "rel_threshold": 0.2}, [(1000.0, 1)]),
        ({"abs_threshold": 50.0, "rel_threshold": 0.05, "stutter_ratio": 0.5}, [(1000.0, 1)]),
        ({"abs_threshold": 50.0, "rel_threshold": 0.05, "stutter_ratio": 0.3}, [(400.0, 2), (1000.0, 1)]),
        ({"abs_threshold": 50.0, "rel_threshold": 0.05, "rel_cutoff": 0.3}, []),
        ({"abs_threshold": 50.0, "rel_threshold": 0.5, "rel_cutoff": 0.3}, [(1000.0, 1)]),
    ],
)
def test_one_cell(spark, params, kept):
    assert one(spark, **params) == kept


def test_each_marker_of_a_single_sample_is_its_own_cell(spark):
    out = allele_frame(cells(spark, [(1, 7, 100.0, 50.0), (2, 7, 90.0, 1000.0), (2, 7, 80.0, 100.0)]), AlleleFilter(rel_threshold=0.5))
    assert sorted((r.marker_id, r.height, r.rank, r.ratio) for r in out.collect()) == [(1, 50.0, 1, 1.0), (2, 1000.0, 1, 1.0)]


def test_stutter_leaves_a_gap_in_the_ranks_and_counts_as_higher(spark):
    rows = [(1, 1, 100.0, 1000.0), (1, 1, 102.0, 300.0), (1, 1, 105.0, 100.0), (1, 1, 130.0, 90.0)]
    out = allele_frame(cells(spark, rows), AlleleFilter(stutter_ratio=0.5))
    assert sorted((r.size, r.rank) for r in out.collect()) == [(100.0, 1), (130.0, 4)]


def test_difference_of_exactly_the_range_is_no_stutter(spark):
    out = allele_frame(cells(spark, [(1, 1, 100.0, 1000.0), (1, 1, 103.5, 400.0)]), AlleleFilter(stutter_ratio=0.5))
    assert out.count() == 2


def test_bad_ratios_are_refused():
    with pytest.raises(ValueError):
        AlleleFilter(stutter_ratio=1.5)
    with pytest.raises(ValueError, match="lacks"):
        AlleleFilter.from_dict({"abs_threshold": 1})


def test_empty_frame_keeps_its_columns(spark):
    out = allele_frame(cells(spark, []), AlleleFilter(rel_threshold=0.2))
    assert out.count() == 0 and "rank" in out.columns


def labelled(spark, rows):
    """A frame from (marker, sample, value) with one height each, falling in order."""
    data = [("x", m, s, v, float(v), 1000.0 - i, 1, i, 1.0, 1) for i, (m, s, v) in enumerate(rows)]
    return spark.createDataFrame(data, "label string, marker_id int, sample_id int, value int, size double, height double, assay_id int, allele_id int, ratio double, rank int")


def test_heterozygosity(spark):
    f = labelled(spark, [(1, 1, 100), (1, 2, 100), (1, 3, 100), (1, 4, 104), (2, 1, 50)])
    adjusted = {r.marker_id: r.he for r in statistics.heterozygosity(f).collect()}
    raw = {r.marker_id: r.he for r in statistics.heterozygosity(f, adjust=False).collect()}
    assert raw[1] == pytest.approx(0.375) and adjusted[1] == pytest.approx(0.5) and adjusted[2] == 0


def test_multiplicity_of_infection(spark):
    f = labelled(spark, [(1, 1, 1), (1, 1, 2), (2, 1, 1), (1, 2, 1), (1, 3, 1), (1, 3, 2), (1, 3, 3), (2, 3, 1), (2, 3, 2)])
    assert sorted((r.sample_id, r.moi, r.mloci) for r in views.sample_multiplicity(f).collect()) == [(1, 2, 1), (2, 1, 0), (3, 3, 2)]
    s = statistics.infection_stats(f).first()
    assert (s["mean"], s["std"], s["n"], s["polyclonal"], s["max"]) == (2.0, 1.0, 3, 2, 3)
    assert sorted((r.marker_id, r.polyclonal, r.cumulative) for r in statistics.polyclonality(f).collect()) == [(1, 2, 2), (2, 1, 2)]


def test_adjacency_of_bins(spark):
    f = labelled(spark, [(1, 1, 100), (1, 2, 101), (1, 3, 105), (1, 4, 106), (2, 1, 100)]).select("label", "marker_id", "value")
    got = {(r.marker_id, r.value): r.isolated for r in statistics.adjacency(f).collect()}
    assert got == {(1, 100): False, (1, 101): False, (1, 105): False, (1, 106): True, (2, 100): True}


def test_marker_without_alleles(spark):
    f = labelled(spark, [(1, 1, 1), (1, 2, 1)])
    totals = spark.createDataFrame([("x", 3)], "label string, n long")
    per_set = {r.marker_id: (r.genotyped, r.passed) for r in quality.set_marker_quality(f, totals, [1, 2], 0.0).collect()}
    assert per_set == {1: (2, True), 2: (0, True)}
    assert [r.marker_id for r in quality.marker_quality(f, totals, 0.0).collect()] == [1]


def test_ties_of_the_dominant_allele(spark):
    f = labelled(spark, [(1, 1, 100), (1, 1, 104)]).withColumn("height", F.lit(5.0))
    assert views.dominant(f).count() == 2
    assert [r.value for r in views.multilocus(f).collect()] == [102.0]


def test_sample_modes(spark):
    f = labelled(spark, [(1, 1, 5), (2, 1, 6), (1, 2, 5), (2, 2, 6), (1, 3, 5), (1, 3, 9), (2, 3, 6)])
    pick = lambda mode: sorted(r.sample_id for r in quality.filtered_samples(f, [1, 2], 1.0, mode).collect())
    assert pick("N") == [1, 2, 3] and pick("M") == [1, 2] and pick("S") == [1, 2, 3] and 1 in pick("U") and 2 not in pick("U")


def test_query_text(spark):
    rows = spark.createDataFrame([(1, "a", "b1", 1), (2, "b", "b1", 2), (3, "c", "b2", 1)], "sample_id int, code string, batch string, category int")
    ids = lambda text: sorted(r.sample_id for r in rows.where(sets.parse_query(text)).collect())
    assert ids("B1[batch]") == [1, 2] and ids("b1[batch] & !(a | c)") == [2] and ids("a | c[code]") == [1, 3] and ids("!b1[batch]") == [3]
    for bad in ("(a", "a &", "& a", "a b", ""):
        with pytest.raises(ValueError):
            sets.parse_query(bad)


def test_overlapping_sets_are_refused(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "label string, sample_id int")
    with pytest.raises(ValueError, match="several sets"):
        sets.require_disjoint(s)
    assert sets.require_disjoint(s.where("label = 'b'")).count() == 2
