"""Traces with known peaks, ladders on known curves, and files written and read."""
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceloom.constants import LADDERS
from traceloom.functions import linear, ranktests, text
from traceloom.operators import bins, channels, distance, peaks, sizing
from traceloom.signals import ladder, trace
from traceloom.sources import abif, manifests


def _run(name, seed=1, n=12000, extra=()):
    rng = np.random.default_rng(seed)
    sizes = np.array(LADDERS[name].sizes)
    at = 1200 + sizes * 11 + sizes**2 * 0.002
    x = np.arange(n)
    y = 60 + 30 * np.sin(x / 3000) + rng.normal(0, 2, n)
    for t in at:
        y += 1000 * rng.uniform(0.6, 1.1) * np.exp(-(((x - t) / 4) ** 2) / 2)
    for t in extra:
        y += 200 * np.exp(-(((x - t) / 4) ** 2) / 2)
    return y, at


@pytest.mark.parametrize("name", list(LADDERS))
def test_ladder_is_aligned(name):
    y, at = _run(name)
    signal, baseline = trace.normalise(y)
    assert signal.min() >= 0 and abs(np.median(baseline) - 60) < 40
    found = trace.file_peaks(signal, trace.LADDER_SCAN, len(at))
    rtimes, heights = [p["rtime"] for p in found], [p["height"] for p in found]
    for got in (ladder.align_file(rtimes, heights, LADDERS[name]), ladder.by_pairs(np.array(rtimes), np.array(heights), LADDERS[name]), ladder.align_stored(rtimes, heights, np.ones(len(rtimes)), LADDERS[name])):
        assert got.score > 0.9 and len(got.fit.pairs) == len(at)
        assert max(abs(np.polyval(got.fit.z, t) - s) for s, t in zip(LADDERS[name].sizes, at, strict=True)) < 0.5


def test_ladder_with_noise_peaks():
    y, at = _run("LIZ500", extra=(900, 2150, 2350, 5230, 6666, 7100, 9999))
    found = trace.file_peaks(trace.normalise(y)[0], trace.LADDER_SCAN, 16)
    got = ladder.align_file([p["rtime"] for p in found], [p["height"] for p in found], LADDERS["LIZ500"])
    assert got.fit is not None and max(abs(np.polyval(got.fit.z, t) - s) for s, t in zip(LADDERS["LIZ500"].sizes, at, strict=True)) < 2


@pytest.mark.parametrize(("kind", "method"), [("good", "fast"), ("fair", "fast"), ("short", "fast"), ("unknown", "greedy"), ("noisy", "greedy")])
def test_stored_ladder(kind, method):
    """The cascade pairs every size with its own peak, whatever is known of the peaks."""
    sizes = np.array(LADDERS["LIZ500"].sizes)
    at = np.round(1200 + 14 * sizes + 0.002 * sizes**2).astype(int)
    rtimes, quality = list(at), np.ones(len(at))
    if kind == "fair":
        quality[1::2] = 0.8
    if kind == "short":  # the run ended before the last two sizes
        rtimes, quality = rtimes[:-2], quality[:-2]
    if kind in ("unknown", "noisy"):
        quality[:] = 0.3
    if kind == "noisy":
        rtimes, quality = [*rtimes, 1350, 2890, 5200], np.full(len(at) + 3, 0.3)
    heights = np.where(np.isin(rtimes, at), 800.0, 60.0)
    got = ladder.align_stored(rtimes, heights, quality, LADDERS["LIZ500"])
    want = list(zip(sizes.tolist(), at.tolist(), strict=True))[: 14 if kind == "short" else 16]
    assert got.method.startswith(method) and got.fit.pairs == want
    assert max(abs(np.polyval(got.fit.z, t) - s) for s, t in want) < 0.5
    assert got.score > (0.7 if kind == "short" else 0.99)


def test_worst_pair_is_dropped():
    fit = ladder.Fit(1.0, 1.0, np.array([1.0, 0.0]), [(10.0, 10), (20.0, 35), (30.0, 30), (40.0, 40), (50.0, 50), (60.0, 60)])
    assert ladder.Stored.without_worst(fit).tolist() == [[10, 20], [30, 30], [40, 40], [50, 50], [60, 60]]


@pytest.mark.parametrize("seed", range(5))
def test_path_against_all_ways(seed):
    """The greatest sum over every way to pair rows and columns in order."""
    scores, gap = np.random.default_rng(seed).normal(size=(3, 4)), -0.3
    n, m = scores.shape

    def best(i, j):
        if i == n:
            return 0.0
        if j == m:
            return (n - i) * gap / 4
        first = gap / 4 if j == 0 else gap
        return max(scores[i, j] + best(i + 1, j + 1), best(i, j + 1), first + best(i + 1, j))

    assert ladder.best_path(scores, gap)[0] == pytest.approx(best(0, 0))


def test_too_few_peaks():
    assert ladder.align_file([1, 2], [1.0, 1.0], LADDERS["LIZ500"]).fit is None


def test_path_prefers_matches():
    score, pairs = ladder.best_path(np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), -0.5)
    assert pairs == [(0, 0), (1, 2)] and score == pytest.approx(2.0)


def test_filters():
    x = np.array([1.0, 9.0, 2.0, 3.0, 8.0, 4.0, 5.0])
    assert trace.median_filter(x, 3).tolist() == [1, 2, 3, 3, 4, 5, 4]
    line = np.arange(50) ** 2 / 7.0
    assert np.allclose(trace.savitzky_golay(line, 11, 3), line)
    assert np.allclose(trace.window_smooth(np.full(30, 2.0), 7, "flat"), 2.0)
    top = trace.white_tophat(np.r_[np.zeros(20), 5.0, np.zeros(20)], 9)
    assert top[20] == 5 and top.sum() == 5


def test_peaks_are_apart():
    y = np.zeros(100)
    y[[20, 25, 60]] = 10, 9, 5
    y[80:83] = 7
    assert trace.peak_indexes(y, 0.0, 10).tolist() == [20, 60, 81]
    assert trace.peak_indexes(y, 0.0, 2).tolist() == [20, 25, 60, 81]
    assert trace.peak_indexes(np.zeros(10), 0.0, 3).tolist() == []


@pytest.mark.parametrize("method", ["pd", "relmax", "window", "cwt"])
def test_peak_methods_find_a_clear_peak(method):
    x = np.arange(4000)
    y = 3000 * np.exp(-(((x - 2000) / 6) ** 2) / 2) + 1
    at = trace.raw_peaks(y, trace.Scan(method=method))
    assert any(abs(i - 2000) <= 3 for i in at)


def test_spline_passes_through_cubics():
    x = np.array([0.0, 1.0, 2.5, 4.0, 6.0])
    f = np.poly1d([0.5, -1, 2, 3])
    at = np.linspace(0, 6, 13)
    assert np.allclose(ladder.spline_sizes(x, f(x), at), f(at))


def test_abif_round_trip(spark):
    tags = {("DyeN", 1): (18, "6FAM"), ("DyeN", 5): (18, "LIZ"), ("DyeN", 2): (18, "NED"), ("DyeW", 1): (4, [520]), ("DATA", 1): (4, [1, -2, 300]), ("DATA", 105): (4, [7, 8]), ("RUND", 1): (10, (2019, 5, 17)), ("RUNT", 1): (11, (10, 20, 30, 0)), ("CMNT", 1): (19, "note"), ("ABCD", 3): (7, [1.5])}
    data = abif.write_tags(tags)
    back = abif.read_tags(data)
    assert back[("DATA", 1)][1].tolist() == [1, -2, 300] and back[("CMNT", 1)][1] == "note" and back[("RUND", 1)][1] == (2019, 5, 17) and back[("ABCD", 3)][1].tolist() == [1.5]
    files = spark.createDataFrame([("f1", bytearray(data)), ("f2", bytearray(data[:200])), ("f3", bytearray(b"nothing"))], "path string, content binary")
    problems = {r.path: r.problem for r in abif.readable(files).collect()}
    assert problems["f1"] is None and problems["f2"] and problems["f3"]
    parsed = abif.parse_files(files.where("path = 'f1'"))
    got = {r.dye: (r.wavelength, r.raw) for r in abif.channels(parsed).collect()}
    assert got == {"6-FAM": (520, [1, -2, 300]), "LIZ": (655, [7, 8])}
    assert str(abif.run_starts(parsed).first().started) == "2019-05-17 10:20:30"
    assert abif.tag(parsed, "DATA105").first().numbers == [7, 8]
    rows = abif.trace_rows(abif.channels(parsed)).orderBy("rtime").collect()
    assert [(r.rtime, r["6-FAM"], r["LIZ"], r["PET"]) for r in rows] == [(0, 1, 7, None), (1, -2, 8, None)]


def test_abif_folder_and_stream(spark, tmp_path):
    from traceloom.streaming import scans

    y = _run("LIZ500")[0]
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.fsa").write_bytes(abif.write_tags({("DyeN", 1): (18, "VIC"), ("DATA", 1): (4, y)}))
    assert abif.read_abif(spark, str(tmp_path / "in")).where("tag = 'DATA'").count() == 2
    abif.register(spark)
    assert spark.read.format("abif").load(str(tmp_path / "in")).where("tag = 'DyeN'").count() == 2
    scans.scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), trace.Scan(max_rtime=12000)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("assay_id").distinct().count() == 2


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("FILENAME,SAMPLE,PANEL,OPTIONS\na.fsa,s1,\"P,Q\",exclude=x/a\n#b.fsa,s2,P,\nc.fsa,s3,P,\n")
    own = manifests.manifest(manifests.read_table(spark, str(path)))
    assert sorted((r["sample"], r.panel, tuple(r.excluded)) for r in own.collect()) == [("s1", "P", ("x/a",)), ("s1", "Q", ("x/a",)), ("s3", "P", ())]
    panels = manifests.panels_table(spark, {"P": {"data": {"ladder": "LIZ500", "markers": {"X/A": {"dye": "VIC", "filter": "G"}}}}, "Q": {"data": {"markers": {"x/b": {"dye": "NED"}}}}})
    assert [(r.panel, r.marker) for r in manifests.unknown_excludes(own, panels).collect()] == [("Q", "x/a")]
    assert manifests.panels_table(spark, {"P": manifests.load_document(manifests.panels_document(panels.where("panel = 'P'")).first().document)}).first().ladder == "LIZ500"
    known = manifests.markers_table(spark, {"x/a": {"min_size": 80, "max_size": 200, "repeats": 3}})
    assert [(r.panel, r.marker) for r in manifests.unknown_markers(panels, known).collect()] == [("Q", "x/b")]
    with pytest.raises(ValueError):
        manifests.markers_table(spark, {"x/a": {"code": "x/b"}})


def test_sniff():
    assert manifests.sniff("a\tb\n1\t2\n")[1] == "\t" and manifests.sniff("a,b,c\n1,2,3\n")[1] == ","
    assert manifests.sniff("a\rb\r")[0] == "a\nb\n"
    with pytest.raises(ValueError):
        manifests.sniff("a\r\r\rb\n")


_COLOURS = {(300, 255): [0, 0, 0], (400, 255): [131, 0, 181], (450, 255): [0, 70, 255], (550, 255): [163, 255, 0], (600, 255): [255, 190, 0], (800, 255): [0, 0, 0], (450, 100): [0, 28, 100], (550, 100): [64, 100, 0]}


def test_colours_of_wavelengths(spark):
    for (nm, most), rgb in _COLOURS.items():
        assert spark.range(1).select(text.wavelength_rgb(F.lit(nm), most).alias("c")).first().c == rgb


def test_options(spark):
    own = spark.createDataFrame([("A=1,2;B",), (" A = x ;; A=y=z ",), ("",), (None,)], "t string")
    assert [r.m for r in own.select(text.options_map(F.col("t")).alias("m")).collect()] == [{"A": "1,2", "B": "true"}, {"A": "y=z"}, {}, None]
    assert spark.range(3).select(text.random_id(40).alias("r")).distinct().where("length(r) = 40").count() == 3


def test_bins_of_sizes(spark):
    own = spark.createDataFrame([(1, 100, 100.2, 99.9, 100.5), (1, 104, 104.1, 103.8, 104.4)], "marker_id int, bin int, mean double, p25 double, p75 double")
    sizes = spark.createDataFrame([(1, x) for x in (99.0, 102.0, 102.2, 110.0, -1.0)], "marker_id int, size double")
    assert sorted((r.size, r.bin) for r in bins.assign_bins(sizes, own).collect()) == [(-1.0, -1), (99.0, 100), (102.0, 100), (102.2, 104), (110.0, 104)]
    made = bins.initial_bins(spark.createDataFrame([(1, 100, 110, 3)], "marker_id int, start int, stop int, repeats int"))
    assert sorted(tuple(r)[1:] for r in made.collect()) == [(s, float(s), s - 1.0, s + 1.0) for s in (100, 103, 106, 109)]


def test_optimised_bins_move_to_the_sizes():
    import pandas as pd

    own = pd.DataFrame({"marker_id": 1, "bin": [100, 103, 106], "mean": [100.0, 103.0, 106.0], "p25": [99.5, 102.5, 105.5], "p75": [100.5, 103.5, 106.5]})
    sizes = np.array([100.4, 103.3, 106.4])
    got = bins.optimise(sizes, np.array([50, 40, 30]), own, 3)
    assert got["mean"].tolist() == [100.4, 103.3, 106.4]


def test_half_even_bins(spark):
    lad = spark.createDataFrame([(1, int(t), float(s), 0.0, 1.0) for t, s in zip(range(0, 700, 100), range(97, 104), strict=True)], "assay_id long, rtime int, size double, deviation double, qscore double")
    rows = spark.createDataFrame([(1, 5, 350, "scanned"), (1, 5, 450, "scanned"), (1, 5, 50, "scanned"), (1, 5, 650, "noise")], "assay_id long, channel_id long, rtime int, type string")
    got = {r.rtime: (round(r.size, 6), r.bin, r.type) for r in sizing.call_peaks(rows, lad).collect()}
    assert got == {350: (100.5, 100, "called"), 450: (101.5, 102, "called"), 50: (-1.0, -1, "unassigned"), 650: (-1.0, -1, "noise")}


def test_fold_and_kernel_agree(spark):
    y = trace.normalise(_run("LIZ500")[0])[0][1500:1900]
    top = int(y.argmax())
    got = spark.createDataFrame([(y.tolist(),)], "data array<double>").select(channels.half_area(F.col("data"), F.lit(top), F.lit(1.0)).alias("h")).first().h
    area, ticks, shared = trace._slope(y[top:], 0.025, 1.0)
    assert got.area == pytest.approx(area) and (got.ticks, got.shared) == (ticks, shared)


def test_overlaps(spark):
    x = np.arange(100)
    small, big = 10 * np.exp(-(((x - 50) / 5) ** 2)), 100 * np.exp(-(((x - 50) / 5) ** 2)) + 1
    table = spark.createDataFrame([(1, 9, "VIC", small.tolist()), (2, 9, "PET", big.tolist())], "channel_id long, assay_id long, dye string, data array<double>")
    found = spark.createDataFrame([(1, 50, 40, 60, 10.0, "scanned", 1.0), (2, 50, 40, 60, 101.0, "scanned", 1.0)], "channel_id long, rtime int, brtime int, ertime int, height double, type string, qscore double")
    got = {r.channel_id: (r.type, round(r.qscore, 3)) for r in peaks.mark_overlaps(found, table).collect()}
    assert got == {1: ("overlap", 0.9), 2: ("scanned", 1.0)}


def test_tails():
    assert ranktests.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and ranktests.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05) and ranktests.chi2_tail(0, 3) == 1
    assert ranktests.normal_tail(1.959963984540054) == pytest.approx(0.05)


def test_tree_of_additive_distances():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    edges = linear.neighbour_joining(d)
    graph = {}
    for p, c, x in edges:
        graph.setdefault(p, []).append((c, x))
        graph.setdefault(c, []).append((p, x))

    def far(a, b, seen=()):
        return 0 if a == b else min((x + far(n, b, (*seen, a)) for n, x in graph[a] if n not in seen), default=math.inf)

    assert all(far(i, j) == pytest.approx(d[i, j]) for i in range(5) for j in range(5))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 100, allow_nan=False), min_size=20, max_size=80))
def test_tophat_is_between_zero_and_the_trace(values):
    y = np.array(values)
    top = trace.white_tophat(y, 7)
    assert (top >= -1e-9).all() and (top <= y + 1e-9).all()


def test_counted_rows_are_like_repeated_ones():
    rng = np.random.default_rng(3)
    g = rng.integers(0, 4, (12, 5)).astype(float)
    g = np.unique(g, axis=0)
    n = rng.integers(1, 5, len(g))
    at = np.repeat(np.arange(len(g)), n)
    m = distance._differences(g)
    assert np.allclose(linear.principal_components(m, 2, n, n)[at], linear.principal_components(m[np.ix_(at, at)], 2))
    one_hot = linear.indicators(g)
    assert np.allclose(linear.principal_components(one_hot, 2, n)[at], linear.principal_components(one_hot[at], 2))
    assert np.allclose(linear.correspondence(g, 2, n)[at], linear.correspondence(g[at], 2))


def test_pictures_of_samples_that_share_genotypes(spark):
    rows = [(i, "a" if i % 2 else "b", [float(i % 4), float(i % 3), 1.0]) for i in range(30)]
    own = spark.createDataFrame(rows, "sample_id long, label string, genotype array<double>")
    for out in (distance.pcoa(own), distance.mca(own), distance.one_hot_components(own)):
        got = {r.sample_id: tuple(r)[1:] for r in out.collect()}
        assert len(got) == 30 and all(got[i][1:] == got[i + 12][1:] for i in range(18)) and len({g[1:] for g in got.values()}) == 12
    moved = distance.pcoa(own, jitter=0.1).collect()
    assert len({tuple(r)[2:] for r in moved}) == 30
    tree = distance.neighbour_tree(own).collect()
    assert sorted(r.sample_id for r in tree if r.sample_id is not None) == list(range(30))
    children = [r.child for r in tree]
    assert len(set(children)) == len(children) and len({r.parent for r in tree} - set(children)) == 1
    with pytest.raises(ValueError):
        distance.mca(own, most=11)
