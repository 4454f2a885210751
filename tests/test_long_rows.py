"""Traces are long rows: they are made in small pieces, dealt over tasks, and no tick is moved."""
import pandas as pd

from traceloom.queries import signal_queries
from traceloom.sources import abif

from .conftest import DATA


def test_channels_are_drawn_in_pieces():
    batch = pd.DataFrame({"assay_id": range(100), "channel_id": range(100), "dye": "VIC", "tops": [[2000.0]] * 100})
    sizes = [len(b) for b in signal_queries._drawn([batch])]
    assert max(sizes) <= signal_queries._PIECE and sum(sizes) == 100


def test_suppliers_of_one_split_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(signal_queries, "_ASSAYS", 2)
    rows = signal_queries.assay_tops(spark, DATA)
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 2) > 1


def test_ticks_come_from_whole_files(spark):
    rows = [("a", "VIC", [1.0, 2.0, 3.0], [9.0, 8.0, 7.0]), ("a", "LIZ", [4.0, 5.0], [6.0, 6.0]), ("b", "VIC", [1.0], [2.0]), ("c", "VIC", [], [])]
    own = spark.createDataFrame(rows, "path string, dye string, data array<double>, baseline array<double>")
    out = abif.trace_columns(own, {"x": ("VIC", "data"), "y": ("LIZ", "baseline")})
    assert sorted(map(tuple, out.collect())) == [("a", 0, 1.0, 6.0), ("a", 1, 2.0, 6.0), ("b", 0, 1.0, None)]
    assert abif.trace_rows(own, "data").where("path = 'a'").count() == 2


def test_channels_straight_from_files(spark):
    data = abif.write_tags({("DyeN", 1): (18, "VIC"), ("DyeN", 5): (18, "LIZ"), ("DyeN", 2): (18, "NED"), ("DyeW", 1): (4, [555.0]), ("DATA", 1): (4, [1.0, 2.0]), ("DATA", 105): (4, [3.0]), ("RUND", 1): (10, (2020, 1, 2)), ("RUNT", 1): (11, (3, 4, 5, 0))})
    files = spark.createDataFrame([("p", data), ("q", data)], "path string, content binary")
    tags = abif.parse_files(files)
    want = abif.channels(tags).join(abif.run_starts(tags), "path").select("path", "channel", "dye", "wavelength", "raw", "started")
    got = abif.file_channels(files)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 4
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
