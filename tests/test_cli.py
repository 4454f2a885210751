"""Commands from their arguments to the tables they write; uploads with every kind of problem; a cache that files outdate."""
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from traceloom import cli, reporting
from traceloom.sources import abif, manifests, uploads

from .conftest import DATA

QUERY = {"selector": {"A": [{"batch": "Brand#1"}], "B": [{"batch": "Brand#2"}]}, "filter": {"abs_threshold": 2000, "rel_threshold": 0.1, "rel_cutoff": 0, "sample_qual_threshold": 0.2, "marker_qual_threshold": 0.1}}
PANELS = {"P": {"data": {"ladder": "LIZ500", "markers": {"X/A": {"dye": "VIC", "filter": "G"}, "X/B": {"dye": "NED", "filter": "G"}}}}}


def _trace(path, dye="VIC", value=7):
    path.write_bytes(abif.write_tags({("DyeN", 1): (18, dye), ("DyeN", 5): (18, "LIZ"), ("DATA", 1): (4, [value, 8, 9]), ("DATA", 105): (4, [1, 2, 3, 4]), ("RUND", 1): (10, (2020, 1, 2)), ("RUNT", 1): (11, (3, 4, 5, 0))}))


@pytest.mark.parametrize("report", ["samples", "alleles", "he", "moi", "bins", "haplotypes"])
def test_reports(spark, tmp_path, report):
    out = str(tmp_path / "out")
    assert cli.main(["analyze", "--data", DATA, "--query", json.dumps(QUERY), "--report", report, "--out", out], spark) == 0
    assert spark.read.parquet(f"{out}/{report}").count() > 0


def test_thresholds_of_the_command_line_count(spark, tmp_path):
    few = cli.run(spark, cli.parser().parse_args(["analyze", "--data", DATA, "--query", json.dumps(QUERY), "--report", "alleles", "--abs-threshold", "40000"]))["alleles"]
    many = cli.run(spark, cli.parser().parse_args(["analyze", "--data", DATA, "--query", json.dumps(QUERY), "--report", "alleles"]))["alleles"]
    n = lambda df: df.agg(F.sum("n")).first()[0]
    assert 0 < n(few) < n(many)


def test_export_and_query(spark, tmp_path):
    out = str(tmp_path / "out")
    assert cli.main(["export", "--data", DATA, "--query", json.dumps(QUERY), "--form", "moidf", "--out", out], spark) == 0
    assert spark.read.option("header", True).option("sep", "\t").csv(f"{out}/moidf").columns == ["LABEL", "SAMPLE", "MOI", "MLOCI"]
    assert cli.main(["query", "--data", DATA, "--name", "he", "--out", out], spark) == 0 and spark.read.parquet(f"{out}/he").count() > 0
    with pytest.raises(SystemExit):
        cli.main(["query", "--data", DATA, "--name", "nothing"], spark)


def test_convert(spark, tmp_path):
    traces = tmp_path / "traces"
    traces.mkdir()
    _trace(traces / "a.fsa")
    raw = cli.run(spark, cli.parser().parse_args(["convert", "--input", str(traces)]))["raw"]
    assert [(r.rtime, r.VIC, r.LIZ) for r in raw.orderBy("rtime").collect()] == [(0, 7, 1), (1, 8, 2), (2, 9, 3)]
    assert cli.run(spark, cli.parser().parse_args(["convert", "--input", str(traces), "--to", "baseline"]))["baseline"].count() == 3


def test_tables_and_bins(spark, tmp_path, capsys):
    panels = cli.run(spark, cli.parser().parse_args(["tables", "--name", "panels", "--document", json.dumps(PANELS)]))["panels"]
    assert sorted(r.marker for r in panels.collect()) == ["X/A", "X/B"]
    assert cli.main(["tables", "--name", "region", "--data", DATA], spark) == 0 and "AFRICA" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["tables", "--name", "region"], spark)
    alleles = tmp_path / "alleles.tsv"
    alleles.write_text("MARKER\tSIZE\n" + "".join(f"m\t{s}\n" for s in [100.4] * 9 + [103.3] * 5))
    old = {"m": {"bins": [[100, 100.0, 99.5, 100.5], [103, 103.0, 102.5, 103.5]]}}
    got = cli.run(spark, cli.parser().parse_args(["bins", "--alleles", str(alleles), "--bins", json.dumps(old), "--repeats", "3"]))["bins"]
    assert sorted((r.bin, r.mean) for r in got.collect()) == [(100, 100.4), (103, 103.3)]


def test_upload(spark, tmp_path):
    traces = tmp_path / "traces"
    traces.mkdir()
    for name in ("a", "b"):
        _trace(traces / f"{name}.fsa")
    (traces / "bad.fsa").write_bytes(b"ABIF but cut")
    manifest = tmp_path / "m.tsv"
    manifest.write_text("SAMPLE\tFILENAME\tPANEL\tOPTIONS\n" + "".join(f"{r}\n" for r in ("s1\ta.fsa\tP\t", "s2\tb.fsa\tP,Q\texclude=x/a", "s3\tgone.fsa\tP\t", "s4\tbad.fsa\tP\t", "s1\ta.fsa\tP\t")))
    out = str(tmp_path / "out")
    assert cli.main(["upload", "--manifest", str(manifest), "--traces", str(traces), "--panels", json.dumps(PANELS), "--out", out], spark) == 0
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert sorted((r["sample"], r.panel, str(r.started)) for r in read("assays").collect()) == [("s1", "P", "2020-01-02 03:04:05"), ("s2", "P", "2020-01-02 03:04:05")]
    status = {(r["sample"], r.dye): (r.marker, r.status) for r in read("channels").join(read("assays"), "assay_id").collect()}
    assert status == {("s1", "VIC"): ("X/A", "assigned"), ("s1", "LIZ"): ("ladder", "ladder"), ("s2", "VIC"): ("X/A", "unassigned"), ("s2", "LIZ"): ("ladder", "ladder")}
    problems = {(r["sample"], r.panel): r.problem for r in read("problems").collect()}
    assert problems[("s2", "Q")] == "unknown panel" and problems[("s3", "P")] == "no such file" and ("s4", "P") in problems and len(problems) == 3
    rows = spark.createDataFrame([("s1", "a.fsa", "P", ["x/zz"])], "sample string, filename string, panel string, excluded array<string>")
    dyes = manifests.panels_table(spark, PANELS).select("panel", "dye", "marker")
    wrong = uploads.upload(rows, cli._files(spark, str(traces)).select("path", "content"), dyes).problems.first()
    assert wrong.problem.endswith("x/zz")


def test_cache_of_channels(spark, tmp_path):
    traces, cache = tmp_path / "traces", str(tmp_path / "cache")
    traces.mkdir()
    for name in ("a", "b"):
        _trace(traces / f"{name}.fsa")
    first = uploads.cached_channels(spark, cli._files(spark, str(traces)), cache)
    assert first.count() == 4 and spark.read.parquet(cache).count() == 4
    _trace(traces / "a.fsa", value=70)
    later = time.time() + 60
    os.utime(traces / "a.fsa", (later, later))
    again = uploads.cached_channels(spark, cli._files(spark, str(traces)), cache)
    assert again.count() == 4 and spark.read.parquet(cache).count() == 6
    assert sorted(r.data[0] for r in again.where("dye = 'VIC'").collect()) == [7.0, 70.0]


def test_messages(capsys):
    reporting.setup()
    reporting.say("%d rows", 3)
    reporting.detail("unseen")
    reporting.warn("odd")
    assert reporting.stop("no more").code == 2
    assert capsys.readouterr().err.splitlines() == ["I 3 rows", "W odd", "E no more"]
