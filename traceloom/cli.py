"""The command line: analyze, export, convert, upload, tables and bins, over tables in folders."""
from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, queries, reporting
from .operators import bins, comparisons, distance, statistics, tables
from .plans.query import Query
from .sources import abif, exports, manifests, uploads

#: Reports of a query by name.
REPORTS: dict[str, Callable[[Query], DataFrame]] = {
    "samples": lambda q: q.sample_summary("mlgt"),
    "alleles": lambda q: q.allele_summary(),
    "bins": lambda q: statistics.bin_summary(q.filtered_frames),
    "he": lambda q: statistics.heterozygosity(q.filtered_frames),
    "moi": lambda q: statistics.infection_stats(q.filtered_frames),
    "haplotypes": lambda q: q.haplotypes,
    "distances": lambda q: distance.pairwise(q.haplotypes),
    "pcoa": lambda q: distance.pcoa(q.haplotypes),
    "mca": lambda q: distance.mca(q.haplotypes),
    "tree": lambda q: distance.neighbour_tree(q.haplotypes),
    "fst": lambda q: comparisons.fst_permutations(q.filtered_frames),
    "jost": lambda q: comparisons.jost_bootstrap(q.filtered_frames),
    "linkage": lambda q: comparisons.association_test(q.filtered_frames, q.markers),
}
#: Documents that become tables.
DOCUMENTS = {"markers": manifests.markers_table, "panels": manifests.panels_table, "bins": manifests.bins_table, "samples": manifests.samples_table}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("traceloom", description=__doc__)
    top.add_argument("-v", "--verbose", action="store_true", help="tell more")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=what, description=what)
        for x in needed:
            p.add_argument(f"--{x}", required=True)
        p.add_argument("--out", help="a folder to write; without it, rows are shown")
        return p

    for name, what in (("analyze", "reports of a query"), ("export", "a query's alleles in an exchange format")):
        p = command(name, what, "data", "query")
        p.add_argument("--abs-threshold", type=float)
        p.add_argument("--rel-threshold", type=float)
        p.add_argument("--sample-quality", type=float)
        p.add_argument("--markers", help="codes with commas")
        if name == "analyze":
            p.add_argument("--report", choices=sorted(REPORTS), default="samples")
        else:
            p.add_argument("--form", choices=sorted(exports.FORMATS), default="major_tab")
    p = command("convert", "trace files to text tables, or a list of called markers to a manifest", "input")
    p.add_argument("--to", choices=("raw", "baseline", "manifest"), default="raw")
    p.add_argument("--panels", help="a document of panels, for manifests")
    p.add_argument("--species")
    p = command("upload", "trace files of a manifest into assays and channels", "manifest", "traces", "panels")
    p.add_argument("--panel", help="of rows that name none")
    p = command("tables", "documents into tables, or a look at tables", "name")
    p.add_argument("--document", help="of markers, panels, bins or samples")
    p.add_argument("--data", help="a folder of tables, to show one of them")
    p.add_argument("--code", action="append", help="only rows of this code")
    p = command("bins", "bins moved to where sizes lie, from a table of alleles", "alleles", "bins")
    p.add_argument("--repeats", type=int, required=True)
    p.add_argument("--rounds", type=int, default=30)
    p = command("query", "a registered query over a folder of tables", "data", "name")
    return top


def _query(spark: SparkSession, args: argparse.Namespace) -> Query:
    doc = dict(manifests.load_document(args.query))
    wanted = {"abs_threshold": args.abs_threshold, "rel_threshold": args.rel_threshold, "sample_qual_threshold": args.sample_quality, "markers": args.markers and args.markers.split(",")}
    doc["filter"] = dict(doc.get("filter") or {}) | {k: v for k, v in wanted.items() if v is not None}
    return Query(doc, catalog.catalog(spark, args.data))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.fsa").load(path).select("path", "modificationTime", "content")


def _converted(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.to == "manifest":
        if not args.panels:
            raise reporting.stop("a manifest needs --panels")
        return manifests.genemapper(manifests.read_table(spark, args.input), manifests.panels_table(spark, args.panels).select("panel", "marker"), args.species).drop("unknown")
    raw = abif.assays(abif.channels(abif.read_abif(spark, args.input)))
    if args.to == "raw":
        return abif.trace_rows(raw)
    normal = uploads.signals.normalise(raw).join(raw.select("channel_id", "path"), "channel_id")
    return abif.trace_rows(normal, "baseline")


def _moved(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Alleles name their markers; numbers stand for them while bins move."""
    own = manifests.read_table(spark, args.alleles)
    old = manifests.bins_table(spark, args.bins)
    codes = sorted({r.marker for r in old.select("marker").collect()})  # as many as the document has

    def numbered() -> DataFrame:
        return spark.createDataFrame([(i, c, args.repeats) for i, c in enumerate(codes)], "marker_id int, marker string, repeats int")

    sized = own.select(F.col("MARKER").alias("marker"), F.col("SIZE").cast("double").alias("size")).join(numbered(), "marker")
    moved = bins.optimise_bins(sized.select("marker_id", "size"), old.join(numbered(), "marker").select("marker_id", "bin", "mean", "p25", "p75"), numbered(), args.rounds)
    return moved.join(numbered(), "marker_id").select("marker", "bin", "mean", "p25", "p75")


def _table(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.document:
        if args.name not in DOCUMENTS:
            raise reporting.stop(f"documents hold {', '.join(DOCUMENTS)}")
        return DOCUMENTS[args.name](spark, args.document)
    if not args.data:
        raise reporting.stop("either --document or --data is needed")
    own = spark.read.parquet(f"{args.data}/{args.name}.parquet")
    return tables.by_code(own, args.code) if args.code else own


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The tables that a command makes, by name; export writes its own."""
    if args.command == "analyze":
        return {args.report: REPORTS[args.report](_query(spark, args))}
    if args.command == "export":
        q = _query(spark, args)
        if args.out:
            q.export(f"{args.out}/{args.form}", args.form)
            return {}
        return {args.form: exports.FORMATS[args.form](q.filtered_frames, q.tables.samples, q.tables.markers, q.markers)}
    if args.command == "convert":
        return {args.to: _converted(spark, args)}
    if args.command == "upload":
        panels = manifests.panels_table(spark, args.panels)
        dyes = panels.select("panel", "dye", "marker").unionByName(panels.where("ladder is not null").select("panel", F.lit("LIZ").alias("dye"), F.lit("ladder").alias("marker")).distinct())
        done = uploads.upload(manifests.manifest(manifests.read_table(spark, args.manifest), args.panel), _files(spark, args.traces).select("path", "content"), dyes)
        return done._asdict()
    if args.command == "tables":
        return {args.name: _table(spark, args)}
    if args.command == "bins":
        return {"bins": _moved(spark, args)}
    known = queries.queries()
    if args.name not in known:
        raise reporting.stop(f"no query is named {args.name}")
    return {args.name: known[args.name](spark, args.data)}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    reporting.setup(args.verbose)
    spark = spark or SparkSession.builder.appName("traceloom").getOrCreate()
    made = run(spark, args)
    for name, df in made.items():
        if args.out:
            df.write.parquet(f"{args.out}/{name}")
            reporting.say("%s written", f"{args.out}/{name}")
        else:
            df.show(100, truncate=False)
    return 0
