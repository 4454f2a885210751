"""Delimited and structured text that describes files, samples, markers, panels and bins."""
from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import options_map


def sniff(text: str) -> tuple[str, str]:
    """(text with line feeds, delimiter): a comma if commas outnumber tabs and lines, else a tab."""
    lines, returns = text.count("\n"), text.count("\r")
    if not lines and returns:
        text, lines = text.replace("\r", "\n"), returns
    elif returns > lines:
        raise ValueError("more carriage returns than line feeds")
    return text, "," if text.count(",") > max(text.count("\t"), lines) else "\t"


def _head(spark: SparkSession, path: str, size: int = 1 << 20) -> str:
    rows = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("c")).limit(1).collect()
    return bytes(rows[0].c).decode("utf-8", "replace") if rows else ""


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with a header, as strings; the delimiter is found from its first megabyte where it is not given."""
    sep = sep or sniff(_head(spark, path))[1]
    return spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def manifest(rows: DataFrame, panel: str | None = None) -> DataFrame:
    """(sample, filename, panel, options map, excluded array) of a table with FILENAME and maybe SAMPLE, PANEL, OPTIONS.

    Rows whose file name starts with '#' are left out; one row a panel of a list with commas; a missing sample is the row's
    number in the file.
    """
    names = {c.upper(): c for c in rows.columns}
    if "FILENAME" not in names:
        raise ValueError("the manifest lacks FILENAME")
    col = lambda name: F.col(f"`{names[name]}`") if name in names else F.lit(None).cast("string")
    own = rows.withColumn("_at", F.monotonically_increasing_id()).where(~col("FILENAME").startswith("#"))
    if "SAMPLE" in names:
        own = own.withColumn("_n", F.lit(0))
    else:  # one file's rows, as many as a person lists
        own = own.withColumn("_n", F.row_number().over(Window.orderBy("_at")))
    options = options_map(col("OPTIONS"))
    out = own.select(
        F.coalesce(col("SAMPLE"), F.col("_n").cast("string")).alias("sample"), F.trim(col("FILENAME")).alias("filename"),
        F.explode(F.split(F.coalesce(col("PANEL"), F.lit(panel or "undefined")), ",")).alias("panel"), options.alias("options"),
    )
    excluded = F.when(F.map_contains_key("options", "exclude"), F.transform(F.split(F.lower(F.element_at("options", "exclude")), ","), lambda p: F.trim(p)))
    return out.withColumn("panel", F.trim("panel")).withColumn("excluded", F.coalesce(excluded, F.array().cast("array<string>")))


def unknown_excludes(manifest_: DataFrame, panels: DataFrame) -> DataFrame:
    """(sample, filename, panel, marker): excluded markers that the panel (panel, marker) does not have."""
    named = manifest_.select("sample", "filename", "panel", F.explode("excluded").alias("marker"))
    return named.join(panels.select("panel", F.lower("marker").alias("marker")), ["panel", "marker"], "left_anti").select("sample", "filename", "panel", "marker")


def repeated_files(manifest_: DataFrame) -> DataFrame:
    return manifest_.groupBy("filename").agg(F.count("*").alias("n")).where("n > 1")


def genemapper(rows: DataFrame, panels: DataFrame, species: str | None = None) -> DataFrame:
    """(sample, assay, panel, options, unknown): one row for each sample, file and panel of an export with one row a marker.

    options excludes the markers of the panel (panel, marker) that the file lacks; unknown lists those that the panel lacks,
    which is an error. Comparison is without case.
    """
    marker = F.upper(F.when(F.col("Marker").contains("/") | F.lit(species is None), F.col("Marker")).otherwise(F.concat(F.lit(f"{species}/"), F.col("Marker"))))
    have = rows.groupBy(F.col("`Sample Name`").alias("sample"), F.col("`Sample File`").alias("assay"), F.col("Panel").alias("panel")).agg(F.collect_set(marker).alias("have"))
    want = panels.groupBy("panel").agg(F.collect_set(F.upper("marker")).alias("want"))
    both = have.join(want, "panel", "left").withColumn("want", F.coalesce("want", F.array().cast("array<string>")))
    lacking = F.array_sort(F.array_except("want", "have"))
    return both.select("sample", "assay", "panel", F.when(F.size(lacking) > 0, F.concat(F.lit("exclude="), F.array_join(lacking, ","))).otherwise("").alias("options"), F.array_sort(F.array_except("have", "want")).alias("unknown"))


def mixed_runs(rows: DataFrame) -> DataFrame:
    """(assay, runs): files that an export gives several runs, which is an error."""
    return rows.groupBy(F.col("`Sample File`").alias("assay")).agg(F.countDistinct("`Run Name`").alias("runs")).where("runs > 1")


def load_document(source: str | dict | list) -> Any:
    """A JSON or YAML text, a path to one, or a value that is loaded already. YAML needs its library."""
    if not isinstance(source, str):
        return source
    text = Path(source).read_text() if "\n" not in source and len(source) < 4096 and Path(source).is_file() else source
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        raise ValueError("not JSON, and no YAML library is installed") from None
    return yaml.safe_load(text)


def markers_table(spark: SparkSession, source: str | dict) -> DataFrame:
    """(code, species, min_size, max_size, repeats, related_to, bins_range) from a map of markers; each key must be its marker's code."""
    rows = []
    for key, m in load_document(source).items():
        code = m.get("code", key)
        if code != key:
            raise ValueError(f"marker {key} has the code {code}")
        species, _, name = code.rpartition("/")
        rows.append((name, m.get("species", species or "x"), m.get("min_size", 0), m.get("max_size", 0), m.get("repeats", 1), m.get("related_to"), m.get("bins_range")))
    return spark.createDataFrame(rows, "code string, species string, min_size int, max_size int, repeats int, related_to string, bins_range array<int>")


def panels_table(spark: SparkSession, source: str | dict) -> DataFrame:
    """(panel, ladder, marker, dye, filter) from a map of panels, one row a marker."""
    rows = []
    for key, p in load_document(source).items():
        data = p.get("data", {})
        rows += [(p.get("code", key), data.get("ladder") or None, marker, m.get("dye"), m.get("filter")) for marker, m in (data.get("markers") or {}).items()]
    return spark.createDataFrame(rows, "panel string, ladder string, marker string, dye string, filter string")


def panels_document(panels: DataFrame) -> DataFrame:
    """(panel, document): each panel as JSON of the form that panels_table reads."""
    markers = F.map_from_entries(F.array_sort(F.collect_list(F.struct("marker", F.struct("dye", "filter")))))
    own = panels.groupBy("panel").agg(F.max("ladder").alias("ladder"), markers.alias("markers"))
    return own.select("panel", F.to_json(F.struct(F.col("panel").alias("code"), F.struct("ladder", "markers").alias("data"))).alias("document"))


def unknown_markers(panels: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers of panels, with or without their species, that the markers table lacks."""
    known = markers.select(F.lower(F.concat_ws("/", "species", "code")).alias("name")).unionByName(markers.select(F.lower("code").alias("name"))).distinct()
    return panels.select("panel", "marker", F.lower("marker").alias("name")).join(known, "name", "left_anti").select("panel", "marker")


def bins_table(spark: SparkSession, source: str | dict) -> DataFrame:
    """(marker, bin, mean, p25, p75) from a map of markers with lists of such bins."""
    rows = [(key, int(b[0]), *map(float, b[1:4])) for key, m in load_document(source).items() for b in m["bins"]]
    return spark.createDataFrame(rows, "marker string, bin int, mean double, p25 double, p75 double")


def samples_table(spark: SparkSession, source: str | dict) -> DataFrame:
    """(code, type, altcode, category, remark) from a document with a map of samples, in the order of codes where it has them."""
    doc = load_document(source)
    samples = doc["samples"]
    rows = [(c, s.get("type"), s.get("altcode"), s.get("category", 0), s.get("remark")) for c, s in ((c, samples[c]) for c in doc.get("codes", list(samples)))]
    return spark.createDataFrame(rows, "code string, type string, altcode string, category int, remark string")
