"""Trace files into stored assays and channels: manifests checked against panels, and a cache of normalised channels."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as signals
from ..signals.trace import FILE_SMOOTHING, Smoothing
from . import abif, manifests


class Upload(NamedTuple):
    """assays (assay_id, sample, filename, path, panel, excluded, started), one for each file and panel; their channels with
    marker and status; problems (sample, filename, panel, problem) of rows that have no assay."""

    assays: DataFrame
    channels: DataFrame
    problems: DataFrame


def _name(path: str) -> F.Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def upload(manifest: DataFrame, files: DataFrame, panels: DataFrame) -> Upload:
    """Assays of a manifest (sample, filename, panel, excluded) whose files (path, content) are at hand and readable.

    A row goes to problems if its file is missing or damaged, its panel unknown, or a marker it excludes is not of the panel.
    Panels are (panel, dye, marker), the ladder's dye with the marker ladder. Files are read once, names are compared without
    their folders; a manifest that names a file twice in one panel gives that assay once.
    """
    sound = abif.readable(files)
    known = sound.select("path", "problem", _name("path").alias("filename"))
    rows = manifest.select("sample", "filename", "panel", "excluded").dropDuplicates(["filename", "panel"]).join(known, "filename", "left")
    of_panels = panels.select("panel").distinct().withColumn("_known", F.lit(True))
    wrong = manifests.unknown_excludes(manifest, panels).groupBy("filename", "panel").agg(F.array_join(F.array_sort(F.collect_set("marker")), ",").alias("_wrong"))
    rows = rows.join(of_panels, "panel", "left").join(wrong, ["filename", "panel"], "left")
    problem = F.when(F.col("path").isNull(), "no such file").when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_known").isNull(), "unknown panel").when(F.col("_wrong").isNotNull(), F.concat(F.lit("excludes what the panel lacks: "), "_wrong"))
    rows = rows.withColumn("problem", problem)
    tags = abif.parse_files(files.join(sound.where("problem is null").select("path"), "path", "left_semi"))
    good = rows.where("problem is null").join(abif.run_starts(tags), "path", "left")
    assays = good.select(F.xxhash64("path", "panel").alias("assay_id"), "sample", "filename", "path", "panel", "excluded", "started")
    raw = assays.select("assay_id", "path", "panel", "excluded").join(abif.channels(tags), "path").withColumn("channel_id", F.xxhash64("assay_id", "channel"))
    given = signals.assign_channels(raw, panels)
    out = F.array_contains("excluded", F.lower("marker"))
    status = F.when((F.col("status") == "assigned") & out, "unassigned").otherwise(F.col("status"))
    return Upload(assays, given.withColumn("status", status).select("channel_id", "assay_id", "dye", "wavelength", "marker", "status", "raw"), rows.where("problem is not null").select("sample", "filename", "panel", "problem"))


def cached_channels(spark: SparkSession, files: DataFrame, cache: str, how: Smoothing = FILE_SMOOTHING) -> DataFrame:
    """(path, modificationTime, channel, dye, wavelength, data, baseline) of all files (path, modificationTime, content).

    Normalised channels are kept as a table in `cache`. Only files that it does not hold as new as they are get parsed; what
    they give is appended, and of each file the newest entry counts.
    """
    try:
        held = spark.read.parquet(cache)
        news = abif.fresh(files, held)
    except Exception as e:  # there is no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        news = files
    own = abif.channels(abif.parse_files(news)).withColumns({"channel_id": F.col("channel").cast("long"), "assay_id": F.xxhash64("path")})
    normal = signals.normalise(own, how).join(own.select("assay_id", "channel_id", "path", "channel", "wavelength"), ["assay_id", "channel_id"])
    normal.join(news.select("path", "modificationTime"), "path").select("path", "modificationTime", "channel", "dye", "wavelength", "data", "baseline").write.mode("append").parquet(cache)
    held = spark.read.parquet(cache)
    newest = held.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))
    return held.join(newest, ["path", "modificationTime"]).join(files.select("path"), "path", "left_semi")
