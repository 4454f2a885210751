"""Quality of samples and markers, and the filters that follow from it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import views


def sample_quality(frame: DataFrame, n_markers: int, threshold: float) -> DataFrame:
    """(label, sample_id, genotyped): samples with alleles at threshold of all markers or more; one without any is never among them."""
    counted = frame.groupBy("label", "sample_id").agg(F.countDistinct("marker_id").alias("genotyped"))
    return counted.where(F.col("genotyped") >= n_markers * threshold)


def filtered_samples(frame: DataFrame, markers: Sequence[int], threshold: float, mode: str = "N") -> DataFrame:
    """(label, sample_id) of good samples: all (N), of one allele everywhere (M), of several at one marker at most (S), or the first of each complete genotype (U)."""
    good = sample_quality(frame, len(markers), threshold).select("label", "sample_id")
    mode = mode.upper()
    if mode == "N":
        return good
    if mode == "U":
        also = views.unique_genotypes(views.complete_genotypes(frame, markers))
    else:
        also = views.sample_multiplicity(frame).where("moi = 1" if mode == "M" else "mloci <= 1")
    return good.join(also.select("label", "sample_id"), ["label", "sample_id"], "left_semi")


def genotyped_samples(frame: DataFrame, totals: DataFrame, markers: Sequence[int]) -> DataFrame:
    """(label, marker_id, genotyped): samples with an allele, 0 where a set has none."""
    counted = frame.groupBy("label", "marker_id").agg(F.countDistinct("sample_id").alias("genotyped"))
    grid = totals.select("label", F.explode(F.array(*map(F.lit, markers))).alias("marker_id"))
    return grid.join(counted, ["label", "marker_id"], "left").withColumn("genotyped", F.coalesce("genotyped", F.lit(0)).cast("long"))


def set_marker_quality(frame: DataFrame, totals: DataFrame, markers: Sequence[int], threshold: float) -> DataFrame:
    """(label, marker_id, genotyped, passed): a marker passes in a set at threshold of its n samples or more."""
    counted = genotyped_samples(frame, totals, markers)
    return counted.join(totals, "label").select("label", "marker_id", "genotyped", (F.col("genotyped") >= F.col("n") * threshold).alias("passed"))


def marker_quality(frame: DataFrame, totals: DataFrame, threshold: float) -> DataFrame:
    """(marker_id, genotyped): markers above threshold of all samples, so that one without any allele never passes.

    Samples are counted in each set first; sets are disjoint, so the counts add up.
    """
    counted = frame.groupBy("label", "marker_id").agg(F.countDistinct("sample_id").alias("g")).groupBy("marker_id").agg(F.sum("g").alias("genotyped"))
    whole = totals.agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    both = counted.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")  # one row
    return both.where(F.col("genotyped") > F.col("total") * threshold).select("marker_id", "genotyped")


def with_good_samples(frame: DataFrame, n_markers: int, threshold: float) -> DataFrame:
    """Rows of samples that sample_quality passes, by a window over each sample: a frame that is dealt by sample needs no exchange for it."""
    seen = F.size(F.collect_set("marker_id").over(Window.partitionBy("sample_id")))
    return frame.withColumn("_n", seen).where(F.col("_n") >= n_markers * threshold).drop("_n")


def good_markers(frame: DataFrame, threshold: float) -> DataFrame:
    """(marker_id, genotyped): markers above threshold of all samples that the frame has, counted with those in one pass."""
    counted = frame.rollup("marker_id").agg(F.countDistinct("sample_id").alias("genotyped"), F.grouping_id().alias("_level"))
    total = F.max(F.when(F.col("_level") == 1, F.col("genotyped"))).over(Window.partitionBy())  # one row a marker
    return counted.withColumn("_total", total).where((F.col("_level") == 0) & (F.col("genotyped") > F.col("_total") * threshold)).select("marker_id", "genotyped")


def sample_summary(initial: DataFrame, filtered: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """(label, initial, filtered, complete): sizes of sets before and after filtering, and samples with complete genotypes."""
    parts = [("initial", initial), ("filtered", filtered), *([("complete", complete)] if complete is not None else [])]
    rows = [df.select("label", *(F.lit(1 if name == own else 0).alias(name) for name, _ in parts)) for own, df in parts]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionByName(r)
    return union.groupBy("label").agg(*(F.sum(name).alias(name) for name, _ in parts))
