"""Views of an allele frame, one row a fact; pivots only at the edge, over a given list of markers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import CELL


def _label(frame: DataFrame) -> list[str]:
    return ["label"] if "label" in frame.columns else []


def dominant(frame: DataFrame) -> DataFrame:
    """Rows of the greatest height of their cell; ties stay."""
    return frame.withColumn("_top", F.max("height").over(Window.partitionBy(*CELL))).where("height = _top").drop("_top")


def distribution(frame: DataFrame) -> DataFrame:
    return frame.groupBy(*_label(frame), "marker_id", "value").agg(F.count("*").alias("n"))


def multiplicity(frame: DataFrame) -> DataFrame:
    """(label, sample_id, marker_id, n): alleles of each cell that has any."""
    return frame.groupBy(*_label(frame), *CELL).agg(F.count("*").alias("n"))


def pivoted(cells: DataFrame, markers: Sequence[int], value: Column, fill: int | None = None) -> DataFrame:
    """One row a sample, one column m<id> a marker; the list of markers is given, so no job looks for it."""
    out = cells.groupBy(*_label(cells), "sample_id").pivot("marker_id", list(markers)).agg(value)
    out = out.select(*_label(cells), "sample_id", *(F.col(str(m)).alias(f"m{m}") for m in markers))
    return out if fill is None else out.na.fill(fill, [f"m{m}" for m in markers])


def genotypes(frame: DataFrame, markers: Sequence[int], what: str = "value") -> DataFrame:
    """Alleles of each cell in the order of their ranks, as arrays in a column a marker; null where a cell is empty."""
    listed = F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("h"), F.col("allele_id").alias("a"), F.col("size").alias("s"), F.col(what).alias("x"))))
    return pivoted(frame, markers, F.transform(listed, lambda s: s["x"]))


def multilocus(frame: DataFrame) -> DataFrame:
    """(label, sample_id, marker_id, value): the value of the dominant allele, the mean of several."""
    top = dominant(frame)
    return top.groupBy(*_label(frame), *CELL).agg(F.avg("value").alias("value"))


def complete_genotypes(frame: DataFrame, markers: Sequence[int]) -> DataFrame:
    """(label, sample_id, genotype): the dominant values in the order of markers, of samples that lack none."""
    own = multilocus(frame).where(F.col("marker_id").isin(*markers))
    cells = own.groupBy(*_label(frame), "sample_id").agg(F.collect_list(F.struct("marker_id", "value")).alias("g"), F.count("*").alias("n")).where(F.col("n") == len(set(markers)))
    by_marker = F.map_from_entries("g")
    return cells.select(*_label(frame), "sample_id", F.array(*(F.element_at(by_marker, F.lit(m)) for m in markers)).alias("genotype"))


def unique_genotypes(genotypes_: DataFrame) -> DataFrame:
    """The sample of least id for each different genotype of a set."""
    keys = [c for c in ("label",) if c in genotypes_.columns] + ["genotype"]
    return genotypes_.groupBy(*keys).agg(F.min("sample_id").alias("sample_id")).select(*genotypes_.columns)


def sample_multiplicity(frame: DataFrame) -> DataFrame:
    """(label, sample_id, moi, mloci): the most alleles at any marker, and markers with several."""
    return multiplicity(frame).groupBy(*_label(frame), "sample_id").agg(F.max("n").alias("moi"), F.count_if(F.col("n") > 1).alias("mloci"))


def locus_multiplicity(frame: DataFrame) -> DataFrame:
    return multiplicity(frame).withColumn("several", F.when(F.col("n") > 1, 1).otherwise(0)).drop("n")


def sample_markers(frame: DataFrame) -> DataFrame:
    return frame.groupBy(*_label(frame), "sample_id").agg(F.sort_array(F.collect_set("marker_id")).alias("markers"))
