"""Statistics of allele frames with a label: alleles, bins, heterozygosity, multiplicity of infection."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import views

_MARKER = ("label", "marker_id")


def allele_summary(frame: DataFrame, samples: bool = False) -> DataFrame:
    """(label, marker_id, value, n, freq, mean_height, mean_size, min_size, max_size, delta, unique_alleles, total_alleles) of each allele.

    With samples also sample_ids, a list as long as the allele is frequent.
    """
    more = [F.sort_array(F.collect_list("sample_id")).alias("sample_ids")] if samples else []
    own = frame.groupBy(*_MARKER, "value").agg(F.count("*").alias("n"), F.avg("height").alias("mean_height"), F.avg("size").alias("mean_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), *more)
    marker = Window.partitionBy(*_MARKER)
    return own.withColumn("delta", F.col("max_size") - F.col("min_size")).withColumn("unique_alleles", F.count("*").over(marker)).withColumn("total_alleles", F.sum("n").over(marker)).withColumn("freq", F.col("n") / F.col("total_alleles"))


def adjacency(summary: DataFrame) -> DataFrame:
    """Adds isolated: no other allele within 1 of it. The last allele of several always counts as isolated, as does a single one."""
    order = Window.partitionBy(*_MARKER).orderBy("value")
    before, after = F.col("value") - F.lag("value").over(order), F.lead("value").over(order) - F.col("value")
    return summary.withColumn("isolated", after.isNull() | ~((F.coalesce(before, F.lit(2)) <= 1) | (after <= 1)))


def bin_summary(frame: DataFrame) -> DataFrame:
    """(marker_id, bin, mean, p25, p75) of the sizes of each bin over all sets; exact percentiles, interpolated."""
    p = F.percentile("size", F.array(F.lit(0.25), F.lit(0.75)))
    own = frame.groupBy("marker_id", F.col("value").alias("bin")).agg(F.avg("size").alias("mean"), p.alias("p"))
    return own.select("marker_id", "bin", "mean", F.get("p", F.lit(0)).alias("p25"), F.get("p", F.lit(1)).alias("p75"))


def heterozygosity(frame: DataFrame, adjust: bool = True) -> DataFrame:
    """(label, marker_id, n, he): 1 less the sum of squared frequencies of dominant alleles, times n / (n - 1) if adjusted and n > 1."""
    counts = views.distribution(views.dominant(frame))
    sums = counts.groupBy(*_MARKER).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    n = F.col("n").cast("double")
    he = 1 - F.col("squares") / (n * n)
    return sums.select(*_MARKER, "n", (F.when(F.col("n") > 1, he * n / (n - 1)).otherwise(he) if adjust else he).alias("he"))


def infection_histogram(frame: DataFrame, what: str = "moi") -> DataFrame:
    """(label, moi or mloci, n): samples of each multiplicity."""
    return views.sample_multiplicity(frame).groupBy("label", what).agg(F.count("*").alias("n"))


def infection_stats(frame: DataFrame) -> DataFrame:
    """(label, mean, std, median, max, n, polyclonal) of the samples' multiplicity."""
    moi = F.col("moi")
    return views.sample_multiplicity(frame).groupBy("label").agg(F.avg(moi).alias("mean"), F.stddev_samp(moi).alias("std"), F.median(moi).alias("median"), F.max(moi).alias("max"), F.count("*").alias("n"), F.count_if(moi > 1).alias("polyclonal"))


def polyclonality(frame: DataFrame) -> DataFrame:
    """(label, marker_id, polyclonal, place, cumulative): samples with several alleles at each marker, markers by falling number.

    cumulative counts the samples that have several alleles at any marker up to this one: each sample enters at its first.
    """
    several = views.multiplicity(frame).withColumn("p", F.when(F.col("n") > 1, 1).otherwise(0))
    counts = several.groupBy(*_MARKER).agg(F.sum("p").alias("polyclonal"))
    counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.col("polyclonal").desc(), "marker_id")))
    first = several.where("p = 1").join(counts.select(*_MARKER, "place"), list(_MARKER)).groupBy("label", "sample_id").agg(F.min("place").alias("place"))
    entering = first.groupBy("label", "place").agg(F.count("*").alias("new"))
    run = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("label").orderBy("place"))
    return counts.join(entering, ["label", "place"], "left").select(*_MARKER, "polyclonal", "place", run.alias("cumulative"))


def genotype_groups(frame: DataFrame, markers: tuple[int, ...]) -> DataFrame:
    """(label, copies, genotypes): how many complete genotypes occur once, twice and so on in a set."""
    each = views.complete_genotypes(frame, markers).groupBy("label", "genotype").agg(F.count("*").alias("copies"))
    return each.groupBy("label", "copies").agg(F.count("*").alias("genotypes"))


def allele_correlation(left: DataFrame, right: DataFrame, marker_id: int) -> DataFrame:
    """(n, r): correlation of dominant values of one marker between two frames, by sample code."""
    own = lambda df, name: views.dominant(df.where(F.col("marker_id") == marker_id)).groupBy("code").agg(F.avg("value").alias(name))
    return own(left, "x").join(own(right, "y"), "code").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
