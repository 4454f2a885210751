"""Exports of allele frames as DataFrames of lines or columns, and the writer of one text file."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import views
from ..operators.joins import small


def _arrays(frame: DataFrame, markers: Sequence[int], what: str) -> DataFrame:
    return views.genotypes(frame, markers, what)


def tabulated(frame: DataFrame, samples: DataFrame, markers: Sequence[int], what: str = "value") -> DataFrame:
    """(label, sample, id, line, m<id>...): alleles of each sample below each other, one column a marker, by falling height.

    A sample has as many lines as the marker of most alleles; sample and id stand on the first, '' fills what is missing.
    """
    names = [f"m{m}" for m in markers]
    wide = _arrays(frame, markers, what).join(samples.select("sample_id", "code"), "sample_id")
    most = F.greatest(F.lit(1), *(F.coalesce(F.size(F.col(n)), F.lit(0)) for n in names))
    lines = wide.withColumn("line", F.explode(F.sequence(F.lit(0), most - 1)))
    first = lambda c: F.when(F.col("line") == 0, c.cast("string")).otherwise("")
    return lines.select("label", first(F.col("code")).alias("sample"), first(F.col("sample_id")).alias("id"), F.col("sample_id").alias("of"), "line", *(F.coalesce(F.get(F.col(n), F.col("line")).cast("string"), F.lit("")).alias(n) for n in names))


def tab(frame: DataFrame, samples: DataFrame, markers: Sequence[int]) -> DataFrame:
    return tabulated(frame, samples, markers)


def major_tab(frame: DataFrame, samples: DataFrame, markers: Sequence[int]) -> DataFrame:
    return tabulated(views.dominant(frame), samples, markers)


def major_r(frame: DataFrame, samples: DataFrame, markers: Sequence[int]) -> DataFrame:
    return major_tab(frame, samples, markers).withColumnRenamed("label", "group")


def allele_rows(frame: DataFrame, samples: DataFrame, markers: DataFrame) -> DataFrame:
    """LABEL, MARKER, SAMPLE, BIN, SIZE, HEIGHT, RATIO, RANK with codes instead of ids."""
    own = frame.join(small(markers.select("marker_id", F.col("code").alias("MARKER"))), "marker_id").join(samples.select("sample_id", F.col("code").alias("SAMPLE")), "sample_id")
    return own.select(F.col("label").alias("LABEL"), "MARKER", "SAMPLE", F.col("value").alias("BIN"), F.col("size").alias("SIZE"), F.col("height").alias("HEIGHT"), F.col("ratio").alias("RATIO"), F.col("rank").alias("RANK"))


def infection_rows(frame: DataFrame, samples: DataFrame) -> DataFrame:
    """LABEL, SAMPLE, MOI, MLOCI."""
    own = views.sample_multiplicity(frame).join(samples.select("sample_id", "code"), "sample_id")
    return own.select(F.col("label").alias("LABEL"), F.col("code").alias("SAMPLE"), F.col("moi").alias("MOI"), F.col("mloci").alias("MLOCI"))


def flat(frame: DataFrame, markers: Sequence[int]) -> DataFrame:
    """(label, sample_id, line): the sample and its complete genotype, with spaces."""
    own = views.complete_genotypes(frame, markers)
    return own.select("label", "sample_id", F.concat_ws(" ", F.col("sample_id").cast("string"), F.transform("genotype", lambda x: F.floor(x).cast("string"))).alias("line"))


def peak_rows(peaks: DataFrame, assays: DataFrame) -> DataFrame:
    """SAMPLE, FILENAME, DYE, RTIME, HEIGHT, SIZE, SCORE, ID of peaks; assays has (assay_id, sample, filename)."""
    own = peaks.join(assays.select("assay_id", "sample", "filename"), "assay_id")
    score = F.col("qscore") if "qscore" in peaks.columns else F.lit(-1.0)
    return own.select(F.col("sample").alias("SAMPLE"), F.col("filename").alias("FILENAME"), F.col("dye").alias("DYE"), F.col("rtime").alias("RTIME"), F.col("height").alias("HEIGHT"), F.col("size").alias("SIZE"), score.alias("SCORE"), F.xxhash64("channel_id", "rtime").alias("ID"))


def sized_peaks(peaks: DataFrame) -> DataFrame:
    """(size, rtime, height) of peaks that have a size: what a picture of an assay shows."""
    return peaks.where("size <> -1").select(*[c for c in ("assay_id", "channel_id", "dye") if c in peaks.columns], "size", "rtime", "height")


def demetics(frame: DataFrame, markers: DataFrame) -> DataFrame:
    """individual, population (from 0, by label), fragment_length, locus of each allele."""
    numbers = frame.select("label").distinct().withColumn("population", F.row_number().over(Window.orderBy("label")) - 1)  # one row a set
    own = frame.join(numbers, "label").join(small(markers.select("marker_id", F.col("code").alias("locus"))), "marker_id")
    return own.select(F.col("sample_id").alias("individual"), "population", F.col("value").alias("fragment_length"), "locus")


def arlequin(frame: DataFrame, markers: Sequence[int], recode: bool = False) -> DataFrame:
    """(label, place, line): the lines of a project's data, in order; recode makes alleles private by the set's number before them.

    place orders the head of a set, its samples by id, and its end. Sets without complete genotypes have no lines.
    """
    own = views.complete_genotypes(frame, markers)
    sets = own.groupBy("label").agg(F.count("*").alias("n")).withColumn("no", F.row_number().over(Window.orderBy("label")) - 1)  # one row a set
    allele: Callable[[Column], Column] = lambda x: F.lpad(F.floor(x).cast("string"), 3, "0")
    numbered = own.join(sets, "label")
    text = F.transform("genotype", lambda x: F.concat(F.lpad(F.col("no").cast("string"), 2, "0"), allele(x)) if recode else allele(x))
    samples = numbered.select("label", (F.col("sample_id") + 1).alias("place"), F.concat(F.lit("    "), F.col("sample_id").cast("string"), F.lit(" 1 "), F.array_join(text, " ")).alias("line"))
    head = sets.select("label", F.lit(-1).cast("long").alias("place"), F.concat(F.lit('    SampleName="'), "label", F.lit('"\n    SampleSize='), F.col("n").cast("string"), F.lit("\n    SampleData={")).alias("line"))
    tail = sets.select("label", F.lit((1 << 63) - 1).alias("place"), F.lit("    }").alias("line"))
    return head.unionByName(samples).unionByName(tail)


def arlequin_head(title: str, n: int) -> list[str]:
    """The lines before the data of a project of n sets."""
    settings = {"Title": f'"{title}"', "NbSamples": n, "DataType": "MICROSAT", "GenotypicData": 0, "GameticPhase": 0, "MissingData": '"?"', "LocusSeparator": "WHITESPACE"}
    return ["[Profile]", *(f"  {k}={v}" for k, v in settings.items()), "", "[Data]", "  [[Samples]]"]


#: Exports by name: (frame, samples, markers table, marker ids).
FORMATS: dict[str, Callable[[DataFrame, DataFrame, DataFrame, Sequence[int]], DataFrame]] = {
    "tab": lambda f, s, m, ids: tab(f, s, ids),
    "major_tab": lambda f, s, m, ids: major_tab(f, s, ids),
    "major_r": lambda f, s, m, ids: major_r(f, s, ids),
    "alleledf": lambda f, s, m, ids: allele_rows(f, s, m),
    "moidf": lambda f, s, m, ids: infection_rows(f, s),
    "arlequin": lambda f, s, m, ids: arlequin(f, ids),
    "demetics": lambda f, s, m, ids: demetics(f, m),
    "flat": lambda f, s, m, ids: flat(f, ids),
}


def export(frame: DataFrame, samples: DataFrame, markers: DataFrame, ids: Sequence[int], path: str, form: str = "major_tab", sep: str = "\t") -> None:
    """Writes an export as a folder of delimited files with headers, or of lines where the format has them."""
    if form not in FORMATS:
        raise KeyError(f"no export named {form}")
    out = FORMATS[form](frame, samples, markers, ids)
    if form == "arlequin":
        out.orderBy("label", "place").select("line").write.text(path)
    elif form == "flat":
        out.select("line").write.text(path)
    else:
        out.write.option("header", True).option("sep", sep).csv(path)
