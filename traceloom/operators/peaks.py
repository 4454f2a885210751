"""Relational operators over peaks (channel_id, rtime, height, ...) of many channels at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNEL = ("channel_id",)


def local_maxima(trace: DataFrame, min_height: float = 0.0, min_rtime: int = -1, max_rtime: int | None = None) -> DataFrame:
    """(channel_id, rtime, height) of an exploded trace (channel_id, rtime, rfu) that rise before and do not rise after."""
    order = Window.partitionBy(*CHANNEL).orderBy("rtime")
    near = trace.withColumn("_a", F.lag("rfu").over(order)).withColumn("_b", F.lead("rfu").over(order))
    kept = near.where((F.col("_a") < F.col("rfu")) & (F.col("rfu") >= F.col("_b")) & (F.col("rfu") > min_height) & (F.col("rtime") > min_rtime))
    if max_rtime is not None:
        kept = kept.where(F.col("rtime") < max_rtime)
    return kept.select(*CHANNEL, "rtime", F.col("rfu").alias("height"))


def strongest(peaks: DataFrame, k: int, *then: Column) -> DataFrame:
    """The k highest peaks of each channel; equal heights go by then, then by rtime."""
    order = Window.partitionBy(*CHANNEL).orderBy(F.col("height").desc(), *then, F.col("rtime"))
    return peaks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def shape_metrics(peaks: DataFrame) -> DataFrame:
    """Adds wrtime, beta = area / height, theta = height / width, omega = area / width."""
    width = F.col("ertime") - F.col("brtime")
    wide = F.nullif(width, F.lit(0)).cast("double")
    return peaks.withColumn("wrtime", width).withColumn("beta", F.col("area") / F.col("height")).withColumn("theta", F.col("height") / wide).withColumn("omega", F.col("area") / wide)


def without_artefacts(peaks: DataFrame, gap: int = 5, ratio: float = 0.8) -> DataFrame:
    """Drops peaks that begin or end within gap of a neighbour and are lower than ratio times it."""
    order = Window.partitionBy(*CHANNEL).orderBy("rtime")
    before, after = F.lag(F.struct("height", "ertime")).over(order), F.lead(F.struct("height", "brtime")).over(order)
    near = peaks.withColumn("_p", before).withColumn("_n", after)
    left = (F.col("brtime") - F.col("_p.ertime") < gap) & (F.col("height") < ratio * F.col("_p.height"))
    right = (F.col("_n.brtime") - F.col("ertime") < gap) & (F.col("height") < ratio * F.col("_n.height"))
    return near.where(~(F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))).drop("_p", "_n")


def filtered(peaks: DataFrame, most: int, min_ratio: float = 0.0, max_ratio: float = 0.0, min_height_ratio: float = 0.0, artefact_ratio: float = 0.8) -> DataFrame:
    """Measured raw peaks to good ones: the 2 * most highest; within ratios to the channel's median and maximum; wide and strong enough; no artefacts; the most highest."""
    out = strongest(peaks, 2 * most)
    channel = Window.partitionBy(*CHANNEL)
    if min_ratio > 0 or max_ratio > 0:
        out = out.withColumn("_m", F.median("height").over(channel))
        out = out.where((F.col("height") > F.col("_m") * min_ratio) & ((F.col("height") < F.col("_m") * max_ratio) if max_ratio > 0 else F.lit(True))).drop("_m")
    if min_height_ratio > 0:
        out = out.withColumn("_m", F.max("height").over(channel)).where(F.col("height") > F.col("_m") * min_height_ratio).drop("_m")
    strength = F.col("beta") * F.col("theta")
    out = shape_metrics(out).where((F.col("wrtime") >= 3) & (strength >= F.when(F.col("height") >= 25, 6).otherwise(3)))
    return strongest(without_artefacts(out, ratio=artefact_ratio), most, strength.desc())


def noise_level(peaks: DataFrame) -> DataFrame:
    """Adds noise_level: mean of beta * theta of the channel's peaks without the two least and greatest, or of all if none is left."""
    channel = Window.partitionBy(*CHANNEL)
    strength = F.col("beta") * F.col("theta")
    placed = peaks.withColumn("_n", F.row_number().over(channel.orderBy(strength, "rtime"))).withColumn("_k", F.count("*").over(channel))
    inner = (F.col("_n") > 2) & (F.col("_n") <= F.col("_k") - 2)
    mean = F.avg(F.when(inner | (F.col("_k") <= 4), strength)).over(channel)
    return placed.withColumn("noise_level", mean).drop("_n", "_k")


def score_peaks(peaks: DataFrame, max_beta: float = 15.0) -> DataFrame:
    """Adds type and qscore from the shape of each peak of a channel that is not a ladder.

    peaks hold beta, theta, wrtime, srtime, baseline (the channel's median) and edge (the greater of the trace's values at
    begin and end). Low, thin, or weak peaks with high edges are noise at 0.25. From 1, breadth or slimness and flatness cost
    0.2 each, small height 0.1 twice, asymmetry 0.1; below 0.5 a peak that is not broad is noise.
    """
    own = noise_level(peaks)
    strength = F.col("beta") * F.col("theta")
    noise = (F.col("height") < 2 * F.col("baseline")) | (F.col("wrtime") < 6) | ((F.col("wrtime") < 10) & (strength < 0.275 * F.col("noise_level"))) | ((strength < 0.33 * F.col("noise_level")) & (F.col("edge") > 0.5 * F.col("height")))
    cost = lambda c, x: F.when(c, F.lit(x)).otherwise(0.0)
    broad = F.col("beta") > max_beta
    score = 1.0 - cost(broad | (F.col("beta") < 5), 0.2) - cost(F.col("theta") < 4, 0.2) - cost(F.col("height") < 75, 0.1) - cost(F.col("height") < 50, 0.1) - cost(F.abs("srtime") >= 1.32, 0.1)
    score = F.greatest(F.round(score, 6), F.lit(0.0))
    kind = F.when(noise, "noise").when(broad, "broad").when(score < 0.5, "noise").otherwise("scanned")
    return own.withColumn("type", kind).withColumn("qscore", F.when(noise, 0.25).otherwise(score))


def time_stutter(peaks: DataFrame, within: int = 10, ratio: float = 0.5) -> DataFrame:
    """Peaks with a neighbour in time closer than within and higher than height / ratio become stutter; each such neighbour costs 0.2."""
    order = Window.partitionBy(*CHANNEL).orderBy("rtime")
    before, after = F.lag(F.struct("height", "rtime")).over(order), F.lead(F.struct("height", "rtime")).over(order)
    near = peaks.withColumn("_a", before).withColumn("_b", after)
    left = (F.col("rtime") - F.col("_a.rtime") < within) & (F.col("_a.height") * ratio > F.col("height"))
    right = (F.col("_b.rtime") - F.col("rtime") < within) & (F.col("_b.height") * ratio > F.col("height"))
    n = F.coalesce(left.cast("int"), F.lit(0)) + F.coalesce(right.cast("int"), F.lit(0))
    return near.withColumn("_n", n).withColumn("type", F.when(F.col("_n") > 0, "stutter").otherwise(F.col("type"))).withColumn("qscore", F.col("qscore") - F.lit(0.2) * F.col("_n")).drop("_a", "_b", "_n")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def overlap_ratio(data: Column, other: Column, rtime: Column, begin: Column, end: Column) -> Column:
    """struct(state, ratio, symmetry): mean ratios to the other trace left and right of a peak's top, if it is below it throughout.

    begin, rtime and end count from 0. state is false where the peak is above the other trace at any point; ratio and symmetry
    are then 0.
    """
    left, right = (F.zip_with(F.slice(data, a + 1, b - a + 1), F.slice(other, a + 1, b - a + 1), lambda x, y: F.struct(x.alias("x"), y.alias("y"))) for a, b in ((begin, rtime), (rtime, end)))
    under = F.forall(left, lambda p: p["x"] <= p["y"]) & F.forall(right, lambda p: p["x"] <= p["y"])
    mean = lambda side: _fold(F.transform(side, lambda p: p["x"] / p["y"])) / F.size(side)
    l, r = mean(left), mean(right)
    return F.when(under, F.struct(F.lit(True).alias("state"), ((l + r) / 2).alias("ratio"), F.log2(r / l).alias("symmetry"))).otherwise(F.struct(F.lit(False).alias("state"), F.lit(0.0).alias("ratio"), F.lit(0.0).alias("symmetry")))


def mark_overlaps(peaks: DataFrame, channels: DataFrame, height_threshold: float = 0.75) -> DataFrame:
    """Peaks that are overlap of another dye of their assay: type overlap, and 0.1 less for each such dye.

    peaks: channel_id, rtime, brtime, ertime, height, type, qscore; channels: channel_id, assay_id, dye, data array. An assay
    has five channels, so a peak meets four others.
    """
    me = channels.select("channel_id", "assay_id", F.col("data").alias("_mine"))
    other = channels.select("assay_id", F.col("channel_id").alias("_other"), F.col("data").alias("_data"))
    width = F.col("ertime") - F.col("brtime")
    trim = F.when(width < 3, 0).when(width < 6, 1).otherwise(3)
    cross = peaks.where("type <> 'noise'").join(me, "channel_id").join(other, "assay_id").where("_other <> channel_id")
    cross = cross.withColumn("_b", F.greatest(F.lit(0), F.least(F.col("brtime") + trim, F.col("rtime")))).withColumn("_e", F.least(F.greatest(F.col("ertime") - trim, F.col("rtime")), F.least(F.size("_mine"), F.size("_data")) - 1))
    at = lambda name, place: F.get(F.col(name), F.col(place).cast("int"))
    cross = cross.where((at("_mine", "_b") < at("_data", "_b")) & (at("_mine", "_e") < at("_data", "_e")) & (F.col("height") < at("_data", "rtime")))
    cross = cross.withColumn("_rel", F.col("height") / at("_data", "rtime")).withColumn("_o", overlap_ratio(F.col("_mine"), F.col("_data"), F.col("rtime"), F.col("_b"), F.col("_e")))
    sym, ratio, rel = F.abs("_o.symmetry"), F.col("_o.ratio"), F.col("_rel")
    hit = F.col("_o.state") & ((rel < 0.15) | ((rel < height_threshold) & (sym < 0.5)) | ((ratio < 0.25) & (sym < 1.5)) | ((ratio < 0.75) & (sym < 0.5)))
    found = cross.where(hit).groupBy("channel_id", "rtime").agg(F.count("*").alias("_n"))
    out = peaks.join(found, ["channel_id", "rtime"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return out.withColumn("type", F.when(F.col("_n") > 0, "overlap").otherwise(F.col("type"))).withColumn("qscore", F.col("qscore") - F.lit(0.1) * F.col("_n")).drop("_n")


def mark_stutter(peaks: DataFrame, reach: float = 3.5, ratio: float = 0.95, max_beta: float = 15.0, by: tuple[str, ...] = CHANNEL) -> DataFrame:
    """Binned peaks to broad (beta above max_beta) or stutter of a higher peak that is not broad, itself stutter or not.

    Stutter: closer than reach and lower than ratio times it, closer than reach / 2 + 1, or of the same bin.
    """
    binned = peaks.where("type = 'bin'").withColumn("type", F.when(F.col("beta") > max_beta, "broad").otherwise("bin"))
    order = Window.partitionBy(*by).orderBy(F.col("height").desc(), "rtime").rowsBetween(Window.unboundedPreceding, -1)
    history = F.collect_list(F.when(F.col("type") == "bin", F.struct("size", "height", "bin"))).over(order)
    near = lambda d: F.abs(d["size"] - F.col("size"))
    rule = F.exists("_h", lambda d: ((near(d) < reach) & (F.col("height") / d["height"] < ratio)) | (near(d) < reach / 2 + 1) | (d["bin"] == F.col("bin")))
    done = binned.withColumn("_h", history).withColumn("type", F.when((F.col("type") == "bin") & rule, "stutter").otherwise(F.col("type"))).drop("_h")
    return done.unionByName(peaks.where("type <> 'bin' or type is null"))


def set_types(peaks: DataFrame, to: str, markers: list[int] | None = None, bins: list[int] | None = None, source: str | None = None) -> DataFrame:
    """Peaks of these markers, bins and of that type get the type `to`."""
    hit = F.lit(True)
    if markers is not None:
        hit = hit & F.col("marker_id").isin(*markers)
    if bins is not None:
        hit = hit & F.col("bin").isin(*bins)
    if source is not None:
        hit = hit & (F.col("type") == source)
    return peaks.withColumn("type", F.when(hit, to).otherwise(F.col("type")))
