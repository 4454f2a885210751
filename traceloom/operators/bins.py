"""Bins: creation, lookup, and the nearest bin of a size."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import small

#: Bins of all markers that are brought to the driver between rounds, at most.
MOST_BINS = 200_000


def initial_bins(markers: DataFrame) -> DataFrame:
    """(marker_id, bin, mean, p25, p75) from start (inclusive) to stop (exclusive) in steps of repeats, one base either way."""
    own = markers.select("marker_id", F.explode(F.sequence("start", F.col("stop") - 1, "repeats")).alias("bin"))
    s = F.col("bin").cast("double")
    return own.select("marker_id", "bin", s.alias("mean"), (s - 1).alias("p25"), (s + 1).alias("p75"))


def anchored_bins(markers: DataFrame) -> DataFrame:
    """Bins in the phase of anchor, from one repeat below the step of min_size and below max_size, half a base either way; all but bin move by shift."""
    first = (F.floor(F.col("min_size") / F.col("repeats")) - 1) * F.col("repeats") + F.pmod("anchor", "repeats")
    own = markers.select("marker_id", "shift", F.explode(F.sequence(first.cast("int"), F.col("max_size") - 1, F.col("repeats"))).alias("bin"))
    s = F.col("bin") + F.col("shift").cast("double")
    return own.select("marker_id", "bin", s.alias("mean"), (s - 0.5).alias("p25"), (s + 0.5).alias("p75"))


def adjust_bins(bins: DataFrame, updates: DataFrame, by: Sequence[str] = ("marker_id", "bin")) -> DataFrame:
    """bins with mean, p25, p75 of updates where those have the same marker and bin."""
    new = updates.select(*by, F.struct("mean", "p25", "p75").alias("_u"))
    joined = bins.join(new, list(by), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_u.{c}"), F.col(c)) for c in ("mean", "p25", "p75")}).drop("_u")


def bins_of_batches(batches: DataFrame, bins: DataFrame, depth: int = 3) -> DataFrame:
    """(batch, marker_id, source, bin, ...): bins of a batch, or of the nearest of its bin_batch parents that has any for the marker."""
    has = bins.select("batch", "marker_id").distinct()
    chain = batches.select("batch", F.col("batch").alias("source"), F.lit(0).alias("step"))
    up = batches.select(F.col("batch").alias("source"), F.col("bin_batch").alias("parent"))
    level = chain
    for i in range(1, depth + 1):
        level = level.join(up, "source").where("parent is not null and parent <> source").select("batch", F.col("parent").alias("source"), F.lit(i).alias("step"))
        chain = chain.unionByName(level)
    found = chain.join(has.withColumnRenamed("batch", "source"), "source").groupBy("batch", "marker_id").agg(F.min_by("source", "step").alias("source"))
    return found.join(bins.withColumnRenamed("batch", "source"), ["source", "marker_id"])


def _gaps(bins: DataFrame) -> DataFrame:
    """One row for each space between neighbouring bins by mean: [low, high), open at both ends of a marker."""
    order = Window.partitionBy("marker_id").orderBy("mean", "bin")
    bin_ = F.struct("bin", "mean", "p25", "p75")
    rows = bins.select("marker_id", bin_.alias("left"), F.lead(bin_).over(order).alias("right"), F.lag(bin_).over(order).alias("before"))
    inner = rows.select("marker_id", F.col("left.mean").alias("low"), F.coalesce(F.col("right.mean"), F.lit(float("inf"))).alias("high"), "left", "right")
    first = rows.where("before is null").select("marker_id", F.lit(float("-inf")).alias("low"), F.col("left.mean").alias("high"), "left", F.lit(None).cast(rows.schema["right"].dataType).alias("right"))
    return inner.unionByName(first)


def assign_bins(peaks: DataFrame, bins: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """peaks with bin: that of the neighbour whose near quartile is closer, the right one on a tie; beyond the ends the end's.

    A marker has many sizes and few bins, so the bins are broadcast once their number is checked. Rows of unknown size (below 0) stay as they are. With markers (marker_id, min_size, max_size), sizes not strictly between
    them become unassigned and keep their bin; others become bins if called or unassigned. The bins of a marker are joined as
    gaps, so a size meets one row.
    """
    gaps = small(_gaps(bins).withColumnRenamed("marker_id", "_of"))
    side = F.when(F.col("right").isNull() | (F.col("size") - F.col("left.p75") < F.col("right.p25") - F.col("size")), F.col("left.bin")).otherwise(F.col("right.bin"))
    own = peaks
    if markers is not None:
        own = own.join(small(markers.select("marker_id", "min_size", "max_size")), "marker_id", "left")
    known = own.where("size >= 0")
    if markers is not None:
        known = known.where("size > min_size and size < max_size")
    hit = known.join(gaps, F.expr("marker_id = _of and size >= low and size < high"))
    done = hit.withColumn("bin", side).drop("_of", "low", "high", "left", "right")
    if "type" in peaks.columns and markers is not None:
        done = done.withColumn("type", F.when(F.col("type").isin("unassigned", "called"), "bin").otherwise(F.col("type")))
    rest = own.where("size < 0 or size is null")
    if "bin" not in peaks.columns:
        rest = rest.withColumn("bin", F.lit(-1))
    out = done.unionByName(rest.select(*done.columns))
    if markers is not None:
        outside = own.where("size >= 0 and not (size > min_size and size < max_size)")
        outside = outside.withColumn("type", F.lit("unassigned")) if "type" in peaks.columns else outside
        outside = outside if "bin" in peaks.columns else outside.withColumn("bin", F.lit(-1))
        out = out.unionByName(outside.select(*done.columns))
    return out.drop("min_size", "max_size") if markers is not None else out


def bin_channels(peaks: DataFrame, channel_markers: DataFrame, bins: DataFrame, markers: DataFrame) -> DataFrame:
    """Binned peaks, one revision for each marker of a channel (channel_id, marker_id).

    A channel of combined markers has several, and each gets its own copy of the peaks; those outside the marker's sizes become
    unassigned there. Few channels may hold most peaks, so a list of channels that is small is broadcast.
    """
    own = peaks.drop("marker_id").join(small(channel_markers.select("channel_id", "marker_id")), "channel_id")
    return assign_bins(own, bins, markers)


def fixed_bins(bins: DataFrame) -> DataFrame:
    """bins as a table of its own, without the plan that led to it; some hundreds of rows a marker, MOST_BINS in all."""
    rows = bins.limit(MOST_BINS + 1).collect()
    if len(rows) > MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} bins")
    return bins.sparkSession.createDataFrame(rows, bins.schema)


def refine_bins(sized: DataFrame, bins: DataFrame, rounds: int = 3) -> DataFrame:
    """bins after rounds of assigning sizes and taking mean and quartiles of what each bin got; bins that got nothing stay."""
    for _ in range(rounds):
        own = assign_bins(sized.select("marker_id", "size"), bins).where("bin >= 0")
        q = F.percentile("size", F.array(F.lit(0.25), F.lit(0.75)))
        news = own.groupBy("marker_id", "bin").agg(F.bround(F.avg("size"), 3).alias("mean"), q.alias("q")).select("marker_id", "bin", "mean", F.bround(F.get("q", F.lit(0)), 3).alias("p25"), F.bround(F.get("q", F.lit(1)), 3).alias("p75"))
        bins = fixed_bins(adjust_bins(bins, news))
    return bins


def bin_round(sized: DataFrame, bins: DataFrame) -> DataFrame:
    """(marker_id, bin, n, median, p10, p25, p75, p90) of sizes after one assignment."""
    q = F.percentile("size", F.array(*map(F.lit, (0.5, 0.1, 0.25, 0.75, 0.9))))
    own = assign_bins(sized.select("marker_id", "size"), bins).where("bin >= 0").groupBy("marker_id", "bin").agg(F.count("*").alias("n"), q.alias("q"))
    return own.select("marker_id", "bin", "n", *(F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("median", "p10", "p25", "p75", "p90"))))


def optimise(sizes: np.ndarray, counts: np.ndarray, bins: pd.DataFrame, repeats: int, rounds: int = 30, every: int = 10) -> pd.DataFrame:
    """Bins of one marker moved to where its sizes lie.

    Sizes come as different values with counts. Each round assigns sizes to bins by mean. Every `every` rounds, from the first,
    spacing is set anew outward from the most frequent bin (the narrower of equals): a bin closer to its neighbour than
    repeats - 0.75 is put repeats - 0.5 away. In other rounds a bin's mean becomes its median, and its quartiles the 10th and
    90th percentile, or half a base either way where its sizes spread over no more than half a base.
    """
    own = bins.sort_values(["mean", "bin"]).reset_index(drop=True)
    order = np.argsort(sizes, kind="stable")
    sizes, counts = np.asarray(sizes, float)[order], np.asarray(counts, np.int64)[order]
    for turn in range(rounds):
        own = own.sort_values("mean", kind="stable").reset_index(drop=True)
        mean, low, high = (own[c].to_numpy(float).copy() for c in ("mean", "p25", "p75"))
        place = np.searchsorted(mean, sizes, "right")
        left, right = np.maximum(place - 1, 0), np.minimum(place, len(own) - 1)
        at = np.where((place == 0) | ((place < len(own)) & ~(sizes - high[left] < low[right] - sizes)), right, left)
        members = {i: np.repeat(sizes[at == i], counts[at == i]) for i in np.unique(at).tolist()}
        if turn % every and members:
            for i, x in members.items():
                tenth, middle, last = np.percentile(x, (10, 50, 90))
                mean[i] = middle
                low[i], high[i] = (tenth, last) if np.ptp(x) > 0.5 else (middle - 0.5, middle + 0.5)
        elif members:
            ranks = np.argsort(own["bin"].to_numpy(), kind="stable")
            best = min(members, key=lambda i: (-len(members[i]), np.ptp(members[i])))
            low[best], high[best] = mean[best] - 0.5, mean[best] + 0.5
            start = int(np.flatnonzero(ranks == best)[0])
            for step in (1, -1):
                base = mean[best]
                for i in ranks[start + step :: step] if start + step >= 0 else []:
                    if (mean[i] - base) * step < repeats - 0.75:
                        mean[i] = base + step * (repeats - 0.5)
                        low[i], high[i] = mean[i] - 0.5, mean[i] + 0.5
                    base = mean[i]
        own["mean"], own["p25"], own["p75"] = mean, low, high
    return own.sort_values("bin").reset_index(drop=True)


def optimise_bins(sized: DataFrame, bins: DataFrame, repeats: DataFrame, rounds: int = 30) -> DataFrame:
    """(marker_id, bin, mean, p25, p75) after optimise() on each marker.

    Sizes are counted first, to hundredths of a base, so that a marker's task gets its different sizes and not its rows.
    """
    counted = sized.where("size >= 0").groupBy("marker_id", (F.floor(F.col("size") * 100 + F.lit(0.5)) / 100).alias("size")).agg(F.count("*").alias("n"))
    own = bins.join(repeats.select("marker_id", "repeats"), "marker_id")

    def move(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame({"marker_id": [], "bin": [], "mean": [], "p25": [], "p75": []})
        done = optimise(left["size"].to_numpy(), left["n"].to_numpy(), right, int(right["repeats"].iloc[0]), rounds)
        return done[["marker_id", "bin", "mean", "p25", "p75"]]

    return counted.groupBy("marker_id").cogroup(own.groupBy("marker_id")).applyInPandas(move, "marker_id int, bin int, mean double, p25 double, p75 double")
