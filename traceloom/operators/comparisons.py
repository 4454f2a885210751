"""Comparisons of labelled sets: rank tests with their probabilities, permutations and resampling."""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes, ranktests
from . import distance, statistics, views

#: Rounds of a permutation test that one task makes over a set.
SHUFFLES = 25
#: Stands for a missing value among the codes of alleles.
_NO_VALUE = -(2**31)


def _two_labels(frame: DataFrame) -> list[str]:
    return [r.label for r in frame.select("label").distinct().orderBy("label").limit(3).collect()]


def compare_heterozygosity(frame: DataFrame) -> dict:
    """Test of expected heterozygosity over markers: the paired signed-rank test for two sets, H for more; none for one.

    Returns test, statistic and p; the table of sets stays a plan.
    """
    # equal values tie also where they were summed in another order
    he = statistics.heterozygosity(frame).withColumn("he", F.floor(F.col("he") * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9))
    labels = _two_labels(he)
    if len(labels) < 2:
        return {"test": None, "statistic": None, "p": None}
    if len(labels) == 2:
        one, two = (he.where(F.col("label") == name).select("marker_id", F.col("he").alias(side)) for name, side in zip(labels, "xy", strict=True))
        r = ranktests.signed_rank(one.join(two, "marker_id"), "x", "y").first()
        return {"test": "signed rank, paired", "statistic": r.t, "p": ranktests.signed_rank_p(r.t, r.n)}
    r = ranktests.kruskal_wallis(he, "label", "he").first()
    return {"test": "Kruskal-Wallis", "statistic": r.h, "p": ranktests.chi2_tail(r.h, r.df)}


def compare_infection(frame: DataFrame) -> dict:
    """Test of the samples' multiplicity of infection: the rank sum for two sets, H for more; none for one."""
    moi = views.sample_multiplicity(frame)
    labels = _two_labels(moi)
    if len(labels) < 2:
        return {"test": None, "statistic": None, "p": None}
    if len(labels) == 2:
        r = ranktests.rank_sum(moi, "label", "moi", *labels).first()
        return {"test": "rank sum", "statistic": r.z, "p": ranktests.normal_tail(r.z)}
    r = ranktests.kruskal_wallis(moi, "label", "moi").first()
    return {"test": "Kruskal-Wallis", "statistic": r.h, "p": ranktests.chi2_tail(r.h, r.df)}


def _divisions(top: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(set1, set2, round, label, marker_id, value, n): counts of dominant alleles of both sets of each pair, as labels 1 and 2, as
    they are in round 0 and with samples dealt to the sets anew, by size, in `rounds` others.

    A sample's rank by a hash of the round decides its set. Each sample is sent once to each pair, whose task makes all rounds over
    the samples' numbers and alleles, so that rounds are neither rows nor shuffled.
    """
    code = F.shiftleft(F.col("marker_id").cast("long"), 32) + F.coalesce(F.col("value").cast("long"), F.lit(_NO_VALUE))
    own = top.select("label", hashes.numbered(top).alias("number"), code.alias("code")).groupBy("label", "number").agg(F.collect_list("code").alias("codes"))
    # from the same exchange as own
    labels = own.groupBy("label").agg(F.sum(F.size("codes")).alias("n")).where("n > 0").select("label")
    pairs = labels.select(F.col("label").alias("set1")).join(labels.select(F.col("label").alias("set2")), F.expr("set1 < set2"))
    members = pairs.select("set1", "set2", F.explode(F.array("set1", "set2")).alias("label")).join(own, "label").withColumn("first", F.expr("label = set1")).drop("label")

    def divide(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, first = (group[c].to_numpy() for c in ("number", "first"))
        listed = group["codes"].combine_chunks()
        owner = np.repeat(np.arange(len(ids)), listed.value_lengths().to_numpy())
        at, kinds = pd.factorize(listed.flatten().to_numpy())
        at = at.astype(np.int32)
        marker = (kinds + 2**31) >> 32
        value = kinds - (marker << 32)
        values, of = pa.array(value, pa.int32(), mask=value == _NO_VALUE), pa.array(marker, pa.int32())
        total, some = np.bincount(at, minlength=len(kinds)), int(first.sum())
        out = []
        for r in range(rounds + 1):
            side = first
            if r:
                h = hashes.xxhash64(seed, r, ids)
                side = h <= np.partition(h, some - 1)[some - 1]
            one = np.bincount(at[side[owner]], minlength=len(kinds))
            for label, n in (("1", one), ("2", total - one)):
                held = np.flatnonzero(n)
                out.append(pa.table({"round": pa.array(np.full(len(held), r), pa.int32()), "label": pa.array([label] * len(held), pa.string()), "marker_id": of.take(held), "value": values.take(held), "n": pa.array(n[held], pa.int64())}))
        made = pa.concat_tables(out)
        for i, c in enumerate(("set1", "set2")):
            made = made.add_column(i, c, pa.repeat(group[c][0].as_py(), len(made)).cast(pa.string()))
        return made

    return members.groupBy("set1", "set2").applyInArrow(divide, "set1 string, set2 string, round int, label string, marker_id int, value int, n long")


def fst_permutations(frame: DataFrame, rounds: int = 100, seed: int = 1) -> DataFrame:
    """(set1, set2, fst, p): p is the share of random divisions of both sets' samples, this one included, that differ as much."""
    top = views.dominant(frame).select("label", "sample_id", "marker_id", "value")
    found = distance.fst_of_counts(_divisions(top, rounds, seed), by=("set1", "set2", "round")).select("set1", "set2", "round", "fst")
    sets = found.groupBy("set1", "set2").agg(F.max(F.when(F.col("round") == 0, F.col("fst"))).alias("fst"), F.collect_list(F.when(F.col("round") > 0, F.struct("fst"))).alias("others"))
    as_much = F.size(F.filter("others", lambda x: F.coalesce(x["fst"] >= F.col("fst"), F.lit(False))))
    return sets.select("set1", "set2", "fst", ((as_much + 1) / (F.size("others") + 1)).alias("p"))


def jost_bootstrap(frame: DataFrame, rounds: int = 100, seed: int = 1) -> DataFrame:
    """(set1, set2, d, low, high): Jost's D with an interval of 95 percent.

    Alleles are drawn anew inside each set and marker: counts become multinomial draws, made from the counts alone, one task a
    set and marker. Draws differ more than the sets do, so the interval is moved from the draws' mean to d.
    """
    counts = views.distribution(views.dominant(frame))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("value")
        n = int(own["n"].sum())
        rng = np.random.default_rng([seed, int(own["marker_id"].iloc[0]), *map(ord, str(own["label"].iloc[0]))])
        drawn = rng.multinomial(n, own["n"] / n, size=rounds)
        at, col = np.nonzero(drawn)
        return pd.DataFrame({"round": at + 1, "label": own["label"].iloc[0], "marker_id": own["marker_id"].iloc[0], "value": own["value"].to_numpy()[col], "n": drawn[at, col]})

    drawn = counts.groupBy("label", "marker_id").applyInPandas(draw, "round int, label string, marker_id int, value int, n long")
    found = distance.jost_of_counts(drawn, by=("round",)).groupBy("set1", "set2").agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg("d").alias("m"))
    real = distance.jost_d(frame)
    end = lambda i: F.col("d") + F.get("q", F.lit(i)) - F.col("m")
    return real.join(found, ["set1", "set2"]).select("set1", "set2", "d", end(0).alias("low"), end(1).alias("high"))


def _together(loci: Sequence[np.ndarray], sizes: Sequence[int]) -> int:
    """Sum over pairs of loci of the ordered pairs of rows, a row with itself too, that agree at both."""
    out = 0
    for i, j in combinations(range(len(loci)), 2):
        both = loci[i] * np.int64(sizes[j]) + loci[j]
        k = np.bincount(both) if sizes[i] * sizes[j] <= 4 * len(both) + 2**20 else np.unique(both, return_counts=True)[1]
        out += int((k.astype(np.int64) ** 2).sum())
    return out


def association_test(frame: DataFrame, markers: Sequence[int], rounds: int = 100, seed: int = 1) -> DataFrame:
    """(label, n, index, p): p is the share of shuffles of each locus inside its set, the real one included, with an index as large.

    A shuffle keeps the values of each locus, so of all that an index holds it changes only how many pairs of samples agree at two
    loci, which are whole numbers. A task gets the genotypes of a set once and makes SHUFFLES rounds of them, so that rounds are
    neither rows nor shuffled; a set takes some 200 bytes a sample there.
    """
    genotypes = views.complete_genotypes(frame, markers)
    real = distance.association_of(genotypes, len(markers))
    names = [f"g{k}" for k in range(len(markers))]
    parts = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-rounds // SHUFFLES) - 1))))
    sent = genotypes.select("label", hashes.numbered(genotypes).alias("number"), *(F.get("genotype", F.lit(k)).cast("double").alias(c) for k, c in enumerate(names)), parts.alias("part"))

    def shuffle(group: pa.Table) -> pa.Table:
        ids, part = group["number"].to_numpy(), group["part"][0].as_py()
        loci, sizes = zip(*((at.astype(np.int32), len(kinds)) for at, kinds in (pd.factorize(group[c].to_numpy(), use_na_sentinel=False) for c in names)), strict=True)
        own, large = _together(loci, sizes), 0
        for r in range(part * SHUFFLES + 1, min((part + 1) * SHUFFLES, rounds) + 1):
            large += _together([g[np.argsort(hashes.xxhash64(seed, r, k, ids))] for k, g in enumerate(loci)], sizes) >= own
        return pa.table({"label": pa.array([group["label"][0].as_py()], pa.string()), "large": pa.array([large], pa.int64())})

    found = sent.where("label IS NOT NULL").groupBy("label", "part").applyInArrow(shuffle, "label string, large long").groupBy("label").agg(F.sum("large").alias("large"))
    # without any difference there is no index, and none is as large
    return real.join(found, "label").select("label", "n", "index", ((F.when(F.col("index").isNotNull(), F.col("large")).otherwise(0) + 1) / F.lit(rounds + 1)).alias("p"))
