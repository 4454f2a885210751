"""Rank statistics as plans, and tail probabilities as plain numbers."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mid_ranks(values: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(value, n, mid): each different value with its count and the mean rank of its rows.

    Values are counted before they are ordered, so the ordered table has one row a different value.
    """
    counted = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("mid", before + (F.col("n") + 1) / F.lit(2.0))


def kruskal_wallis(values: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, h, df): the H statistic with its correction for ties. Null values do not count."""
    own = values.where(F.col(value).isNotNull())
    ranks = mid_ranks(own, value)
    by_group = own.groupBy(group, value).agg(F.count("*").alias("k")).join(ranks.select(value, "mid"), value)
    sums = by_group.groupBy(group).agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("mid")).alias("r"))
    totals = sums.agg(F.count("*").alias("groups"), F.sum("k").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s")).withColumn("one", F.lit(1))
    ties = ranks.agg(F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double").alias("t")).withColumn("one", F.lit(1))
    n = F.col("n").cast("double")
    h = (F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / F.nullif(1 - F.col("t") / (n * n * n - n), F.lit(0.0))
    return totals.join(ties, "one").select("groups", "n", h.alias("h"), (F.col("groups") - 1).alias("df"))


def rank_sum(values: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """(n1, n2, w, z): rank sum of the first group and its normal deviate, without a correction for ties."""
    own = values.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranked = own.groupBy(group, value).agg(F.count("*").alias("k")).join(mid_ranks(own, value).select(value, "mid"), value)
    sums = ranked.agg(
        F.sum(F.when(F.col(group) == first, F.col("k"))).alias("n1"), F.sum(F.when(F.col(group) == second, F.col("k"))).alias("n2"),
        F.sum(F.when(F.col(group) == first, F.col("k") * F.col("mid"))).alias("w"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    return sums.select("n1", "n2", "w", ((F.col("w") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def signed_rank(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(n, w_plus, w_minus, t): signed ranks of the differences that are not zero; t is the smaller sum."""
    d = pairs.select((F.col(left) - F.col(right)).alias("d")).where("d is not null and d <> 0").withColumn("a", F.abs("d"))
    ranked = d.join(mid_ranks(d, "a").select("a", "mid"), "a")
    sums = ranked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("mid"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("mid"))), F.lit(0.0)).alias("w_minus"))
    return sums.withColumn("t", F.least("w_plus", "w_minus"))


def signed_rank_p(t: float, n: int) -> float:
    """Two-sided probability of a smaller sum of signed ranks of n differences: counted exactly up to 25, normal beyond."""
    if n == 0:
        return 1.0
    if n > 25:
        return normal_tail((t - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return min(1.0, 2 * sum(ways[: int(t) + 1]) / 2**n)


def normal_tail(z: float) -> float:
    """Two-sided probability of a deviate as large as z."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Probability of more than x, from the series of the incomplete gamma function or its continued fraction."""
    if x <= 0:
        return 1.0
    a, y = df / 2, x / 2
    scale = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= y / n
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300
    b, c = y + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h
