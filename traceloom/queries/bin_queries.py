"""Bins and sizes of peaks."""
from pyspark.sql import functions as F

from .. import catalog
from ..constants import LADDERS
from ..functions.stable import fixed as stable
from ..operators import bins as ops
from ..operators import peaks, sizing
from .base import fixed, query

_STARTS = "SELECT CAST(i AS INT) AS marker_id, CAST(i AS INT) AS start, CAST(i + 49 AS INT) AS stop, CAST(i % 3 + 2 AS INT) AS repeats FROM range(1, 8) t(i)"


def _starts(spark):
    i = F.col("id").cast("int")
    return spark.range(1, 8, numPartitions=1).select(i.alias("marker_id"), i.alias("start"), (i + 49).alias("stop"), (i % 3 + 2).alias("repeats"))


@query(f"WITH m AS ({_STARTS}), b AS (SELECT marker_id, CAST(unnest(range(start, stop, repeats)) AS INT) AS bin FROM m) SELECT marker_id, bin, bin::DOUBLE AS mean, bin::DOUBLE - 1 AS p25, bin::DOUBLE + 1 AS p75 FROM b")
def init_bins(spark, d):
    return ops.initial_bins(_starts(spark))


@query(f"""WITH m AS ({_STARTS}), b AS (SELECT marker_id, CAST(unnest(range(((start + 10) // repeats - 1) * repeats + 101 % repeats, stop, repeats)) AS INT) AS bin FROM m)
SELECT marker_id, bin, bin + 0.25::DOUBLE AS mean, bin + 0.25::DOUBLE - 0.5 AS p25, bin + 0.25::DOUBLE + 0.5 AS p75 FROM b""")
def anchored_bins(spark, d):
    own = _starts(spark).select("marker_id", (F.col("start") + 10).alias("min_size"), F.col("stop").alias("max_size"), "repeats", F.lit(101).alias("anchor"), F.lit(0.25).alias("shift"))
    return ops.anchored_bins(own)


#: Every third base a bin.
_BINS = "b AS (SELECT CAST(m AS INT) AS marker_id, CAST(i AS INT) AS bin, i + 0.1::DOUBLE * (m % 3) AS mean, i + 0.1::DOUBLE * (m % 3) - 0.4::DOUBLE AS p25, i + 0.1::DOUBLE * (m % 3) + 0.6::DOUBLE AS p75 FROM range(1, 8) t(m), range(1, 50, 3) u(i))"


def _bins(spark):
    own = spark.range(1, 8, numPartitions=1).select(F.col("id").cast("int").alias("marker_id"), F.explode(F.sequence(F.lit(1), F.lit(49), F.lit(3))).alias("bin"))
    mean = F.col("bin") + F.lit(0.1) * (F.col("marker_id") % 3)
    return own.select("marker_id", "bin", mean.alias("mean"), (mean - F.lit(0.4)).alias("p25"), (mean + F.lit(0.6)).alias("p75"))


_ASSIGN = f"""WITH {catalog.SQL}, {_BINS}, x AS (SELECT *, lead(bin) OVER w AS rbin, lead(p25) OVER w AS rp25, min(mean) OVER (PARTITION BY marker_id) AS lowest FROM b WINDOW w AS (PARTITION BY marker_id ORDER BY mean)),
a AS (SELECT a.marker_id, a.sample_id, a.allele_id, a.size, a.type, x.bin AS lbin, x.p75, x.rbin, x.rp25 FROM alleles a ASOF LEFT JOIN x ON a.marker_id = x.marker_id AND a.size >= x.mean),
n AS (SELECT *, CASE WHEN lbin IS NULL THEN 1 WHEN rbin IS NULL OR size - p75 < rp25 - size THEN lbin ELSE rbin END AS bin FROM a)"""


@query(_ASSIGN + " SELECT marker_id, sample_id, allele_id, size, bin FROM n")
def bin_assign_asof(spark, d):
    return ops.assign_bins(catalog.alleles(spark, d).select("marker_id", "sample_id", "allele_id", "size"), _bins(spark))


@query(_ASSIGN + " SELECT marker_id, sample_id, allele_id, size, CASE WHEN size > 5 AND size < 45 THEN bin ELSE -1 END AS bin, CASE WHEN NOT (size > 5 AND size < 45) THEN 'unassigned' WHEN type IN ('called', 'unassigned') THEN 'bin' ELSE type END AS type FROM n")
def bin_peaks_in_range(spark, d):
    limits = _starts(spark).select("marker_id", F.lit(5.0).alias("min_size"), F.lit(45.0).alias("max_size"))
    return ops.assign_bins(catalog.alleles(spark, d).select("marker_id", "sample_id", "allele_id", "size", "type"), _bins(spark), limits)


@query(f"""WITH {catalog.SQL}, {_BINS}, u AS (SELECT marker_id, value AS bin, avg(size) AS mean, quantile_cont(size, 0.25) AS p25, quantile_cont(size, 0.75) AS p75 FROM alleles WHERE value % 2 = 0 GROUP BY ALL)
SELECT b.marker_id, b.bin, {fixed('coalesce(u.mean, b.mean)')} AS mean, {fixed('coalesce(u.p25, b.p25)', 4)} AS p25, {fixed('coalesce(u.p75, b.p75)', 4)} AS p75 FROM b LEFT JOIN u USING (marker_id, bin)""")
def bin_adjust(spark, d):
    from ..operators.statistics import bin_summary

    news = bin_summary(catalog.alleles(spark, d).where("value % 2 = 0"))
    return ops.adjust_bins(_bins(spark), news).select("marker_id", "bin", *(stable(F.col(c), 6 if c == "mean" else 4).alias(c) for c in ("mean", "p25", "p75")))


_STATS = "quantile_cont(size, {q})"


@query(_ASSIGN + f" SELECT marker_id, bin, count(*)::BIGINT AS n, {', '.join(fixed(_STATS.format(q=q), 4) + ' AS ' + c for c, q in (('median', 0.5), ('p10', 0.1), ('p25', 0.25), ('p75', 0.75), ('p90', 0.9)))} FROM n GROUP BY ALL")
def bin_round_stats(spark, d):
    own = ops.bin_round(catalog.alleles(spark, d), _bins(spark))
    return own.select("marker_id", "bin", "n", *(stable(F.col(c), 4).alias(c) for c in ("median", "p10", "p25", "p75", "p90")))


@query()
def bin_optimise(spark, d):
    repeats = spark.range(1, 8, numPartitions=1).select(F.col("id").cast("int").alias("marker_id"), F.lit(3).alias("repeats"))
    return ops.optimise_bins(catalog.alleles(spark, d), _bins(spark), repeats)


def _refined(rounds: int) -> str:
    """Bins after each round as tables b0, b1, ..."""
    sql = f"WITH {catalog.SQL}, {_BINS.replace('b AS', 'b0 AS', 1)}"
    for k in range(rounds):
        sql += f""",
x{k} AS (SELECT *, lead(bin) OVER w AS rbin, lead(p25) OVER w AS rp25 FROM b{k} WINDOW w AS (PARTITION BY marker_id ORDER BY mean)),
a{k} AS (SELECT a.marker_id, a.size, x.bin AS lbin, x.p75, x.rbin, x.rp25 FROM alleles a ASOF LEFT JOIN x{k} x ON a.marker_id = x.marker_id AND a.size >= x.mean),
n{k} AS (SELECT marker_id, size, CASE WHEN lbin IS NULL THEN 1 WHEN rbin IS NULL OR size - p75 < rp25 - size THEN lbin ELSE rbin END AS bin FROM a{k}),
q{k} AS (SELECT marker_id, bin, round_even(avg(size), 3) AS m, round_even(quantile_cont(size, 0.25), 3) AS l, round_even(quantile_cont(size, 0.75), 3) AS h FROM n{k} GROUP BY ALL),
b{k + 1} AS (SELECT b.marker_id, b.bin, coalesce(m, b.mean) AS mean, coalesce(l, b.p25) AS p25, coalesce(h, b.p75) AS p75 FROM b{k} b LEFT JOIN q{k} q USING (marker_id, bin))"""
    return f"{sql} SELECT marker_id, bin, mean, p25, p75 FROM b{rounds}"


@query(_refined(3))
def bin_refine_rounds(spark, d):
    return ops.refine_bins(catalog.alleles(spark, d), _bins(spark), 3)


@query(_ASSIGN.replace("FROM alleles a ASOF", "FROM (SELECT a.* REPLACE (c.marker_id AS marker_id), a.marker_id AS channel_id FROM alleles a JOIN (SELECT 1 AS channel_id, 1 AS marker_id UNION ALL SELECT 1, 2 UNION ALL SELECT 3, 3) c ON c.channel_id = a.marker_id) a ASOF").replace("a.allele_id, a.size", "a.channel_id, a.allele_id, a.size")
+ " SELECT channel_id, marker_id, sample_id, allele_id, CASE WHEN size > 5 AND size < 45 THEN bin ELSE -1 END AS bin, CASE WHEN NOT (size > 5 AND size < 45) THEN 'unassigned' WHEN type IN ('called', 'unassigned') THEN 'bin' ELSE type END AS type FROM n")
def bin_combined_channels(spark, d):
    limits = _starts(spark).select("marker_id", F.lit(5.0).alias("min_size"), F.lit(45.0).alias("max_size"))
    pairs = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "channel_id int, marker_id int")
    own = catalog.alleles(spark, d).select(F.col("marker_id").alias("channel_id"), "sample_id", "allele_id", "size", "type")
    return ops.bin_channels(own, pairs, _bins(spark), limits).select("channel_id", "marker_id", "sample_id", "allele_id", "bin", "type")


@query("""WITH b AS (SELECT n_name AS batch, 'NATION_' || (n_nationkey // 2) AS bin_batch FROM nation), x AS (SELECT n_name AS batch, CAST(n_nationkey % 3 AS INT) AS marker_id, CAST(n_nationkey AS INT) AS bin FROM nation WHERE n_nationkey < 4 OR n_nationkey % 7 = 0),
c AS (SELECT batch, batch AS source, 0 AS step FROM b UNION ALL SELECT batch, bin_batch, 1 FROM b WHERE bin_batch <> batch UNION ALL SELECT b.batch, p.bin_batch, 2 FROM b JOIN b p ON p.batch = b.bin_batch WHERE b.bin_batch <> b.batch AND p.bin_batch <> p.batch
  UNION ALL SELECT b.batch, q.bin_batch, 3 FROM b JOIN b p ON p.batch = b.bin_batch JOIN b q ON q.batch = p.bin_batch WHERE b.bin_batch <> b.batch AND p.bin_batch <> p.batch AND q.bin_batch <> q.batch),
f AS (SELECT c.batch, x.marker_id, arg_min(c.source, c.step) AS source FROM c JOIN (SELECT DISTINCT batch, marker_id FROM x) x ON x.batch = c.source GROUP BY ALL)
SELECT f.source, f.marker_id, f.batch, x.bin FROM f JOIN x ON x.batch = f.source AND x.marker_id = f.marker_id""")
def bin_fallback_lookup(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey")
    batches = nation.select(F.col("n_name").alias("batch"), F.concat(F.lit("NATION_"), F.floor(key / 2)).alias("bin_batch"))
    own = nation.where((key < 4) | (key % 7 == 0)).select(F.col("n_name").alias("batch"), (key % 3).cast("int").alias("marker_id"), key.cast("int").alias("bin"))
    return ops.bins_of_batches(batches, own)


_SIZES = LADDERS["LIZ500"].sizes
#: A ladder an assay, on a curve that differs a little between assays.
_LADDER = f"""l AS (SELECT s_suppkey AS assay_id, i, size, CAST(floor(size * 15 + s_suppkey % 37 + size * size * 0.002::DOUBLE) AS INT) AS rtime, i % 5 * 0.125::DOUBLE AS deviation, 1 - i % 4 * 0.0625::DOUBLE AS qscore
  FROM supplier, (SELECT unnest([{', '.join(map(str, _SIZES))}]::DOUBLE[]) AS size, unnest(range({len(_SIZES)})) AS i)),
g AS (SELECT assay_id, rtime AS low, lead(rtime) OVER w AS high, row_number() OVER w AS gap, count(*) OVER (PARTITION BY assay_id) AS peaks, lag(rtime) OVER w AS x0, lag(size) OVER w AS y0, lag(qscore) OVER w AS q0,
  rtime AS x1, size AS y1, qscore AS q1, deviation AS d1, lead(rtime) OVER w AS x2, lead(size) OVER w AS y2, lead(qscore) OVER w AS q2, lead(deviation) OVER w AS d2, lead(rtime, 2) OVER w AS x3, lead(size, 2) OVER w AS y3, lead(qscore, 2) OVER w AS q3
  FROM l WINDOW w AS (PARTITION BY assay_id ORDER BY rtime)),
p AS (SELECT l_suppkey AS assay_id, l_orderkey AS channel_id, CAST(l_extendedprice AS BIGINT) % 8200 AS rtime, CASE WHEN l_returnflag = 'N' THEN 'noise' ELSE 'scanned' END AS type FROM lineitem),
j AS (SELECT p.*, g.* EXCLUDE (assay_id), p.rtime::DOUBLE AS x FROM p JOIN g ON p.assay_id = g.assay_id AND p.rtime >= g.low AND p.rtime < g.high)"""


def _ladder(spark, d):
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("size")) for i, s in enumerate(_SIZES)))
    own = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("assay_id"), F.inline(pairs))
    rtime = F.floor(F.col("size") * 15 + F.col("assay_id") % 37 + F.col("size") * F.col("size") * F.lit(0.002)).cast("int")
    return own.select("assay_id", rtime.alias("rtime"), "size", (F.col("i") % 5 * F.lit(0.125)).alias("deviation"), (1 - F.col("i") % 4 * F.lit(0.0625)).alias("qscore"))


def _peaks(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select(F.col("l_suppkey").alias("assay_id"), F.col("l_orderkey").alias("channel_id"), (F.bround("l_extendedprice", 0).cast("long") % 8200).alias("rtime"), F.when(F.col("l_returnflag") == "N", "noise").otherwise("scanned").alias("type"))


def _parabola(a: int, b: int, c: int) -> str:
    parts = []
    for k in (a, b, c):
        i, m = (n for n in (a, b, c) if n != k)
        parts.append(f"y{k} * (x - x{i}) * (x - x{m}) / ((x{k}::DOUBLE - x{i}) * (x{k}::DOUBLE - x{m}))")
    return "0.0::DOUBLE + " + " + ".join(parts)


_SOUTHERN = f"{_LADDER}, s AS (SELECT *, {_parabola(0, 1, 2)} AS a, {_parabola(1, 2, 3)} AS b FROM j WHERE gap >= 2 AND gap <= peaks - 2 AND NOT (gap = 2 AND rtime = low))"


@query(f"WITH {_SOUTHERN} SELECT assay_id, channel_id, rtime, {fixed('(a + b) / 2', 5)} AS size, {fixed('(a - b) * (a - b)', 5)} AS deviation, (least(q0, q1, q2) + least(q1, q2, q3)) / 2 AS qcall FROM s")
def local_southern_size(spark, d):
    near = sizing.beside(_peaks(spark, d), _ladder(spark, d)).where("gap >= 2 and gap <= peaks - 2 and not (gap = 2 and rtime = low)")
    return sizing.local_southern(near).select("assay_id", "channel_id", "rtime", stable(F.col("size"), 5).alias("size"), stable(F.col("deviation"), 5).alias("deviation"), "qcall")


@query(f"WITH {_LADDER} SELECT assay_id, channel_id, rtime, {fixed('(-0.0000005::DOUBLE * x + 0.065::DOUBLE) * x + assay_id / 64.0::DOUBLE')} AS size, (d1 + d2) / 2 AS deviation, least(q1, q2) AS qcall FROM j")
def least_square_size(spark, d):
    near = sizing.beside(_peaks(spark, d), _ladder(spark, d)).withColumn("z", F.array(F.lit(-0.0000005), F.lit(0.065), F.col("assay_id") / F.lit(64.0)))
    return sizing.least_square(near).select("assay_id", "channel_id", "rtime", stable(F.col("size")).alias("size"), "deviation", "qcall")


@query(f"""WITH {_SOUTHERN} SELECT assay_id, channel_id, rtime, CASE type WHEN 'scanned' THEN 'called' ELSE type END AS type, CAST(round_even((a + b) / 2, 0) AS INT) AS bin FROM s
UNION ALL SELECT p.assay_id, channel_id, p.rtime, CASE type WHEN 'scanned' THEN 'unassigned' ELSE type END, -1 FROM p JOIN (SELECT assay_id, min(x1) FILTER (gap = 2) AS a, min(x2) FILTER (gap = peaks - 2) AS b FROM g GROUP BY ALL) e USING (assay_id) WHERE NOT (p.rtime > e.a AND p.rtime < e.b)""")
def call_peaks_range(spark, d):
    return sizing.call_peaks(_peaks(spark, d), _ladder(spark, d)).select("assay_id", "channel_id", "rtime", "type", "bin")


@query()
def cubic_spline_size(spark, d):
    from ..operators.channels import spline_sizes

    return spline_sizes(_peaks(spark, d).withColumn("rtime", F.col("rtime").cast("int")), _ladder(spark, d))


@query("""WITH a AS (SELECT l_linenumber AS marker_id, l_partkey AS sample_id, l_orderkey AS rtime, CAST(l_quantity AS INT) AS bin, l_quantity + (l_discount - 0.05::DOUBLE) * 4 AS size, l_extendedprice AS height, l_tax * 200 AS beta, CASE WHEN l_returnflag = 'N' THEN 'called' ELSE 'bin' END AS type FROM lineitem),
b AS (SELECT *, CASE WHEN type = 'bin' AND beta > 15 THEN 'broad' ELSE type END AS t, row_number() OVER (PARTITION BY marker_id, sample_id ORDER BY height DESC, rtime) AS k FROM a)
SELECT marker_id, sample_id, rtime, bin, height, CASE WHEN t = 'bin' AND EXISTS (SELECT 1 FROM b d WHERE d.marker_id = b.marker_id AND d.sample_id = b.sample_id AND d.k < b.k AND d.t = 'bin' AND ((abs(d.size - b.size) < 3.5 AND b.height / d.height < 0.95) OR abs(d.size - b.size) < 2.75 OR d.bin = b.bin)) THEN 'stutter' ELSE t END AS type FROM b""")
def postannotate_stutter(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    own = rows.select(
        F.col("l_linenumber").alias("marker_id"), F.col("l_partkey").alias("sample_id"), F.col("l_orderkey").alias("rtime"), F.col("l_quantity").cast("int").alias("bin"),
        (F.col("l_quantity") + (F.col("l_discount") - F.lit(0.05)) * F.lit(4)).alias("size"), F.col("l_extendedprice").alias("height"), (F.col("l_tax") * 200).alias("beta"), F.when(F.col("l_returnflag") == "N", "called").otherwise("bin").alias("type"),
    )
    return peaks.mark_stutter(own, by=("marker_id", "sample_id")).select("marker_id", "sample_id", "rtime", "bin", "height", "type")
