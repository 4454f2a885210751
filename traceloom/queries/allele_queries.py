"""The core query step by step, and views of its frame."""
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import MARKERS
from ..operators import core as ops
from ..operators import views
from ..operators.core import AlleleFilter, allele_frame
from .base import FRAME, PARAMS, WIDE, core, fixed, frame, query
from ..functions.stable import fixed as stable

_CUTOFF = AlleleFilter(abs_threshold=5000.0, rel_threshold=0.1, rel_cutoff=0.6, peak_types=None)
_STUTTER = AlleleFilter(stutter_ratio=0.6, stutter_range=6.0, peak_types=None)
_REL = AlleleFilter(rel_threshold=0.4, peak_types=("called", "stutter"))


def _plain(where: str) -> str:
    return f"WITH {catalog.SQL} SELECT marker_id, sample_id, value, size, height, assay_id, allele_id, 1.0::DOUBLE AS ratio, -1::INT AS rank FROM alleles WHERE {where}"


@query(_plain("height > 50000"))
def abs_threshold(spark, d):
    return allele_frame(catalog.alleles(spark, d), AlleleFilter(abs_threshold=50000.0, peak_types=None))


@query(_plain("type = 'bin'"))
def peak_type_filter(spark, d):
    return allele_frame(catalog.alleles(spark, d), AlleleFilter())


@query("""SELECT o.o_orderkey AS alleleset_id, o.o_custkey AS channel_id, o.o_orderkey % 2000 AS sample_id, CAST(o.o_orderkey % 7 + 1 AS INT) AS set_marker_id,
l.l_linenumber AS marker_id, l.l_extendedprice AS height, c.c_nationkey AS assay_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def join_alleleset_channel(spark, d):
    return ops.join_revisions(*_stored(spark, d))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
SELECT o.o_orderkey AS alleleset_id, o.o_custkey AS channel_id, o.o_orderkey % 2000 AS sample_id, CAST(o.o_orderkey % 7 + 1 AS INT) AS set_marker_id,
l.l_linenumber AS marker_id, l.l_extendedprice AS height, c.c_nationkey AS assay_id FROM lineitem l JOIN n o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE k = 1""")
def latest_revision(spark, d):
    return ops.join_revisions(*_stored(spark, d), latest_only=True)


def _stored(spark, d):
    """Revisions, alleles and channels as a store keeps them."""
    sets = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("alleleset_id"), F.col("o_custkey").alias("channel_id"), (F.col("o_orderkey") % 2000).alias("sample_id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("marker_id"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("alleleset_id"), F.col("l_linenumber").alias("marker_id"), F.col("l_extendedprice").alias("height"))
    channels = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("channel_id"), F.col("c_nationkey").alias("assay_id"))
    return sets, rows, channels


@query(f"""WITH {catalog.SQL} SELECT marker_id, sample_id, height, CAST(row_number() OVER c AS INT) AS rank, height / max(height) OVER (PARTITION BY marker_id, sample_id) AS ratio
FROM alleles WINDOW c AS (PARTITION BY marker_id, sample_id ORDER BY height DESC, allele_id, size)""")
def ratio_rank(spark, d):
    return ops.ranked(catalog.alleles(spark, d)).select("marker_id", "sample_id", "height", "rank", "ratio")


@query(core(_REL) + f"SELECT label, {FRAME} FROM f")
def rel_threshold(spark, d):
    return frame(spark, d, _REL)


@query(core(_CUTOFF) + f"SELECT label, {FRAME} FROM f")
def rel_cutoff_group_drop(spark, d):
    return frame(spark, d, _CUTOFF)


@query(core(_STUTTER) + f"SELECT label, {FRAME} FROM f")
def stutter_filter(spark, d):
    return frame(spark, d, _STUTTER)


@query(core() + f"SELECT label, {FRAME} FROM f")
def core_query_full(spark, d):
    return frame(spark, d)


@query(core() + f"SELECT label, {FRAME} FROM top")
def dominant_alleles(spark, d):
    return views.dominant(frame(spark, d)).select("label", *ops.FRAME)


@query(core() + "SELECT label, marker_id, value, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def allele_distribution(spark, d):
    return views.distribution(frame(spark, d))


@query(core() + "SELECT label, marker_id, value, count(*)::BIGINT AS n FROM top GROUP BY ALL")
def dominant_distribution(spark, d):
    return views.distribution(views.dominant(frame(spark, d)))


def _lists(what: str) -> str:
    cols = ", ".join(f"array_to_string(list({what} ORDER BY height DESC) FILTER (marker_id = {m}), ',') AS m{m}" for m in MARKERS)
    return core() + f"SELECT label, sample_id, {cols} FROM f GROUP BY ALL"


@query(_lists("value"))
def genotype_pivot(spark, d):
    wide = views.genotypes(frame(spark, d), MARKERS)
    return wide.select("label", "sample_id", *(F.when(F.size(f"m{m}") > 0, F.array_join(F.transform(f"m{m}", lambda x: x.cast("string")), ",")).alias(f"m{m}") for m in MARKERS))


@query(core(WIDE) + f"SELECT label, sample_id, {', '.join(f'max(value) FILTER (marker_id = {m}) AS m{m}' for m in MARKERS)} FROM ml GROUP BY ALL HAVING count(*) = 7")
def mlgt_pivot(spark, d):
    own = views.complete_genotypes(frame(spark, d, WIDE), MARKERS)
    return own.select("label", "sample_id", *(F.get("genotype", F.lit(i)).alias(f"m{m}") for i, m in enumerate(MARKERS)))


@query(core(WIDE) + "SELECT label, min(sample_id) AS sample_id, array_to_string(list_transform(genotype, lambda x: CAST(x * 100 AS BIGINT)), ',') AS genotype FROM g GROUP BY label, genotype")
def unique_mlgt(spark, d):
    own = views.unique_genotypes(views.complete_genotypes(frame(spark, d, WIDE), MARKERS))
    return own.select("label", "sample_id", F.array_join(F.transform("genotype", lambda x: F.bround(x * 100, 0).cast("long").cast("string")), ",").alias("genotype"))


@query(core() + f"SELECT label, sample_id, {', '.join(f'count(*) FILTER (marker_id = {m})::BIGINT AS m{m}' for m in MARKERS)} FROM f GROUP BY ALL")
def allele_multiplicity(spark, d):
    return views.pivoted(frame(spark, d), MARKERS, F.count("value"), fill=0)


@query(core() + "SELECT * FROM moi")
def sample_multiplicity(spark, d):
    return views.sample_multiplicity(frame(spark, d))


@query(core() + "SELECT label, sample_id, marker_id, CASE WHEN n > 1 THEN 1 ELSE 0 END AS several FROM cells")
def locus_multiplicity(spark, d):
    return views.locus_multiplicity(frame(spark, d))


@query(core() + f"SELECT label, sample_id, {', '.join(f'nullif(count(*) FILTER (marker_id = {m}), 0)::BIGINT AS m{m}' for m in MARKERS)} FROM f GROUP BY ALL")
def marker_df(spark, d):
    return views.pivoted(views.multiplicity(frame(spark, d)), MARKERS, F.first("n"))


@query(core() + "SELECT label, sample_id, array_to_string(list_sort(list(DISTINCT marker_id)), ',') AS markers FROM f GROUP BY ALL")
def sample_marker_set(spark, d):
    own = views.sample_markers(frame(spark, d))
    return own.withColumn("markers", F.array_join(F.transform("markers", lambda x: x.cast("string")), ","))


@query(core(PARAMS) + f"SELECT marker_id, {fixed('corr(x.value, y.value)')} AS r, count(*)::BIGINT AS n FROM (SELECT sample_id, marker_id, value FROM ml WHERE marker_id = 1) x JOIN (SELECT sample_id, value FROM ml WHERE marker_id = 2) y USING (sample_id) GROUP BY ALL")
def marker_correlation(spark, d):
    own = views.multilocus(frame(spark, d))
    x, y = own.where("marker_id = 1").select("sample_id", "marker_id", F.col("value").alias("x")), own.where("marker_id = 2").select("sample_id", F.col("value").alias("y"))
    return x.join(y, "sample_id").groupBy("marker_id").agg(stable(F.corr("x", "y")).alias("r"), F.count("*").alias("n"))
