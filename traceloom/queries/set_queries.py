"""Selection of samples, set algebra, quality of samples and markers."""
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import MARKERS, catalog as tables
from ..operators import quality, sets
from ..operators.core import AlleleFilter
from ..plans.query import Query, allele_report, sample_report
from .base import WIDE, core, fixed, frame, query

_S = f"WITH {catalog.SQL} "


def _picked(spark, d, selector):
    return sets.select_samples(catalog.samples(spark, d), selector)


@query(_S + "SELECT '-' AS label, 'blue' AS colour, sample_id FROM samples WHERE lower(batch) = 'brand#12'")
def select_by_batch(spark, d):
    return _picked(spark, d, [{"batch": "brand#12"}])


@query(_S + "SELECT 'x' AS label, '#1f78b4' AS colour, sample_id FROM samples WHERE lower(code) IN ('small ring', 'red widget') AND lower(batch) = 'brand#2'")
def select_by_codes(spark, d):
    return _picked(spark, d, {"x": [{"codes": ["Small Ring", "red widget"], "batch": "Brand#2"}]})


@query(_S + "SELECT CASE WHEN sample_id < 10 THEN 'low' ELSE 'high' END AS label, CASE WHEN sample_id < 10 THEN '#1f78b4' ELSE '#33a02c' END AS colour, sample_id FROM samples WHERE sample_id IN (1, 2, 3, 9, 50, 51)")
def select_by_ids(spark, d):
    return _picked(spark, d, {"low": [{"ids": [1, 2, 3, 9]}], "high": [{"sample_ids": [50, 51]}]})


@query(_S + "SELECT 'u' AS label, '#1f78b4' AS colour, sample_id FROM samples WHERE (lower(batch) = 'brand#3' AND category = 10) OR (lower(batch) = 'brand#7') OR (lower(label) = 'promo' AND NOT (lower(batch) = 'brand#1' OR lower(code) = 'red widget'))")
def select_union_filtered(spark, d):
    own = catalog.samples(spark, d).withColumn("tag", F.translate("code", " ", "_"))
    return sets.select_samples(own, {"u": [{"batch": "Brand#3", "category": 10}, {"batch": "brand#7"}, {"query": "PROMO[label] & !(Brand#1[batch] | red_widget[tag])"}]})


@query(_S + "SELECT sample_id, 2::BIGINT AS labels FROM samples WHERE lower(batch) = 'brand#4' AND category < 20")
def sample_set_overlap_check(spark, d):
    own = catalog.samples(spark, d)
    both = own.where("lower(batch) = 'brand#4'").select(F.lit("a").alias("label"), "sample_id").unionByName(own.where("category < 20").select(F.lit("b").alias("label"), "sample_id"))
    return sets.shared_samples(both)


@query(_S + "SELECT label, sample_id FROM samples WHERE sample_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def sample_set_intersect(spark, d):
    seen = catalog.alleles(spark, d).where("type = 'stutter' and value > 45").select("sample_id")
    return sets.restrict(catalog.samples(spark, d).select("label", "sample_id"), seen).select("label", "sample_id")


@query(_S + "SELECT label, count(*)::BIGINT AS n FROM samples GROUP BY ALL")
def sample_set_totals(spark, d):
    return sets.set_totals(catalog.samples(spark, d))


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 30), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_linenumber = 6 AND l_quantity > 30)
SELECT id, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT id, 'right' AS side FROM (FROM b EXCEPT FROM a)""")
def marker_symmetric_difference(spark, d):
    rows = catalog.alleles(spark, d).where("value > 30").select("marker_id", F.col("assay_id").alias("id"))
    return sets.symmetric_difference(rows.where("marker_id = 7").select("id"), rows.where("marker_id = 6").select("id"))


_GENOTYPED = "q AS (SELECT label, sample_id, count(DISTINCT marker_id)::BIGINT AS genotyped FROM f GROUP BY ALL)"


@query(core() + f", {_GENOTYPED} SELECT * FROM q WHERE genotyped >= 7 * 0.8")
def sample_quality(spark, d):
    return quality.sample_quality(frame(spark, d), len(MARKERS), 0.8)


#: Few alleles a cell, so that samples of one allele everywhere exist.
_LEAN = AlleleFilter(abs_threshold=30000.0, rel_threshold=0.9, peak_types=("bin", "called"))


@query(core() + f", {_GENOTYPED} SELECT label, genotyped, count(*)::BIGINT AS samples FROM q GROUP BY ALL")
def genotyped_distribution(spark, d):
    return quality.sample_quality(frame(spark, d), len(MARKERS), 0.0).groupBy("label", "genotyped").agg(F.count("*").alias("samples"))


def _good(also: str, params: AlleleFilter = _LEAN) -> str:
    return core(params) + f", {_GENOTYPED} SELECT label, sample_id FROM q WHERE genotyped >= 7 * 0.5 AND (label, sample_id) IN ({also})"


@query(_good("SELECT (label, sample_id) FROM moi WHERE moi = 1"))
def monoclonal_samples(spark, d):
    return quality.filtered_samples(frame(spark, d, _LEAN), MARKERS, 0.5, "M")


@query(_good("SELECT (label, sample_id) FROM moi WHERE mloci <= 1"))
def low_complexity_samples(spark, d):
    return quality.filtered_samples(frame(spark, d, _LEAN), MARKERS, 0.5, "S")


@query(_good("SELECT (label, min(sample_id)) FROM g GROUP BY label, genotype", WIDE))
def unique_haplotype_samples(spark, d):
    return quality.filtered_samples(frame(spark, d, WIDE), MARKERS, 0.5, "U")


@query(core() + """, n AS (SELECT label, count(*) AS n FROM samples GROUP BY ALL), q AS (SELECT label, marker_id, count(DISTINCT sample_id) AS k FROM f GROUP BY ALL)
SELECT n.label, m.marker_id, coalesce(k, 0)::BIGINT AS genotyped, coalesce(k, 0) >= n.n * 0.7 AS passed FROM n CROSS JOIN markers m LEFT JOIN q ON q.label = n.label AND q.marker_id = m.marker_id""")
def marker_quality_per_set(spark, d):
    return quality.set_marker_quality(frame(spark, d), sets.set_totals(catalog.samples(spark, d)), MARKERS, 0.7)


@query(core() + "SELECT marker_id, count(DISTINCT sample_id)::BIGINT AS genotyped FROM f GROUP BY ALL HAVING count(DISTINCT sample_id) > (SELECT count(*) FROM samples) * 0.7")
def marker_quality_total(spark, d):
    return quality.marker_quality(frame(spark, d), sets.set_totals(catalog.samples(spark, d)), 0.7)


_LABELS = ("ECONOMY", "PROMO", "STANDARD")
#: Selects three labels, filters samples and markers.
SPEC = {
    "selector": {x.title(): [{"query": f"{x}[label]"}] for x in _LABELS},
    "filter": {"abs_threshold": 12000.0, "rel_threshold": 0.2, "rel_cutoff": 0, "sample_qual_threshold": 0.7, "marker_qual_threshold": 0.75, "stutter_ratio": 0.5, "stutter_range": 3.5, "peak_types": ["bin", "called"]},
}


def built(spark, d) -> Query:
    return Query(SPEC, tables(spark, d))


_PIPE = (
    core()
    + """, own AS (SELECT CASE label WHEN 'ECONOMY' THEN 'Economy' WHEN 'PROMO' THEN 'Promo' ELSE 'Standard' END AS label, sample_id FROM samples WHERE label IN ('ECONOMY', 'PROMO', 'STANDARD')),
ff AS (SELECT own.label, f.* EXCLUDE (label) FROM f JOIN own USING (sample_id)),
good AS (SELECT label, sample_id FROM ff GROUP BY ALL HAVING count(DISTINCT marker_id) >= 7 * 0.7),
fg AS (SELECT ff.* FROM ff SEMI JOIN good USING (sample_id)),
gm AS (SELECT marker_id FROM fg GROUP BY ALL HAVING count(DISTINCT sample_id) > (SELECT count(*) FROM good) * 0.75),
final AS (SELECT fg.* FROM fg SEMI JOIN gm USING (marker_id)) """
)


@query(_PIPE + "SELECT label, marker_id, sample_id, value, size, height, rank FROM final")
def filtered_frames(spark, d):
    return built(spark, d).filtered_frames.select("label", "marker_id", "sample_id", "value", "size", "height", "rank")


@query(_PIPE + "SELECT * FROM (SELECT label, count(*)::BIGINT AS initial FROM own GROUP BY ALL) JOIN (SELECT label, count(*)::BIGINT AS filtered FROM good GROUP BY ALL) USING (label)")
def sample_summary(spark, d):
    return built(spark, d).sample_summary()


@query(_PIPE + "SELECT label, count(*)::BIGINT AS samples FROM (SELECT label, sample_id FROM final GROUP BY ALL HAVING count(DISTINCT marker_id) = (SELECT count(*) FROM gm)) GROUP BY ALL")
def haplotype_sets(spark, d):
    return built(spark, d).haplotypes.groupBy("label").agg(F.count("*").alias("samples"))


_NUMBERS = ", ".join(("value", fixed("freq", 3), "n", fixed("mh", 1), fixed("low", 2), fixed("high", 2), fixed("high - low", 2)))


@query(
    _PIPE
    + f""", s AS (SELECT label, marker_id, value, count(*)::BIGINT AS n, avg(height) AS mh, min(size) AS low, max(size) AS high FROM final GROUP BY ALL),
p AS (SELECT *, n / (sum(n) OVER (PARTITION BY label, marker_id))::DOUBLE AS freq, value - lag(value) OVER w AS l, lead(value) OVER w - value AS r FROM s WINDOW w AS (PARTITION BY label, marker_id ORDER BY value))
SELECT label, printf('%3d\t%5.3f\t%3d\t%7.1f\t%6.2f - %6.2f (%5.2f)\t%s', {_NUMBERS}, CASE WHEN r IS NULL OR NOT (coalesce(l, 2) <= 1 OR r <= 1) THEN '' ELSE '*' END) AS line FROM p
UNION ALL SELECT label, printf('%s\t%d', label, count(*)) FROM good GROUP BY label"""
)
def text_reports(spark, d):
    own = built(spark, d)
    alleles = allele_report(own.allele_summary()).select(F.col("label"), "line")
    return sample_report(sets.set_totals(own.filtered_sample_sets)).unionByName(alleles)
