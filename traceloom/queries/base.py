"""The registry, the parameters the queries share, and pieces of SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import catalog
from ..operators.core import AlleleFilter, allele_frame

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: The frame that most queries start from.
PARAMS = AlleleFilter(abs_threshold=12000.0, rel_threshold=0.2, stutter_ratio=0.5, stutter_range=3.5, peak_types=("bin", "called"))
#: As above, with all kinds of peaks, so that most samples have all markers.
WIDE = AlleleFilter(abs_threshold=2000.0, rel_threshold=0.1, stutter_ratio=0.3, peak_types=None)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, folder) under its own or another name."""

    def add(fn):
        REGISTRY[name or fn.__name__] = (fn, sql)
        return fn

    return add


def frame(spark: SparkSession, folder: str, params: AlleleFilter = PARAMS) -> DataFrame:
    return allele_frame(catalog.alleles(spark, folder), params, catalog.samples(spark, folder))


def fixed(expr: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5001::DOUBLE) / {scale})"


def core(p: AlleleFilter = PARAMS) -> str:
    """Common table expressions up to f, the allele frame with labels."""
    types = "TRUE" if p.peak_types is None else "type IN (" + ", ".join(f"'{t}'" for t in p.peak_types) + ")"
    cell = "PARTITION BY marker_id, sample_id"
    near = f"(abs(d.size - k.size) < {p.stutter_range} AND k.height / d.height < {p.stutter_ratio}) OR (abs(d.size - k.size) < {p.stutter_baserange} AND k.height / d.height < {p.stutter_baseratio})"
    keep = f"WHERE NOT EXISTS (SELECT 1 FROM k d WHERE d.marker_id = k.marker_id AND d.sample_id = k.sample_id AND d.rank < k.rank AND ({near}))" if p.stutter_ratio else ""
    cut = f"rank = 2 AND ratio > {p.rel_cutoff} AND ratio >= {p.rel_threshold}" if p.rel_cutoff else "FALSE"
    return f"""WITH {catalog.SQL},
r AS (SELECT s.label, a.*, CAST(row_number() OVER ({cell} ORDER BY height DESC, allele_id, size) AS INT) AS rank, height / max(height) OVER ({cell}) AS ratio
  FROM alleles a JOIN samples s USING (sample_id) WHERE {types} AND height > {p.abs_threshold}),
c AS (SELECT *, max(CASE WHEN {cut} THEN 1 ELSE 0 END) OVER ({cell}) AS gone FROM r),
k AS (SELECT * FROM c WHERE gone = 0 AND (rank = 1 OR ratio >= {p.rel_threshold})),
f AS (SELECT label, marker_id, sample_id, value, size, height, assay_id, allele_id, ratio, rank FROM k {keep}),
top AS (SELECT * EXCLUDE (h) FROM (SELECT *, max(height) OVER ({cell}) AS h FROM f) WHERE height = h),
cells AS (SELECT label, sample_id, marker_id, count(*)::BIGINT AS n FROM f GROUP BY ALL),
moi AS (SELECT label, sample_id, max(n) AS moi, count(*) FILTER (n > 1)::BIGINT AS mloci FROM cells GROUP BY ALL),
ml AS (SELECT label, sample_id, marker_id, avg(value)::DOUBLE AS value FROM top GROUP BY ALL),
g AS (SELECT label, sample_id, list(value ORDER BY marker_id) AS genotype FROM ml GROUP BY ALL HAVING count(*) = 7)
"""


FRAME = "marker_id, sample_id, value, size, height, assay_id, allele_id, ratio, rank"
