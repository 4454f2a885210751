"""The core query: alleles of sample sets, ranked inside each cell of marker and sample, without noise and stutter."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import small

CELL = ("marker_id", "sample_id")
FRAME = ("marker_id", "sample_id", "value", "size", "height", "assay_id", "allele_id", "ratio", "rank")


@dataclass(frozen=True)
class AlleleFilter:
    """What counts as an allele, a sample and a marker. Thresholds of zero are off."""

    abs_threshold: float = 0.0
    rel_threshold: float = 0.0
    rel_cutoff: float = 0.0
    sample_quality: float = 0.0
    marker_quality: float = 0.0
    peak_types: tuple[str, ...] | None = ("bin",)
    sample_filtering: str = "N"
    stutter_ratio: float = 0.0
    stutter_range: float = 3.5
    stutter_baserange: float = 4.5
    stutter_baseratio: float = 0.1
    markers: tuple[str, ...] = field(default=())
    marker_ids: tuple[int, ...] = field(default=())

    def __post_init__(self):
        if not 0 <= self.stutter_ratio <= 1 or not 0 <= self.stutter_baseratio <= 1:
            raise ValueError("stutter ratios must be from 0 to 1")
        if self.sample_filtering.upper() not in "NMSU" or len(self.sample_filtering) != 1:
            raise ValueError("sample_filtering must be N, M, S or U")

    @staticmethod
    def from_dict(spec: dict) -> AlleleFilter:
        """Keys as in a query's text; the names of markers may come as one text with commas."""
        names = {"sample_qual_threshold": "sample_quality", "marker_qual_threshold": "marker_quality"}
        missing = {"abs_threshold", "rel_threshold", "rel_cutoff", "sample_qual_threshold", "marker_qual_threshold"} - set(spec)
        if missing:
            raise ValueError(f"the filter lacks {', '.join(sorted(missing))}")
        own = {names.get(k, k): v for k, v in spec.items()}
        for key in ("markers", "marker_ids", "peak_types"):
            if isinstance(own.get(key), str):
                own[key] = [x.strip() for x in own[key].split(",") if x.strip()]
            if own.get(key) is not None:
                own[key] = tuple(own[key])
        return AlleleFilter(**{k: v for k, v in own.items() if v is not None or k == "peak_types"})

    @property
    def plain(self) -> bool:
        return not (self.rel_threshold or self.rel_cutoff or self.stutter_ratio)


def of_types(alleles: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
    return alleles if types is None else alleles.where(F.col("type").isin(*types))


def join_revisions(allelesets: DataFrame, alleles: DataFrame, channels: DataFrame, latest_only: bool = False) -> DataFrame:
    """Stored rows in the shape of the alleles table: sample_id and the set's marker come from the allele's revision, assay_id from its channel.

    Every revision of a channel counts; with latest_only only that of the greatest id.
    """
    if latest_only:
        newest = Window.partitionBy("channel_id").orderBy(F.col("alleleset_id").desc())
        allelesets = allelesets.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    own = allelesets.select("alleleset_id", "channel_id", "sample_id", F.col("marker_id").alias("set_marker_id"))
    return alleles.join(own, "alleleset_id").join(channels.select("channel_id", "assay_id"), "channel_id")


def ranked(alleles: DataFrame) -> DataFrame:
    """Adds rank from 1 by falling height and ratio to the greatest height of the cell. Ties go by allele_id."""
    cell = Window.partitionBy(*CELL)
    order = cell.orderBy(F.col("height").desc(), F.col("allele_id"), F.col("size"))
    return alleles.withColumn("rank", F.row_number().over(order)).withColumn("ratio", F.col("height") / F.max("height").over(cell))


def without_stutter(cells: DataFrame, ratio: float, reach: float, base_reach: float, base_ratio: float) -> DataFrame:
    """Drops rows that are stutter of a higher row of their cell, itself stutter or not.

    A frame over size gathers the rows within reach only, however large the cell, and no row joins another. Both ratios are at
    most 1, so a row that is not higher never counts.
    """
    wide = max(reach, base_reach) * (1 + 1e-9)  # the frame's ends are rounded; the rule itself is exact
    near = F.expr(f"collect_list(struct(size, height)) OVER (PARTITION BY {', '.join(CELL)} ORDER BY size RANGE BETWEEN {wide!r}D PRECEDING AND {wide!r}D FOLLOWING)")
    away, share = lambda d: F.abs(d["size"] - F.col("size")), lambda d: F.col("height") / d["height"]
    rule = F.exists("_near", lambda d: ((away(d) < reach) & (share(d) < ratio)) | ((away(d) < base_reach) & (share(d) < base_ratio)))
    return cells.withColumn("_near", near).where(~rule).drop("_near")


def allele_frame(alleles: DataFrame, params: AlleleFilter, sets: DataFrame | None = None, markers: DataFrame | None = None, by_sample: bool = False, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """label (where sets has one) and the columns of FRAME.

    Rows of samples in sets (label, sample_id; disjoint) and markers (marker_id) whose type counts and whose height exceeds
    abs_threshold are ranked by falling height inside each cell of marker and sample. Then, in this order: rows below
    rel_threshold of the cell's greatest height go; the whole cell goes if its second row is kept but above rel_cutoff; rows
    that are stutter go, without closing the gap in the ranks. If none of these rules is on, ratio is 1 and rank -1.
    Filters on samples, markers, types and heights reach the scan; one exchange by cell serves all windows. by_sample deals
    rows by sample instead, which serves windows over whole samples too. refine is a caller's own rule on the scanned rows, before
    any ranking; it may filter them, but must keep their columns.
    """
    rows = of_types(alleles, params.peak_types)
    if refine is not None:
        rows = refine(rows)
    if params.abs_threshold > 0:
        rows = rows.where(F.col("height") > params.abs_threshold)
    marker = "set_marker_id" if "set_marker_id" in rows.columns else "marker_id"
    if params.marker_ids:
        rows = rows.where(F.col(marker).isin(*params.marker_ids))
    if markers is not None:
        rows = rows.join(small(markers.select(F.col("marker_id").alias(marker))), marker, "left_semi")
    label = [] if sets is None or "label" not in sets.columns else ["label"]
    if sets is not None:
        rows = rows.join(sets.select("sample_id", *label), "sample_id")
    if params.plain:
        return rows.withColumn("ratio", F.lit(1.0)).withColumn("rank", F.lit(-1)).select(*label, *FRAME)
    cells = ranked(rows.repartition("sample_id") if by_sample else rows)
    kept = (F.col("rank") == 1) | (F.col("ratio") >= params.rel_threshold)
    if params.rel_cutoff > 0:
        second = (F.col("rank") == 2) & (F.col("ratio") > params.rel_cutoff) & (F.col("ratio") >= params.rel_threshold)
        cells = cells.withColumn("_two", F.max(F.when(second, 1).otherwise(0)).over(Window.partitionBy(*CELL))).where("_two = 0").drop("_two")
    cells = cells.where(kept)
    if params.stutter_ratio > 0:
        cells = without_stutter(cells, params.stutter_ratio, params.stutter_range, params.stutter_baserange, params.stutter_baseratio)
    return cells.select(*label, *FRAME)
