"""A query: a selector of sample sets and a filter, and what follows from them, as one lazy chain."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.stable import fixed
from ..operators import quality, sets, statistics, views
from ..operators.core import AlleleFilter, allele_frame
from ..sources import exports
from ..sources.manifests import load_document


class Query:
    """Sets, filtered sets and frames of a specification {'selector': ..., 'filter': ...} over a catalog.

    The filter on samples comes first, over all wanted markers; that on markers then counts the samples that are left. Cells
    of marker and sample stand alone, so the ranked frame of all samples is also that of those left. Rows are dealt by sample
    once, for ranks and the filter on samples; the filter on markers is one more pass, as it needs all samples.
    """

    def __init__(self, spec: str | dict, tables: Catalog, refine: Callable[[DataFrame, dict], DataFrame] | None = None):
        doc = load_document(spec)
        if unknown := set(doc) - {"selector", "filter", "options"}:
            raise ValueError(f"unknown parts of a query: {', '.join(sorted(unknown))}")
        self.selector, self.params, self.tables, self.refine = doc["selector"], AlleleFilter.from_dict(doc["filter"]), tables, refine

    @cached_property
    def markers(self) -> list[int]:
        """Ids of the wanted markers; a handful."""
        own = self.tables.markers
        if self.params.markers:
            own = own.where(F.lower("code").isin(*[m.lower() for m in self.params.markers]))
        ids = sorted(r.marker_id for r in own.select("marker_id").collect())
        if self.params.marker_ids:
            ids = [i for i in ids if i in self.params.marker_ids]
        if not ids:
            raise ValueError("no marker is wanted")
        return ids

    @cached_property
    def sample_sets(self) -> DataFrame:
        return sets.select_samples(self.tables.samples, self.selector, refine=self.refine)

    @cached_property
    def _wanted(self) -> DataFrame:
        return self.tables.markers.where(self.tables.markers["marker_id"].isin(*self.markers))

    @cached_property
    def frames(self) -> DataFrame:
        """The allele frame of all sets."""
        return allele_frame(self.tables.alleles, self.params, self.sample_sets, self._wanted, by_sample=True)

    @cached_property
    def filtered_sample_sets(self) -> DataFrame:
        good = self._of_good_samples.select("label", "sample_id").distinct()
        return self.sample_sets.join(good, ["label", "sample_id"], "left_semi")

    @cached_property
    def _of_good_samples(self) -> DataFrame:
        good = quality.with_good_samples(self.frames, len(self.markers), self.params.sample_quality)
        if self.params.sample_filtering.upper() == "N":
            return good
        kept = quality.filtered_samples(self.frames, self.markers, self.params.sample_quality, self.params.sample_filtering)
        return good.join(kept, ["label", "sample_id"], "left_semi")

    @cached_property
    def filtered_markers(self) -> DataFrame:
        return quality.good_markers(self._of_good_samples, self.params.marker_quality)

    @cached_property
    def filtered_frames(self) -> DataFrame:
        """The allele frame of good samples and good markers."""
        # no more rows than wanted markers
        return self._of_good_samples.join(F.broadcast(self.filtered_markers.select("marker_id")), "marker_id", "left_semi")

    @cached_property
    def haplotypes(self) -> DataFrame:
        """(label, sample_id, genotype) over the good markers."""
        ids = sorted(r.marker_id for r in self.filtered_markers.select("marker_id").collect())
        return views.complete_genotypes(self.filtered_frames, ids)

    def sample_summary(self, mode: str | None = None) -> DataFrame:
        """(label, initial, filtered, and complete with mode 'mlgt')."""
        complete = self.haplotypes if mode == "mlgt" else None
        return quality.sample_summary(self.sample_sets, self.filtered_sample_sets, complete)

    def allele_summary(self) -> DataFrame:
        return statistics.adjacency(statistics.allele_summary(self.filtered_frames))

    def export(self, path: str, form: str = "major_tab") -> None:
        exports.export(self.filtered_frames, self.tables.samples, self.tables.markers, self.markers, path, form)


def allele_report(summary: DataFrame) -> DataFrame:
    """(label, marker_id, value, line): one text line an allele; numbers are rounded with ties up."""
    flag = F.when(F.col("isolated"), "").otherwise("*")
    return summary.select("label", "marker_id", "value", F.format_string("%3d\t%5.3f\t%3d\t%7.1f\t%6.2f - %6.2f (%5.2f)\t%s", F.col("value").cast("long"), fixed(F.col("freq"), 3), F.col("n").cast("long"), fixed(F.col("mean_height"), 1), fixed(F.col("min_size"), 2), fixed(F.col("max_size"), 2), fixed(F.col("delta"), 2), flag).alias("line"))


def sample_report(totals: DataFrame) -> DataFrame:
    return totals.select("label", F.format_string("%s\t%d", "label", F.col("n").cast("long")).alias("line"))
