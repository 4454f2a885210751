"""Changes of stored tables as plans: lookups, upserts, deletes, and checks that a database would make."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_code(table: DataFrame, codes: str | Sequence[str] | None = None, column: str = "code") -> DataFrame:
    """Rows of these codes without regard to case; all if None."""
    if codes is None:
        return table
    wanted = [codes] if isinstance(codes, str) else list(codes)
    return table.where(F.lower(column).isin(*[c.lower() for c in wanted]))


def require_codes(table: DataFrame, codes: Sequence[str], column: str = "code") -> DataFrame:
    found = {r[0] for r in by_code(table, codes, column).select(F.lower(column)).distinct().limit(len(codes) + 1).collect()}
    if missing := sorted({c.lower() for c in codes} - found):
        raise KeyError(f"no row with the code {', '.join(missing)}")
    return by_code(table, codes, column)


def by_id(table: DataFrame, ids: Sequence[int], column: str) -> DataFrame:
    return table.where(F.col(column).isin(*ids))


def upsert(table: DataFrame, news: DataFrame, keys: Sequence[str], fold: Sequence[str] = ()) -> DataFrame:
    """table with news: rows of the same keys take the new values that are not null, others are added.

    Keys named in fold compare without case, and keep the stored spelling. Columns that only table has stay, or are null in
    added rows. News of one key must be one row.
    """
    key = lambda df, k: F.lower(df[k]) if k in fold else df[k]
    old = table.select(*(key(table, k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*table.columns).alias("_old"))
    new = news.select(*(key(news, k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*news.columns).alias("_new"))
    both = old.join(new, [f"_k{i}" for i in range(len(keys))], "full")
    return both.select(*(F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")).alias(c) if c in keys and c in news.columns else F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) if c in news.columns else F.col(f"_old.{c}").alias(c) for c in table.columns))


def append(table: DataFrame, news: DataFrame) -> DataFrame:
    return table.unionByName(news, allowMissingColumns=True)


def repeated(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def without(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, chain: Sequence[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Deletes rows and all that hangs on them. gone has the first table's id; chain lists (table, own id, id of the one before).

    A table whose own id is that of the one before loses the rows of these ids, without a second reading of itself.
    """
    out, ids = dict(tables), gone
    for i, (name, own, parent) in enumerate(chain):
        key = own if i == 0 else parent
        ids = ids.withColumnRenamed(ids.columns[0], key).select(key)
        lost = tables[name].join(ids.distinct(), key, "left_semi")
        out[name] = without(tables[name], ids if key == own else lost, [own])
        ids = lost.select(own)
    return out


def latest_revisions(allelesets: DataFrame) -> DataFrame:
    """The revision of greatest id of each channel."""
    newest = Window.partitionBy("channel_id").orderBy(F.col("alleleset_id").desc())
    return allelesets.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def rename_files(assays: DataFrame, manifest: DataFrame) -> DataFrame:
    """filename by a table of (sample, filename, newname)."""
    new = manifest.select("sample", "filename", F.col("newname").alias("_new"))
    return assays.join(new, ["sample", "filename"], "left").withColumn("filename", F.coalesce("_new", "filename")).drop("_new").select(*assays.columns)


def reassign(assays: DataFrame, manifest: DataFrame) -> DataFrame:
    """panel by a table of (sample, filename, panel)."""
    new = manifest.select("sample", "filename", F.col("panel").alias("_new"))
    return assays.join(new, ["sample", "filename"], "left").withColumn("panel", F.coalesce("_new", "panel")).drop("_new").select(*assays.columns)


def reassign_marker(allelesets: DataFrame, marker: int, to: int, assays: DataFrame | None = None) -> DataFrame:
    """marker_id from one to another, of all rows or those of some assays."""
    hit = F.col("marker_id") == marker
    own = allelesets
    if assays is not None:
        own = own.join(assays.select("assay_id", F.lit(True).alias("_in")).distinct(), "assay_id", "left")
        hit = hit & F.col("_in").isNotNull()
    return own.withColumn("marker_id", F.when(hit, F.lit(to)).otherwise(F.col("marker_id"))).select(*allelesets.columns)


def assay_list(batches: DataFrame, samples: DataFrame, assays: DataFrame, batch: str, codes: Sequence[str] | None = None, filenames: Sequence[str] | None = None) -> DataFrame:
    """Assays of a batch, of some samples and files if given."""
    own = samples.join(by_code(batches, batch).select("batch_id"), "batch_id", "left_semi")
    own = by_code(own, codes)
    out = assays.join(own.select("sample_id", F.col("code").alias("sample")), "sample_id")
    return out if filenames is None else out.where(F.col("filename").isin(*filenames))


def cache_key(batch, sample, filename, runtime, dye):
    """The name under which a channel's peaks are kept."""
    return F.concat_ws("|", batch, sample, filename, runtime, F.upper(dye))


def cache_counts(cache: DataFrame) -> DataFrame:
    """(batch, n): kept channels by the batch in their names."""
    return cache.groupBy(F.substring_index("key", "|", 1).alias("batch")).agg(F.count("*").alias("n"))
