"""Embedding near-duplicates: p-stable hashing into buckets of several tables, then exact cosines inside buckets."""
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, components, connected, durable, small_batches

#: Tables, projections in each, and the width of a projection's step over unit vectors. Two unit vectors at cosine 0.98 are
#: 0.2 apart and share one projection's step with probability 0.84, so at least one table with 1 - (1 - 0.84 ** 10) ** 24 = 0.99.
TABLES, PROJECTIONS, WIDTH = 24, 10, 1.0
#: Vectors of one bucket that are compared in one piece; larger buckets are split into pairs of blocks.
BLOCK = 1024


class PStable:
    """Floors of (a . x + b) / width with normal a, for unit vectors of one dimension."""

    def __init__(self, dim: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH):
        rng = np.random.default_rng(1000 + dim)
        self.tables, self.projections, self.width = tables, projections, width
        self.a = rng.standard_normal((dim, tables * projections))
        self.b = rng.uniform(0, width, tables * projections)
        self.mix = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket numbers."""
        steps = np.floor((unit @ self.a + self.b) / self.width).astype(np.int64)
        with np.errstate(over="ignore"):
            return (steps.reshape(len(unit), self.tables, self.projections) * self.mix).sum(axis=2)


_HASHERS: dict[int, PStable] = {}


def _hasher(dim: int) -> PStable:
    if dim not in _HASHERS:
        _HASHERS[dim] = PStable(dim)
    return _HASHERS[dim]


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All components in a row, and where each vector starts and ends."""
    lists = column(batch, "embedding")
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False).astype(np.float64), offsets


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = _vectors(batch)
        size, cid = np.diff(offsets), column(batch, "cid").to_numpy()
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            x = flat[(offsets[:-1][at][:, None] + np.arange(dim))]
            keys = _hasher(int(dim)).keys(_unit(x))
            n, t = keys.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[at], t)), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(keys.ravel())], ["cid", "t", "bucket"])


def _compare(own: dict[str, np.ndarray], dim: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, links): a spanning forest of the group's links, then (a, a, n) with the members a class links to in this group.

    A pair counts only in the first table whose bucket it shares. In a pair of blocks only pairs across them count.
    """
    unit, cid, count, side, table = _unit(own["x"]), own["cid"], own["count"], own["side"], int(own["t"][0])
    keys = _hasher(dim).keys(unit)[:, :table]
    n = len(cid)
    links = np.zeros(n, np.int64)
    us, vs = [], []
    for i in range(0, n, BLOCK):
        a, b = np.nonzero(unit[i : i + BLOCK] @ unit.T >= least)
        a += i
        keep = a < b
        if own["across"]:
            keep &= side[a] != side[b]
        a, b = a[keep], b[keep]
        if table:
            first = ~(keys[a] == keys[b]).any(axis=1)
            a, b = a[first], b[first]
        np.add.at(links, a, count[b])
        np.add.at(links, b, count[a])
        us.append(a)
        vs.append(b)
    label = components(n, np.concatenate(us), np.concatenate(vs))
    moved, linked = np.flatnonzero(label != np.arange(n)), np.flatnonzero(links)
    return np.concatenate([cid[moved], cid[linked]]), np.concatenate([cid[label[moved]], cid[linked]]), np.concatenate([np.zeros(len(moved), np.int64), links[linked]])


def _linked(least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group; a group is at most two blocks, or one."""
    kept: pa.Table | None = None

    def groups(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        table = table.combine_chunks()
        cols = [table.column(c).to_numpy() for c in ("t", "label", "dim", "bucket", "low", "high")]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        starts = [0, *edge.tolist(), table.num_rows]
        stop = len(starts) - 1 if last else len(starts) - 2
        out = []
        batch = table.to_batches()[0]
        flat, offsets = _vectors(batch)
        offsets = offsets.astype(np.int64)
        cid, count, side = (column(batch, c).to_numpy() for c in ("cid", "n", "side"))
        parts = []
        for s, e in zip(starts[:stop], starts[1 : stop + 1], strict=True):
            if e - s > 1:
                dim = int(cols[2][s])
                x = flat[offsets[s] - offsets[0] : offsets[e] - offsets[0]].reshape(e - s, dim) if offsets[0] == 0 else flat[offsets[s] : offsets[e]].reshape(e - s, dim)
                parts.append(_compare({"x": x, "cid": cid[s:e], "count": count[s:e], "side": side[s:e], "t": cols[0][s:e], "across": cols[4][s] != cols[5][s]}, dim, least))
        if parts:
            a, b, n = (np.concatenate(p) for p in zip(*parts, strict=True))
            out.append(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "links"]))
        return out, None if last else table.slice(starts[stop])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        table = new if kept is None else pa.concat_tables([kept, new])
        out, kept = groups(table, False)
        yield from out
    if kept is not None and kept.num_rows:
        yield from groups(kept, True)[0]


def link_embeddings(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Vectors of one label and length that share a bucket in any table are compared by cosine in double precision. Equal
    vectors of a label are one class from the start, so copies are never compared; links are counted with the copies.
    Buckets above BLOCK classes are split into pairs of blocks, so no task holds more than two blocks and no pair is lost.
    Vectors with a null label, null, empty or zero vectors, and those with null or non-finite components link with nothing:
    n_links 0, component_id their vec_id. A null vec_id still counts as a link; component_id is the least non-null one.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    big = F.lit(float("inf"))
    fine = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.cast("array<double>").alias("embedding"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("k1", F.when(F.col("fine"), F.xxhash64("label", "embedding"))).withColumn("k2", F.when(F.col("fine"), F.xxhash64(F.lit("again"), "embedding", "label")))
    names = rows.select("vec_id", "k1", "k2")
    classes = rows.where("fine").groupBy("k1", "k2", "label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    small_batches(spark)
    keyed = classes.select("cid", "embedding").mapInArrow(_bucketed, "cid long, t int, bucket long").join(classes.select("cid", "label", "dim"), "cid")
    keyed = durable(keyed)
    group = ["t", "label", "dim", "bucket"]
    shared = keyed.groupBy(*group).agg(F.count("*").alias("members")).where("members > 1").select(*group, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(shared, group).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*group, "cid", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own").alias("side"))
    key = [*group, "low", "high"]
    full = placed.join(classes.select("cid", "n", "embedding"), "cid").repartition(*key).sortWithinPartitions(*key)
    found = durable(full.mapInArrow(partial(_linked, least), "a long, b long, links long"))
    small_batches(spark)
    roots = connected(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    named = classes.select("cid", "k1", "k2", "n", "least").join(counts, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least_of = named.groupBy("root").agg(F.min("least").alias("component"))
    done = durable(named.join(least_of, "root").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component"))
    out = names.join(done, ["k1", "k2"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 6: links and components of all embeddings."""
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
