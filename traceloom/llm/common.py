"""Helpers shared by the corpus operators: durable cuts of lineage, Arrow maps, connected components."""
from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every contract here.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch, at most; a batch of long texts has fewer rows.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a local master, as in tests, may it be unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir is None:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if getattr(spark.sparkContext, "_llm_dir", None) is None:
            spark.sparkContext._llm_dir = tempfile.mkdtemp(prefix="traceloom-")
        set_dir = spark.sparkContext._llm_dir
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Compute now and keep in the shared folder, so that a lost executor costs only what it was doing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished plans go now: Spark drops them when the driver collects its garbage, which may be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches; every operator sets the same bounds, so a lazy result runs under them whenever it runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in column(batch, name).to_pylist()]


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest vertex reachable from each of n vertices over the edges (u, v), within one task."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(hop := label[label], label):
            label = hop
        left = label[u] != label[v]
        u, v = u[left], v[left]
    return label


#: Edges of a task of connected, about; edges up to which the least neighbours of all nodes are broadcast (16 bytes each, at most
#: two for an edge); neighbours from which a node is a hub. Of hubs there are fewer than two for HUB edges.
EDGES, FEW_EDGES, HUB = 50_000, 200_000, 20_000


def _joined_least(edges: DataFrame, least: DataFrame, n: int, p: int) -> DataFrame:
    """edges (a, b) with the least neighbour m of a. Hubs are broadcast, so their edges stay where they are."""
    if n <= FEW_EDGES:
        return edges.join(F.broadcast(least.select("a", "m")), "a")
    least = durable(least.coalesce(p))
    hubs = F.broadcast(least.where(F.col("n") >= HUB).select("a", "m"))
    other = edges.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") < HUB).select("a", "m"), "a")
    return edges.join(hubs, "a").unionByName(other)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b), root the smallest node reachable.

    Alternates large and small stars over DataFrames. Each star takes the least neighbour by a partially aggregated
    min and joins it back. Every round is kept in the shared folder, in as many files as its edges need. Raises if the edges
    still change after `rounds` rounds.
    """
    links = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, p = None, links.rdd.getNumPartitions()
    for turn in range(rounds + 1):
        sizes = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sizes == seen or not sizes[0]:
            break
        if turn == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        seen, n = sizes, sizes[0]
        p = min(p, 1 + n // EDGES)
        links = links.coalesce(p)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _joined_least(both, least, n, p).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct().coalesce(p)
        large = durable(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _joined_least(large, down, n, p)
        links = durable(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct().coalesce(p))
    stars = links.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
