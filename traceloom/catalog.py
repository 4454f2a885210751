"""Logical tables of the domain: bound to a folder of Parquet tables, or given as DataFrames."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Loci of the bound tables.
MARKERS = tuple(range(1, 8))


@dataclass(frozen=True)
class Catalog:
    """samples (sample_id, code, batch, category, label), alleles (marker_id, sample_id, value, size, height, assay_id, allele_id, type), markers (marker_id, code)."""

    samples: DataFrame
    alleles: DataFrame
    markers: DataFrame


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("code"), F.col("p_brand").alias("batch"), F.col("p_size").alias("category"), F.col("p_type").alias("label"))


def alleles(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("l_quantity") + (F.col("l_discount") - F.lit(0.05)) * F.lit(4)
    kind = F.when(F.col("l_returnflag") == "R", "stutter").when(F.col("l_returnflag") == "A", "called").otherwise("bin")
    return _table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("marker_id"), F.col("l_partkey").alias("sample_id"), F.col("l_quantity").cast("int").alias("value"), size.alias("size"),
        F.col("l_extendedprice").alias("height"), F.col("l_suppkey").alias("assay_id"), F.col("l_orderkey").alias("allele_id"), kind.alias("type"),
    )


def markers(spark: SparkSession) -> DataFrame:
    return spark.range(1, len(MARKERS) + 1, numPartitions=1).select(F.col("id").cast("int").alias("marker_id"), F.concat(F.lit("m"), "id").alias("code"))


def catalog(spark: SparkSession, folder: str) -> Catalog:
    return Catalog(samples(spark, folder), alleles(spark, folder), markers(spark))


#: The same bindings for SQL engines that see the physical tables as views.
SQL = """
samples AS (SELECT p_partkey AS sample_id, p_name AS code, p_brand AS batch, p_size AS category, p_type AS label FROM part),
markers AS (SELECT CAST(i AS INT) AS marker_id, 'm' || i AS code FROM range(1, 8) t(i)),
alleles AS (SELECT l_linenumber AS marker_id, l_partkey AS sample_id, CAST(l_quantity AS INT) AS value, l_quantity + (l_discount - 0.05::DOUBLE) * 4 AS size,
  l_extendedprice AS height, l_suppkey AS assay_id, l_orderkey AS allele_id,
  CASE l_returnflag WHEN 'R' THEN 'stutter' WHEN 'A' THEN 'called' ELSE 'bin' END AS type FROM lineitem)"""
