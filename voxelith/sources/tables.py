"""Voxel tables derived from the shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The registry of the derived world (key, flags, colour, material); key 7 is left out on purpose.
REGISTRY = ((1, 1, 0xFF0000FF, 11), (2, 3, 0x00FF00FF, 12), (3, 4, 0x0000FFFF, 0), (4, 9, 0, 14), (5, 1, 0x808080FF, 99999), (6, 2, 0, 0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, key): one row a cell, of the writers the last by order number and key.

    The world is 50 cells high, 40 deep and grows along x with the orders, at much the same density. A line number is
    below 8, so order and key make one number, and its maximum is a plain hash aggregation.
    """
    w = table(spark, sf_dir, "lineitem").select(
        (F.expr("l_orderkey div 300") - 8).alias("x"), (F.col("l_quantity").cast("bigint") - 20).alias("y"), (F.col("l_suppkey") % 40 - 20).alias("z"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order"))
    return w.groupBy("x", "y", "z").agg((F.max("order") % 8).alias("key"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, x, y, z, key); key 0 erases. Edits move along x as the world grows; about one in ten hits a cell again."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.expr("event_id div 200") - 8).alias("x"), (F.col("user_id") % 50 - 20).alias("y"),
        (F.floor("value").cast("bigint") % 40 - 20).alias("z"), (F.col("event_id") % 8).alias("key"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, x, y, z): cells in and around the world."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(o.alias("ordinal"), (F.expr("o_orderkey div 300") - 10 + o % 5).alias("x"), (c % 77 - 38).alias("y"), ((o + c) % 63 - 31).alias("z"))


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REGISTRY)], "ordinal int, key bigint, flags int, rgba bigint, material_id bigint")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("material_id"), (F.col("p_size").cast("bigint") * 65536 + F.col("p_partkey") % 256 * (F.col("p_partkey") % 2)).alias("tint"))
