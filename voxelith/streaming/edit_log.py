"""A stream of edits (seq, x, y, z, key) applied batch by batch to a world kept as Parquet.

An extension beside the batch operators. A world is a directory of voxels partitioned by region. A batch
reads and rewrites only the regions that its edits touch, so its cost follows the edits and not the world.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.address import Geometry
from ..operators.voxel import CELL, REGION, last_writes, located

SCHEMA = "x bigint, y bigint, z bigint, key bigint, rx bigint, ry bigint, rz bigint"


def write_world(v: DataFrame, g: Geometry, path: str) -> None:
    """Start a world at ``path``."""
    located(v, g).select(*CELL, "key", *REGION).write.partitionBy(*REGION).parquet(path)


def read_world(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, key, rx, ry, rz): the voxels of a world. Conditions on regions leave out whole files."""
    return spark.read.schema(SCHEMA).parquet(path).where("key <> 0")


def apply_batch(edits: DataFrame, g: Geometry, path: str, staging: str) -> None:
    """Apply a batch of edits to the world at ``path``. Applying it again changes nothing.

    The touched regions are written to ``staging`` first, for Spark does not overwrite what it reads, and then put in the
    place of the old ones. An erased cell stays as a row of air, so that a region that is wholly erased is overwritten too.
    """
    spark = edits.sparkSession
    last = located(last_writes(edits), g).select(*CELL, F.col("key").alias("new"), *REGION)
    touched = last.select(*REGION).distinct()
    old = spark.read.schema(SCHEMA).parquet(path).join(touched, REGION, "left_semi")
    merged = old.join(last, [*CELL, *REGION], "full").select(*CELL, F.coalesce("new", "key").alias("key"), *REGION)
    merged.write.mode("overwrite").parquet(staging)
    spark.read.schema(SCHEMA).parquet(staging).repartition(*REGION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*REGION).parquet(path)


def start(edits: DataFrame, g: Geometry, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Apply a streaming table of edits to the world at ``path``; within a batch the last edit of a cell by seq counts.

    Batches are replayed whole after a failure, and applying one twice is harmless. ``once``: take what is there and end.
    """
    writer = edits.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, g, path, f"{checkpoint}/staging")).option("checkpointLocation", f"{checkpoint}/log")
    return (writer.trigger(availableNow=True) if once else writer).start()
