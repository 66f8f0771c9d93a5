"""Checks of a world against fifteen rules, each a relational plan; a report row for every breach."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.address import Geometry
from .voxel import CHUNK, REGION, located

# Numbers of the rules' codes and of severities.
UNREGISTERED, NO_MATERIAL, OUT_OF_BOUNDS, OUT_OF_REGION, REPEATED_REGION, REPEATED_KEY, AIR_KEY, LONG_PATH, BAD_TEXTURE, UNRESOLVED, BAD_GEOMETRY, EMPTY_REGION, NO_REGISTRY, NO_TEXTURES, NO_UNITS = range(1, 16)
INFO, WARNING, ERROR = 0, 1, 2
#: Longest path of a texture in a world's description, and longest edge of a chunk whose summary fits bytes.
PATH, EDGE = 127, 255


@dataclass(frozen=True)
class World:
    """What is checked. ``geometry`` may be a faulty one, so it is six plain numbers.

    registry: ordinal, key, material_id. textures: ordinal, path (as the world refers to it), and optionally problem.
    materials: material_id, of all textures. regions: ordinal, rx, ry, rz. chunks: region (ordinal), ordinal, cx, cy, cz and
    the summary's top_key_0 to top_key_3. voxels: x, y, z, key. bounds: lowest and highest region, None if unbounded.
    """

    chunk: tuple[int, int, int]
    region: tuple[int, int, int]
    registry: DataFrame
    textures: DataFrame
    materials: DataFrame
    regions: DataFrame
    chunks: DataFrame
    voxels: DataFrame
    bounds: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None
    default_units: bool = True


def _issue(df: DataFrame, code: int, severity: int, region: Column | None = None, chunk: Column | None = None, key: Column | None = None) -> DataFrame:
    minus = F.lit(-1)
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), *((minus if c is None else c).cast("bigint").alias(n) for c, n in ((region, "region"), (chunk, "chunk"))), (F.lit(0) if key is None else key).cast("bigint").alias("key"))


def _once(spark, holds: bool, code: int, severity: int) -> DataFrame:
    return _issue(spark.range(1 if holds else 0), code, severity)


def _if_none(df: DataFrame, code: int, severity: int) -> DataFrame:
    """One row if ``df`` is empty."""
    return _issue(df.agg(F.count("*").alias("n")).where("n = 0"), code, severity)


def _used(w: World, deep: bool) -> DataFrame:
    """(region, chunk, key): keys of each chunk, all of them or the four that its summary has."""
    if not deep:
        tops = F.explode(F.array(*(F.col(f"top_key_{i}") for i in range(4)))).alias("key")
        return w.chunks.select(F.col("region"), F.col("ordinal").alias("chunk"), tops).where("key <> 0").distinct()
    seen = located(w.voxels.where("key <> 0"), Geometry(w.chunk, w.region)).select(*CHUNK, "key").distinct()
    named = w.regions.select(F.col("ordinal").alias("region"), *REGION).join(w.chunks.select("region", F.col("ordinal").alias("chunk"), "cx", "cy", "cz"), "region")
    return seen.join(named, CHUNK).select("region", "chunk", "key")


def validate(w: World, deep: bool = False) -> DataFrame:
    """(code, severity, region, chunk, key) for every breach; -1 and 0 where a rule is about none.

    The shallow check sees the four top keys of each summary, the deep one every key in use. A geometry with a zero edge
    ends the check, for nothing else can be told then. Code 10 is reserved and never reported.
    """
    spark = w.registry.sparkSession
    if min(*w.chunk, *w.region) < 1:
        return _once(spark, True, BAD_GEOMETRY, ERROR)
    real = w.registry.where("key <> 0")
    repeat = Window.partitionBy("key").orderBy("ordinal")
    place = Window.partitionBy(*REGION).orderBy("ordinal")
    rules = [
        _once(spark, max(w.chunk) > EDGE, BAD_GEOMETRY, ERROR),
        _issue(w.registry.where("key = 0"), AIR_KEY, WARNING),
        _issue(w.registry.select("key", F.row_number().over(repeat).alias("r")).where("r > 1"), REPEATED_KEY, ERROR, key=F.col("key")),
        _if_none(w.registry, NO_REGISTRY, WARNING),
        _once(spark, w.default_units, NO_UNITS, INFO),
        _issue(w.textures.where(F.octet_length("path") > PATH), LONG_PATH, ERROR),
        _issue(w.regions.select("ordinal", F.row_number().over(place).alias("r")).where("r > 1"), REPEATED_REGION, ERROR, region=F.col("ordinal")),
        _issue(w.regions.join(w.chunks.select(F.col("region").alias("ordinal")), "ordinal", "left_anti"), EMPTY_REGION, INFO, region=F.col("ordinal")),
        _issue(w.chunks.where(reduce(lambda a, b: a | b, (F.col(f"c{a}") >= n for a, n in zip("xyz", w.region, strict=True)))), OUT_OF_REGION, ERROR, region=F.col("region"), chunk=F.col("ordinal")),
        _issue(_used(w, deep).join(w.registry.select("key").distinct(), "key", "left_anti"), UNREGISTERED, WARNING, region=F.col("region"), chunk=F.col("chunk"), key=F.col("key")),
    ]
    if "problem" in w.textures.columns:
        rules.append(_issue(w.textures.where("problem is not null"), BAD_TEXTURE, ERROR))
    # Without textures no material is missed: that no texture exists is one row of its own.
    some = w.textures.agg(F.count("*").alias("n_textures"))
    rules.append(_issue(real.join(w.materials.select("material_id").distinct(), "material_id", "left_anti").join(F.broadcast(some), F.col("n_textures") > 0), NO_MATERIAL, WARNING, key=F.col("key")))
    rules.append(_issue(w.registry.agg(F.count("*").alias("n")).join(F.broadcast(some), (F.col("n") > 0) & (F.col("n_textures") == 0)), NO_TEXTURES, INFO))
    if w.bounds:
        inside = reduce(lambda a, b: a & b, (F.col(r).between(lo, hi) for r, lo, hi in zip(REGION, *w.bounds, strict=True)))
        rules.append(_issue(w.regions.where(~inside), OUT_OF_BOUNDS, WARNING, region=F.col("ordinal")))
    return reduce(DataFrame.unionByName, rules)
