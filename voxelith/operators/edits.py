"""Edits of a world's tables: chunks, regions, payloads, the registry, metadata; and what changed between two versions.

Tables. chunks: region and chunk coordinates, flags, non_air and any summary columns. payloads: region and chunk
coordinates, section, codec, entry_flags, bytes. regions: rx, ry, rz. registry: ordinal, key, material_id, flags, name,
name_hash, rgba. metadata: scope, key, value. All edits give new tables; none changes one in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.address import Geometry, convert
from ..functions.scalar import fnv1a64
from .voxel import CELL, CHUNK, REGION, chunk_summary, convert_world, located

# Bits of a chunk's flags, and the sections whose payload sets one.
PRESENT, CHUNK_EMPTY, HAS_VOXELS = 1, 2, 4
SECTION_FLAGS = {2: HAS_VOXELS, 3: 8, 4: 16, 5: 32, 6: 64}
WORLD_DESC = 1


def _at(columns: list[str], coord: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == n for c, n in zip(columns, coord, strict=True)))


def set_chunk(v: DataFrame, g: Geometry, chunk: tuple[int, ...], keys: list[int]) -> DataFrame:
    """``v`` with one chunk (rx, ry, rz, cx, cy, cz) replaced by ``keys`` in linear order; their number must be right."""
    if len(keys) != g.volume:
        raise ValueError(f"{len(keys)} keys for a chunk of {g.volume}")
    (sx, sy, _), base = g.chunk, [r * s + c * e for r, c, s, e in zip(chunk[:3], chunk[3:], g.span, g.chunk, strict=True)]
    rows = [(base[0] + i % sx, base[1] + i // sx % sy, base[2] + i // (sx * sy), k) for i, k in enumerate(keys) if k]
    new = v.sparkSession.createDataFrame(rows, "x bigint, y bigint, z bigint, key bigint")
    return remove_chunk(v, g, chunk).unionByName(new)


def remove_chunk(v: DataFrame, g: Geometry, chunk: tuple[int, ...]) -> DataFrame:
    """``v`` without the cells of one chunk: a range predicate on the cells, which reaches the source."""
    base = [r * s + c * e for r, c, s, e in zip(chunk[:3], chunk[3:], g.span, g.chunk, strict=True)]
    inside = reduce(lambda a, b: a & b, (F.col(c).between(lo, lo + e - 1) for c, lo, e in zip(CELL, base, g.chunk, strict=True)))
    return v.where(~inside)


def without_chunk(table: DataFrame, chunk: tuple[int, ...]) -> DataFrame:
    """A chunk or payload table without one chunk's rows."""
    return table.where(~_at(CHUNK, chunk))


def clear_chunk(chunks: DataFrame, chunk: tuple[int, ...]) -> DataFrame:
    """The chunk stays, empty: its summary is zero and its flags say that it is there and holds nothing."""
    here = _at(CHUNK, chunk)
    return chunks.select(*CHUNK, *(F.when(here, F.lit(PRESENT | CHUNK_EMPTY if c == "flags" else 0).cast(t)).otherwise(F.col(c)).alias(c) for c, t in chunks.dtypes if c not in CHUNK))


def set_payload(payloads: DataFrame, new: DataFrame) -> DataFrame:
    """Payloads of ``new`` take the place of those of the same chunk and section; of repeats the last by seq.

    The description of the world is no chunk's payload: its section is refused.
    """
    key = [*CHUNK, "section"]
    refused = F.when(F.col("section") == WORLD_DESC, F.raise_error(F.lit("the world's description is no chunk's payload")).cast("int")).otherwise(F.col("section"))
    last = new.withColumn("section", refused).groupBy(*key).agg(*(F.max_by(c, "seq").alias(c) for c in ("codec", "entry_flags", "bytes")))
    return payloads.join(last, key, "left_anti").unionByName(last.select(payloads.columns))


def remove_payload(payloads: DataFrame, chunk: tuple[int, ...], section: int) -> DataFrame:
    return payloads.where(~(_at(CHUNK, chunk) & (F.col("section") == section)))


def chunk_flags(chunks: DataFrame, payloads: DataFrame) -> DataFrame:
    """``chunks`` with flags that follow from their payloads and summary: there, empty, and which sections they have."""
    bits = reduce(lambda w, kv: w.when(F.col("section") == kv[0], kv[1]), list(SECTION_FLAGS.items())[1:], F.when(F.col("section") == 2, HAS_VOXELS))
    has = payloads.groupBy(*CHUNK).agg(F.bit_or(F.coalesce(bits, F.lit(0))).alias("has"))
    j = chunks.drop("flags").join(has, CHUNK, "left")
    empty = F.when(F.col("non_air") == 0, CHUNK_EMPTY).otherwise(0)
    return j.withColumn("flags", F.lit(PRESENT).bitwiseOR(empty).bitwiseOR(F.coalesce("has", F.lit(0)))).drop("has")


def remove_region(table: DataFrame, coord: tuple[int, int, int]) -> DataFrame:
    return table.where(~_at(REGION, coord))


def add_region(regions: DataFrame, coord: tuple[int, int, int]) -> DataFrame:
    """One more region; a coordinate that is taken is an error, found when the table is read."""
    new = regions.sparkSession.createDataFrame([coord], "rx bigint, ry bigint, rz bigint")
    taken = F.raise_error(F.lit(f"region {coord} is there already")).cast("bigint")
    return regions.select(F.when(_at(REGION, coord), taken).otherwise(F.col("rx").cast("bigint")).alias("rx"), F.col("ry").cast("bigint").alias("ry"), F.col("rz").cast("bigint").alias("rz")).unionByName(new)


def prune_empty_regions(regions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The regions that hold a voxel; those without chunks, and with empty ones only, go."""
    full = chunks.groupBy(*REGION).agg(F.sum("non_air").alias("n")).where("n > 0").select(*REGION)
    return regions.join(full, REGION, "left_semi")


def rebuild_bounds(regions: DataFrame) -> DataFrame:
    """(explicit, min_rx .. max_rz): the bounds that the regions span; without any the world is unbounded."""
    b = regions.agg(F.count("*").alias("n"), *(F.min(c).alias(f"min_{c}") for c in REGION), *(F.max(c).alias(f"max_{c}") for c in REGION))
    return b.select((F.col("n") > 0).alias("explicit"), *(F.coalesce(f"{e}_{c}", F.lit(0)).cast("bigint").alias(f"{e}_{c}") for e in ("min", "max") for c in REGION))


def registry_upsert(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """``registry`` with ``changes`` (seq, key, material_id, flags): entries by key, of several the last; new ones at the end.

    Air cannot be registered: key 0 is an error. Names and colours stay.
    """
    checked = F.when(F.col("key") == 0, F.raise_error(F.lit("key 0 is air")).cast("bigint")).otherwise(F.col("key"))
    last = changes.withColumn("key", checked).groupBy("key").agg(F.max_by("material_id", "seq").alias("m"), F.max_by("flags", "seq").alias("f"), F.min("seq").alias("seq"))
    top = registry.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("top"))
    new = last.join(registry.select("key"), "key", "left_anti").withColumn("r", F.row_number().over(Window.orderBy("seq", "key")) - 1).join(F.broadcast(top))
    added = new.select((F.col("top") + F.col("r")).cast("int").alias("ordinal"), "key", F.col("m").alias("material_id"), F.col("f").alias("flags"))
    old = registry.join(last.select("key", "m", "f"), "key", "left")
    return old.select(*(F.coalesce("m", "material_id").alias(c) if c == "material_id" else F.coalesce("f", "flags").alias(c) if c == "flags" else F.col(c) for c in registry.columns)).unionByName(added, allowMissingColumns=True)


def registry_remove(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries without those of ``keys`` (key). Colours are kept apart from entries and outlive them: see ``set_colours``."""
    return registry.join(keys, "key", "left_anti")


def set_names(registry: DataFrame, names: DataFrame) -> DataFrame:
    """``registry`` with ``names`` (seq, key, name): the last of a key counts; an empty or null one takes the name away.

    The hash of the name follows a new name; it stays where a name goes.
    """
    last = names.groupBy("key").agg(F.max(F.struct("seq", F.coalesce("name", F.lit("")).alias("name"))).alias("s"))
    j = registry.join(last, "key", "left")
    new = F.col("s.name")
    named = {"name": F.when(new.isNull(), F.col("name")).otherwise(F.nullif(new, F.lit(""))), "name_hash": F.when(new.isNull() | (new == ""), F.col("name_hash")).otherwise(fnv1a64(new.cast("binary")))}
    return j.select(*(named.get(c, F.col(c)).alias(c) for c in registry.columns))


def set_colours(colours: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, rgba) with ``changes`` (seq, key, rgba): the last of a key counts, 0 takes the colour away. Colours need no entry."""
    last = changes.groupBy("key").agg(F.max(F.struct("seq", "rgba"))["rgba"].alias("new"))
    return colours.join(last, "key", "full").select("key", F.coalesce("new", "rgba").alias("rgba")).where("rgba <> 0")


def push_registry(registry: DataFrame, mirror: DataFrame) -> DataFrame:
    """``registry`` with all rows of ``mirror`` (ordinal, key, material_id, flags): the first of a key counts, air is passed
    over, and entries that only the registry has stay."""
    first = mirror.where("key <> 0").groupBy("key").agg(F.min("ordinal").alias("seq"), F.min_by("material_id", "ordinal").alias("material_id"), F.min_by("flags", "ordinal").alias("flags"))
    return registry_upsert(registry, first)


def merge_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """(scope, key, value) with ``changes`` (seq, scope, key, value): the last counts, a null value removes. Sort by key to list."""
    last = changes.groupBy("scope", "key").agg(F.max_by(F.struct("value"), "seq").alias("s"))
    j = metadata.join(last, ["scope", "key"], "full")
    return j.select("scope", "key", F.when(F.col("s").isNotNull(), F.col("s.value")).otherwise(F.col("value")).alias("value")).where("value is not null")


def _signature(v: DataFrame, g: Geometry) -> DataFrame:
    h = F.xxhash64(*CELL, "key")
    return located(v, g).groupBy(*REGION).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("s"), F.bit_xor(h).alias("e"))


def dirty_regions(before: DataFrame, after: DataFrame, g: Geometry) -> DataFrame:
    """Regions whose voxels differ between two versions, by sums of hashes: one row a region is compared."""
    a, b = _signature(before, g), _signature(after, g)
    j = a.toDF(*REGION, "n", "s", "e").join(b.toDF(*REGION, "m", "t", "f"), REGION, "full")
    same = F.col("n").eqNullSafe(F.col("m")) & F.col("s").eqNullSafe(F.col("t")) & F.col("e").eqNullSafe(F.col("f"))
    return j.where(~same).select(*REGION)


def converted(v: DataFrame, registry: DataFrame, g: Geometry, source: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A world in another convention: its voxels, their chunks' new summaries, and (moved) how many voxels moved, none if
    the convention is the same. Other payloads belong to the old cells and are to be dropped."""
    new = v if source == target else convert_world(v, source, target)
    moved = v.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("moved")) if source == target else v.agg(F.count("*").alias("moved"))
    return new, chunk_summary(new, registry, g), moved


def checked_description(old: Geometry, new: Geometry, convention: int, has_chunks: bool) -> Geometry:
    """``new``, if a world may take it: its geometry is fixed once it has chunks, and only the canonical convention is set."""
    if has_chunks and old != new:
        raise ValueError("the geometry of a world with chunks cannot change")
    if convention:
        raise ValueError("a description is in the canonical convention")
    return new


def content_hashes(v: DataFrame, g: Geometry) -> DataFrame:
    """FNV-1a of each chunk's keys, 4 bytes each, air included: what the chunk holds, whatever its codec.

    A chunk's voxels, at most its volume, meet in one row as pieces of hex text, each with the air before it.
    """
    h = F.lpad(F.hex("key"), 8, "0")
    little = F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    w = Window.partitionBy(*CHUNK).orderBy("li")
    gap = (F.col("li") - F.coalesce(F.lag("li").over(w), F.lit(-1)) - 1).cast("int")
    pieces = located(v.where("key <> 0"), g).select(*CHUNK, "li", F.concat(F.repeat(F.lit("0" * 8), gap), little).alias("piece"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("li", "piece"))), lambda s: s["piece"]), "")
    whole = pieces.groupBy(*CHUNK).agg(F.rpad(text, 8 * g.volume, "0").alias("t"))
    return whole.select(*CHUNK, fnv1a64(F.unhex("t")).alias("hash"))


def dense_chunks(v: DataFrame, g: Geometry) -> DataFrame:
    """Each chunk's keys as one array in linear order, air included."""
    m = located(v, g).groupBy(*CHUNK).agg(F.map_from_entries(F.collect_list(F.struct("li", "key"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(g.volume - 1).cast("bigint")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint")))
    return m.select(*CHUNK, cells.alias("keys"))


def sparse_cells(dense: DataFrame, g: Geometry) -> DataFrame:
    """(x, y, z, key) of the voxels of ``dense`` chunks."""
    (sx, sy, _) = g.chunk
    e = dense.select(*CHUNK, F.posexplode("keys").alias("i", "key")).where("key <> 0")
    loc = {"x": F.col("i") % sx, "y": F.expr(f"i div {sx}") % sy, "z": F.expr(f"i div {sx * sy}")}
    return e.select(*((F.col(f"r{a}") * s + F.col(f"c{a}") * c + loc[a]).cast("bigint").alias(a) for a, s, c in zip("xyz", g.span, g.chunk, strict=True)), "key")


def inside_region(chunks: DataFrame, g: Geometry) -> DataFrame:
    """The chunks that lie in their region's grid; the rest are left out of whole-region reads."""
    return chunks.where(reduce(lambda a, b: a & b, (F.col(f"c{a}").between(0, n - 1) for a, n in zip("xyz", g.region, strict=True))))


def in_bounds(regions: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    return regions.where(reduce(lambda a, b: a & b, (F.col(c).between(lo, hi) for c, lo, hi in zip(REGION, low, high, strict=True))))


def orphans(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files (path) that nothing refers to."""
    return files.join(referenced.select("path"), "path", "left_anti")


def hash_mismatches(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Regions of a manifest (rx, ry, rz, path, hash) whose file (path, frx, fry, frz, file_hash) is elsewhere or another.

    A zero hash on either side is not stamped, and passes.
    """
    j = manifest.join(files, "path")
    moved = reduce(lambda a, b: a | b, (F.col(c) != F.col(f"f{c}") for c in REGION))
    other = (F.col("hash") != 0) & (F.col("file_hash") != 0) & (F.col("hash") != F.col("file_hash"))
    return j.where(moved | other).select("path", moved.alias("moved"), other.alias("other_hash"))


def resident_bytes(chunks: DataFrame, sections: int = 1) -> DataFrame:
    """Bytes of a region that are held without payloads: header, 16 and 56 a chunk, 40 a section, 16 an entry."""
    return chunks.groupBy(*REGION).agg((F.lit(88 + 40 * sections) + F.count("*") * (16 + 56 + 16 * sections)).alias("resident"))


def place_cells(v: DataFrame, source: int, target: int) -> DataFrame:
    """Cells of one convention in another, their key kept."""
    return v.select(*(c.alias(a) for c, a in zip(convert(source, target, *map(F.col, CELL), cells=True), "xyz", strict=True)), "key")
