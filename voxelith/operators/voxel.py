"""Operators on voxel tables (x, y, z, key): lookups, edits, summaries, runs, faces, codecs and checks.

Keys are never 0 in a table: 0 is air. The registry is a dimension that a world holds once, so joins with it leave the
choice of a broadcast to its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.address import Geometry, convert, floor_div, locate
from ..functions.scalar import bit_width, index_bits

#: Edge of the cubes in which neighbours meet.
TILE = 32
CELL, CHUNK, REGION = ["x", "y", "z"], ["rx", "ry", "rz", "cx", "cy", "cz"], ["rx", "ry", "rz"]
# Names of the faces of a chunk, with axis and side.
FACES = {"px": (0, 1), "nx": (0, 0), "py": (1, 1), "ny": (1, 0), "pz": (2, 1), "nz": (2, 0)}
# Numbers of the chunk codecs.
EMPTY, UNIFORM, PALETTE, LIST, COLUMNS, RAW, PACKED = 1, 2, 3, 4, 5, 6, 7


def located(v: DataFrame, g: Geometry) -> DataFrame:
    return v.select("*", *locate(g))


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``, the first by ordinal where there is one: of equal keys the first counts."""
    rest = [c for c in df.columns if c != key]
    if "ordinal" not in rest:
        return df.dropDuplicates([key])
    return df.groupBy(key).agg(*(F.min_by(c, "ordinal").alias(c) for c in rest if c != "ordinal"))


def classified(v: DataFrame, registry: DataFrame) -> DataFrame:
    """With opaque, emissive and special of each voxel; keys that aren't registered are opaque. The first of equal keys counts."""
    known = first_rows(registry.select("ordinal", "key", "flags"), "key")
    j = v.join(known, "key", "left")
    return j.select(*v.columns, *(F.coalesce(F.col("flags").bitwiseAND(F.lit(b)) != 0, F.lit(b == 1)).alias(n) for n, b in (("opaque", 1), ("emissive", 2), ("special", 4))))


def chunk_summary(v: DataFrame, registry: DataFrame, g: Geometry) -> DataFrame:
    """One row for each chunk: counts, bounds, face states, occupied macro cells as two 32-bit halves, four top keys.

    Voxels are first counted by chunk and key, so that both the totals and the ranking come from one shuffle on the chunk.
    """
    at, size = [F.col(f"l{a}") for a in "xyz"], g.chunk
    bit = sum((F.floor(a * 4 / s).cast("bigint") * 4 ** i for i, (a, s) in enumerate(zip(at, size, strict=True))), F.lit(0)).cast("int")
    halves = [F.bit_or(F.when((bit >= lo) & (bit < lo + 32), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit - lo)).otherwise(0)).alias(n) for n, lo in (("macro_lo", 0), ("macro_hi", 32))]
    on_face = [F.count_if(at[a] == (size[a] - 1 if side else 0)).alias(f"n_{n}") for n, (a, side) in FACES.items()]
    by_key = located(v, g).groupBy(*CHUNK, "key").agg(F.count("*").alias("n"), *(F.min(a).alias(f"lo{i}") for i, a in enumerate(at)), *(F.max(a).alias(f"hi{i}") for i, a in enumerate(at)), *halves, *on_face)
    k = classified(by_key, registry)
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))), 1, 4).alias("top")
    s = k.groupBy(*CHUNK).agg(
        F.sum("n").alias("non_air"), *(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c) for c in ("opaque", "emissive", "special")),
        *(F.min(f"lo{i}").alias(f"min_{a}") for i, a in enumerate("xyz")), *(F.max(f"hi{i}").alias(f"max_{a}") for i, a in enumerate("xyz")),
        F.bit_or("macro_lo").alias("macro_lo"), F.bit_or("macro_hi").alias("macro_hi"), *(F.sum(f"n_{n}").alias(f"n_{n}") for n in FACES), top)
    areas = [g.volume // e for e in size]
    states = [F.when(F.col(f"n_{n}") == 0, 0).when(F.col(f"n_{n}") == areas[a], 1).otherwise(2).cast("bigint").alias(f"face_{n}") for n, (a, _) in FACES.items()]
    slots = [c for i in range(4) for c in (F.coalesce(F.get("top", F.lit(i))["key"], F.lit(0)).alias(f"top_key_{i}"), F.least(F.coalesce(-F.get("top", F.lit(i))["m"], F.lit(0)), F.lit(65535)).alias(f"top_count_{i}"))]
    return s.select(*CHUNK, "non_air", "opaque", (F.col("emissive") % 65536).alias("emissive"), (F.col("special") % 65536).alias("special"), *(f"{e}_{a}" for e in ("min", "max") for a in "xyz"), "macro_lo", "macro_hi", *states, *slots)


def gather(probes: DataFrame, v: DataFrame) -> DataFrame:
    """Key of each probed cell, 0 where there is none."""
    return probes.join(v, CELL, "left").select("ordinal", *CELL, F.coalesce("key", F.lit(0)).alias("key"))


#: Keys are below this, so that a sequence number and a key make one decimal number.
KEYS = 4294967296


def last_writes(edits: DataFrame) -> DataFrame:
    """The last edit of each cell by seq, of equal ones that with the highest key.

    Both make one number, whose maximum is a hash aggregation, partial before the shuffle; a maximum of structs would sort.
    """
    order = F.col("seq").cast("decimal(20,0)") * F.lit(KEYS).cast("decimal(11,0)") + F.col("key").cast("decimal(10,0)")
    last = edits.groupBy(*CELL).agg(F.max(order).alias("order"))
    return last.select(*CELL, F.pmod("order", F.lit(KEYS).cast("decimal(11,0)")).cast("bigint").alias("key"))


def set_voxels(v: DataFrame, edits: DataFrame, g: Geometry, create_missing: bool = True) -> DataFrame:
    """Apply edits, the last of a cell winning; without ``create_missing`` edits in chunks that don't exist are dropped."""
    e = last_writes(edits)
    if not create_missing:
        e = located(e, g).join(located(v, g).select(*CHUNK).distinct(), CHUNK, "left_semi").select(*CELL, "key")
    return v.join(e.withColumnRenamed("key", "new"), CELL, "full").select(*CELL, F.coalesce("new", "key").alias("key")).where("key <> 0")


def hits(v: DataFrame, edits: DataFrame, g: Geometry) -> DataFrame:
    """How many edits an application without ``create_missing`` counts: all that fall in existing chunks, repeats included."""
    return located(edits, g).join(located(v, g).select(*CHUNK).distinct(), CHUNK, "left_semi").agg(F.count("*").alias("hits"))


def in_box(low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).between(lo, hi) for c, lo, hi in zip(CELL, low, high, strict=True)))


def box_cells(spark, low, high, key: int) -> DataFrame:
    """Every cell of an inclusive box, made by the executors."""
    if any(a > b for a, b in zip(low, high, strict=True)):
        raise ValueError("a box needs low <= high")
    sx, sy, sz = (b - a + 1 for a, b in zip(low, high, strict=True))
    i = F.col("id")
    return spark.range(sx * sy * sz).select((i % sx + low[0]).alias("x"), (F.floor(i / sx).cast("bigint") % sy + low[1]).alias("y"), (F.floor(i / (sx * sy)).cast("bigint") + low[2]).alias("z"), F.lit(key).cast("bigint").alias("key"))


def chunks_of(v: DataFrame, g: Geometry) -> DataFrame:
    """The chunks that hold a voxel."""
    return located(v, g).select(*CHUNK).distinct()


def fill_box(v: DataFrame, low, high, key: int, g: Geometry | None = None, create_missing: bool = True) -> DataFrame:
    """Write ``key`` to every cell of an inclusive box; 0 erases, by a range predicate, without making the box.

    Without ``create_missing`` (which needs a geometry) only cells of existing chunks are written. A box whose low corner
    is above its high one is refused, whatever the key.
    """
    cells = box_cells(v.sparkSession, low, high, key)
    rest = v.where(~in_box(low, high))
    if key == 0:
        return rest
    if not create_missing:
        cells = located(cells, g).join(chunks_of(v, g), CHUNK, "left_semi").select(*CELL, "key")
    return rest.unionByName(cells)


def box_hits(v: DataFrame, low, high, g: Geometry, create_missing: bool = True) -> DataFrame:
    """(hits): cells that ``fill_box`` counts, the whole volume or the part in existing chunks."""
    cells = box_cells(v.sparkSession, low, high, 0)
    if create_missing:
        return cells.agg(F.count("*").alias("hits"))
    return located(cells, g).join(chunks_of(v, g), CHUNK, "left_semi").agg(F.count("*").alias("hits"))


def replace_bounds(v: DataFrame, low, high, edits: DataFrame, g: Geometry) -> DataFrame:
    """Clear a box, creating no chunk, then write all ``edits``, also those outside it; key 0 erases."""
    return set_voxels(fill_box(v, low, high, 0), edits, g)


def convert_world(v: DataFrame, source: int, target: int) -> DataFrame:
    return v.select(*(c.alias(a) for c, a in zip(convert(source, target, *map(F.col, CELL), cells=True), "xyz", strict=True)), "key")


def y_runs(v: DataFrame, g: Geometry) -> DataFrame:
    """Longest stretches of one key along y within a chunk's column."""
    c = [*CHUNK, "lx", "lz", "key"]
    w = Window.partitionBy(*c).orderBy("ly")
    islands = located(v, g).withColumn("run", F.col("ly") - F.row_number().over(w))
    return islands.groupBy(*c, "run").agg(F.min("ly").alias("y0"), F.count("*").alias("len")).drop("run")


def exposed_faces(v: DataFrame) -> DataFrame:
    """(x, y, z, axis, sign, key) of sides with air beyond.

    Voxels meet by tile, a cube of ``TILE`` cells; those on a tile's border are sent to the tile beyond too, where they
    own no face. That is one shuffle of little more than one row a voxel: within a tile, each of the three directions is
    only another sort.
    """
    tile = [floor_div(F.col(a), TILE) for a in CELL]
    place = [F.pmod(F.col(a), F.lit(TILE).cast("bigint")) for a in CELL]

    def at(axis: int, step: int) -> Column:
        return F.struct(*((t + (step if i == axis else 0)).alias(f"t{c}") for i, (t, c) in enumerate(zip(tile, CELL, strict=True))), F.lit(step == 0).alias("own"))

    borders = [F.when(place[i] == (0 if step < 0 else TILE - 1), at(i, step)) for i in range(3) for step in (-1, 1)]
    e = v.select(*CELL, "key", F.explode(F.array_compact(F.array(at(0, 0), *borders))).alias("at")).select(*CELL, "key", "at.*").repartition("tx", "ty", "tz")
    for a in CELL:
        w = Window.partitionBy("tx", "ty", "tz", *(c for c in CELL if c != a)).orderBy(a)
        e = e.withColumn(f"low_{a}", F.lag(a).over(w)).withColumn(f"high_{a}", F.lead(a).over(w))
    sides = [F.when(b.isNull() | (b != F.col(a) + s), F.struct(F.lit(i).alias("axis"), F.lit(s).alias("sign"))) for i, a in enumerate(CELL) for b, s in ((F.col(f"low_{a}"), -1), (F.col(f"high_{a}"), 1))]
    return e.where("own").select(*CELL, "key", F.explode(F.array_compact(F.array(*sides))).alias("s")).select(*CELL, "s.axis", "s.sign", "key")


def welded(faces: DataFrame) -> DataFrame:
    """Corner points of faces, each once, with how many faces use it."""
    across = F.array(*(F.struct(F.lit(a).alias("u"), F.lit(b).alias("v")) for a in (0, 1) for b in (0, 1)))
    f = faces.select("*", F.explode(across).alias("c"))
    on = F.when(F.col("sign") == 1, 1).otherwise(0)
    steps = {"x": F.when(F.col("axis") == 0, on).otherwise(F.col("c.u")), "y": F.when(F.col("axis") == 1, on).otherwise(F.when(F.col("axis") == 0, F.col("c.u")).otherwise(F.col("c.v"))), "z": F.when(F.col("axis") == 2, on).otherwise(F.col("c.v"))}
    return f.select(*((F.col(a) + s).alias(a) for a, s in steps.items())).groupBy(*CELL).agg(F.count("*").alias("n_faces"))


def colours(v: DataFrame, registry: DataFrame, materials: DataFrame) -> DataFrame:
    """The material's tint, else the registry's colour, else 0xCCCCCCFF; zero is no colour. Of equal keys the first counts."""
    r = first_rows(registry.select("ordinal", "key", "rgba", "material_id"), "key").join(first_rows(materials, "material_id"), "material_id", "left")
    c = r.select("key", F.coalesce(F.nullif("tint", F.lit(0)), F.nullif("rgba", F.lit(0))).alias("c"))
    return v.join(c, "key", "left").select(*CELL, "key", F.coalesce("c", F.lit(0xCCCCCCFF)).alias("rgba"))


#: More keys than this have no palette.
PALETTE_KEYS = 65535


def codec_sizes(v: DataFrame, g: Geometry) -> DataFrame:
    """Payload bytes of each chunk under every codec, and the codec that is chosen: the first smallest in a fixed order.

    Codecs with a palette have no size (null) beyond 65,535 keys. Voxels are located and shuffled once: runs are counted by
    column and key, and columns and keys are summed from those rows.
    """
    volume = g.volume
    w = Window.partitionBy(*CHUNK, "lx", "lz").orderBy("ly")
    before = F.lag(F.struct("ly", "key")).over(w)
    starts = before.isNull() | (before["ly"] != F.col("ly") - 1) | (before["key"] != F.col("key"))
    by_key = located(v, g).select(*CHUNK, "lx", "lz", "key", starts.cast("bigint").alias("start"), before.isNull().cast("bigint").alias("column")).groupBy(*CHUNK, "key").agg(F.count("*").alias("n"), F.sum("start").alias("r"), F.sum("column").alias("c"))
    s = by_key.groupBy(*CHUNK).agg(F.sum("n").alias("n"), F.count("*").alias("q"), F.sum("r").alias("r"), F.sum("c").alias("c")).withColumn("p", F.col("q") + (F.col("n") < volume).cast("bigint"))

    def packed(items: Column, bits: Column) -> Column:
        return F.ceil(items * bits / 8).cast("bigint")

    s = s.select(
        *CHUNK, "n", "q", F.lit(4 * volume).cast("bigint").alias("raw"), F.when(F.col("p") <= PALETTE_KEYS, 4 + 4 * F.col("p") + packed(F.lit(volume), bit_width(F.col("p")))).alias("palette"), (4 + 8 * F.col("n")).alias("list"),
        F.when(F.col("q") <= PALETTE_KEYS, 8 + 4 * F.col("q") + packed(F.col("n"), index_bits(F.lit(volume))) + packed(F.col("n"), index_bits(F.col("q")))).alias("packed"), (4 + 6 * F.col("c") + 8 * F.col("r")).alias("columns"))
    order = (("raw", RAW), ("palette", PALETTE), ("list", LIST), ("packed", PACKED), ("columns", COLUMNS))
    least = F.least(*(F.col(n) for n, _ in order))
    choice = reduce(lambda w, o: w.when(F.col(o[0]) == least, o[1]), order[1:], F.when(F.col("raw") == least, RAW))
    uniform = (F.col("n") == volume) & (F.col("q") == 1)
    return s.select(*CHUNK, *(n for n, _ in order), F.when(uniform, UNIFORM).otherwise(choice).alias("codec"), F.when(uniform, 4).otherwise(least).cast("bigint").alias("payload"))


def only_occupied(codec: Column) -> Column:
    """Whether a codec describes only occupied voxels, so that the rest may be taken for air."""
    return codec.isin(EMPTY, LIST, PACKED, COLUMNS)


def region_linear(v: DataFrame, g: Geometry) -> DataFrame:
    """Index of each voxel within its region, x fastest."""
    sx, sy, sz = g.span
    x, y, z = (F.pmod(c, F.lit(s).cast("bigint")) for c, s in zip(map(F.col, CELL), (sx, sy, sz), strict=True))
    return located(v, g).select(*REGION, (x + sx * (y + sy * z)).alias("i"), "key")


def palette_index(v: DataFrame, g: Geometry) -> DataFrame:
    """Number of each key in its chunk, by first appearance in linear order."""
    first = located(v, g).groupBy(*CHUNK, "key").agg(F.min("li").alias("first"))
    return first.select(*CHUNK, "key", (F.row_number().over(Window.partitionBy(*CHUNK).orderBy("first")) - 1).alias("i"))


def running_offsets(sizes: DataFrame) -> DataFrame:
    """Where each chunk's payload begins in its region's blob, if no two share one."""
    w = Window.partitionBy(*REGION).orderBy("cx", "cy", "cz").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*CHUNK, "payload", F.coalesce(F.sum("payload").over(w), F.lit(0)).alias("offset"))


def compacted(entries: DataFrame) -> DataFrame:
    """New offsets for payload ``entries`` (region columns, ordinal, offset, size) of a blob without its dead bytes.

    Entries with the same range share one copy, placed where the first of them stands; a null offset has no payload.
    """
    live = entries.where("offset is not null")
    ranges = live.groupBy(*REGION, "offset", "size").agg(F.min("ordinal").alias("first"))
    w = Window.partitionBy(*REGION).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    moved = ranges.withColumn("new_offset", F.coalesce(F.sum("size").over(w), F.lit(0))).drop("first")
    return entries.join(moved, [*REGION, "offset", "size"], "left").select(*REGION, "ordinal", "offset", "size", "new_offset")


def reclaimable(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Dead bytes of each region's blob: its size less that of distinct live ranges, never below 0.

    ``blobs``: region columns, blob_size. Entries beyond the blob's end don't count as live.
    """
    e = entries.where("offset is not null").select(*REGION, "offset", "size").distinct()
    live = e.join(blobs, REGION).where(F.col("offset") + F.col("size") <= F.col("blob_size")).groupBy(*REGION).agg(F.sum("size").alias("live"))
    return blobs.join(live, REGION, "left").select(*REGION, F.greatest(F.col("blob_size") - F.coalesce("live", F.lit(0)), F.lit(0)).alias("reclaimable"))


def world_bounds(v: DataFrame, g: Geometry) -> DataFrame:
    """The inclusive box of cells that the regions in use span, whole regions each; a row of nulls if there is none."""
    r = v.select(*(floor_div(F.col(a), s).alias(f"r{a}") for a, s in zip("xyz", g.span, strict=True)))
    return r.agg(*((F.min(f"r{a}") * s).alias(f"{a}0") for a, s in zip("xyz", g.span, strict=True)), *(((F.max(f"r{a}") + 1) * s - 1).alias(f"{a}1") for a, s in zip("xyz", g.span, strict=True)))


def _lines(faces: DataFrame) -> DataFrame:
    """Faces across the axis that most of them lie on (of equals the lowest), ranked along their line: u, v, at, closing, key, r."""
    axis = faces.groupBy("axis").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "axis").limit(1).select("axis")
    on = faces.join(F.broadcast(axis), "axis")
    at = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))
    u, v = F.when(F.col("axis") == 0, F.col("y")).otherwise(F.col("x")), F.when(F.col("axis") == 2, F.col("y")).otherwise(F.col("z"))
    f = on.select("axis", u.alias("u"), v.alias("v"), at.alias("at"), (F.col("sign") > 0).cast("int").alias("closing"), "key")
    w = Window.partitionBy("u", "v").orderBy("at", "closing", "key")
    return f.select("*", (F.row_number().over(w) - 1).alias("r"), F.lead(F.struct("at", "closing")).over(w).alias("then"))


def filled_lines(faces: DataFrame) -> DataFrame:
    """(x, y, z, key): cells enclosed by ``faces`` (x, y, z, axis, sign, key) of a shell, by parity along lines.

    Faces of the axis that most lie on are ordered along each line, openings (sign -1) before closings in one cell. An
    opening of even rank and the closing right after it enclose the cells between, with the opening's key.
    """
    pairs = _lines(faces).where((F.col("r") % 2 == 0) & (F.col("closing") == 0) & (F.col("then.closing") == 1))
    c = pairs.select("axis", "u", "v", "key", F.explode(F.sequence("at", "then.at")).alias("at"))
    x, y = F.when(F.col("axis") == 0, F.col("at")).otherwise(F.col("u")), F.when(F.col("axis") == 1, F.col("at")).when(F.col("axis") == 0, F.col("u")).otherwise(F.col("v"))
    return c.select(x.alias("x"), y.alias("y"), F.when(F.col("axis") == 2, F.col("at")).otherwise(F.col("v")).alias("z"), "key")


def unpaired(faces: DataFrame) -> DataFrame:
    """(unpaired): faces that break the alternation of openings and closings, as an open shell does."""
    return _lines(faces).agg(F.count_if((F.col("r") % 2 == 0) == (F.col("closing") == 1)).alias("unpaired"))


def surface_and_interior(surface: DataFrame, interior: DataFrame) -> DataFrame:
    """Both cells, the surface's where they meet; key 0 goes."""
    both = surface.select(*CELL, "key", F.lit(1).alias("seq")).unionByName(interior.select(*CELL, "key", F.lit(0).alias("seq")))
    return last_writes(both).where("key <> 0")
