"""Textures: sizes by format, ranges of subresources, smaller levels, palettes, and checks.

Tables. textures: archive, texture, kind, format, width, height, mips, layers. subresources: archive, texture, mip, layer,
extents, blob_offset, blob_size. materials: archive, material_id, four texture numbers, tint. texels: image, x, y, channel,
value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Graphics formats by number: bytes of a block, and a block's edge in texels.
FORMATS = {
    9: (1, 1), 16: (2, 1), 76: (2, 1), 37: (4, 1), 43: (4, 1), 44: (4, 1), 50: (4, 1), 100: (4, 1), 97: (8, 1), 109: (16, 1),
    131: (8, 4), 132: (8, 4), 133: (8, 4), 139: (8, 4), 137: (16, 4), 138: (16, 4), 141: (16, 4), 145: (16, 4), 146: (16, 4),
}
# Kinds of texture, and formats whose channels are single bytes.
FLAT, SOLID, BUFFER = 0, 1, 2
BYTE_FORMATS = (9, 16, 37, 43, 44, 50)


def _of_format(fmt: Column, part: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in FORMATS.items() for x in (k, v[part]))), fmt.cast("int")), F.lit(0))


def block_bytes(fmt: Column) -> Column:
    """Bytes of a block of texels; 0 for a format that is not known."""
    return _of_format(fmt, 0)


def block_edge(fmt: Column) -> Column:
    return F.greatest(_of_format(fmt, 1), F.lit(1))


def texel_bytes(fmt: Column) -> Column:
    """Bytes of a texel; 0 where blocks are compressed."""
    return F.when(block_edge(fmt) == 1, block_bytes(fmt)).otherwise(0)


def supported(fmt: Column) -> Column:
    return block_bytes(fmt) > 0


def subresource_bytes(fmt: Column, width: Column, height: Column) -> Column:
    """Bytes of an image; parts of a block count as whole ones."""
    edge = block_edge(fmt)

    def blocks(n: Column) -> Column:
        return F.call_function("div", n.cast("bigint") + edge - 1, edge.cast("bigint"))

    return blocks(width) * blocks(height) * block_bytes(fmt)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows of an archive's table with ids that are their places."""
    return rows.select("*", (F.row_number().over(Window.partitionBy("archive").orderBy(order)) - 1).cast("bigint").alias(name))


def laid_out(subresources: DataFrame) -> DataFrame:
    """``subresources`` (archive, texture, mip, layer, blob_size) by texture, mip and layer: place in the archive and offset."""
    w = Window.partitionBy("archive").orderBy("texture", "mip", "layer")
    return subresources.select("archive", "texture", "mip", "layer", "blob_size", (F.row_number().over(w) - 1).cast("bigint").alias("place"), F.coalesce(F.sum("blob_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("blob_offset"))


def ranges(subresources: DataFrame) -> DataFrame:
    """(archive, texture, first, count): where each texture's subresources are, once sorted.

    Counted by texture first, so that no task holds an archive's subresources.
    """
    n = subresources.groupBy("archive", "texture").agg(F.count("*").alias("count"))
    w = Window.partitionBy("archive").orderBy("texture").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("archive", "texture", F.coalesce(F.sum("count").over(w), F.lit(0)).cast("bigint").alias("first"), "count")


def next_level(texels: DataFrame, images: DataFrame) -> DataFrame:
    """Texels of half the size: means of two by two, rounded half up, edges of width 1 counted twice.

    ``images``: image, width, height, format. Of an odd edge above 1 the last row or column is left out. Formats without
    byte channels have no such level: they are an error.
    """
    bad = F.when(~F.col("format").isin(*BYTE_FORMATS), F.raise_error(F.concat(F.lit("no smaller levels for format "), F.col("format").cast("string"))).cast("bigint"))
    size = images.select("image", F.coalesce(bad, F.col("width").cast("bigint")).alias("width"), F.col("height").cast("bigint").alias("height"))
    t = texels.join(size, "image")
    parent = [F.shiftright(F.col(c), 1).alias(f"p{c}") for c in ("x", "y")]
    weight = reduce(lambda a, b: a * b, (F.when(F.col(e) == 1, 2).otherwise(1) for e in ("width", "height")))
    fits = reduce(lambda a, b: a & b, (F.shiftright(F.col(c), 1) < F.greatest(F.lit(1), F.shiftright(F.col(e), 1)) for c, e in (("x", "width"), ("y", "height"))))
    up = t.where(fits).select("image", *parent, "channel", (F.col("value") * weight).alias("v"))
    return up.groupBy("image", F.col("px").alias("x"), F.col("py").alias("y"), "channel").agg(F.expr("(sum(v) + 2) div 4").alias("value"))


def palette(colours: DataFrame) -> DataFrame:
    """For colours (ordinal, rgba): layer and material of the ordinal's number, voxel key one above it, tint the colour."""
    i = F.col("ordinal").cast("bigint")
    return colours.select(i.alias("layer"), i.alias("material_id"), (i + 1).alias("key"), F.col("rgba").cast("bigint").alias("tint"))


def problems(textures: DataFrame, subresources: DataFrame, materials: DataFrame, blobs: DataFrame) -> DataFrame:
    """(archive, what, id, problem) for each breach of an archive's structure; ``blobs``: archive, blob_bytes."""
    def found(df: DataFrame, what: str, id_: str, rules: dict[str, Column]) -> DataFrame:
        each = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))
        return df.select("archive", F.lit(what).alias("what"), F.col(id_).cast("bigint").alias("id"), each.alias("problem"))

    c = F.col
    t = found(textures, "texture", "texture", {
        "no width or height": (c("width") == 0) | (c("height") == 0), "no mip levels": c("mips") == 0, "no layers": (c("kind") == FLAT) & (c("layers") == 0),
        "a solid has one layer": (c("kind") == SOLID) & (c("layers") != 1), "unknown format": ~supported(c("format")) & (c("kind") != BUFFER)})
    own = textures.select("archive", "texture", "kind", "mips", "layers")
    s = subresources.join(own, ["archive", "texture"], "left").join(blobs, "archive", "left")
    known = c("mips").isNotNull()
    u = found(s, "subresource", "texture", {
        "no such texture": ~known, "mip out of range": known & (c("mip") >= c("mips")), "layer out of range": known & (c("kind") == FLAT) & (c("layer") >= c("layers")),
        "beyond the blob": known & (c("blob_offset") + c("blob_size") > F.coalesce(c("blob_bytes"), F.lit(0))), "no extent": known & ((c("extent_x") == 0) | (c("extent_y") == 0) | (c("extent_z") == 0))})
    count = textures.groupBy("archive").agg(F.count("*").alias("n"))
    m = found(materials.join(count, "archive", "left"), "material", "material_id", {f"no such {k} texture": (c(k) != 0) & (c(k) >= F.coalesce(c("n"), F.lit(0))) for k in ("albedo", "normal", "orm", "emissive")})
    return t.unionByName(u).unionByName(m)
