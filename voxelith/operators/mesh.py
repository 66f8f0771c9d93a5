"""Between meshes and cells: faces to cell ranges, rays through shells, colours to keys; and scenes of placed models.

A mesh lies in a frame whose third axis is up (``address.Z_UP``); a world has its own convention, a voxel size and an
origin. Faces: face, axis and sign of the normal, low and high corner (lx .. hz).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.address import Y_UP, Z_UP, Geometry, convert
from .voxel import CELL, filled_lines, last_writes, replace_bounds, set_voxels, surface_and_interior

#: A normal is along an axis from here on; a face is flat up to this share of a voxel; its probe stands this far inside.
STRAIGHT, FLAT, INSET = 0.999, 1e-3, 0.25
#: Share of faces along an axis from which on a mesh is made of voxels; least squared distance of a colour of its own.
SHAPED, TOLERANCE = 0.999, 0.02
LOW, HIGH = ["lx", "ly", "lz"], ["hx", "hy", "hz"]


@dataclass(frozen=True)
class Frame:
    size: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    convention: int = Y_UP

    def extent(self) -> list[float]:
        """A voxel's edges along the mesh's axes."""
        x, y, z = self.size
        return [x, z, y] if self.convention != Z_UP else [x, y, z]

    def to_cells(self, p: list[Column]) -> list[Column]:
        """The cells that hold points of the mesh's frame."""
        q = convert(Z_UP, self.convention, *p, cells=False)
        return [F.floor((c - F.lit(o)) / F.lit(s)).cast("bigint") for c, o, s in zip(q, self.origin, self.size, strict=True)]

    def to_points(self, cell: list[Column], corner: bool = False) -> list[Column]:
        """Centres of cells, or their low corners, in the mesh's frame."""
        at = [F.lit(o) + (c.cast("double") + F.lit(0.0 if corner else 0.5)) * F.lit(s) for c, o, s in zip(cell, self.origin, self.size, strict=True)]
        return list(convert(self.convention, Z_UP, *at, cells=False))


def face_extents(corners: DataFrame) -> DataFrame:
    """Faces from their corners (face, x, y, z, and optionally r, g, b): low and high corner, mean colour."""
    colour = [F.avg(c).alias(c) for c in "rgb" if c in corners.columns]
    return corners.groupBy("face").agg(*(F.min(c).alias(n) for c, n in zip(CELL, LOW, strict=True)), *(F.max(c).alias(n) for c, n in zip(CELL, HIGH, strict=True)), *colour)


def oriented(faces: DataFrame) -> DataFrame:
    """``faces`` with axis and sign of their normal (nx, ny, nz): the axis of the largest part, of equals the lowest."""
    n = [F.col(f"n{c}") for c in "xyz"]
    most = F.greatest(*map(F.abs, n))
    axis = F.when(F.abs(n[0]) == most, 0).when(F.abs(n[1]) == most, 1).otherwise(2)
    return faces.withColumn("axis", axis).withColumn("sign", F.signum(F.when(F.col("axis") == 0, n[0]).when(F.col("axis") == 1, n[1]).otherwise(n[2])).cast("int"))


def _along(columns: list[str], axis: str = "axis") -> Column:
    return F.when(F.col(axis) == 0, F.col(columns[0])).when(F.col(axis) == 1, F.col(columns[1])).otherwise(F.col(columns[2]))


def straight(faces: DataFrame, f: Frame) -> Column:
    """Whether an oriented face lies in a plane across an axis."""
    long = F.sqrt(sum(F.col(f"n{c}") * F.col(f"n{c}") for c in "xyz"))
    return (F.abs(_along(["nx", "ny", "nz"])) > STRAIGHT * long) & (_along(HIGH) - _along(LOW) < FLAT * min(f.extent()))


def voxel_shaped(faces: DataFrame, f: Frame) -> DataFrame:
    """(shaped): whether nearly all faces lie across an axis; false without any."""
    return faces.agg(F.coalesce(F.avg(straight(faces, f).cast("double")) >= SHAPED, F.lit(False)).alias("shaped"))


def face_cells(faces: DataFrame, f: Frame) -> DataFrame:
    """The inclusive range of cells behind each face (face, axis, sign, corners), and its outward axis and sign in the world.

    In its plane the face is shrunk by a quarter of a voxel, so that no probe stands on a border (a face that is too
    narrow is probed in its middle); across it the probe stands a quarter inside.
    """
    low, high = [], []
    for i, (a, b, e) in enumerate(zip(LOW, HIGH, f.extent(), strict=True)):
        mid, inset = (F.col(a) + F.col(b)) * 0.5, INSET * e
        narrow = F.col(a) + inset > F.col(b) - inset
        plane = mid - F.col("sign") * inset
        low.append(F.when(F.col("axis") == i, plane).when(narrow, mid).otherwise(F.col(a) + inset))
        high.append(F.when(F.col("axis") == i, plane).when(narrow, mid).otherwise(F.col(b) - inset))
    p, q = f.to_cells(low), f.to_cells(high)
    unit = [F.when(F.col("axis") == i, F.col("sign")).otherwise(0) for i in range(3)]
    out = convert(Z_UP, f.convention, *unit, cells=False)
    axis = F.when(out[0] != 0, 0).when(out[1] != 0, 1).otherwise(2)
    return faces.select("face", *(F.least(a, b).alias(n) for a, b, n in zip(p, q, ("x0", "y0", "z0"), strict=True)), *(F.greatest(a, b).alias(n) for a, b, n in zip(p, q, ("x1", "y1", "z1"), strict=True)), axis.alias("axis"), (out[0] + out[1] + out[2]).cast("int").alias("sign"))


def rasterized(ranges: DataFrame, limit: int | None = None) -> DataFrame:
    """Every cell of each range (face, x0 .. z1 and any other columns). ``limit``: more cells than this in all are an error.

    Ranges are exploded axis by axis, a row at a time; with a limit the volume is summed first.
    """
    if limit is not None:
        total = ranges.agg(F.sum((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) * (F.col("z1") - F.col("z0") + 1)).alias("n")).first()["n"] or 0
        if total > limit:
            raise ValueError(f"the faces cover {total} cells, more than {limit}")
    rest = [c for c in ranges.columns if c not in ("x0", "y0", "z0", "x1", "y1", "z1")]
    out = ranges
    for c in CELL:
        out = out.withColumn(c, F.explode(F.sequence(f"{c}0", f"{c}1")))
    return out.select(*rest, *CELL)


def import_mesh(v: DataFrame, faces: DataFrame, keys: DataFrame, f: Frame, g: Geometry, solid: bool = True, bounds: tuple | None = None, limit: int | None = 16_000_000) -> DataFrame:
    """``v`` with the cells of a voxel-shaped mesh written to it.

    ``faces`` as for ``face_cells``, ``keys`` (face, key). Cells behind faces take their face's key, of several the last
    face's; with ``solid``, what the faces enclose is filled, and the surface wins where they meet. ``bounds`` (low, high):
    a box that is cleared first.
    """
    shell = rasterized(face_cells(faces, f).join(keys, "face"), limit)
    surface = last_writes(shell.select(F.col("face").alias("seq"), *CELL, "key"))
    cells = surface_and_interior(surface, filled_lines(shell.select(*CELL, "axis", "sign", "key"))) if solid else surface.where("key <> 0")
    edits = cells.select(F.lit(0).alias("seq"), *CELL, "key")
    return replace_bounds(v, *bounds, edits, g) if bounds else set_voxels(v, edits, g)


def voxelized(triangles: DataFrame, f: Frame, surface_only: bool = False, limit: int = 8_000_000) -> DataFrame:
    """(x, y, z, face): cells of a closed mesh of ``triangles`` (face, ax .. cz), by rays along x through the centres of
    lines of cells; with ``surface_only`` just the cells that the surface passes along x.

    Cells between a crossing and the next belong to it. A box of more than ``limit`` cells is refused.
    """
    points = triangles.select(F.explode(F.array(*(F.struct(*(F.col(f"{p}{c}").alias(c) for c in CELL)) for p in "abc"))).alias("p")).select("p.*")
    box = cell_box(points, f).first()
    if box["x0"] is None:
        return triangles.limit(0).select(*(F.lit(0).cast("bigint").alias(c) for c in CELL), "face")
    low, high = [box[f"{c}0"] for c in CELL], [box[f"{c}1"] for c in CELL]
    nx, ny, nz = (b - a + 1 for a, b in zip(low, high, strict=True))
    if nx * ny * nz > limit:
        raise ValueError(f"the mesh's box holds {nx * ny * nz} cells, more than {limit}")
    line = triangles.sparkSession.range(ny * nz).select(F.col("id").alias("ray"), (F.col("id") % ny + low[1]).alias("cy"), (F.expr(f"id div {ny}") + low[2]).alias("cz"))
    centre = f.to_points([F.lit(low[0]), F.col("cy"), F.col("cz")])
    rays = line.select("ray", centre[1].alias("y"), centre[2].alias("z"))
    hits = crossings(rays, triangles, max(f.extent()))
    first = f.origin[0] + low[0] * f.size[0]
    if surface_only:
        found = surface_cells(hits, first, f.size[0], nx)
    else:
        cells = hits.select("ray").distinct().select("ray", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nx - 1).cast("bigint"))).alias("cell"))
        found = span_cells(paired(hits), cells.withColumn("x", F.lit(first) + (F.col("cell") + 0.5) * F.lit(f.size[0])), 64 * f.size[0])
    return found.join(line, "ray").select((F.col("cell") + low[0]).alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "face")


def cell_box(points: DataFrame, f: Frame) -> DataFrame:
    """(x0 .. z1): the cells that the points (x, y, z) of an object span."""
    c = f.to_cells([F.col(a) for a in CELL])
    each = points.select(*(v.alias(a) for v, a in zip(c, CELL, strict=True)))
    return each.agg(*(F.min(a).alias(f"{a}0") for a in CELL), *(F.max(a).alias(f"{a}1") for a in CELL))


def grid_code(cell: list[Column], low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """One number for a cell of a box, x fastest; boxes of 2^62 cells or more are refused."""
    sx, sy, sz = (b - a + 1 for a, b in zip(low, high, strict=True))
    if min(sx, sy, sz) < 1 or sx * sy * sz >= 1 << 62:
        raise ValueError("a box of at least one and fewer than 2^62 cells is needed")
    x, y, z = (c - F.lit(a) for c, a in zip(cell, low, strict=True))
    return x + sx * (y + sy * z)


def grid_cell(code: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> list[Column]:
    sx, sy, _ = (b - a + 1 for a, b in zip(low, high, strict=True))
    rest = F.call_function("div", code, F.lit(sx).cast("bigint"))
    return [code % sx + low[0], rest % sy + low[1], F.call_function("div", rest, F.lit(sy).cast("bigint")) + low[2]]


def crossings(rays: DataFrame, triangles: DataFrame, width: float = 1.0) -> DataFrame:
    """(ray, at, face): where rays along x (ray, y, z) cross triangles (face, ax .. cz).

    Rays and triangles meet in cells of a grid of ``width`` over y and z, each triangle in all that its box touches, so
    none is compared with all. A ray through an edge shared by two triangles crosses it once.
    """
    def cells(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))

    t = triangles.select("*", F.explode(cells(F.least("ay", "by", "cy"), F.greatest("ay", "by", "cy"))).alias("gy")).withColumn("gz", F.explode(cells(F.least("az", "bz", "cz"), F.greatest("az", "bz", "cz"))))
    r = rays.select("ray", "y", "z", F.floor(F.col("y") / width).cast("bigint").alias("gy"), F.floor(F.col("z") / width).cast("bigint").alias("gz"))
    j = r.join(t, ["gy", "gz"])

    def turn(p: str, q: str) -> Column:
        return (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col("z") - F.col(f"{p}z")) - (F.col(f"{q}z") - F.col(f"{p}z")) * (F.col("y") - F.col(f"{p}y"))

    u, v, w = turn("b", "c"), turn("c", "a"), turn("a", "b")
    area = u + v + w
    # A ray on an edge belongs to the side on which the edge goes up, or along if level: one of two neighbours.
    def inside(e: Column, p: str, q: str) -> Column:
        rising = (F.col(f"{q}y") > F.col(f"{p}y")) | ((F.col(f"{q}y") == F.col(f"{p}y")) & (F.col(f"{q}z") > F.col(f"{p}z")))
        return (e * F.signum(area) > 0) | ((e == 0) & ((area > 0) == rising))

    hit = (area != 0) & inside(u, "b", "c") & inside(v, "c", "a") & inside(w, "a", "b")
    return j.where(hit).select("ray", ((u * F.col("ax") + v * F.col("bx") + w * F.col("cx")) / area).alias("at"), "face").distinct()


def paired(hits: DataFrame) -> DataFrame:
    """(ray, start, end, face): crossings of a ray (ray, at, face) in order, two by two; a last odd one is dropped."""
    w = Window.partitionBy("ray").orderBy("at", "face")
    r = hits.select("ray", "at", "face", (F.row_number().over(w) - 1).alias("r"), F.lead("at").over(w).alias("end"))
    return r.where("r % 2 = 0 and `end` is not null").select("ray", F.col("at").alias("start"), "end", "face")


def span_cells(spans: DataFrame, lines: DataFrame, bin_width: float = 64.0) -> DataFrame:
    """(ray, cell, face): cells of a line (ray, cell, x) whose centre lies in a span of the same ray, ends included.

    Spans and centres meet in bins of ``bin_width`` along the line; of several spans of a cell the last to begin counts.
    """
    s = spans.select("ray", "start", "end", "face", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width))).alias("bin"))
    c = lines.select("ray", "cell", "x", F.floor(F.col("x") / bin_width).alias("bin"))
    met = c.join(s, ["ray", "bin"]).where("x between start and `end`")
    return met.groupBy("ray", "cell").agg(F.max(F.struct("start", "face"))["face"].alias("face"))


def surface_cells(hits: DataFrame, origin: float, size: float, count: int) -> DataFrame:
    """(ray, cell, face): for each crossing the first cell of its line whose centre is not before it, the last one at most."""
    first = F.ceil((F.col("at") - F.lit(origin)) / F.lit(size) - 0.5).cast("bigint")
    cell = F.least(F.greatest(first, F.lit(0).cast("bigint")), F.lit(count - 1).cast("bigint"))
    return hits.select("ray", cell.alias("cell"), "at", "face").groupBy("ray", "cell").agg(F.max(F.struct("at", "face"))["face"].alias("face"))


def nearest_keys(colours: DataFrame, registry: DataFrame) -> DataFrame:
    """(colour columns, key): for each colour (r, g, b in 0 to 255) the registry's nearest (ordinal, key, r, g, b), of
    equals the first; 0 if it is further than ``TOLERANCE`` in units of full scale.

    The registry is a world's, one array in a single row; each distinct colour looks through it once.
    """
    one = registry.agg(F.sort_array(F.collect_list(F.struct("ordinal", "key", "r", "g", "b"))).alias("known"))
    distinct = colours.select("r", "g", "b").distinct().join(F.broadcast(one))

    def far(s) -> Column:
        return sum((s[c] - F.col(c)) * (s[c] - F.col(c)) for c in "rgb").cast("bigint")

    best = F.array_min(F.transform("known", lambda s: F.struct(far(s).alias("d"), s["ordinal"].alias("o"), s["key"].alias("key"))))
    return distinct.select("r", "g", "b", F.when(best["d"] / F.lit(255.0 * 255.0) <= TOLERANCE, best["key"]).otherwise(0).alias("key"))


def registered_colours(colours: DataFrame, registry: DataFrame, limit: int = 65_536) -> list[tuple[int, int, int, int]]:
    """(key, r, g, b) of the colours that get keys of their own: each, in order, that is far from all known so far.

    One colour's key depends on those before it, so the distinct far ones, at most ``limit``, come to the driver.
    """
    far = nearest_keys(colours, registry).where("key = 0").select("r", "g", "b").orderBy("r", "g", "b").limit(limit + 1).collect()
    if len(far) > limit:
        raise ValueError(f"more than {limit} new colours")
    key, new = (registry.agg(F.max("key")).first()[0] or 0) + 1, []
    for c in far:
        if all(sum((a - b) ** 2 for a, b in zip(c, n[1:], strict=True)) / 255.0 ** 2 > TOLERANCE for n in new):
            new.append((key, *c))
            key += 1
    return new


def slot_keys(slots: DataFrame, registry: DataFrame) -> DataFrame:
    """(object, slot, key): a material's stamped key, else that of the registry entry of its name, else slot + 1.

    ``slots``: object, slot, material, stamped. Of entries that share a name the last counts.
    """
    named = registry.where("name is not null and name <> ''").groupBy("name").agg(F.max_by("key", "ordinal").alias("by_name"))
    j = slots.join(named, F.col("material") == F.col("name"), "left")
    return j.select("object", "slot", F.coalesce("stamped", "by_name", F.col("slot") + 1).cast("bigint").alias("key"))


def face_keys(faces: DataFrame, slots: DataFrame, colours: DataFrame, active: int) -> DataFrame:
    """(face, key): a face's own attribute, else its material slot's key, else its colour's, else the active key; 0 is none."""
    j = faces.join(slots, ["object", "slot"], "left").join(colours.withColumnRenamed("key", "by_colour"), ["r", "g", "b"], "left")
    return j.select("face", F.coalesce(F.nullif("attribute", F.lit(0)), F.nullif("key", F.lit(0)), F.nullif("by_colour", F.lit(0)), F.lit(active)).cast("bigint").alias("key"))


def corner_order(axis: int, sign: int, f: Frame) -> list[tuple[int, int, int]]:
    """The four corner steps of a cube's face, in an order whose normal points outward in the mesh's frame."""
    others = [i for i in range(3) if i != axis]
    steps = []
    for u, v in ((0, 0), (1, 0), (1, 1), (0, 1)):
        s = [0, 0, 0]
        s[axis], s[others[0]], s[others[1]] = int(sign > 0), u, v
        steps.append(tuple(s))

    def moved(p):
        x, y, z = (a * b for a, b in zip(p, f.size, strict=True))
        return (x, y, z) if f.convention == Z_UP else (x, -z, y) if f.convention == Y_UP else (x, z, y)

    def cross(a, b):
        return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    p = [moved(s) for s in steps]
    normal = cross(*([b - a for a, b in zip(p[0], q, strict=True)] for q in (p[1], p[3])))
    out = [0, 0, 0]
    out[axis] = sign
    return steps if sum(a * b for a, b in zip(normal, moved(out), strict=True)) > 0 else steps[::-1]


def quads(faces: DataFrame, f: Frame) -> tuple[DataFrame, DataFrame]:
    """A cube mesh of exposed ``faces`` (x, y, z, axis, sign, key): its points, each once, and each face's four of them.

    Points (px, py, pz in the corner lattice, and where they lie) are named by their place in the lattice, so faces refer
    to them without a number that would need all points in order.
    """
    order = F.create_map(*(x for a in range(3) for s in (-1, 1) for x in (F.lit(f"{a}{s}"), F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(step, "xyz", strict=True))) for step in corner_order(a, s, f))))))
    steps = F.element_at(order, F.concat(F.col("axis").cast("string"), F.col("sign").cast("string")))
    each = faces.select(*CELL, "axis", "sign", "key", F.transform(steps, lambda s: F.struct(*((F.col(c) + s[c]).alias(f"p{c}") for c in CELL))).alias("corners"))
    points = each.select(F.explode("corners").alias("c")).select("c.*").distinct()
    at = f.to_points([F.col(f"p{c}") for c in CELL], corner=True)
    return points.select("px", "py", "pz", *(p.alias(f"at_{c}") for p, c in zip(at, CELL, strict=True))), each


def turn(byte: Column) -> dict[str, Column]:
    """A packed rotation: for each row the column that is not zero (r0, r1, r2) and its sign (s0, s1, s2)."""
    def bits(shift: int, mask: int) -> Column:
        return F.shiftright(byte.cast("int"), shift).bitwiseAND(F.lit(mask))

    a, b = bits(0, 3), bits(2, 3)
    return {"r0": a, "r1": b, "r2": F.lit(3) - a - b} | {f"s{i}": F.when(bits(4 + i, 1) == 1, -1).otherwise(1) for i in range(3)}


def placed(instances: DataFrame, models: DataFrame, voxels: DataFrame) -> DataFrame:
    """(ordinal, model, sx .. sz, x, y, z, colour): model voxels where each instance puts them, in the scene.

    ``instances``: ordinal, model, r0 .. s2 as ``turn`` gives, tx, ty, tz, hidden. ``models``: model, sx, sy, sz (their
    sizes). ``voxels``: model, vx, vy, vz, colour. Hidden instances, colour 0 and voxels outside a model's size are left
    out. A model turns about its middle; of a turned cell's two corners the lower one is its place.
    """
    shown = instances.where("not hidden").join(models, "model")
    j = shown.join(sound_voxels(voxels, models).select("model", "vx", "vy", "vz", "colour"), "model")
    local = [F.col(f"v{c}") - F.expr(f"s{c} div 2") for c in CELL]
    at = []
    for i, c in enumerate(CELL):
        p = F.when(F.col(f"r{i}") == 0, local[0]).when(F.col(f"r{i}") == 1, local[1]).otherwise(local[2])
        at.append((F.when(F.col(f"s{i}") > 0, p).otherwise(-p - 1) + F.col(f"t{c}")).cast("bigint").alias(c))
    return j.select("ordinal", "model", *at, "colour")


def sound_voxels(voxels: DataFrame, models: DataFrame) -> DataFrame:
    """Model voxels that have a colour and lie in their model."""
    return voxels.join(models, "model").where("colour <> 0 and vx < sx and vy < sy and vz < sz").select(voxels.columns)


def scene(instances: DataFrame, models: DataFrame, voxels: DataFrame) -> DataFrame:
    """(x, y, z, key): a scene's voxels in the canonical convention, moved so that their box begins at zero; of voxels that
    meet the later instance's counts."""
    p = placed(instances, models, voxels)
    c = p.select(*(v.alias(a) for v, a in zip(convert(Z_UP, Y_UP, *map(F.col, CELL), cells=True), CELL, strict=True)), "ordinal", "colour")
    one = c.groupBy(*CELL).agg((F.max(F.col("ordinal").cast("bigint") * 256 + F.col("colour")) % 256).cast("bigint").alias("key"))
    box = scene_box(one)
    return one.join(F.broadcast(box)).select(*((F.col(a) - F.col(f"{a}0")).alias(a) for a in CELL), "key")


def scene_box(cells: DataFrame) -> DataFrame:
    return cells.agg(*(F.min(a).alias(f"{a}0") for a in CELL), *(F.max(a).alias(f"{a}1") for a in CELL))
