"""Queries of textures, meshes and scenes of placed models, each with SQL that another engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import address, scalar
from ..operators import mesh, textures as tx, voxel as op
from ..sources.tables import registry, table, voxels
from .queries import _AT, _BASE, _FACES, _SHELL, G, _shell, query

_FORMAT = "format(format, size, edge) AS (VALUES " + ", ".join(f"({k}::BIGINT, {a}::BIGINT, {b}::BIGINT)" for k, (a, b) in tx.FORMATS.items()) + ")"
_NUMBERS = [*sorted(tx.FORMATS), 1]
_PICK = "[" + ", ".join(map(str, _NUMBERS)) + "]"


def _textures(spark, d) -> DataFrame:
    """A texture for each part: formats in turn, one of them unknown, a few with faults."""
    i = F.col("p_partkey")
    fmt = F.element_at(F.array(*map(F.lit, _NUMBERS)), (i % len(_NUMBERS) + 1).cast("int")).cast("bigint")
    return table(spark, d, "part").select(
        F.expr("p_partkey div 100").alias("archive"), (i % 100).alias("texture"), (i % 3).alias("kind"), fmt.alias("format"), F.when(i % 41 == 7, 0).otherwise(F.col("p_size").cast("bigint")).alias("width"),
        (i % 64 + 1).alias("height"), (i % 4).alias("mips"), (i % 3).alias("layers"))


_TEXTURE = f"texture AS (SELECT p_partkey // 100 AS archive, p_partkey % 100 AS texture, p_partkey % 3 AS kind, CAST({_PICK}[p_partkey % {len(_NUMBERS)} + 1] AS BIGINT) AS format, CASE WHEN p_partkey % 41 = 7 THEN 0 ELSE CAST(p_size AS BIGINT) END AS width, p_partkey % 64 + 1 AS height, p_partkey % 4 AS mips, p_partkey % 3 AS layers FROM part)"


@query(f"WITH {_FORMAT}, {_TEXTURE} SELECT archive, texture, coalesce(size, 0) > 0 AS supported, CASE WHEN coalesce(edge, 1) = 1 THEN coalesce(size, 0) ELSE 0 END::INT AS texel, CAST((width + coalesce(edge, 1) - 1) // coalesce(edge, 1) * ((height + coalesce(edge, 1) - 1) // coalesce(edge, 1)) * coalesce(size, 0) AS BIGINT) AS bytes FROM texture LEFT JOIN format USING (format)")
def q_subresource_size(spark, d):
    f = F.col("format")
    return _textures(spark, d).select("archive", "texture", tx.supported(f).alias("supported"), tx.texel_bytes(f).alias("texel"), tx.subresource_bytes(f, F.col("width"), F.col("height")).alias("bytes"))


def _subresources(spark, d) -> DataFrame:
    t = _textures(spark, d)
    e = t.select("archive", "texture", "format", "width", "height", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("mips"))).alias("mip"), "layers").withColumn("layer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("layers"))))
    w, h = scalar.mip_extent(F.col("width"), F.col("mip").cast("int")), scalar.mip_extent(F.col("height"), F.col("mip").cast("int"))
    return e.select("archive", "texture", "mip", "layer", tx.subresource_bytes(F.col("format"), w, h).alias("blob_size"), w.alias("extent_x"), h.alias("extent_y"), F.lit(1).alias("extent_z"))


_SUB = f"{_FORMAT}, {_TEXTURE}, cut AS (SELECT archive, texture, format, mip, layer, greatest(1, width >> mip) AS w, greatest(1, height >> mip) AS h FROM texture, range(4) m(mip), range(3) l(layer) WHERE mip <= mips AND layer <= layers), sub AS (SELECT archive, texture, mip, layer, w, h, CAST((w + coalesce(edge, 1) - 1) // coalesce(edge, 1) * ((h + coalesce(edge, 1) - 1) // coalesce(edge, 1)) * coalesce(size, 0) AS BIGINT) AS blob_size FROM cut LEFT JOIN format USING (format))"


@query(f"WITH {_SUB} SELECT archive, texture, mip, layer, blob_size, row_number() OVER w - 1 AS place, CAST(coalesce(sum(blob_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blob_offset FROM sub WINDOW w AS (PARTITION BY archive ORDER BY texture, mip, layer)")
def q_subresource_layout(spark, d):
    return tx.laid_out(_subresources(spark, d))


@query(f"WITH {_SUB}, n AS (SELECT archive, texture, count(*) AS \"count\" FROM sub GROUP BY 1, 2) SELECT archive, texture, CAST(coalesce(sum(\"count\") OVER (PARTITION BY archive ORDER BY texture ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, \"count\" FROM n")
def q_subresource_ranges(spark, d):
    return tx.ranges(_subresources(spark, d))


def _images(spark, d) -> DataFrame:
    i = F.col("p_partkey")
    return table(spark, d, "part").select(i.alias("image"), (i % 7 + 1).alias("width"), (i % 5 + 1).alias("height"), F.lit(37).alias("format"))


@query("""WITH t AS (SELECT p_partkey AS image, x, y, ch AS channel, p_partkey % 7 + 1 AS w, p_partkey % 5 + 1 AS h, (p_partkey * 31 + x * 17 + y * 29 + ch * 7) % 256 AS value FROM part, range(7) a(x), range(5) b(y), range(4) c(ch) WHERE x <= p_partkey % 7 AND y <= p_partkey % 5),
p AS (SELECT DISTINCT image, w, h, x, y FROM t WHERE x < greatest(1, w >> 1) AND y < greatest(1, h >> 1))
SELECT p.image, p.x, p.y, a.channel, CAST((a.value + b.value + c.value + e.value + 2) // 4 AS BIGINT) AS value FROM p
JOIN t a ON a.image = p.image AND a.x = 2 * p.x AND a.y = 2 * p.y
JOIN t b ON b.image = p.image AND b.channel = a.channel AND b.x = least(2 * p.x + 1, p.w - 1) AND b.y = 2 * p.y
JOIN t c ON c.image = p.image AND c.channel = a.channel AND c.x = 2 * p.x AND c.y = least(2 * p.y + 1, p.h - 1)
JOIN t e ON e.image = p.image AND e.channel = a.channel AND e.x = least(2 * p.x + 1, p.w - 1) AND e.y = least(2 * p.y + 1, p.h - 1)""")
def q_mip_box_filter(spark, d):
    images = _images(spark, d)
    t = images
    for c, n in (("x", F.col("width") - 1), ("y", F.col("height") - 1), ("channel", F.lit(3).cast("bigint"))):
        t = t.withColumn(c, F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    texels = t.select("image", "x", "y", "channel", ((F.col("image") * 31 + F.col("x") * 17 + F.col("y") * 29 + F.col("channel") * 7) % 256).alias("value"))
    return tx.next_level(texels, images)


@query("SELECT p_partkey AS layer, p_partkey AS material_id, p_partkey + 1 AS key, p_partkey * 256 + 255 AS tint FROM part")
def q_make_palette(spark, d):
    return tx.palette(table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), (F.col("p_partkey") * 256 + 255).alias("rgba")))


@query(f"""WITH {_SUB}, known AS (SELECT * FROM texture LEFT JOIN format USING (format)),
lost AS (SELECT archive, texture + CASE WHEN texture % 10 = 3 THEN 1000 ELSE 0 END AS texture, mip, layer, w, h, blob_size FROM sub),
laid AS (SELECT l.*, t.kind, t.mips, t.layers, t.texture IS NOT NULL AS there, 900 * l.mip AS blob_offset FROM lost l LEFT JOIN texture t USING (archive, texture)),
mat AS (SELECT archive, texture AS material_id, texture + 60 AS albedo, texture AS normal, 0 AS orm, texture % 7 AS emissive FROM texture),
n AS (SELECT archive, count(*) AS n FROM texture GROUP BY 1)
SELECT archive, 'texture' AS what, texture AS id, 'no width or height' AS problem FROM known WHERE width = 0 OR height = 0
UNION ALL SELECT archive, 'texture', texture, 'no mip levels' FROM known WHERE mips = 0
UNION ALL SELECT archive, 'texture', texture, 'no layers' FROM known WHERE kind = 0 AND layers = 0
UNION ALL SELECT archive, 'texture', texture, 'a solid has one layer' FROM known WHERE kind = 1 AND layers <> 1
UNION ALL SELECT archive, 'texture', texture, 'unknown format' FROM known WHERE size IS NULL AND kind <> 2
UNION ALL SELECT archive, 'subresource', texture, 'no such texture' FROM laid WHERE NOT there
UNION ALL SELECT archive, 'subresource', texture, 'mip out of range' FROM laid WHERE there AND mip >= mips
UNION ALL SELECT archive, 'subresource', texture, 'layer out of range' FROM laid WHERE there AND kind = 0 AND layer >= layers
UNION ALL SELECT archive, 'subresource', texture, 'beyond the blob' FROM laid WHERE there AND blob_offset + blob_size > 2000
UNION ALL SELECT archive, 'material', material_id, 'no such albedo texture' FROM mat JOIN n USING (archive) WHERE albedo <> 0 AND albedo >= n
UNION ALL SELECT archive, 'material', material_id, 'no such normal texture' FROM mat JOIN n USING (archive) WHERE normal <> 0 AND normal >= n
UNION ALL SELECT archive, 'material', material_id, 'no such emissive texture' FROM mat JOIN n USING (archive) WHERE emissive <> 0 AND emissive >= n""")
def q_texture_validate(spark, d):
    t = _textures(spark, d)
    s = _subresources(spark, d).withColumn("blob_offset", F.col("mip") * 900).withColumn("texture", F.col("texture") + F.when(F.col("texture") % 10 == 3, 1000).otherwise(0))
    m = t.select("archive", F.col("texture").alias("material_id"), (F.col("texture") + 60).alias("albedo"), F.col("texture").alias("normal"), F.lit(0).alias("orm"), (F.col("texture") % 7).alias("emissive"))
    return tx.problems(t, s, m, t.select("archive", F.lit(2000).alias("blob_bytes")).distinct())


# A rectangle for each event: across an axis in turn, one to three voxels wide, in halves of a voxel.
FRAME = mesh.Frame((0.5, 0.25, 1.0), (0.125, -0.5, 2.0), address.Y_UP)


def _faces(spark, d) -> DataFrame:
    i = F.col("event_id")
    axis, sign = (i % 3).cast("int"), F.when(i % 2 == 0, 1).otherwise(-1)
    low = [F.col("user_id") * 0.5, (i % 37) * 1.0, (i % 23) * 0.25]
    wide = [1.0 + i % 3, 2.0, 0.5 + 0.25 * (i % 4)]
    e = table(spark, d, "events").select(i.alias("face"), axis.alias("axis"), sign.alias("sign"), *(v.cast("double").alias(c) for v, c in zip(low, mesh.LOW, strict=True)), *(v.cast("double").alias(f"w{c}") if not isinstance(v, float) else F.lit(v).alias(f"w{c}") for v, c in zip(wide, "xyz", strict=True)))
    return e.select("face", "axis", "sign", *mesh.LOW, *((F.col(a) + F.when(F.col("axis") == k, 0.0).otherwise(F.col(f"w{c}"))).alias(b) for k, (a, b, c) in enumerate(zip(mesh.LOW, mesh.HIGH, "xyz", strict=True))))


_RECT = """rect AS (SELECT event_id AS face, CAST(event_id % 3 AS INTEGER) AS axis, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sign, user_id * 0.5::DOUBLE AS lx, (event_id % 37)::DOUBLE AS ly, (event_id % 23) * 0.25::DOUBLE AS lz,
user_id * 0.5::DOUBLE + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1.0::DOUBLE + event_id % 3 END AS hx, (event_id % 37)::DOUBLE + CASE WHEN event_id % 3 = 1 THEN 0 ELSE 2.0::DOUBLE END AS hy, (event_id % 23) * 0.25::DOUBLE + CASE WHEN event_id % 3 = 2 THEN 0 ELSE 0.5::DOUBLE + 0.25::DOUBLE * (event_id % 4) END AS hz FROM events)"""


def _probe(k: int, c: str, edge: float, low: bool) -> str:
    mid, inset = f"(l{c} + h{c}) * 0.5::DOUBLE", f"{0.25 * edge!r}::DOUBLE"
    end = f"l{c} + {inset}" if low else f"h{c} - {inset}"
    return f"CASE WHEN axis = {k} THEN {mid} - sign * {inset} WHEN l{c} + {inset} > h{c} - {inset} THEN {mid} ELSE {end} END"


def _cells_sql(low: bool) -> list[str]:
    """Cells of the frame, whose world is y up: x stays, y is the mesh's z, z is minus its y."""
    ex, ey, ez = 0.5, 1.0, 0.25
    px, py, pz = _probe(0, "x", ex, low), _probe(1, "y", ey, low), _probe(2, "z", ez, low)
    return [f"CAST(floor((({px}) - 0.125::DOUBLE) / 0.5::DOUBLE) AS BIGINT)", f"CAST(floor((({pz}) + 0.5::DOUBLE) / 0.25::DOUBLE) AS BIGINT)", f"CAST(floor((-({py}) - 2.0::DOUBLE) / 1.0::DOUBLE) AS BIGINT)"]


_RANGE = f"WITH {_RECT}, p AS (SELECT face, " + ", ".join(f"{a} AS a{i}, {b} AS b{i}" for i, (a, b) in enumerate(zip(_cells_sql(True), _cells_sql(False), strict=True))) + ", CAST(CASE axis WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS INTEGER) AS axis, CAST(CASE axis WHEN 1 THEN -sign ELSE sign END AS INTEGER) AS sign FROM rect), cells AS (SELECT face, " + ", ".join(f"least(a{i}, b{i}) AS {c}0, greatest(a{i}, b{i}) AS {c}1" for i, c in enumerate("xyz")) + ", axis, sign FROM p)"


@query(_RANGE + " SELECT * FROM cells")
def q_face_cells(spark, d):
    return mesh.face_cells(_faces(spark, d), FRAME)


@query(_RANGE + " SELECT face, axis, sign, x, y, unnest(range(z0, z1 + 1)) AS z FROM (SELECT face, axis, sign, z0, z1, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT face, axis, sign, y0, y1, z0, z1, unnest(range(x0, x1 + 1)) AS x FROM cells))")
def q_rasterize_faces(spark, d):
    return mesh.rasterized(mesh.face_cells(_faces(spark, d), FRAME))


_CORNERS = "corner AS (SELECT face, x, y, z, face % 5 * 0.25::DOUBLE + x AS r FROM (SELECT face, CASE WHEN u = 0 THEN lx ELSE hx END AS x, CASE WHEN w = 0 THEN ly ELSE hy END AS y, CASE WHEN (u + w) % 2 = 0 THEN lz ELSE hz END AS z FROM rect, range(2) a(u), range(2) b(w)))"


@query(f"WITH {_RECT}, {_CORNERS} SELECT face, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM corner GROUP BY face")
def q_face_extents(spark, d):
    ends = F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(w).alias("w")) for u in (0, 1) for w in (0, 1))))
    f = _faces(spark, d).select("*", ends.alias("e"))
    corners = f.select("face", F.when(F.col("e.u") == 0, F.col("lx")).otherwise(F.col("hx")).alias("x"), F.when(F.col("e.w") == 0, F.col("ly")).otherwise(F.col("hy")).alias("y"), F.when((F.col("e.u") + F.col("e.w")) % 2 == 0, F.col("lz")).otherwise(F.col("hz")).alias("z"))
    return mesh.face_extents(corners)


@query(f"WITH {_RECT}, c AS (SELECT CAST(floor((lx - 0.125::DOUBLE) / 0.5::DOUBLE) AS BIGINT) AS x, CAST(floor((lz + 0.5::DOUBLE) / 0.25::DOUBLE) AS BIGINT) AS y, CAST(floor(-ly - 2.0::DOUBLE) AS BIGINT) AS z FROM rect) SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM c")
def q_cell_box(spark, d):
    return mesh.cell_box(_faces(spark, d).select(F.col("lx").alias("x"), F.col("ly").alias("y"), F.col("lz").alias("z")), FRAME)


@query(f"WITH {_RECT}, n AS (SELECT face, CASE WHEN face % 50 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS n, axis, hx - lx AS dx, hy - ly AS dy, hz - lz AS dz FROM rect) SELECT face, n > 0.999 * sqrt(n * n + (1 - n) * (1 - n)) AS straight FROM n")
def q_straight_faces(spark, d):
    f = _faces(spark, d)
    n = F.when(F.col("face") % 50 == 0, 0.8).otherwise(1.0)
    tilted = f.select("*", *(F.when(F.col("axis") == k, n * F.col("sign")).when(F.col("axis") == (k + 1) % 3, 1.0 - n).otherwise(0.0).alias(f"n{c}") for k, c in enumerate("xyz"))).drop("axis", "sign")
    o = mesh.oriented(tilted)
    return o.select("face", mesh.straight(o, FRAME).alias("straight"))


@query(_BASE + "one AS (SELECT 1), c AS (SELECT * FROM voxel WHERE x BETWEEN -8 AND 100) SELECT x, y, z, x + 8 + 109 * (y + 20 + 51 * (z + 20)) AS code, x AS bx, y AS by_, z AS bz FROM c")
def q_grid_code(spark, d):
    low, high = (-8, -20, -20), (100, 30, 20)
    v = voxels(spark, d).where("x between -8 and 100").select("x", "y", "z")
    coded = v.withColumn("code", mesh.grid_code([F.col(c) for c in "xyz"], low, high))
    return coded.select("*", *(c.alias(n) for c, n in zip(mesh.grid_cell(F.col("code"), low, high), ("bx", "by_", "bz"), strict=True)))


@query(_BASE + "one AS (SELECT 1) SELECT x, y, z, 0.125::DOUBLE + (x + 0.5::DOUBLE) * 0.5::DOUBLE AS px, -(2.0::DOUBLE + (z + 0.5::DOUBLE) * 1.0::DOUBLE) AS py, -0.5::DOUBLE + (y + 0.5::DOUBLE) * 0.25::DOUBLE AS pz, 0.125::DOUBLE + x * 0.5::DOUBLE AS qx FROM voxel")
def q_cell_points(spark, d):
    cell = [F.col(c) for c in "xyz"]
    corner = FRAME.to_points(cell, corner=True)[0]
    return voxels(spark, d).select("x", "y", "z", *(p.alias(n) for p, n in zip(FRAME.to_points(cell), ("px", "py", "pz"), strict=True)), corner.alias("qx"))


@query("SELECT * FROM (VALUES (0, 0.5::DOUBLE, 1.0::DOUBLE, 0.25::DOUBLE), (1, 0.5, 0.25, 1.0), (2, 0.5, 1.0, 0.25)) t(convention, ex, ey, ez)")
def q_display_extent(spark, d):
    return spark.createDataFrame([(c, *mesh.Frame((0.5, 0.25, 1.0), convention=c).extent()) for c in (address.Y_UP, address.Z_UP, address.Z_BACK)], "convention int, ex double, ey double, ez double")


@query("SELECT * FROM (VALUES ('canonical', 0), ('blender', 1), ('z_up', 1), ('unity', 2)) t(name, convention)")
def q_axis_names(spark, d):
    return spark.createDataFrame(list(address.CONVENTION_NAMES.items()), "name string, convention int")


# Crossings of rays: lines are orders, hits are line items along them.
_HITS = "hit AS (SELECT l_orderkey AS ray, CAST(l_quantity AS DOUBLE) + l_linenumber * 0.125::DOUBLE AS pos, l_partkey AS face FROM lineitem)"
_SPANS = _HITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY ray ORDER BY pos, face) - 1 AS r FROM hit), span AS (SELECT a.ray, a.pos AS start, b.pos AS \"end\", a.face FROM r a JOIN r b ON a.ray = b.ray AND b.r = a.r + 1 WHERE a.r % 2 = 0)"


def _hits(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ray"), (F.col("l_quantity").cast("double") + F.col("l_linenumber") * 0.125).alias("at"), F.col("l_partkey").alias("face"))


@query(f"WITH {_SPANS} SELECT * FROM span")
def q_ray_parity(spark, d):
    return mesh.paired(_hits(spark, d))


@query(f"WITH {_SPANS}, met AS (SELECT ray, cell, start, face FROM span, range(56) c(cell) WHERE cell + 0.5 BETWEEN start AND \"end\") SELECT ray, cell, arg_max(face, row(start, face)) AS face FROM met GROUP BY 1, 2")
def q_span_cells(spark, d):
    hits = _hits(spark, d)
    lines = hits.select("ray").distinct().select("ray", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(55).cast("bigint"))).alias("cell"))
    return mesh.span_cells(mesh.paired(hits), lines.select("ray", "cell", (F.col("cell") + 0.5).cast("double").alias("x")), 16.0)


@query(f"WITH {_HITS}, c AS (SELECT ray, CAST(least(greatest(ceil(pos - 0.5), 0), 39) AS BIGINT) AS cell, pos, face FROM hit) SELECT ray, cell, arg_max(face, row(pos, face)) AS face FROM c GROUP BY 1, 2")
def q_surface_cells(spark, d):
    return mesh.surface_cells(_hits(spark, d), 0.0, 1.0, 40)


_PALETTE = "palette AS (SELECT p_partkey AS ordinal, p_partkey + 1 AS key, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS b FROM part WHERE p_partkey < 40)"
_WANTED = "wanted AS (SELECT DISTINCT event_id * 7 % 256 AS r, user_id * 11 % 256 AS g, event_id % 13 * 19 AS b FROM events)"


def _palette(spark, d) -> DataFrame:
    i = F.col("p_partkey")
    return table(spark, d, "part").where("p_partkey < 40").select(i.alias("ordinal"), (i + 1).alias("key"), (i * 37 % 256).alias("r"), (i * 91 % 256).alias("g"), (i * 53 % 256).alias("b"))


def _wanted(spark, d) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select((i * 7 % 256).alias("r"), (F.col("user_id") * 11 % 256).alias("g"), (i % 13 * 19).alias("b"))


@query(f"WITH {_PALETTE}, {_WANTED}, far AS (SELECT w.r, w.g, w.b, key, ordinal, (w.r - p.r) * (w.r - p.r) + (w.g - p.g) * (w.g - p.g) + (w.b - p.b) * (w.b - p.b) AS d FROM wanted w, palette p) SELECT r, g, b, CAST(CASE WHEN min(d) / (255.0::DOUBLE * 255.0::DOUBLE) <= 0.02 THEN arg_min(key, row(d, ordinal)) ELSE 0 END AS BIGINT) AS key FROM far GROUP BY 1, 2, 3")
def q_nearest_color(spark, d):
    return mesh.nearest_keys(_wanted(spark, d), _palette(spark, d))


_SLOTS = "slot AS (SELECT p_partkey // 8 AS object, p_partkey % 8 AS slot, 'm' || (p_partkey % 23) AS material, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 17 END AS stamped FROM part), named AS (SELECT 'm' || (c_custkey % 15) AS name, arg_max(c_custkey % 31, c_custkey) AS key FROM customer GROUP BY 1), keyed AS (SELECT object, slot, coalesce(stamped, key, slot + 1) AS key FROM slot LEFT JOIN named ON material = name)"


def _slot_keys(spark, d) -> DataFrame:
    i, c = F.col("p_partkey"), F.col("c_custkey")
    slots = table(spark, d, "part").select(F.expr("p_partkey div 8").alias("object"), (i % 8).alias("slot"), F.concat(F.lit("m"), i % 23).alias("material"), F.when(i % 5 == 0, i % 17).alias("stamped"))
    reg = table(spark, d, "customer").select(c.alias("ordinal"), (c % 31).alias("key"), F.concat(F.lit("m"), c % 15).alias("name"))
    return mesh.slot_keys(slots, reg)


@query(f"WITH {_SLOTS} SELECT object, slot, key FROM keyed")
def q_slot_keys(spark, d):
    return _slot_keys(spark, d)


@query(f"WITH {_SLOTS}, {_PALETTE}, {_WANTED}, far AS (SELECT w.r, w.g, w.b, key, ordinal, (w.r - p.r) * (w.r - p.r) + (w.g - p.g) * (w.g - p.g) + (w.b - p.b) * (w.b - p.b) AS d FROM wanted w, palette p), near AS (SELECT r, g, b, CASE WHEN min(d) / (255.0::DOUBLE * 255.0::DOUBLE) <= 0.02 THEN arg_min(key, row(d, ordinal)) ELSE 0 END AS key FROM far GROUP BY 1, 2, 3), f AS (SELECT event_id AS face, event_id % 9 * (event_id % 2) AS attribute, event_id % 11 AS object, user_id % 12 AS slot, event_id * 7 % 256 AS r, user_id * 11 % 256 AS g, event_id % 13 * 19 AS b FROM events) SELECT face, CAST(coalesce(nullif(attribute, 0), nullif(k.key, 0), nullif(n.key, 0), 77) AS BIGINT) AS key FROM f LEFT JOIN keyed k USING (object, slot) LEFT JOIN near n USING (r, g, b)")
def q_face_keys(spark, d):
    i = F.col("event_id")
    faces = table(spark, d, "events").select(i.alias("face"), (i % 9 * (i % 2)).alias("attribute"), (i % 11).alias("object"), (F.col("user_id") % 12).alias("slot"), (i * 7 % 256).alias("r"), (F.col("user_id") * 11 % 256).alias("g"), (i % 13 * 19).alias("b"))
    return mesh.face_keys(faces, _slot_keys(spark, d), mesh.nearest_keys(_wanted(spark, d), _palette(spark, d)), 77)


# A scene: models from suppliers, their voxels from parts, an instance for each nation and a few more.
_ROTATIONS = [r0 | r1 << 2 | s << 4 for r0 in range(3) for r1 in range(3) if r0 != r1 for s in range(8)]
_SCENE = f"""instance AS (SELECT c_custkey AS ordinal, c_custkey % 5 AS model, {_ROTATIONS}[c_custkey % 48 + 1] AS b, c_custkey % 7 * 3 AS tx, c_custkey % 11 - 5 AS ty, c_nationkey AS tz, c_custkey % 13 = 0 AS hidden FROM customer),
turned AS (SELECT *, b & 3 AS r0, b >> 2 & 3 AS r1, 3 - (b & 3) - (b >> 2 & 3) AS r2, CASE WHEN b & 16 <> 0 THEN -1 ELSE 1 END AS s0, CASE WHEN b & 32 <> 0 THEN -1 ELSE 1 END AS s1, CASE WHEN b & 64 <> 0 THEN -1 ELSE 1 END AS s2 FROM instance WHERE NOT hidden),
model AS (SELECT range AS model, 3 + range AS sx, 4 + range % 2 AS sy, 5 AS sz FROM range(5)),
mv AS (SELECT DISTINCT p_partkey % 5 AS model, p_partkey % 6 AS vx, p_partkey % 7 % 5 AS vy, p_size % 6 AS vz, p_partkey % 6 * 31 % 7 AS colour FROM part),
sound AS (SELECT mv.* FROM mv JOIN model USING (model) WHERE colour <> 0 AND vx < sx AND vy < sy AND vz < sz),
p AS (SELECT t.*, vx - sx // 2 AS a0, vy - sy // 2 AS a1, vz - sz // 2 AS a2, colour FROM turned t JOIN model USING (model) JOIN sound USING (model)),
placed AS (SELECT ordinal, model, colour, {", ".join(f"(CASE WHEN s{i} > 0 THEN [a0, a1, a2][r{i} + 1] ELSE -[a0, a1, a2][r{i} + 1] - 1 END + t{c})::BIGINT AS {c}" for i, c in enumerate("xyz"))} FROM p)"""


def _scene(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, i = F.col("c_custkey"), F.col("p_partkey")
    byte = F.element_at(F.array(*map(F.lit, _ROTATIONS)), (c % 48 + 1).cast("int"))
    instances = table(spark, d, "customer").select(c.alias("ordinal"), (c % 5).alias("model"), *(v.alias(n) for n, v in mesh.turn(byte).items()), (c % 7 * 3).alias("tx"), (c % 11 - 5).alias("ty"), F.col("c_nationkey").alias("tz"), (c % 13 == 0).alias("hidden"))
    models = spark.range(5).select(F.col("id").alias("model"), (F.col("id") + 3).alias("sx"), (F.col("id") % 2 + 4).alias("sy"), F.lit(5).cast("bigint").alias("sz"))
    cells = table(spark, d, "part").select((i % 5).alias("model"), (i % 6).alias("vx"), (i % 7 % 5).alias("vy"), (F.col("p_size").cast("bigint") % 6).alias("vz"), (i % 6 * 31 % 7).alias("colour")).distinct()
    return instances, models, cells


@query(f"WITH {_SCENE} SELECT ordinal, model, x, y, z, colour FROM placed")
def q_vox_world_cell(spark, d):
    return mesh.placed(*_scene(spark, d))


_TURNED = _SCENE + ", c AS (SELECT x, z AS y, -y - 1 AS z, arg_max(colour, row(ordinal, colour)) AS key FROM placed GROUP BY 1, 2, 3)"


@query(f"WITH {_TURNED} SELECT x - (SELECT min(x) FROM c) AS x, y - (SELECT min(y) FROM c) AS y, z - (SELECT min(z) FROM c) AS z, key FROM c")
def q_place_instances(spark, d):
    return mesh.scene(*_scene(spark, d))


@query(f"WITH {_SCENE} SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM placed")
def q_scene_bbox(spark, d):
    return mesh.scene_box(mesh.placed(*_scene(spark, d)))


@query(f"WITH {_SCENE} SELECT count(*) AS skipped FROM mv JOIN model USING (model) WHERE NOT (colour <> 0 AND vx < sx AND vy < sy AND vz < sz)")
def q_vox_skipped(spark, d):
    _, models, cells = _scene(spark, d)
    sound = mesh.sound_voxels(cells, models)
    return cells.join(models, "model").join(sound, cells.columns, "left_anti").agg(F.count("*").alias("skipped"))


@query(_FACES + """, o AS (SELECT *, CASE WHEN sign = 1 THEN 1 ELSE 0 END AS s FROM face)
SELECT DISTINCT x + CASE axis WHEN 0 THEN s ELSE u END AS px, y + CASE axis WHEN 1 THEN s WHEN 0 THEN u ELSE w END AS py, z + CASE axis WHEN 2 THEN s ELSE w END AS pz FROM o, range(2) a(u), range(2) b(w)""")
def q_mesh_points(spark, d):
    points, _ = mesh.quads(op.exposed_faces(voxels(spark, d)), FRAME)
    return points.select("px", "py", "pz")


@query(_SHELL + "SELECT axis, count(*) AS n FROM shell GROUP BY axis")
def q_shell_axes(spark, d):
    return _shell(spark, d).groupBy("axis").agg(F.count("*").alias("n"))


@query("SELECT page_id, NOT regexp_matches(url, '[\\x00-\\x1f\\x7f]') AS printable FROM pages")
def q_is_printable(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.is_printable(F.col("url")).alias("printable"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN event_id * 4096 + 10 WHEN event_id % 3 = 1 THEN event_id ELSE -1 END AS BIGINT) AS n FROM events")
def q_hex_numbers(spark, d):
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit("0x"), F.hex(i * 4096 + 10))).when(i % 3 == 1, F.lower(F.hex(i))).otherwise(F.lit("none"))
    return table(spark, d, "events").select("event_id", scalar.hex_number(text, F.lit(-1)).cast("bigint").alias("n"))


@query(_AT + " SELECT key, count(*) AS n, sum(li) AS s FROM v WHERE key IN (SELECT key FROM registry) GROUP BY key")
def q_registered_voxels(spark, d):
    return op.located(voxels(spark, d), G).join(registry(spark).select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.sum("li").alias("s"))


_IMPORTED = _RANGE + """, raster AS (SELECT face, axis, sign, x, y, unnest(range(z0, z1 + 1)) AS z, face % 7 + 1 AS key FROM (SELECT face, axis, sign, z0, z1, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT face, axis, sign, y0, y1, z0, z1, unnest(range(x0, x1 + 1)) AS x FROM cells))),
surface AS (SELECT x, y, z, arg_max(key, face) AS key FROM raster GROUP BY 1, 2, 3),
ax AS (SELECT axis FROM raster GROUP BY axis ORDER BY count(*) DESC, axis LIMIT 1),
f AS (SELECT axis, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS a, CASE axis WHEN 0 THEN y ELSE x END AS u, CASE axis WHEN 2 THEN y ELSE z END AS w, sign > 0 AS closing, key FROM raster JOIN ax USING (axis)),
r AS (SELECT *, row_number() OVER (PARTITION BY u, w ORDER BY a, closing, key) - 1 AS r FROM f),
inside AS (SELECT CASE axis WHEN 0 THEN c ELSE u END AS x, CASE axis WHEN 1 THEN c WHEN 0 THEN u ELSE w END AS y, CASE axis WHEN 2 THEN c ELSE w END AS z, max(key) AS key FROM (SELECT o.axis, o.u, o.w, o.key, unnest(range(o.a, e.a + 1)) AS c FROM r o JOIN r e ON o.u = e.u AND o.w = e.w AND e.r = o.r + 1 WHERE o.r % 2 = 0 AND NOT o.closing AND e.closing) GROUP BY 1, 2, 3),
new AS (SELECT x, y, z, coalesce(s.key, i.key) AS key FROM surface s FULL JOIN inside i USING (x, y, z)), """


@query(_IMPORTED + _BASE.strip().removeprefix("WITH ") + """ one AS (SELECT 1) SELECT x, y, z, coalesce(n.key, v.key) AS key FROM voxel v FULL JOIN new n USING (x, y, z)""")
def q_import_mesh(spark, d):
    faces = _faces(spark, d)
    return mesh.import_mesh(voxels(spark, d), faces, faces.select("face", (F.col("face") % 7 + 1).alias("key")), FRAME, G, limit=None)
