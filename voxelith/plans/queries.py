"""Queries of the voxel operators over the shared tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import address, scalar
from ..functions.address import Geometry
from ..operators import voxel as op
from ..sources.tables import REGISTRY, edits, materials, probes, registry, table, voxels

G = Geometry()
LOW, HIGH = (-10, -5, -8), (9, 14, 7)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_BASE = f"""
WITH voxel AS (SELECT l_orderkey // 300 - 8 AS x, CAST(l_quantity AS BIGINT) - 20 AS y, l_suppkey % 40 - 20 AS z, arg_max(CAST(l_linenumber AS BIGINT), row(l_orderkey, l_linenumber)) AS key FROM lineitem GROUP BY 1, 2, 3),
registry(key, flags, rgba, material_id) AS (VALUES {", ".join(f"({a}::BIGINT, {b}, {c}::BIGINT, {d}::BIGINT)" for a, b, c, d in REGISTRY)}),
material AS (SELECT p_partkey AS material_id, p_size::BIGINT * 65536 + p_partkey % 256 * (p_partkey % 2) AS tint FROM part),
edit AS (SELECT event_id AS seq, event_id // 200 - 8 AS x, user_id % 50 - 20 AS y, CAST(floor(value) AS BIGINT) % 40 - 20 AS z, event_id % 8 AS key FROM events),
probe AS (SELECT o_orderkey AS ordinal, o_orderkey // 300 - 10 + o_orderkey % 5 AS x, o_custkey % 77 - 38 AS y, (o_orderkey + o_custkey) % 63 - 31 AS z FROM orders),
"""


def _at(source: str, name: str) -> str:
    """SQL for the address columns of a table."""
    f = lambda e: f"CAST(floor({e}) AS BIGINT)"
    r = ", ".join(f"{f(f'{a} / 16.0')} AS r{a}" for a in "xyz")
    c = ", ".join(f"{f(f'{a} / 8.0')} - 2 * {f(f'{a} / 16.0')} AS c{a}" for a in "xyz")
    loc = [f"{a} - 8 * {f(f'{a} / 8.0')}" for a in "xyz"]
    return f"{name} AS (SELECT *, {r}, {c}, {', '.join(f'{e} AS l{a}' for e, a in zip(loc, 'xyz', strict=True))}, {loc[0]} + 8 * ({loc[1]} + 8 * ({loc[2]})) AS li FROM {source})"


_AT = _BASE + _at("voxel", "v")
_CHUNK = "rx, ry, rz, cx, cy, cz"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(_BASE + _at("probe", "a") + " SELECT * FROM a")
def q_locate_voxel(spark, d):
    return op.located(probes(spark, d), G)


@query(_BASE + "one AS (SELECT 1) SELECT ordinal, x, y, z FROM probe")
def q_address_roundtrip(spark, d):
    return op.located(probes(spark, d), G).select("ordinal", *address.world(G))


def _converted(spark, d, cells: bool) -> DataFrame:
    p = probes(spark, d)
    at = [F.col(c) if cells else F.col(c) + F.lit(0.25) for c in "xyz"]
    each = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), *(v.alias(n) for v, n in zip(address.convert(a, b, *at, cells), ("nx", "ny", "nz"), strict=True))) for a in range(3) for b in range(3)]
    return p.select("ordinal", F.explode(F.array(*each)).alias("s")).select("ordinal", "s.*")


def _convert_sql(cells: bool) -> str:
    off, neg = ("", " - 1") if cells else (" + 0.25::DOUBLE", "")
    to = f"""SELECT ordinal, s AS source, x{off} AS x, CASE WHEN s = 1 THEN z{off} ELSE y{off} END AS y, CASE s WHEN 0 THEN z{off} WHEN 1 THEN -(y{off}){neg} ELSE -(z{off}){neg} END AS z FROM probe, range(3) t(s)"""
    return _BASE + f"""c AS ({to}) SELECT ordinal, source::INT AS source, t::INT AS target, x AS nx, CASE WHEN t = 1 THEN -z{neg} ELSE y END AS ny, CASE t WHEN 0 THEN z WHEN 1 THEN y ELSE -z{neg} END AS nz FROM c, range(3) u(t)"""


@query(_convert_sql(True))
def q_convert_cell(spark, d):
    return _converted(spark, d, True)


@query(_convert_sql(False))
def q_convert_position(spark, d):
    return _converted(spark, d, False)


@query(_AT + " SELECT x, y, z, li AS linear, li % 8 AS bx, li // 8 % 8 AS by_, li // 64 AS bz, cx + cy * 65536 + cz * 4294967296 AS chunk_key FROM v")
def q_linear_index(spark, d):
    v = op.located(voxels(spark, d), G)
    back = address.from_linear(F.col("li"), G.chunk)
    return v.select("x", "y", "z", F.col("li").alias("linear"), *(c.alias(n) for c, n in zip(back, ("bx", "by_", "bz"), strict=True)), address.chunk_key(F.col("cx"), F.col("cy"), F.col("cz")).alias("chunk_key"))


@query("SELECT page_id, lower(hex(encode(url))) AS h, url AS back, '0x' || printf('%X', page_id) AS u FROM pages")
def q_hex(spark, d):
    h = scalar.to_hex(F.col("url").cast("binary"))
    return table(spark, d, "pages").select("page_id", h.alias("h"), scalar.from_hex(h).cast("string").alias("back"), scalar.u64_hex(F.col("page_id")).alias("u"))


@query("SELECT p_partkey, CASE WHEN p_partkey <= 2 THEN 1 ELSE length(bin(p_partkey - 1)) END::INT AS bits, CAST(ceil(p_partkey / 16.0) AS BIGINT) * 16 AS aligned FROM part")
def q_index_bits(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", scalar.index_bits(k).alias("bits"), scalar.align(k, 16).alias("aligned"))


@query("SELECT p_partkey, c, c >> 24 & 255 AS r, c >> 16 & 255 AS g, c >> 8 & 255 AS b, c & 255 AS a FROM (SELECT p_partkey, p_partkey % 256 * 16777216 + p_size % 256 * 65536 + 7 * 256 + 255 AS c FROM part)")
def q_rgba(spark, d):
    c = scalar.rgba(F.col("p_partkey") % 256, F.col("p_size").cast("bigint") % 256, F.lit(7), F.lit(255))
    return table(spark, d, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c", *(x.alias(n) for x, n in zip(scalar.channels(F.col("c")), "rgba", strict=True)))


@query(_BASE + "one AS (SELECT 1) SELECT key, flags AS bits, concat_ws(',', CASE WHEN flags & 1 <> 0 THEN 'opaque' END, CASE WHEN flags & 2 <> 0 THEN 'emissive' END, CASE WHEN flags & 4 <> 0 THEN 'special' END, CASE WHEN flags & 8 <> 0 THEN 'collidable' END) AS names FROM registry")
def q_registry_flags(spark, d):
    names = scalar.flag_names(F.col("flags"))
    return registry(spark).select("key", scalar.flag_bits(names).alias("bits"), F.array_join(names, ",").alias("names"))


@query("SELECT p_partkey, level::INT AS level, greatest(1, p_partkey >> level) AS extent FROM part, range(12) t(level) WHERE level = 0 OR p_partkey >> (level - 1) > 1")
def q_mip_chain(spark, d):
    k = F.col("p_partkey")
    levels = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("level")
    return table(spark, d, "part").select("p_partkey", levels).select("p_partkey", "level", scalar.mip_extent(k, F.col("level")).alias("extent"), scalar.mip_extent(k, F.col("level") - 1).alias("before")).where("level = 0 or before > 1").drop("before")


@query("SELECT vec_id, " + ", ".join(f"CAST(floor((embedding[{i}]::DOUBLE - 0.5) / 0.25) AS BIGINT) AS {a}" for i, a in ((1, "x"), (2, "y"), (3, "z"))) + " FROM embeddings")
def q_points_to_cells(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", *(F.floor((F.get(e, F.lit(i)).cast("double") - 0.5) / 0.25).cast("bigint").alias(a) for i, a in enumerate("xyz")))


@query(_BASE + "one AS (SELECT 1) SELECT * FROM edit WHERE key <> 0")
def q_non_air(spark, d):
    return edits(spark, d).where("key <> 0")


@query(_AT + f" SELECT x, y, z, key FROM v WHERE ({_CHUNK}) IN (SELECT ({_CHUNK}) FROM v GROUP BY {_CHUNK} HAVING count(*) > 100)")
def q_skip_chunks(spark, d):
    v = op.located(voxels(spark, d), G)
    busy = v.groupBy(*op.CHUNK).count().where("count > 100").drop("count")
    return v.join(busy, op.CHUNK, "left_semi").select("x", "y", "z", "key")


_IN = " AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyz", LOW, HIGH, strict=True))


@query(_BASE + f"one AS (SELECT 1) SELECT * FROM voxel WHERE {_IN}")
def q_box_query(spark, d):
    return voxels(spark, d).where(op.in_box(LOW, HIGH))


_CLASS = _AT + ", k AS (SELECT v.*, coalesce(flags & 1 <> 0, true) AS opaque, coalesce(flags & 2 <> 0, false) AS emissive, coalesce(flags & 4 <> 0, false) AS special FROM v LEFT JOIN registry USING (key))"


@query(_CLASS + " SELECT x, y, z, key, opaque, emissive, special FROM k")
def q_classify_voxels(spark, d):
    return op.classified(voxels(spark, d), registry(spark))


_RANK = "row_number() OVER (PARTITION BY rx, ry, rz, cx, cy, cz ORDER BY count(*) DESC, key)"
_SUMMARY = _CLASS + f""", t AS (SELECT {_CHUNK}, key, count(*) AS n, {_RANK} AS r FROM k GROUP BY {_CHUNK}, key),
top AS (SELECT {_CHUNK}, {", ".join(f"coalesce(max(key) FILTER (r = {i + 1}), 0) AS top_key_{i}, coalesce(max(least(n, 65535)) FILTER (r = {i + 1}), 0) AS top_count_{i}" for i in range(4))} FROM t GROUP BY {_CHUNK}),
s AS (SELECT {_CHUNK}, count(*) AS non_air, count(*) FILTER (opaque) AS opaque, count(*) FILTER (emissive) % 65536 AS emissive, count(*) FILTER (special) % 65536 AS special,
{", ".join(f"{e}(l{a}) AS {e}_{a}" for e in ("min", "max") for a in "xyz")},
bit_or(CASE WHEN lz < 4 THEN 1::BIGINT << CAST(lx // 2 + 4 * (ly // 2) + 16 * (lz // 2) AS INT) ELSE 0 END) AS macro_lo, bit_or(CASE WHEN lz >= 4 THEN 1::BIGINT << CAST(lx // 2 + 4 * (ly // 2) + 16 * (lz // 2) - 32 AS INT) ELSE 0 END) AS macro_hi,
{", ".join(f"CASE count(*) FILTER (l{n[1]} = {7 if n[0] == 'p' else 0}) WHEN 0 THEN 0 WHEN 64 THEN 1 ELSE 2 END::BIGINT AS face_{n}" for n in op.FACES)} FROM k GROUP BY {_CHUNK})
"""


@query(_SUMMARY + f" SELECT * FROM s JOIN top USING ({_CHUNK})")
def q_chunk_summary(spark, d):
    return op.chunk_summary(voxels(spark, d), registry(spark), G)


@query(_SUMMARY + f" SELECT {_CHUNK}, {', '.join(f'face_{n}' for n in op.FACES)} FROM s")
def q_face_states(spark, d):
    return q_chunk_summary(spark, d).select(*op.CHUNK, *(f"face_{n}" for n in op.FACES))


@query(_SUMMARY + f" SELECT {_CHUNK}, macro_lo, macro_hi FROM s")
def q_macro_occupancy(spark, d):
    return q_chunk_summary(spark, d).select(*op.CHUNK, "macro_lo", "macro_hi")


@query(_SUMMARY + f" SELECT {_CHUNK}, {', '.join(f'top_key_{i}, top_count_{i}' for i in range(4))} FROM top")
def q_chunk_top_keys(spark, d):
    return q_chunk_summary(spark, d).select(*op.CHUNK, *(f"top_{w}_{i}" for i in range(4) for w in ("key", "count")))


@query(_SUMMARY + f" SELECT {_CHUNK}, non_air FROM s ORDER BY {_CHUNK} LIMIT 50 OFFSET 100")
def q_chunk_page(spark, d):
    return q_chunk_summary(spark, d).select(*op.CHUNK, "non_air").orderBy(*op.CHUNK).offset(100).limit(50)


@query(_BASE + "one AS (SELECT 1) SELECT ordinal, x, y, z, coalesce(key, 0) AS key FROM probe LEFT JOIN voxel USING (x, y, z)")
def q_get_voxels(spark, d):
    return op.gather(probes(spark, d), voxels(spark, d))


@query(_AT + ", " + _at("probe", "p") + f" SELECT ordinal, coalesce(n, 0) AS n FROM p LEFT JOIN (SELECT {_CHUNK}, count(*) AS n FROM v GROUP BY {_CHUNK}) USING ({_CHUNK})")
def q_find_chunk(spark, d):
    chunks = op.located(voxels(spark, d), G).groupBy(*op.CHUNK).agg(F.count("*").alias("n"))
    return op.located(probes(spark, d), G).join(chunks, op.CHUNK, "left").select("ordinal", F.coalesce("n", F.lit(0)).alias("n"))


_FACES = _BASE + """side(axis, sign, dx, dy, dz) AS (VALUES (0, -1, -1, 0, 0), (0, 1, 1, 0, 0), (1, -1, 0, -1, 0), (1, 1, 0, 1, 0), (2, -1, 0, 0, -1), (2, 1, 0, 0, 1)),
face AS (SELECT v.x, v.y, v.z, axis, sign, v.key FROM voxel v CROSS JOIN side s WHERE NOT EXISTS (SELECT 1 FROM voxel o WHERE o.x = v.x + s.dx AND o.y = v.y + s.dy AND o.z = v.z + s.dz))
"""


@query(_FACES + "SELECT * FROM face")
def q_exposed_faces(spark, d):
    return op.exposed_faces(voxels(spark, d))


@query(_FACES + """, o AS (SELECT *, CASE WHEN sign = 1 THEN 1 ELSE 0 END AS s FROM face)
SELECT x, y, z, count(*) AS n_faces FROM (SELECT x + CASE axis WHEN 0 THEN s ELSE u END AS x, y + CASE axis WHEN 1 THEN s WHEN 0 THEN u ELSE w END AS y, z + CASE axis WHEN 2 THEN s ELSE w END AS z FROM o, range(2) a(u), range(2) b(w)) GROUP BY 1, 2, 3""")
def q_weld_vertices(spark, d):
    return op.welded(op.exposed_faces(voxels(spark, d)))


@query(_BASE + "one AS (SELECT 1) SELECT x, y, z, key, coalesce(nullif(tint, 0), nullif(rgba, 0), 3435973887) AS rgba FROM voxel LEFT JOIN registry USING (key) LEFT JOIN material USING (material_id)")
def q_voxel_colors(spark, d):
    return op.colours(voxels(spark, d), registry(spark), materials(spark, d))


@query(_AT + " SELECT min(rx) * 16 AS x0, min(ry) * 16 AS y0, min(rz) * 16 AS z0, max(rx) * 16 + 15 AS x1, max(ry) * 16 + 15 AS y1, max(rz) * 16 + 15 AS z1 FROM v")
def q_world_bounds(spark, d):
    return op.world_bounds(voxels(spark, d), G)


@query(_BASE + "one AS (SELECT 1) SELECT key, count(*) AS n FROM voxel GROUP BY key")
def q_used_keys(spark, d):
    return voxels(spark, d).groupBy("key").agg(F.count("*").alias("n"))


@query(_AT + f" SELECT (SELECT count(*) FROM v) AS voxels, (SELECT count(*) FROM (SELECT DISTINCT {_CHUNK} FROM v)) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT rx, ry, rz FROM v)) AS regions, (SELECT count(*) FROM registry) AS keys, (SELECT count(*) FROM material) AS materials")
def q_world_counts(spark, d):
    c = op.located(voxels(spark, d), G).groupBy(*op.CHUNK).agg(F.count("*").alias("n"))
    r = c.groupBy(*op.REGION).agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    one = r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("voxels"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.count("*").alias("regions"))
    return one.join(registry(spark).agg(F.count("*").alias("keys"))).join(materials(spark, d).agg(F.count("*").alias("materials")))


@query(_AT + " SELECT DISTINCT rx, ry, rz, 'r_' || rx || '_' || ry || '_' || rz || '.bvx' AS path FROM v")
def q_region_paths(spark, d):
    r = op.located(voxels(spark, d), G).select(*op.REGION).distinct()
    return r.select("*", F.concat(F.lit("r_"), F.concat_ws("_", *op.REGION), F.lit(".bvx")).alias("path"))


_LAST = _BASE + "lw AS (SELECT x, y, z, arg_max(key, row(seq, key)) AS key FROM edit GROUP BY 1, 2, 3)"


@query(_LAST + " SELECT * FROM lw")
def q_last_write_wins(spark, d):
    return op.last_writes(edits(spark, d))


@query(_LAST + " SELECT x, y, z, coalesce(l.key, v.key) AS key FROM voxel v FULL JOIN lw l USING (x, y, z) WHERE coalesce(l.key, v.key) <> 0")
def q_set_voxels(spark, d):
    return op.set_voxels(voxels(spark, d), edits(spark, d), G)


@query(_LAST + ", " + _at("voxel", "v") + ", " + _at("lw", "e") + f", k AS (SELECT x, y, z, key FROM e WHERE ({_CHUNK}) IN (SELECT ({_CHUNK}) FROM v)) SELECT x, y, z, coalesce(l.key, v.key) AS key FROM voxel v FULL JOIN k l USING (x, y, z) WHERE coalesce(l.key, v.key) <> 0")
def q_set_voxels_existing(spark, d):
    return op.set_voxels(voxels(spark, d), edits(spark, d), G, create_missing=False)


@query(_AT + ", " + _at("edit", "e") + f" SELECT count(*) AS hits FROM e WHERE ({_CHUNK}) IN (SELECT ({_CHUNK}) FROM v)")
def q_edit_hits(spark, d):
    return op.hits(voxels(spark, d), edits(spark, d), G)


_BOX = ", ".join(f"range({a}, {b + 1}) {c}_({c})" for c, a, b in zip("xyz", LOW, HIGH, strict=True))


@query(_BASE + f"one AS (SELECT 1) SELECT * FROM voxel WHERE NOT ({_IN}) UNION ALL SELECT x, y, z, 9::BIGINT FROM {_BOX}")
def q_fill_box(spark, d):
    return op.fill_box(voxels(spark, d), LOW, HIGH, 9)


@query(_BASE + f"one AS (SELECT 1) SELECT * FROM voxel WHERE NOT ({_IN})")
def q_erase_box(spark, d):
    return op.fill_box(voxels(spark, d), LOW, HIGH, 0)


@query(_LAST + f", rest AS (SELECT * FROM voxel WHERE NOT ({_IN})) SELECT x, y, z, coalesce(l.key, r.key) AS key FROM rest r FULL JOIN lw l USING (x, y, z) WHERE coalesce(l.key, r.key) <> 0")
def q_replace_bounds(spark, d):
    return op.replace_bounds(voxels(spark, d), LOW, HIGH, edits(spark, d), G)


@query(_AT + f", box AS (SELECT x, y, z FROM {_BOX}), " + _at("box", "b") + f" SELECT * FROM v_rest UNION ALL SELECT x, y, z, 9::BIGINT FROM b WHERE ({_CHUNK}) IN (SELECT ({_CHUNK}) FROM v)".replace("v_rest", f"(SELECT x, y, z, key FROM voxel WHERE NOT ({_IN}))"))
def q_fill_box_existing(spark, d):
    return op.fill_box(voxels(spark, d), LOW, HIGH, 9, G, create_missing=False)


@query(_AT + f", box AS (SELECT x, y, z FROM {_BOX}), " + _at("box", "b") + f" SELECT count(*) AS hits FROM b WHERE ({_CHUNK}) IN (SELECT ({_CHUNK}) FROM v)")
def q_box_hits(spark, d):
    return op.box_hits(voxels(spark, d), LOW, HIGH, G, create_missing=False)


@query(_BASE + "one AS (SELECT 1) SELECT x, -z - 1 AS y, y AS z, key FROM voxel")
def q_convert_world(spark, d):
    return op.convert_world(voxels(spark, d), address.Y_UP, address.Z_UP)


@query(_AT + f""", i AS (SELECT *, ly - row_number() OVER (PARTITION BY {_CHUNK}, lx, lz, key ORDER BY ly) AS g FROM v)
SELECT {_CHUNK}, lx, lz, key, min(ly) AS y0, count(*) AS len FROM i GROUP BY {_CHUNK}, lx, lz, key, g""")
def q_y_runs(spark, d):
    return op.y_runs(voxels(spark, d), G)


#: A shell with holes: all faces but those of cells that a hash of their place leaves out.
_SHELL = _FACES + """, shell AS (SELECT * FROM face WHERE (x + 2 * y + 3 * z + 5 * sign) % 11 <> 0),
ax AS (SELECT axis FROM shell GROUP BY axis ORDER BY count(*) DESC, axis LIMIT 1),
f AS (SELECT axis, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS a, CASE axis WHEN 0 THEN y ELSE x END AS u, CASE axis WHEN 2 THEN y ELSE z END AS w, sign > 0 AS closing, key FROM shell JOIN ax USING (axis)),
r AS (SELECT *, row_number() OVER (PARTITION BY u, w ORDER BY a, closing, key) - 1 AS r FROM f)
"""


def _shell(spark, d) -> DataFrame:
    return op.exposed_faces(voxels(spark, d)).where("(x + 2 * y + 3 * z + 5 * sign) % 11 <> 0")


@query(_SHELL + """SELECT CASE axis WHEN 0 THEN c ELSE u END AS x, CASE axis WHEN 1 THEN c WHEN 0 THEN u ELSE w END AS y, CASE axis WHEN 2 THEN c ELSE w END AS z, key FROM (
SELECT o.axis, o.u, o.w, o.key, unnest(range(o.a, e.a + 1)) AS c FROM r o JOIN r e ON o.u = e.u AND o.w = e.w AND e.r = o.r + 1 WHERE o.r % 2 = 0 AND NOT o.closing AND e.closing)""")
def q_fill_interior(spark, d):
    return op.filled_lines(_shell(spark, d))


@query(_SHELL + "SELECT count(*) FILTER ((r % 2 = 0) = closing) AS unpaired FROM r")
def q_unpaired_faces(spark, d):
    return op.unpaired(_shell(spark, d))


@query(_LAST + """, surface AS (SELECT * FROM lw), interior AS (SELECT * FROM voxel)
SELECT x, y, z, coalesce(s.key, i.key) AS key FROM surface s FULL JOIN interior i USING (x, y, z) WHERE coalesce(s.key, i.key) <> 0""")
def q_union_surface(spark, d):
    return op.surface_and_interior(op.last_writes(edits(spark, d)), voxels(spark, d))


@query(_AT + f" SELECT {_CHUNK}, key, row_number() OVER (PARTITION BY {_CHUNK} ORDER BY min(li)) - 1 AS i FROM v GROUP BY {_CHUNK}, key")
def q_palette_index(spark, d):
    return op.palette_index(voxels(spark, d), G).withColumn("i", F.col("i").cast("bigint"))


@query(_AT + " SELECT rx, ry, rz, CAST((x - 16 * rx) + 16 * ((y - 16 * ry) + 16 * (z - 16 * rz)) AS BIGINT) AS i, key FROM v")
def q_region_linear(spark, d):
    return op.region_linear(voxels(spark, d), G)


_SIZES = _AT + f""", i AS (SELECT *, ly - row_number() OVER (PARTITION BY {_CHUNK}, lx, lz, key ORDER BY ly) AS g FROM v),
n AS (SELECT {_CHUNK}, count(*) AS n, count(DISTINCT key) AS q, count(DISTINCT key) + CASE WHEN count(*) < 512 THEN 1 ELSE 0 END AS p, count(DISTINCT row(lx, lz, key, g)) AS r, count(DISTINCT row(lx, lz)) AS c FROM i GROUP BY {_CHUNK}),
w AS (SELECT *, length(bin(p)) AS pb, CASE WHEN q <= 2 THEN 1 ELSE length(bin(q - 1)) END AS qb FROM n),
z AS (SELECT {_CHUNK}, n = 512 AND q = 1 AS uniform, 2048::BIGINT AS raw, 4 + 4 * p + (512 * pb + 7) // 8 AS palette, 4 + 8 * n AS list, 8 + 4 * q + (9 * n + 7) // 8 + (qb * n + 7) // 8 AS packed, 4 + 6 * c + 8 * r AS columns FROM w),
size AS (SELECT *, CASE WHEN uniform THEN 2 WHEN raw <= least(palette, list, packed, columns) THEN 6 WHEN palette <= least(list, packed, columns) THEN 3 WHEN list <= least(packed, columns) THEN 4 WHEN packed <= columns THEN 7 ELSE 5 END AS codec, CASE WHEN uniform THEN 4 ELSE least(raw, palette, list, packed, columns) END AS payload FROM z)
"""


@query(_SIZES + f" SELECT {_CHUNK}, raw, palette, list, packed, columns, codec, payload FROM size")
def q_codec_choice(spark, d):
    return op.codec_sizes(voxels(spark, d), G)


@query(_SIZES + " SELECT codec, count(*) AS chunks, CAST(sum(payload) AS BIGINT) AS bytes FROM size GROUP BY codec")
def q_codec_anatomy(spark, d):
    return op.codec_sizes(voxels(spark, d), G).groupBy("codec").agg(F.count("*").alias("chunks"), F.sum("payload").alias("bytes"))


@query(_SIZES + f" SELECT {_CHUNK}, payload, CAST(coalesce(sum(payload) OVER (PARTITION BY rx, ry, rz ORDER BY cx, cy, cz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM size")
def q_layout_offsets(spark, d):
    return op.running_offsets(op.codec_sizes(voxels(spark, d), G))


#: Payload entries as edits leave them: every third chunk shares the range of the chunk before it, every seventh has none.
_ENTRIES = _SIZES + f""", laid AS (SELECT *, row_number() OVER w - 1 AS ordinal, CAST(coalesce(sum(payload) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM size WINDOW w AS (PARTITION BY rx, ry, rz ORDER BY cx, cy, cz)),
shared AS (SELECT *, CASE WHEN ordinal % 3 = 2 THEN lag(pos) OVER w ELSE pos END AS pos2, CASE WHEN ordinal % 3 = 2 THEN lag(payload) OVER w ELSE payload END AS size2 FROM laid WINDOW w AS (PARTITION BY rx, ry, rz ORDER BY ordinal)),
entry AS (SELECT rx, ry, rz, ordinal, CASE WHEN ordinal % 7 <> 5 THEN pos2 END AS "offset", CASE WHEN ordinal % 7 <> 5 THEN size2 END AS size FROM shared),
blob AS (SELECT rx, ry, rz, CAST(sum(payload) AS BIGINT) AS blob_size FROM size GROUP BY 1, 2, 3)
"""


def _entries(spark, d) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    sizes = op.codec_sizes(voxels(spark, d), G).select(*op.CHUNK, "payload")
    w = Window.partitionBy(*op.REGION).orderBy("cx", "cy", "cz")
    laid = sizes.select(*op.REGION, "payload", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"), F.coalesce(F.sum("payload").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    o = Window.partitionBy(*op.REGION).orderBy("ordinal")
    third, there = F.col("ordinal") % 3 == 2, F.col("ordinal") % 7 != 5
    shared = laid.select(*op.REGION, "ordinal", F.when(third, F.lag("at").over(o)).otherwise(F.col("at")).alias("at"), F.when(third, F.lag("payload").over(o)).otherwise(F.col("payload")).alias("n"))
    entries = shared.select(*op.REGION, "ordinal", F.when(there, F.col("at")).alias("offset"), F.when(there, F.col("n")).alias("size"))
    return entries, sizes.groupBy(*op.REGION).agg(F.sum("payload").alias("blob_size"))


@query(_ENTRIES + """, range AS (SELECT rx, ry, rz, "offset", size, min(ordinal) AS first FROM entry WHERE "offset" IS NOT NULL GROUP BY ALL),
moved AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY rx, ry, rz ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM range)
SELECT rx, ry, rz, ordinal, "offset", size, new_offset FROM entry LEFT JOIN moved USING (rx, ry, rz, "offset", size)""")
def q_compact_offsets(spark, d):
    return op.compacted(_entries(spark, d)[0])


@query(_ENTRIES + """ SELECT rx, ry, rz, CAST(greatest(blob_size - coalesce(live, 0), 0) AS BIGINT) AS reclaimable FROM blob LEFT JOIN (
SELECT rx, ry, rz, sum(size) AS live FROM (SELECT DISTINCT rx, ry, rz, "offset", size FROM entry WHERE "offset" IS NOT NULL) e JOIN blob USING (rx, ry, rz) WHERE "offset" + size <= blob_size GROUP BY 1, 2, 3) USING (rx, ry, rz)""")
def q_reclaimable(spark, d):
    return op.reclaimable(*_entries(spark, d))


@query(_AT + f" SELECT {_CHUNK}, row_number() OVER (PARTITION BY rx, ry, rz ORDER BY cx, cy, cz) - 1 AS ordinal FROM (SELECT DISTINCT {_CHUNK} FROM v)")
def q_chunk_ordinals(spark, d):
    from pyspark.sql import Window

    chunks = op.located(voxels(spark, d), G).select(*op.CHUNK).distinct()
    return chunks.select("*", (F.row_number().over(Window.partitionBy(*op.REGION).orderBy("cx", "cy", "cz")) - 1).cast("bigint").alias("ordinal"))


@query(_SIZES + f" SELECT {_CHUNK}, codec, codec IN (1, 4, 5, 7) AS only_occupied FROM size")
def q_codec_class(spark, d):
    return op.codec_sizes(voxels(spark, d), G).select(*op.CHUNK, "codec", op.only_occupied(F.col("codec")).alias("only_occupied"))


@query("SELECT p_partkey, '0x' || printf('%X', p_partkey * 1048576 + 10) AS u FROM part")
def q_u64_hex(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.u64_hex(F.col("p_partkey") * 1048576 + 10).alias("u"))


@query(_AT + " SELECT DISTINCT cx, cy, cz, cx + cy * 65536 + cz * 4294967296 AS chunk_key FROM v")
def q_chunk_key(spark, d):
    c = op.located(voxels(spark, d), G).select("cx", "cy", "cz").distinct()
    return c.select("*", address.chunk_key(F.col("cx"), F.col("cy"), F.col("cz")).alias("chunk_key"))
