"""Edits, rules, textures and meshes on literal cases, and edit logs as streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import address, scalar
from voxelith.functions.address import Geometry
from voxelith.operators import edits as ed, mesh, rules, textures as tx, voxel as op
from voxelith.streaming import edit_log

CELLS = "x bigint, y bigint, z bigint, key bigint"
G = Geometry((4, 4, 4), (2, 2, 2))


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_set_and_remove_chunk(spark):
    v = spark.createDataFrame([(0, 0, 0, 1), (5, 0, 0, 2), (-1, 0, 0, 3)], CELLS)
    keys = [0] * 64
    keys[0], keys[63] = 7, 8
    assert rows(ed.set_chunk(v, G, (0, 0, 0, 1, 0, 0), keys)) == {(0, 0, 0, 1), (-1, 0, 0, 3), (4, 0, 0, 7), (7, 3, 3, 8)}
    assert rows(ed.remove_chunk(v, G, (0, 0, 0, 1, 0, 0))) == {(0, 0, 0, 1), (-1, 0, 0, 3)}
    with pytest.raises(ValueError):
        ed.set_chunk(v, G, (0, 0, 0, 0, 0, 0), [1, 2])


def test_payloads_and_flags(spark):
    p = "rx bigint, ry bigint, rz bigint, cx bigint, cy bigint, cz bigint, section int, codec int, entry_flags int, bytes binary"
    old = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 2, 1, 0, bytearray(b"a")), (0, 0, 0, 0, 0, 0, 3, 1, 0, bytearray(b"b"))], p)
    new = spark.createDataFrame([(*([0] * 6), 2, 5, 1, bytearray(b"x"), 1), (*([0] * 6), 2, 6, 1, bytearray(b"y"), 2)], p + ", seq int")
    got = {(r["section"], r["codec"], bytes(r["bytes"])) for r in ed.set_payload(old, new).collect()}
    assert got == {(2, 6, b"y"), (3, 1, b"b")}
    assert [r["section"] for r in ed.remove_payload(old, (0,) * 6, 2).collect()] == [3]
    with pytest.raises(Exception, match="no chunk's payload"):
        ed.set_payload(old, new.withColumn("section", F.lit(1))).collect()
    chunks = spark.createDataFrame([(*([0] * 6), 0, 4), (*([1] * 6), 0, 0)], "rx bigint, ry bigint, rz bigint, cx bigint, cy bigint, cz bigint, flags int, non_air bigint")
    assert {r["cx"]: r["flags"] for r in ed.chunk_flags(chunks, old).collect()} == {0: 1 | 4 | 8, 1: 1 | 2}


def test_regions_are_unique(spark):
    r = spark.createDataFrame([(0, 0, 0)], "rx bigint, ry bigint, rz bigint")
    assert ed.add_region(r, (1, 0, 0)).count() == 2
    with pytest.raises(Exception, match="there already"):
        ed.add_region(r, (0, 0, 0)).collect()
    b = ed.rebuild_bounds(r.limit(0)).first()
    assert b["explicit"] is False and b["min_rx"] == 0


def test_air_is_not_registered(spark):
    reg = spark.createDataFrame([(0, 1, 5, 1)], "ordinal int, key bigint, material_id bigint, flags int")
    changes = spark.createDataFrame([(1, 3, 7, 2), (2, 1, 9, 4), (3, 3, 8, 2)], "seq bigint, key bigint, material_id bigint, flags int")
    assert rows(ed.registry_upsert(reg, changes)) == {(0, 1, 9, 4), (1, 3, 8, 2)}
    with pytest.raises(Exception, match="key 0 is air"):
        ed.registry_upsert(reg, changes.withColumn("key", F.lit(0).cast("bigint"))).collect()


def test_unknown_flags_are_refused(spark):
    ok = spark.createDataFrame([(["opaque", "special"],)], "f array<string>")
    assert ok.select(scalar.flag_bits(F.col("f"))).first()[0] == 5
    with pytest.raises(Exception, match="unknown registry flag"):
        spark.createDataFrame([(["shiny"],)], "f array<string>").select(scalar.flag_bits(F.col("f"))).collect()


def test_description_checks():
    other = Geometry((8, 8, 8), (1, 1, 1))
    assert ed.checked_description(G, other, 0, False) == other
    for geometry, convention, chunks in ((other, 0, True), (G, 1, False)):
        with pytest.raises(ValueError):
            ed.checked_description(G, geometry, convention, chunks)


def test_first_rows_win_in_colours(spark):
    v = spark.createDataFrame([(0, 0, 0, 1)], CELLS)
    reg = spark.createDataFrame([(0, 1, 0x11, 1), (1, 1, 0x22, 2)], "ordinal int, key bigint, rgba bigint, material_id bigint")
    materials = spark.createDataFrame([(1, 0), (1, 0), (2, 0x33)], "material_id bigint, tint bigint")
    assert rows(op.colours(v, reg, materials)) == {(0, 0, 0, 1, 0x11)}


def test_fill_box_refuses_and_counts(spark):
    v = spark.createDataFrame([(0, 0, 0, 1)], CELLS)
    for key in (0, 3):
        with pytest.raises(ValueError):
            op.fill_box(v, (1, 0, 0), (0, 0, 0), key)
    assert op.fill_box(v, (2, 0, 0), (5, 0, 0), 3, G, create_missing=False).count() == 3
    assert (op.box_hits(v, (2, 0, 0), (5, 0, 0), G, False).first()[0], op.box_hits(v, (2, 0, 0), (5, 0, 0), G).first()[0]) == (2, 4)


def test_interior_needs_closings(spark):
    # y = 3, 4, 5 open and close as one run; a lone opening at 10 encloses nothing.
    f = spark.createDataFrame([(0, 3, 0, 1, -1, 5), (0, 5, 0, 1, 1, 6), (0, 10, 0, 1, -1, 7), (9, 0, 0, 0, 1, 1)], "x bigint, y bigint, z bigint, axis int, sign int, key bigint")
    assert rows(op.filled_lines(f)) == {(0, 3, 0, 5), (0, 4, 0, 5), (0, 5, 0, 5)} and op.unpaired(f).first()[0] == 0
    assert op.unpaired(f.where("y <> 3")).first()[0] == 2


def test_interior_of_a_cube_is_the_cube(spark):
    box = op.box_cells(spark, (-2, -2, -2), (3, 3, 3), 4)
    assert rows(op.filled_lines(op.exposed_faces(box))) == rows(box)


def test_faces_across_tiles(spark):
    long = spark.createDataFrame([(x, 0, 31, 1) for x in range(-40, 70)], CELLS)
    assert op.exposed_faces(long).count() == 4 * 110 + 2
    rng = np.random.default_rng(2)
    cells = {tuple(map(int, c)) for c in rng.integers(-40, 40, (400, 3)).tolist()} | {(31, 0, 0), (32, 0, 0), (-1, 0, 0), (0, 0, 0)}
    got = op.exposed_faces(spark.createDataFrame([(*c, 1) for c in cells], CELLS))
    want = {(*c, a, s) for c in cells for a in range(3) for s in (-1, 1) if tuple(v + s * (i == a) for i, v in enumerate(c)) not in cells}
    assert {tuple(r)[:5] for r in got.collect()} == want and got.count() == len(want)


def test_last_write_beyond_64_bits(spark):
    big = 2**63 - 1
    e = spark.createDataFrame([(big, 0, 0, 0, 4294967295), (-5, 0, 0, 0, 1), (-7, 1, 0, 0, 9), (-9, 1, 0, 0, 2)], "seq bigint, " + CELLS)
    assert rows(op.last_writes(e)) == {(0, 0, 0, 4294967295), (1, 0, 0, 9)}


def world(spark, **more):
    reg = spark.createDataFrame([(0, 1, 1)], "ordinal int, key bigint, material_id bigint")
    none = {
        "registry": reg, "textures": spark.createDataFrame([], "ordinal int, path string"), "materials": spark.createDataFrame([], "material_id bigint"),
        "regions": spark.createDataFrame([(0, 0, 0, 0)], "ordinal bigint, rx bigint, ry bigint, rz bigint"),
        "chunks": spark.createDataFrame([(0, 0, 0, 0, 0, 1, 0, 0, 0)], "region bigint, ordinal bigint, cx bigint, cy bigint, cz bigint, " + ", ".join(f"top_key_{i} bigint" for i in range(4))),
        "voxels": spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 9)], CELLS)}
    return rules.World(**({"chunk": (4, 4, 4), "region": (2, 2, 2)} | none | more))


def codes(df):
    return sorted(r["code"] for r in df.collect())


def test_rules(spark):
    assert codes(rules.validate(world(spark))) == [rules.NO_TEXTURES, rules.NO_UNITS]
    assert codes(rules.validate(world(spark), deep=True)) == [rules.UNREGISTERED, rules.NO_TEXTURES, rules.NO_UNITS]
    assert codes(rules.validate(world(spark, chunk=(0, 4, 4)))) == [rules.BAD_GEOMETRY]
    assert rules.BAD_GEOMETRY in codes(rules.validate(world(spark, chunk=(256, 4, 4))))
    empty = spark.createDataFrame([], "ordinal int, key bigint, material_id bigint")
    assert codes(rules.validate(world(spark, registry=empty, default_units=False))) == [rules.UNREGISTERED, rules.NO_REGISTRY]
    textured = world(spark, textures=spark.createDataFrame([(0, "a")], "ordinal int, path string"))
    assert codes(rules.validate(textured)) == [rules.NO_MATERIAL, rules.NO_UNITS]


def test_one_half_open_mip(spark):
    texels = spark.createDataFrame([(0, 0, 0, 0, 10), (0, 0, 1, 0, 13)], "image bigint, x bigint, y bigint, channel bigint, value bigint")
    images = spark.createDataFrame([(0, 1, 2, 9)], "image bigint, width bigint, height bigint, format int")
    assert rows(tx.next_level(texels, images)) == {(0, 0, 0, 0, 12)}
    with pytest.raises(Exception, match="no smaller levels"):
        tx.next_level(texels, images.withColumn("format", F.lit(145))).collect()


def test_rays_cross_a_closed_box_twice(spark):
    corners = [(x, y, z) for x in (0.0, 4.0) for y in (0.0, 4.0) for z in (0.0, 4.0)]
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    tri = [(i, *(c for k in t for c in corners[k])) for i, q in enumerate(quads) for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    triangles = spark.createDataFrame(tri, "face bigint, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    rays = spark.createDataFrame([(i * 10 + j, i + 0.5, j + 0.5) for i in range(-1, 6) for j in range(-1, 6)] + [(999, 2.0, 2.0)], "ray bigint, y double, z double")
    hits = mesh.crossings(rays, triangles)
    got = {r["ray"]: (r["start"], r["end"]) for r in mesh.paired(hits).collect()}
    assert got == {i * 10 + j: (0.0, 4.0) for i in range(4) for j in range(4)} | {999: (0.0, 4.0)}
    line = spark.createDataFrame([(22, c, c + 0.5) for c in range(-3, 9)], "ray bigint, cell bigint, x double")
    assert {r["cell"] for r in mesh.span_cells(mesh.paired(hits), line).collect()} == {0, 1, 2, 3}


def box_mesh(spark, low, high):
    corners = [(x, y, z) for x in (low[0], high[0]) for y in (low[1], high[1]) for z in (low[2], high[2])]
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    tri = [(i, *(float(c) for k in t for c in corners[k])) for i, q in enumerate(quads) for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    return spark.createDataFrame(tri, "face bigint, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))


@pytest.mark.parametrize("convention", [address.Y_UP, address.Z_UP, address.Z_BACK])
def test_a_box_is_voxelized_in_any_convention(spark, convention):
    f = mesh.Frame((0.5, 1.0, 1.0), (0.25, 0.0, 0.0), convention)
    t = box_mesh(spark, (0.25, 1.0, -2.0), (2.25, 4.0, 2.0))
    got = mesh.voxelized(t, f)
    assert got.count() == 4 * 3 * 4 and got.agg(F.min("x"), F.max("x")).first()[:] == (0, 3)
    centre = f.to_points([F.col(c) for c in "xyz"])
    assert got.where((centre[1] < 1.0) | (centre[1] > 4.0) | (centre[2] < -2.0) | (centre[2] > 2.0)).count() == 0
    assert {r["x"] for r in mesh.voxelized(t, f, surface_only=True).collect()} == {0, 4} and mesh.voxelized(t.limit(0), f).count() == 0
    with pytest.raises(ValueError):
        mesh.voxelized(t, f, limit=10)


def test_a_cube_mesh_is_imported_solid(spark):
    f = mesh.Frame(convention=address.Z_UP)
    faces = [(i, a, s, *[0.0 if (k != a or s < 0) else 3.0 for k in range(3)], *[3.0 if (k != a or s > 0) else 0.0 for k in range(3)]) for i, (a, s) in enumerate((a, s) for a in range(3) for s in (-1, 1))]
    table = spark.createDataFrame(faces, "face bigint, axis int, sign int, lx double, ly double, lz double, hx double, hy double, hz double")
    keys = table.select("face", F.lit(2).cast("bigint").alias("key"))
    old = spark.createDataFrame([(1, 1, 1, 9), (8, 8, 8, 9), (3, 3, 3, 9)], CELLS)
    got = mesh.import_mesh(old, table, keys, f, G, bounds=((0, 0, 0), (3, 3, 3)))
    assert rows(got) == {(x, y, z, 2) for x in range(3) for y in range(3) for z in range(3)} | {(8, 8, 8, 9)}
    assert mesh.import_mesh(old.limit(0), table, keys, f, G, solid=False).count() == 26


@pytest.mark.parametrize("convention", [address.Y_UP, address.Z_UP, address.Z_BACK])
def test_face_windings_point_outward(convention):
    f = mesh.Frame((1.0, 2.0, 0.5), (0.0, 0.0, 0.0), convention)
    for axis in range(3):
        for sign in (-1, 1):
            steps = mesh.corner_order(axis, sign, f)
            assert len(set(steps)) == 4 and {s[axis] for s in steps} == {int(sign > 0)}


def test_raster_limit_and_shape(spark):
    r = spark.createDataFrame([(1, 0, 0, 0, 3, 1, 0)], "face bigint, x0 bigint, y0 bigint, z0 bigint, x1 bigint, y1 bigint, z1 bigint")
    assert mesh.rasterized(r).count() == 8
    with pytest.raises(ValueError):
        mesh.rasterized(r, 7)
    f = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "face bigint, lx double, ly double, lz double, hx double, hy double, hz double, nx double, ny double, nz double")
    frame = mesh.Frame()
    assert mesh.voxel_shaped(mesh.oriented(f), frame).first()[0] is True and mesh.voxel_shaped(mesh.oriented(f.limit(0)), frame).first()[0] is False


def test_new_colours_get_keys_in_order(spark):
    reg = spark.createDataFrame([(0, 4, 0, 0, 0)], "ordinal int, key bigint, r bigint, g bigint, b bigint")
    colours = spark.createDataFrame([(255, 255, 255), (250, 255, 255), (0, 0, 1), (128, 0, 0)], "r bigint, g bigint, b bigint")
    assert mesh.registered_colours(colours, reg) == [(5, 128, 0, 0), (6, 250, 255, 255)]


def test_grid_codes_refuse_huge_boxes():
    with pytest.raises(ValueError):
        mesh.grid_code([F.lit(0)] * 3, (0, 0, 0), (2**31, 2**31, 8))


def test_edit_log_stream(spark, tmp_path):
    base = spark.createDataFrame([(0, 0, 0, 1), (9, 0, 0, 2), (30, 0, 0, 3)], CELLS)
    world_path, log, state = (str(tmp_path / n) for n in ("world", "log", "state"))
    edit_log.write_world(base, G, world_path)
    schema = "seq bigint, " + CELLS
    first = spark.createDataFrame([(1, 0, 0, 0, 5), (2, 0, 0, 0, 6), (3, 30, 0, 0, 0)], schema)
    second = spark.createDataFrame([(4, 9, 1, 0, 7), (5, 0, 0, 0, 0), (6, -50, 0, 0, 8)], schema)
    for batch in (first, second):
        batch.write.mode("append").parquet(log)
        edit_log.start(spark.readStream.schema(schema).parquet(log), G, world_path, state, once=True).awaitTermination()
    got = edit_log.read_world(spark, world_path)
    assert rows(got.select("x", "y", "z", "key")) == {(9, 0, 0, 2), (9, 1, 0, 7), (-50, 0, 0, 8)}
    edit_log.apply_batch(second, G, world_path, state + "/again")
    assert edit_log.read_world(spark, world_path).count() == 3
