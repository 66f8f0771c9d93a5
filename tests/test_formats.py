"""Payloads, regions, worlds, textures and scenes as bytes: round trips, exact sizes and refusals."""

from __future__ import annotations

import dataclasses
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from voxelith.formats import cells, manifest, payload, region, scene, texture, world
from voxelith.formats.bytes_hash import fnv1a64
from voxelith.functions import scalar
from voxelith.functions.address import Geometry
from voxelith.operators import files, mesh, voxel as op
from voxelith.sources import worlds

CODECS = (payload.PALETTE, payload.LIST, payload.COLUMNS, payload.RAW, payload.PACKED)
REG = "ordinal int, key bigint, material_id bigint, flags int, rgba bigint"


def plain_hash(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return h


@given(st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_hash_equals_the_plain_fold(data):
    assert fnv1a64(data) == plain_hash(data)


def test_hash_of_long_bytes_and_of_a_column(spark):
    data = random.Random(1).randbytes(70_000)
    assert fnv1a64(data) == plain_hash(data)
    got = spark.createDataFrame([(bytearray(data[:9000]),), (None,)], "b binary").select(scalar.fnv1a64(F.col("b"))).collect()
    assert [r[0] for r in got] == [f"{fnv1a64(data[:9000]):016x}", None]


@given(st.integers(1, 6), st.integers(1, 6), st.integers(1, 6), st.lists(st.sampled_from([0, 0, 0, 1, 2, 3, 2**32 - 1]), min_size=216, max_size=216))
@settings(max_examples=80, deadline=None)
def test_every_codec_gives_the_voxels_back(x, y, z, keys):
    dense = np.array(keys[:x * y * z], "<u4")
    best = payload.encode(dense, (x, y, z))
    assert (payload.decode(*best, (x, y, z)) == dense).all()
    sizes = []
    for c in CODECS:
        used, data = payload.encode(dense, (x, y, z), c)
        assert used == c and (payload.decode(c, data, (x, y, z)) == dense).all()
        sizes.append(len(data))
    assert len(best[1]) <= min(sizes)


def test_sizes_of_a_surface_chunk():
    dense = np.zeros(4096, "<u4")
    for x in range(16):
        for z in range(16):
            dense[x + 16 * ((x + z) % 16 + 16 * z)] = 1 + (7 * x + z) % 8
    assert (len(payload.encode(dense, (16, 16, 16), payload.LIST)[1]), len(payload.encode(dense, (16, 16, 16), payload.PACKED)[1]), payload.encode(dense, (16, 16, 16))[0]) == (2052, 520, payload.PACKED)


def test_sizes_equal_those_of_the_plan(spark):
    rng = np.random.default_rng(3)
    g = Geometry((4, 5, 6), (1, 1, 1))
    for share, keys in ((0.05, 3), (0.5, 2), (0.9, 40), (1.0, 1), (1.0, 2)):
        dense = np.where(rng.random(g.volume) < share, rng.integers(1, keys + 1, g.volume), 0).astype("<u4")
        rows = [(int(i % 4), int(i // 4 % 5), int(i // 20), int(k)) for i, k in enumerate(dense) if k]
        r = op.codec_sizes(spark.createDataFrame(rows, "x bigint, y bigint, z bigint, key bigint"), g).first()
        for name, c in (("palette", payload.PALETTE), ("list", payload.LIST), ("columns", payload.COLUMNS), ("raw", payload.RAW), ("packed", payload.PACKED)):
            assert r[name] == len(payload.encode(dense, g.chunk, c)[1]), (name, share, keys)
        used, data = payload.encode(dense, g.chunk)
        assert (r["codec"], r["payload"]) == (used, len(data))


def test_too_many_keys_have_no_palette():
    dense = np.arange(1, 65537, dtype="<u4")
    with pytest.raises(payload.PayloadError):
        payload.encode(dense, (64, 32, 32), payload.PALETTE)
    assert payload.encode(dense, (64, 32, 32))[0] == payload.RAW


@pytest.mark.parametrize(("codec", "data"), [(payload.RAW, b"123"), (payload.LIST, b"\x01\0\0\0\xff\0\0\0\1\0\0\0"), (payload.UNIFORM, b"1"), (payload.PALETTE, b"\x01\0\x01\0\x05\0\0\0"), (payload.COLUMNS, b"\x01\0\0\0\x09\0\0\0\0\0"), (99, b"")])
def test_broken_payloads_are_refused(codec, data):
    with pytest.raises(payload.PayloadError):
        payload.decode(codec, data, (2, 2, 2))


def made(coord=(1, -2, 3), n=300) -> tuple[region.Region, np.ndarray, Geometry]:
    rng, g = np.random.default_rng(5), Geometry((4, 4, 4), (3, 3, 3))
    xyz = np.unique(rng.integers(0, 12, (n, 3)), axis=0) + np.array(coord) * 12
    rows = np.column_stack([xyz, rng.integers(1, 6, len(xyz))])
    return cells.build(coord, rows, g, {1: 1, 2: 3, 3: 4}), rows, g


def test_region_round_trip_and_layout():
    r, rows, g = made()
    r.metadata, r.manifest_hash = {"b": b"\0\xff", "a": b"text"}, 7
    data = region.to_bytes(r)
    back = region.of_bytes(data)
    assert region.to_bytes(back) == data and region.sound(data) and back.metadata == r.metadata and back.coord == (1, -2, 3)
    got = np.concatenate(list(cells.cells_of(files.opened(data), g)))
    assert {tuple(x) for x in got.tolist()} == {tuple(x) for x in rows.tolist()}
    assert (region.HEADER.itemsize, region.CHUNK.itemsize, region.SUMMARY.itemsize, region.SECTION.itemsize, region.ENTRY.itemsize) == (88, 16, 56, 40, 16)


def test_metadata_alone_is_read_without_payloads():
    r, _, _ = made()
    data, touched = region.to_bytes(r), []

    def read(at, n):
        touched.append((at, at + n))
        return data[at:at + n]

    reader = region.Reader(read, len(data))
    blob = int(reader.directory[0]["blob_at"])
    assert all(end <= blob for _, end in touched) and len(reader.chunks) == len(r.chunks)
    assert reader.resident() == 88 + 40 + 88 * len(r.chunks)


def test_broken_regions_are_refused():
    data = bytearray(region.to_bytes(made()[0]))
    assert not region.sound(bytes(data[:-1] + b"\x01" if data[-1] != 1 else data[:-1] + b"\x02"))
    data[-1] ^= 1
    with pytest.raises(region.RegionError):
        region.of_bytes(bytes(data))
    assert region.of_bytes(bytes(data), check=False).coord == (1, -2, 3)
    for bad in (bytes(data[:50]), b"x" * 200, bytes(data[:-5])):
        with pytest.raises(region.RegionError):
            region.of_bytes(bad)


def test_compaction_shares_ranges_and_keeps_voxels():
    r, rows, g = made()
    s = r.sections[0]
    s.blob += b"dead" * 10
    s.entries[1] = s.entries[0]
    before = [payload.decode(int(e["codec"]), s.blob[int(e["offset"]):int(e["offset"]) + int(e["size"])], g.chunk).tolist() for e in s.entries]
    assert region.compact(r) > 40 and region.compact(r) == 0
    s = r.sections[0]
    assert [payload.decode(int(e["codec"]), s.blob[int(e["offset"]):int(e["offset"]) + int(e["size"])], g.chunk).tolist() for e in s.entries] == before


def example_manifest() -> manifest.Manifest:
    entries = [manifest.Entry(1, 4, 9, 'sto"ne\\', fnv1a64(b'sto"ne\\'), 0xFF0000FF), manifest.Entry(7, 0, 0, "", 12, 0)]
    return manifest.Manifest(Geometry((8, 8, 8), (2, 2, 2)), "wörld", "u-1", 1, ((-1, 0, 0), (2, 2, 2)), (0.5, 1.0, 2.0), (1.0, 2.0, 3.0), registry=entries, textures=[{"id": "t", "path": "t.btx", "content_hash": 5}], regions=[{"path": "r_0_0_0.bvx", "coord": (0, 0, 0)}, {"path": "x.bvx", "coord": None}], metadata={"a b": b"x\ny", "k": b"\xff\0", "n": b""})


def test_manifest_round_trip():
    m = example_manifest()
    text = manifest.emit(m)
    back = manifest.parse(text.encode())
    assert back.hash == fnv1a64(text.encode()) and back.registry_hash == manifest.registry_hash(m.registry)
    assert dataclasses.replace(back, hash=0, registry_hash=0) == m and manifest.emit(back) == text


@pytest.mark.parametrize("text", ["", "[geometry]\nchunk_size = [1, 2]\nregion_size = [1, 1, 1]", "[geometry]\nchunk_size = [0, 1, 1]\nregion_size = [1, 1, 1]", "[geometry]\nchunk_size = [4, 4, 4]\nregion_size = [1, 1, 1]\nvoxel_schema = 'other'", "[geometry]\nchunk_size = [4, 4, 4]\nregion_size = [1, 1, 1]\n[[registry]]\nvoxel_key = 1\nflags = ['shiny']", "[geometry]\nchunk_size = [4, 4, 4]\nregion_size = [1, 1, 1]\n[metadata]\na = {hex = 'abc'}"])
def test_faulty_manifests_are_refused(text):
    with pytest.raises(ValueError):
        manifest.parse(text.encode())


def test_numbers_of_manifests():
    assert [manifest.number(v, 9) for v in (5, "0x1F", "10", "zz", None)] == [5, 31, 16, 9, 9]


def test_description_round_trip():
    m = example_manifest()
    back = world.described(world.description(m))
    assert (back.geometry, back.convention, back.bounds, back.size, back.origin, back.registry) == (m.geometry, m.convention, m.bounds, m.size, m.origin, m.registry)
    assert back.textures[0]["path"] == "textures/t.btx"
    m.textures[0]["path"] = "x" * 130
    with pytest.raises(ValueError):
        world.description(m)


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    g = Geometry((4, 4, 4), (2, 2, 2))
    v = spark.createDataFrame([(x, y, -x, 1 + (x + y) % 3) for x in range(-9, 9) for y in range(3)], "x bigint, y bigint, z bigint, key bigint")
    reg = spark.createDataFrame([(0, 1, 0, 1, 0xFF0000FF), (1, 2, 0, 2, 0)], REG)
    path = str(tmp_path_factory.mktemp("world"))
    m = worlds.manifest_of(g, reg, name="w", metadata={"k": b"v"})
    report = worlds.save_world(path, m, v, reg)
    return path, m, v, reg, g, report


def test_world_round_trip(spark, saved):
    path, m, v, reg, g, report = saved
    got = worlds.read_table(spark, path, "voxels")
    assert got.exceptAll(v).count() == v.exceptAll(got).count() == 0 and report["full"] == 1
    chunks = worlds.read_table(spark, path, "chunks")
    want = op.chunk_summary(v, reg, g)
    assert chunks.select(want.columns).exceptAll(want).count() == 0 and chunks.count() == want.count()
    assert worlds.read_table(spark, path, "regions").count() == report["files_written"]
    assert [tuple(r)[1:4] for r in worlds.read_table(spark, path, "registry").orderBy("ordinal").collect()] == [(1, 0, 1), (2, 0, 2)]
    assert [tuple(r) for r in worlds.read_table(spark, path, "metadata").collect()] == [("world", "k", bytearray(b"v"))]


def test_region_filters_leave_out_files(spark, saved):
    path, _, v, _, g, _ = saved
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        r = op.located(v, g).select("rx", "ry", "rz").orderBy("rx", "rz").first()
        got = worlds.read_table(spark, path, "chunks", pushdown="true").where(f"rx = {r['rx']} and rz = {r['rz']}")
        want = worlds.read_table(spark, path, "chunks").where(f"rx = {r['rx']} and rz = {r['rz']}")
        assert got.count() == want.count() > 0 and len(got.inputFiles()) == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_dirty_save_prune_and_dry_run(spark, saved):
    path, m, v, reg, g, _ = saved
    one = op.located(v, g).select("rx", "ry", "rz").distinct().limit(1)
    m2 = worlds.manifest_of(g, reg, name="w", metadata={"k": b"v"})
    assert worlds.save_world(path, m2, v, reg, only=one, dry_run=True) == {"files_written": 1, "files_deleted": 0, "full": 0}
    renamed = worlds.manifest_of(g, reg, name="other", metadata={"k": b"v"})
    assert worlds.save_world(path, renamed, v, reg, only=one, dry_run=True)["full"] == 1
    fewer = v.where("x >= 0")
    report = worlds.save_world(path, m2, fewer, reg, prune=True, keep_backup=True)
    assert report["files_deleted"] > 0 and worlds.read_table(spark, path, "voxels").count() == fewer.count()
    worlds.save_world(path, m, v, reg)


def test_files_of_another_world_are_refused(spark, saved, tmp_path):
    path, m, v, reg, g, _ = saved
    worlds.save_world(str(tmp_path), worlds.manifest_of(g, reg, name="x"), v, reg)
    text = (tmp_path / "manifest.toml").read_text()
    (tmp_path / "manifest.toml").write_text(text.replace('name = "x"', 'name = "y"'))
    with pytest.raises(Exception, match="another world"):
        worlds.read_table(spark, str(tmp_path), "chunks").count()
    assert worlds.read_table(spark, str(tmp_path), "chunks", ignoreHashMismatch="true").count() > 0


def test_files_without_a_manifest(spark, saved):
    path, _, v, _, g, report = saved
    folder = f"{path}/regions"
    assert worlds.read_table(spark, folder, "regions").count() == report["files_written"]
    assert worlds.read_table(spark, folder, "voxels", chunkSize="4,4,4", regionSize="2,2,2").count() == v.count()
    raw = spark.read.format("binaryFile").load(folder).select("path", "content")
    assert files.integrity(raw).where("sound").count() == report["files_written"] and files.voxels(raw, g).count() == v.count()


def test_a_world_that_stands_alone(spark, saved):
    _, _, v, reg, _, _ = saved
    near, g = v.where("x >= 0 and z > -8").selectExpr("x", "y", "z + 8 as z", "key"), Geometry((4, 4, 4), (8, 8, 8))
    rows = worlds.standalone(near, reg, worlds.manifest_of(g, reg, metadata={"a": b"b"})).collect()
    r = files.opened(bytes(rows[0]["content"]))
    assert len(rows) == 1 and world.described(r.world).geometry == g and r.metadata == {"a": b"b"} and region.sound(bytes(rows[0]["content"]))
    with pytest.raises(Exception, match="one region"):
        worlds.standalone(v, reg, worlds.manifest_of(Geometry((4, 4, 4), (2, 2, 2)), reg)).collect()


def test_textures_round_trip_and_mips(spark):
    a = texture.Archive()
    t = a.add_texture(format=37, width=5, height=3, mips=3, layers=2)
    for layer in range(2):
        a.add_texels(t, 0, layer, 5, 3, bytes((i * 7 + layer) % 256 for i in range(60)))
    a.add_mips(t)
    a.add_mips(t)
    a.add_material(albedo=t, tint=0x11223344)
    data = texture.to_bytes(a)
    assert texture.to_bytes(texture.of_bytes(data)) == data and len(a.subresources) == 6
    assert (texture.HEADER.itemsize, texture.SAMPLER.itemsize, texture.TEXTURE.itemsize, texture.SUBRESOURCE.itemsize, texture.MATERIAL.itemsize) == (88, 28, 56, 48, 56)
    tables = files.texture_tables(spark.createDataFrame([("a.btx", bytearray(data))], "path string, content binary"))
    assert [d.count() for d in tables] == [1, 6, 1, 1] and tables[0].first()["count"] == 6
    with pytest.raises(texture.TextureError):
        a.add_texels(t, 0, 0, 5, 3, b"short")
    with pytest.raises(texture.TextureError):
        texture.of_bytes(data[:-1] + bytes([data[-1] ^ 1]))


def test_palette_archive():
    a = texture.palette([0xFF0000FF, 0x00FF00FF])
    assert a.blob == bytes([255, 0, 0, 255, 0, 255, 0, 255]) and a.materials["tint"].tolist() == [0xFF0000FF, 0x00FF00FF] and not texture.problems(a)
    assert texture.of_bytes(texture.to_bytes(texture.palette([]))).textures.size == 0


def graph() -> bytes:
    """A scene of two models under a turned group, one of them hidden by its layer."""
    import struct

    def text(s):
        return struct.pack("<I", len(s)) + s.encode()

    def pairs(d):
        return struct.pack("<I", len(d)) + b"".join(text(k) + text(v) for k, v in d.items())

    def chunk(kind, content):
        return kind + struct.pack("<II", len(content), 0) + content

    def move(n, child, layer, about, frame):
        return chunk(b"nTRN", struct.pack("<i", n) + pairs(about) + struct.pack("<iiiI", child, -1, layer, 1) + pairs(frame))

    base = scene.Scene(models=[((2, 3, 4), np.array([[0, 0, 0, 1], [1, 2, 3, 2]], np.uint8)), ((1, 1, 1), np.array([[0, 0, 0, 3]], np.uint8))])
    body = scene.emit(base)
    turn = str(1 | 0 << 2 | 1 << 4)
    return body + move(0, 1, -1, {"_name": "top"}, {}) + chunk(b"nGRP", struct.pack("<i", 1) + pairs({}) + struct.pack("<Iii", 2, 2, 4)) + move(2, 3, 0, {}, {"_r": turn, "_t": "10 20 30"}) + chunk(b"nSHP", struct.pack("<i", 3) + pairs({}) + struct.pack("<Ii", 1, 0) + pairs({})) + move(4, 5, 1, {"_name": "in"}, {}) + chunk(b"nSHP", struct.pack("<i", 5) + pairs({}) + struct.pack("<Ii", 1, 1) + pairs({})) + chunk(b"LAYR", struct.pack("<i", 1) + pairs({"_hidden": "1"}) + struct.pack("<i", -1))


def test_scene_graph_is_flattened_and_placed(spark):
    s = scene.parse(graph())
    assert [(i.model, i.name, i.hidden) for i in s.instances] == [(0, "top", False), (1, "in", True)] and s.instances[0].translation.tolist() == [10, 20, 30]
    instances, models, voxels = files.scenes(spark.createDataFrame([("a.vox", bytearray(graph()))], "path string, content binary"))
    got = {tuple(r)[2:] for r in mesh.placed(instances, models, voxels).collect()}
    want = set()
    for x, y, z, colour in ((0, 0, 0, 1), (1, 2, 3, 2)):
        ends = [s.instances[0].rotation @ (np.array([x, y, z]) - np.array([1, 1, 2]) + d) + s.instances[0].translation for d in (0, 1)]
        want.add((*np.minimum(*ends).tolist(), colour))
    assert got == want and mesh.scene(instances, models, voxels).agg(F.min("x"), F.min("y"), F.min("z")).first()[:] == (0, 0, 0)


def test_a_scene_becomes_a_world(spark):
    rng = np.random.default_rng(4)
    s = scene.Scene(models=[((5, 6, 7), np.unique(np.column_stack([rng.integers(0, 5, 60), rng.integers(0, 6, 60), rng.integers(0, 7, 60)]), axis=0))])
    cells_ = s.models[0][1]
    s.models[0] = (5, 6, 7), np.column_stack([cells_, rng.integers(1, 4, len(cells_))]).astype(np.uint8)
    s.palette = rng.integers(0, 256, (256, 4)).astype(np.uint8)
    f = spark.createDataFrame([("m.vox", bytearray(scene.emit(s)))], "path string, content binary")
    rows = worlds.converted_scene(f, 4).collect()
    r = files.opened(bytes(rows[0]["content"]))
    m = world.described(r.world)
    got = np.concatenate(list(cells.cells_of(r, m.geometry)))
    assert len(rows) == 1 and len(got) == len(cells_) and got[:, :3].min() == 0 and [e.key for e in m.registry] == sorted({int(k) for k in s.models[0][1][:, 3]})
    x, y, z, colour = s.models[0][1].astype(int).T
    want = np.column_stack([x, z, -y - 1, colour])
    want[:, :3] -= want[:, :3].min(0)
    assert {tuple(map(int, t)) for t in got} == {tuple(map(int, t)) for t in want}
    assert all(e.rgba == max(1, int.from_bytes(bytes(s.palette[e.key - 1].tolist()), "big")) for e in m.registry)
    with pytest.raises(worlds.WorldError):
        worlds.converted_scene(spark.createDataFrame([("e.vox", bytearray(scene.emit(scene.Scene())))], "path string, content binary"))


@pytest.mark.parametrize("data", [b"", b"VOX", b"VOX \x96\0\0\0XYZI\x04\0\0\0\0\0\0\0\0\0\0\0", graph()[:-4], b"VOX \x96\0\0\0SIZE\xff\0\0\0\0\0\0\0"])
def test_broken_scenes_are_refused(data):
    with pytest.raises(scene.SceneError):
        scene.parse(data)


def test_no_rotation_is_packed_in_a_bad_byte():
    for byte in (3, 0, 5):
        with pytest.raises(scene.SceneError):
            scene.rotation(byte)
