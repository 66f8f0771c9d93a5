"""Voxel operators against literal cases, and every query against its SQL."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelith.functions import address, scalar
from voxelith.functions.address import Geometry
from voxelith.operators import voxel as op
from voxelith.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
CELLS = "x bigint, y bigint, z bigint, key bigint"
REG = "ordinal int, key bigint, flags int"


@pytest.mark.parametrize(("x", "want"), [(0, (0, 0, 0)), (5, (0, 1, 1)), (-1, (-1, 1, 3)), (-8, (-1, 0, 0))])
def test_locate(spark, x, want):
    g = Geometry((4, 4, 4), (2, 2, 2))
    r = spark.range(1).select(F.lit(x).cast("bigint").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z")).select(*address.locate(g)).first()
    assert (r["rx"], r["cx"], r["lx"]) == want


def test_geometry_needs_positive_edges():
    with pytest.raises(ValueError):
        Geometry((0, 4, 4))


def test_convert(spark):
    cell = address.convert(address.Z_UP, address.Y_UP, *(F.lit(v) for v in (1, 2, 3)), cells=True)
    place = address.convert(address.Z_UP, address.Y_UP, *(F.lit(float(v)) for v in (1, 2, 3)), cells=False)
    r = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cell)), *(c.alias(f"p{i}") for i, c in enumerate(place))).first()
    assert tuple(r) == (1, 3, -3, 1.0, 3.0, -2.0)


@pytest.mark.parametrize(("text", "want"), [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, text, want):
    assert spark.range(1).select(scalar.fnv1a64(F.lit(text).cast("binary"))).first()[0] == want


def test_hex_rejects_odd_and_bad(spark):
    rows = spark.createDataFrame([("0aFf",), ("abc",), ("zz",)], "h string").select(scalar.from_hex(F.col("h"))).collect()
    assert [None if r[0] is None else bytes(r[0]) for r in rows] == [b"\x0a\xff", None, None]


def test_surface_chunk_sizes(spark):
    rows = [(x, (x + z) % 16, z, 1 + (7 * x + z) % 8) for x in range(16) for z in range(16)]
    r = op.codec_sizes(spark.createDataFrame(rows, CELLS), Geometry((16, 16, 16), (1, 1, 1))).first()
    assert (r["list"], r["packed"], r["codec"]) == (2052, 520, op.PACKED)


def test_lone_voxel_and_full_chunk(spark):
    g = Geometry((16, 16, 16), (1, 1, 1))
    assert op.codec_sizes(spark.createDataFrame([(2, 13, 4, 5)], CELLS), g).first()["codec"] == op.LIST
    full = op.box_cells(spark, (0, 0, 0), (15, 15, 15), 1)
    assert op.codec_sizes(full, g).first()["codec"] == op.UNIFORM
    two = full.withColumn("key", F.lit(1) + F.col("x") % 2)
    assert op.codec_sizes(two, g).first()["codec"] == op.PALETTE


def test_summary_counts(spark):
    g = Geometry((8, 8, 8), (2, 2, 2))
    v = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 2)], CELLS)
    r = op.chunk_summary(v, spark.createDataFrame([(0, 1, 1), (1, 2, 2)], REG), g).first()
    assert (r["non_air"], r["opaque"], r["emissive"], r["top_key_0"], r["top_count_0"], r["top_key_2"]) == (3, 2, 1, 1, 2, 0)


def test_face_states_after_clearing(spark):
    g = Geometry((4, 4, 4), (2, 2, 2))
    v = op.box_cells(spark, (0, 0, 0), (3, 3, 3), 1).where("not (y = 0 and z = 0 and x < 2)")
    r = op.chunk_summary(v, spark.createDataFrame([], REG), g).first()
    assert [r[f"face_{n}"] for n in ("nx", "ny", "nz", "px", "py", "pz")] == [2, 2, 2, 1, 1, 1]


def test_edits_last_wins_and_missing_chunks(spark):
    g = Geometry((4, 4, 4), (2, 2, 2))
    v = spark.createDataFrame([(0, 0, 0, 1)], CELLS)
    e = spark.createDataFrame([(1, 0, 0, 0, 5), (2, 0, 0, 0, 0), (3, 1, 0, 0, 7), (4, 90, 0, 0, 7)], "seq bigint, " + CELLS)
    assert {tuple(r) for r in op.set_voxels(v, e, g).collect()} == {(1, 0, 0, 7), (90, 0, 0, 7)}
    assert {tuple(r) for r in op.set_voxels(v, e, g, create_missing=False).collect()} == {(1, 0, 0, 7)}
    assert op.hits(v, e, g).first()[0] == 3


def test_box_and_faces(spark):
    box = op.box_cells(spark, (-1, -1, -1), (1, 1, 1), 3)
    assert box.count() == 27 and op.exposed_faces(box).count() == 54 and op.welded(op.exposed_faces(box)).count() == 56
    with pytest.raises(ValueError):
        op.box_cells(spark, (1, 0, 0), (0, 0, 0), 1)


def test_empty_world(spark):
    none, g = spark.createDataFrame([], CELLS), Geometry()
    reg = spark.createDataFrame([], REG)
    assert [op.chunk_summary(none, reg, g).count(), op.codec_sizes(none, g).count(), op.exposed_faces(none).count(), op.y_runs(none, g).count()] == [0, 0, 0, 0]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "pages", "embeddings", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [[None if pd.isna(v) else v for v in r] for r in want.fetchall()]
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, map(tuple, rows)))
