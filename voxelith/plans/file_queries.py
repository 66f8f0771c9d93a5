"""Queries through region files as bytes: what is encoded, described and decoded again, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import files, voxel as op
from ..sources.tables import registry, voxels
from .queries import _AT, _BASE, _CHUNK, _SIZES, _SUMMARY, G, query

_NAME = "'r_' || rx || '_' || ry || '_' || rz || '.bvx'"


def _files(spark, d) -> DataFrame:
    """The region files of the derived world, as bytes: what ``save_world`` would write."""
    return files.encoded(voxels(spark, d), registry(spark), G)


@query(_BASE + "one AS (SELECT 1) SELECT * FROM voxel")
def q_region_roundtrip(spark, d):
    return files.voxels(_files(spark, d), G)


_SUMMARY_COLUMNS = ["non_air", "opaque", "emissive", "special", *(f"{e}_{a}" for e in ("min", "max") for a in "xyz"), "macro_lo", "macro_hi", *(f"face_{n}" for n in op.FACES), *(f"top_{w}_{i}" for i in range(4) for w in ("key", "count"))]


@query(_SUMMARY + f" SELECT {_CHUNK}, {', '.join(_SUMMARY_COLUMNS)} FROM s JOIN top USING ({_CHUNK})")
def q_file_summaries(spark, d):
    return files.chunks(_files(spark, d)).select(*op.CHUNK, *_SUMMARY_COLUMNS)


@query(_SIZES + f" SELECT {_CHUNK}, codec, payload AS payload_size, {_NAME} AS path, 5 AS flags FROM size")
def q_file_payload_sizes(spark, d):
    return files.chunks(_files(spark, d)).select(*op.CHUNK, "codec", "payload_size", "path", "flags")


@query(_SIZES + f" SELECT {_CHUNK}, 2::BIGINT AS section, codec, 0 AS entry_flags, payload AS n FROM size")
def q_file_payloads(spark, d):
    return files.payloads(_files(spark, d)).select(*op.CHUNK, "section", "codec", "entry_flags", F.octet_length("bytes").cast("bigint").alias("n"))


@query(_SIZES + " SELECT 2::BIGINT AS section, count(*) AS n, CAST(sum(payload) AS BIGINT) AS bytes FROM size")
def q_file_sections(spark, d):
    return files.payload_sections(_files(spark, d))


@query(_AT + f" SELECT DISTINCT {_NAME} AS path, true AS sound FROM v")
def q_file_integrity(spark, d):
    return files.integrity(_files(spark, d))


@query(_SIZES + f", f AS (SELECT {_NAME} AS path, count(*) AS k, sum(payload) AS bytes FROM size GROUP BY 1) SELECT path, 88 AS header, 16 * k AS chunk_map, 56 * k AS summaries, 40 AS directory, 16 * k AS entries, CAST(bytes AS BIGINT) AS payloads FROM f")
def q_file_anatomy(spark, d):
    return files.anatomy(_files(spark, d)).drop("gaps")


@query(_AT + f" SELECT {_NAME} AS path, 88 + 40 + 88 * count(*) AS resident FROM (SELECT DISTINCT {_CHUNK} FROM v) GROUP BY rx, ry, rz")
def q_file_resident(spark, d):
    return files.resident(_files(spark, d))


@query(_AT + f" SELECT DISTINCT {_NAME} AS path, 0::BIGINT AS reclaimed FROM v")
def q_file_compact(spark, d):
    return files.compacted(_files(spark, d)).select("path", "reclaimed")
