"""Region files as rows of bytes: encoding voxels, reading descriptions, payloads and voxels, checking hashes.

Files are rows (path, content), as ``spark.read.format("binaryFile")`` gives them from any store that Spark reads. A region
is what one task encodes: its size is bounded by the world's geometry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..formats import cells, payload, region
from ..functions.address import Geometry
from .voxel import CELL, REGION, first_rows, located

REGION_FILE = "rx bigint, ry bigint, rz bigint, path string, content binary"
_SUMMARY = ["non_air", "opaque", "emissive", "special", *(f"{e}_{a}" for e in ("min", "max") for a in "xyz"), *(f"face_{s}{a}" for a in "xyz" for s in "pn"), *(f"top_key_{i}" for i in range(4)), *(f"top_count_{i}" for i in range(4))]
CHUNKS = "path string, rx bigint, ry bigint, rz bigint, ordinal bigint, cx bigint, cy bigint, cz bigint, flags int, " + ", ".join(f"{c} bigint" for c in _SUMMARY) + ", macro_lo bigint, macro_hi bigint, codec int, payload_size bigint"
PAYLOADS = "path string, rx bigint, ry bigint, rz bigint, cx bigint, cy bigint, cz bigint, section bigint, codec int, entry_flags int, bytes binary"
VOXELS = "x bigint, y bigint, z bigint, key bigint"


def opened(data: bytes) -> region.Reader:
    return region.Reader(lambda at, n: data[at:at + n], len(data))


def chunk_rows(r: region.Reader, path: str) -> pd.DataFrame:
    """A row for each chunk, from the tables before any payload."""
    s, c = r.summaries[r.chunks["summary"]] if len(r.chunks) else r.summaries, r.chunks
    out = pd.DataFrame({"path": path, "rx": r.coord[0], "ry": r.coord[1], "rz": r.coord[2], "ordinal": np.arange(len(c)), **{n: c[n].astype(np.int64) for n in ("cx", "cy", "cz")}, "flags": c["flags"].astype(np.int32)}, index=range(len(c)))
    for n in _SUMMARY:
        out[n] = s[n].astype(np.int64)
    out["macro_lo"], out["macro_hi"] = (s["macro"] & np.uint64(0xFFFFFFFF)).astype(np.int64), (s["macro"] >> np.uint64(32)).astype(np.int64)
    codec, size = np.zeros(len(c), np.int32), np.zeros(len(c), np.int64)
    for d, e in zip(r.directory, r.entries, strict=True):
        if int(d["type"]) == region.VOXELS and len(e) == len(c):
            there = e["offset"] != np.uint64(region.NOWHERE)
            codec, size = np.where(there, e["codec"], 0).astype(np.int32), np.where(there, e["size"], 0).astype(np.int64)
    return out.assign(codec=codec, payload_size=size)


def payload_rows(r: region.Reader, path: str) -> Iterator[pd.DataFrame]:
    """A row for each payload of each chunk, one section at a time; sections of unknown types too, as they are."""
    for k, d in enumerate(r.directory):
        if int(d["type"]) in (region.WORLD_DESC, region.METADATA) or not r.by_chunk(k):
            continue
        rows = [(path, *r.coord, int(c["cx"]), int(c["cy"]), int(c["cz"]), int(d["type"]), int(e["codec"]), int(e["flags"]), data) for i, (c, e) in enumerate(zip(r.chunks, r.entries[k], strict=False)) if (data := r.payload(k, i)) is not None]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAYLOADS.split(", ")])


def voxel_rows(r: region.Reader, g: Geometry) -> Iterator[pd.DataFrame]:
    for rows in cells.cells_of(r, g):
        yield pd.DataFrame(rows, columns=["x", "y", "z", "key"])


def region_name(coord) -> str:
    return "r_{}_{}_{}.bvx".format(*coord)


def encoded(v: DataFrame, registry: DataFrame, g: Geometry, codec: int = payload.AUTO, manifest_hash: int = 0, registry_hash: int = 0) -> DataFrame:
    """(rx, ry, rz, path, content): the file of each region that holds a voxel of ``v``.

    The registry, which a world holds once, goes to every task as a dict of flags; the first of equal keys counts.
    """
    flags = {int(r["key"]): int(r["flags"]) for r in first_rows(registry.select("ordinal", "key", "flags"), "key").collect()}

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = cells.build(key, pdf[[*CELL, "key"]].to_numpy(np.int64), g, flags, codec, manifest_hash, registry_hash)
        return pd.DataFrame([(*map(int, key), region_name(key), region.to_bytes(made))], columns=["rx", "ry", "rz", "path", "content"])

    return located(v, g).select(*REGION, *CELL, "key").groupBy(*REGION).applyInPandas(build, REGION_FILE)


def _each(files: DataFrame, rows, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield from rows(opened(bytes(content)), path)

    return files.select("path", "content").mapInPandas(run, schema)


def chunks(files: DataFrame) -> DataFrame:
    """Chunks and summaries of region files."""
    return _each(files, lambda r, path: [chunk_rows(r, path)], CHUNKS)


def payloads(files: DataFrame) -> DataFrame:
    return _each(files, payload_rows, PAYLOADS)


def voxels(files: DataFrame, g: Geometry) -> DataFrame:
    """The voxels of region files, decoded."""
    return _each(files, lambda r, path: voxel_rows(r, g), VOXELS)


def integrity(files: DataFrame) -> DataFrame:
    """(path, sound): whether each file hashes to what its header says."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "sound": [region.sound(bytes(c)) for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, sound boolean")


def anatomy(files: DataFrame) -> DataFrame:
    """(path, header, chunk_map, summaries, directory, entries, payloads, gaps): where each file's bytes are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                r = opened(bytes(content))
                parts = (region.HEADER.itemsize, r.chunks.nbytes, r.summaries.nbytes, r.directory.nbytes, sum(e.nbytes for e in r.entries), int(r.directory["blob_size"].sum()))
                rows.append((path, *parts, len(content) - sum(parts)))
            yield pd.DataFrame(rows, columns=["path", "header", "chunk_map", "summaries", "directory", "entries", "payloads", "gaps"])

    return files.select("path", "content").mapInPandas(run, "path string, header bigint, chunk_map bigint, summaries bigint, directory bigint, entries bigint, payloads bigint, gaps bigint")


def compacted(files: DataFrame) -> DataFrame:
    """(path, content, reclaimed): files without dead bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                r = region.of_bytes(bytes(content))
                gone = region.compact(r)
                rows.append((path, region.to_bytes(r), gone))
            yield pd.DataFrame(rows, columns=["path", "content", "reclaimed"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, reclaimed bigint")


def resident(files: DataFrame) -> DataFrame:
    """(path, resident): bytes of each file that are held without any payload."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "resident": [opened(bytes(c)).resident() for c in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, resident bigint")


def payload_sections(files: DataFrame) -> DataFrame:
    """(section, n, bytes): how many payloads of each section there are."""
    return payloads(files).groupBy("section").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("bytes"))


def scenes(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, their voxels and instances of ``.vox`` files (path, content), as ``mesh.placed`` takes them.

    A file's models are numbered across files by a hash of the path, so that many files can be placed together.
    """
    from ..formats import scene

    def read(batches, rows):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield rows(path, scene.parse(bytes(content)))

    def models(batches):
        yield from read(batches, lambda p, s: pd.DataFrame([(f"{p}#{i}", *size) for i, (size, _) in enumerate(s.models)], columns=["model", "sx", "sy", "sz"]))

    def voxel_rows_(batches):
        def rows(p, s):
            parts = [pd.DataFrame(v.astype(np.int64), columns=["vx", "vy", "vz", "colour"]).assign(model=f"{p}#{i}")[["model", "vx", "vy", "vz", "colour"]] for i, (_, v) in enumerate(s.models)]
            return pd.concat(parts) if parts else pd.DataFrame(columns=["model", "vx", "vy", "vz", "colour"])

        yield from read(batches, rows)

    def instances(batches):
        def rows(p, s):
            out = []
            for i, n in enumerate(s.instances):
                columns = np.abs(n.rotation).argmax(1)
                out.append((i, f"{p}#{n.model}", *map(int, columns), *(int(n.rotation[k, c]) for k, c in enumerate(columns)), *map(int, n.translation), n.name, n.hidden))
            return pd.DataFrame(out, columns=["ordinal", "model", "r0", "r1", "r2", "s0", "s1", "s2", "tx", "ty", "tz", "name", "hidden"])

        yield from read(batches, rows)

    f = files.select("path", "content")
    return (f.mapInPandas(instances, "ordinal bigint, model string, r0 int, r1 int, r2 int, s0 int, s1 int, s2 int, tx bigint, ty bigint, tz bigint, name string, hidden boolean"),
            f.mapInPandas(models, "model string, sx bigint, sy bigint, sz bigint"),
            f.mapInPandas(voxel_rows_, "model string, vx bigint, vy bigint, vz bigint, colour bigint"))


def texture_tables(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Textures, subresources, materials and blob sizes of texture archives (path, content), as ``textures`` takes them."""
    from ..formats import texture

    def table(name: str, columns: dict[str, str], schema: str) -> DataFrame:
        def run(batches):
            for b in batches:
                for path, content in zip(b["path"], b["content"], strict=True):
                    a = texture.of_bytes(bytes(content))
                    rows = getattr(a, name) if name != "blob" else np.array([(len(a.blob),)], [("blob_bytes", "<i8")])
                    yield pd.DataFrame({"archive": path, **{new: rows[old].astype(np.int64) for old, new in columns.items()}}, index=range(len(rows)))

        return files.select("path", "content").mapInPandas(run, f"archive string, {schema}")

    def same(*names: str, **more: str) -> tuple[dict[str, str], str]:
        columns = {n: n for n in names} | more
        return columns, ", ".join(f"{n} bigint" for n in columns.values())

    return (table("textures", *same("kind", "format", "width", "height", "mips", "layers", "first", "count", id="texture")),
            table("subresources", *same("texture", "mip", "layer", "extent_x", "extent_y", "extent_z", "blob_offset", "blob_size")),
            table("materials", *same("albedo", "normal", "orm", "emissive", "tint", id="material_id")),
            table("blob", *same("blob_bytes")))


def palettes(files: DataFrame) -> DataFrame:
    """(path, key, rgba) of ``.vox`` files: colour 1 is the palette's first entry; 0 would be no colour, so 1 stands for it."""
    from ..formats import scene

    def read(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                p = scene.parse(bytes(content)).palette.astype(np.int64)
                rgba = p[:, 0] << 24 | p[:, 1] << 16 | p[:, 2] << 8 | p[:, 3]
                yield pd.DataFrame({"path": path, "key": np.arange(1, 256), "rgba": np.maximum(rgba[:255], 1)})

    return files.select("path", "content").mapInPandas(read, "path string, key bigint, rgba bigint")
