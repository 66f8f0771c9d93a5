"""Worlds as directories: a Spark data source that reads their tables, and a writer that publishes the manifest last.

``spark.dataSource.register(WorldSource)``, then ``spark.read.format("voxel_world").option("path", ...).option("table", ...)``.
Tables: chunks (from the tables before any payload, which stays unread), payloads, voxels, regions, registry, textures,
metadata. A path is a world's directory or manifest, a region file, or a directory of region files. Files are opened through
Arrow's file systems, at random, one task a region file. With the option ``pushdown``, which needs Spark's setting
``spark.sql.python.filterPushdown.enabled``, filters on region coordinates leave out whole files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..formats import manifest as mf, region
from ..formats.bytes_hash import fnv1a64
from ..functions.address import Geometry
from ..operators import files

SCHEMAS = {
    "chunks": files.CHUNKS, "payloads": files.PAYLOADS, "voxels": files.VOXELS, "regions": "path string, rx bigint, ry bigint, rz bigint, n_chunks bigint, manifest_hash string, registry_hash string, resident bigint",
    "registry": "ordinal int, key bigint, material_id bigint, flags int, name string, name_hash string, rgba bigint", "textures": "ordinal int, id string, path string, content_hash string", "metadata": "scope string, key string, value binary",
}
#: What a reader option may skip or forgive.
SUFFIX, TEXTURE_SUFFIX, MANIFEST = ".bvx", ".btx", "manifest.toml"


class WorldError(ValueError):
    """A world whose files are not what its manifest says."""


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str) -> bytes:
    where, at = _opened(path)
    with where.open_input_stream(at) as f:
        return f.read()


def _reader(path: str) -> region.Reader:
    where, at = _opened(path)
    f = where.open_input_file(at)

    def read(offset: int, size: int) -> bytes:
        return f.read_at(size, offset)

    return region.Reader(read, f.size())


def listed(path: str, suffix: str) -> list[str]:
    """Files of a directory with a suffix, by name; none if there is no such directory."""
    where, at = _opened(path)
    found = where.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return [f"{path.rstrip('/')}/{i.base_name}" for i in sorted(found, key=lambda i: i.path) if i.is_file and i.base_name.endswith(suffix)]


def load_manifest(path: str) -> tuple[mf.Manifest | None, str]:
    """The manifest of a world's directory or of the file itself, and the directory; None where there is none."""
    where, at = _opened(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.Directory:
        path = f"{path.rstrip('/')}/{MANIFEST}"
        info = where.get_file_info(f"{at.rstrip('/')}/{MANIFEST}")
    if info.type != fs.FileType.File or not path.endswith(".toml"):
        return None, path.rsplit("/", 1)[0]
    return mf.parse(_read(path)), path.rsplit("/", 1)[0]


@dataclass
class _File(InputPartition):
    path: str
    coord: tuple[int, int, int] | None = None


class _WorldReader(DataSourceReader):
    def __init__(self, options: dict):
        # Spark gives the names of options in lower case.
        self.path, self.table = options["path"].rstrip("/"), options.get("table", "chunks")
        self.forgiving = options.get("ignorehashmismatch", "false").lower() == "true"
        self.coord: dict[str, int] = {}
        self.manifest, self.root = load_manifest(self.path)
        self.geometry = self.manifest.geometry if self.manifest else Geometry(*(tuple(map(int, options[k].split(","))) for k in ("chunksize", "regionsize"))) if "chunksize" in options else None

    def _files(self) -> list[_File]:
        m = self.manifest
        if m is None:
            return [_File(self.path)] if self.path.endswith(SUFFIX) else [_File(p) for p in listed(self.path, SUFFIX)]
        folder = f"{self.root}/{m.regions_dir}"
        if not m.regions:
            return [_File(p) for p in listed(folder, SUFFIX)]
        return [_File(f"{folder}/{r['path']}", r["coord"]) for r in m.regions]

    def partitions(self) -> Sequence[InputPartition]:
        if self.table in ("registry", "textures"):
            return [InputPartition(0)]
        found = self._files()
        if self.table == "metadata" and self.manifest is not None:
            found = [_File(""), *found]
        return [f for f in found if f.coord is None or all(f.coord["xyz".index(k[1])] == v for k, v in self.coord.items())]

    def _checked(self, part: _File) -> region.Reader:
        r, m = _reader(part.path), self.manifest
        if part.coord is not None and tuple(part.coord) != r.coord:
            raise WorldError(f"{part.path} is region {r.coord}, not {tuple(part.coord)}")
        if m is not None and not self.forgiving:
            # A hash of zero was never stamped, and fits.
            for name, own in (("manifest_hash", m.hash), ("registry_hash", m.registry_hash)):
                stamped = int(r.header[name])
                if stamped and own and stamped != own:
                    raise WorldError(f"{part.path} belongs to another world: its {name} is {stamped:x}, not {own:x}")
        return r

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        m = self.manifest
        if partition is None:  # no file is left
            return
        if self.table == "registry":
            for i, e in enumerate(m.registry if m else []):
                yield (i, e.key, e.material_id, e.flags, e.name or None, f"{e.name_hash:016x}", e.rgba)
        elif self.table == "textures":
            for i, t in enumerate(m.textures if m else []):
                yield (i, t["id"], t["path"], f"{t['content_hash']:016x}")
        elif self.table == "metadata" and not partition.path:
            yield from (("world", k, v) for k, v in sorted(m.metadata.items()))
        else:
            r = self._checked(partition)
            if self.table == "metadata":
                yield from ((files.region_name(r.coord), k, v) for k, v in sorted(r.metadata.items()))
            elif self.table == "regions":
                yield (partition.path, *r.coord, len(r.chunks), f"{int(r.header['manifest_hash']):016x}", f"{int(r.header['registry_hash']):016x}", r.resident())
            else:
                if self.table == "voxels" and self.geometry is None:
                    raise WorldError("voxels of region files without a manifest need the options chunkSize and regionSize")
                frames = [files.chunk_rows(r, partition.path)] if self.table == "chunks" else files.payload_rows(r, partition.path) if self.table == "payloads" else files.voxel_rows(r, self.geometry)
                for f in frames:
                    if len(f):
                        yield pa.RecordBatch.from_pandas(f, schema=_arrow(self.table), preserve_index=False)


def _arrow(table: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in SCHEMAS[table].split(", "))])


class _PushingReader(_WorldReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in ("rx", "ry", "rz") and len(f.attribute) == 1:
                self.coord[f.attribute[0]] = f.value
            yield f  # rows are checked again


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _FileWriter(DataSourceWriter):
    """Rows (path, content) to files: under names of this job first, under their own when all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        where, at = _opened(self.path)
        where.create_dir(at, recursive=True)
        names = []
        for row in iterator:
            temporary = f"{at}/.{self.job}-{uuid.uuid4().hex}"
            with where.open_output_stream(temporary) as f:
                f.write(bytes(row["content"]))
            names.append((temporary, f"{at}/{row['path']}"))
        return _Written(names)

    def commit(self, messages) -> None:
        where, _ = _opened(self.path)
        for m in messages:
            for temporary, name in m.names if m else ():
                where.move(temporary, name)

    def abort(self, messages) -> None:
        where, _ = _opened(self.path)
        for m in messages:
            for temporary, _ in m.names if m else ():
                where.delete_file(temporary)


class WorldSource(DataSource):
    """Reads a world's tables; writes rows (path, content) as files of a directory."""

    @classmethod
    def name(cls) -> str:
        return "voxel_world"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "chunks")]

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (_PushingReader if options.get("pushdown", "false").lower() == "true" else _WorldReader)(options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(dict(self.options))


def read_table(spark, path: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(WorldSource)
    return spark.read.format("voxel_world").option("path", path).option("table", table).options(**options).load()


def save_world(path: str, m: mf.Manifest, v: DataFrame, registry: DataFrame, only: DataFrame | None = None, prune: bool = False, dry_run: bool = False, keep_backup: bool = False) -> dict[str, int]:
    """Write a world: region files by the executors, then the manifest, which names them and whose hash they carry.

    ``only`` (rx, ry, rz): the regions that changed; the others' files stay, unless the manifest's text has changed, for then
    all files carry another hash and are written. ``prune``: delete region files that the world no longer has.
    ``keep_backup``: keep the manifest before as ``manifest.toml.bak``. Returns how many files were or, on a dry run, would
    be written and deleted, and whether all had to be.
    """
    spark = v.sparkSession
    spark.dataSource.register(WorldSource)
    named = files.located(v, m.geometry).select("rx", "ry", "rz").distinct().orderBy("rx", "ry", "rz").collect()
    m.regions = [{"path": files.region_name(r), "coord": tuple(map(int, r))} for r in named]
    m.registry_hash = mf.registry_hash(m.registry)
    text = mf.emit(m).encode()
    m.hash = fnv1a64(text)
    where, at = _opened(path)
    old = where.get_file_info(f"{at}/{MANIFEST}").is_file
    before = _read(f"{path}/{MANIFEST}") if old else None
    full = only is None or before != text
    chosen = v if full else files.located(v, m.geometry).join(only, ["rx", "ry", "rz"], "left_semi").select("x", "y", "z", "key")
    folder = f"{path}/{m.regions_dir}"
    gone = [p for p in listed(folder, SUFFIX) if p.rsplit("/", 1)[-1] not in {r["path"] for r in m.regions}] if prune else []
    count = len(m.regions) if full else files.located(chosen, m.geometry).select("rx", "ry", "rz").distinct().count()
    report = {"files_written": count, "files_deleted": len(gone), "full": int(full)}
    if dry_run:
        return report
    made = files.encoded(chosen, registry, m.geometry, manifest_hash=m.hash, registry_hash=m.registry_hash)
    made.select("path", "content").write.format("voxel_world").option("path", folder).mode("append").save()
    if keep_backup and before is not None:
        with where.open_output_stream(f"{at}/{MANIFEST}.bak") as f:
            f.write(before)
    with where.open_output_stream(f"{at}/.{MANIFEST}") as f:
        f.write(text)
    where.move(f"{at}/.{MANIFEST}", f"{at}/{MANIFEST}")
    for p in gone:
        where.delete_file(_opened(p)[1])
    return report


def manifest_of(geometry: Geometry, registry: DataFrame, **more) -> mf.Manifest:
    """A manifest with the entries of a registry table (ordinal, key, material_id, flags, rgba, and name if there is one)."""
    rows = registry.orderBy("ordinal").collect()
    names = "name" in registry.columns
    entries = []
    for r in rows:
        name = (r["name"] or "") if names else ""
        entries.append(mf.Entry(int(r["key"]), int(r["material_id"]), int(r["flags"]), name, fnv1a64(name.encode()) if name else 0, int(r["rgba"] or 0)))
    return mf.Manifest(geometry, registry=entries, **more)


def standalone(v: DataFrame, registry: DataFrame, m: mf.Manifest) -> DataFrame:
    """(path, content): the file of a world of exactly one region, which describes its world itself."""
    from ..formats import world

    described = world.description(m)
    made = files.encoded(v, registry, m.geometry)
    one = F.when(F.col("n") != 1, F.raise_error(F.lit("a world that stands alone has one region"))).otherwise(F.col("path"))

    def embed(batches):
        for b in batches:
            out = b[["path"]].copy()
            out["content"] = [world.embedded(bytes(c), described, m.metadata) for c in b["content"]]
            yield out

    counted = made.join(F.broadcast(made.agg(F.count("*").alias("n"))))
    return counted.select(one.alias("path"), "content").mapInPandas(embed, "path string, content binary")


def converted_scene(files_: DataFrame, edge: int = 16, hidden: bool = False) -> DataFrame:
    """(path, content): the world that stands alone of one ``.vox`` file (path, content), in chunks of ``edge`` cells.

    Its one region is the scene's box, which begins at zero; its registry has the colours in use, opaque. ``hidden``:
    convert what the scene hides too. A scene without a voxel is refused.
    """
    from ..operators import mesh

    instances, models, voxels = files.scenes(files_)
    v = mesh.scene(instances.withColumn("hidden", F.lit(False)) if hidden else instances, models, voxels)
    top = v.agg(*(F.max(c) for c in "xyz")).first()
    if top[0] is None:
        raise WorldError("a scene without a voxel")
    used = v.select("key").distinct().join(files.palettes(files_), "key").orderBy("key").collect()
    g = Geometry((edge,) * 3, tuple(int(t) // edge + 1 for t in top))
    m = mf.Manifest(g, registry=[mf.Entry(int(r["key"]), 0, 1, "", 0, int(r["rgba"])) for r in used])
    registry = v.sparkSession.createDataFrame([(i, e.key, e.flags) for i, e in enumerate(m.registry)], "ordinal int, key bigint, flags int")
    return standalone(v, registry, m)
