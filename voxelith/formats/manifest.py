"""The manifest of a world: TOML in and out, and hashes that couple it to its files."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

import numpy as np

from ..functions.address import CONVENTION_NAMES, Geometry
from ..functions.scalar import FLAGS
from .bytes_hash import fnv1a64

# Names of the conventions in manifests, and layout of a registry entry.
AXES = {0: "x_right_y_up_z_forward", 1: "x_right_z_up_y_forward", 2: "x_right_y_up_z_back"}
SCHEMA = "dense_u32_voxel_key"
ENTRY = np.dtype([("key", "<u4"), ("material_id", "<u4"), ("reserved", "<u4"), ("flags", "<u4"), ("name_hash", "<u8")])


class ManifestError(ValueError):
    """A manifest that lacks something or holds what no world may have."""


@dataclass
class Entry:
    key: int
    material_id: int = 0
    flags: int = 0
    name: str = ""
    name_hash: int = 0
    rgba: int = 0


@dataclass
class Manifest:
    geometry: Geometry
    name: str = ""
    uuid: str = ""
    convention: int = 0
    bounds: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None
    size: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    regions_dir: str = "regions"
    textures_dir: str = "textures"
    registry: list[Entry] = field(default_factory=list)
    textures: list[dict] = field(default_factory=list)  # id, path, content_hash
    regions: list[dict] = field(default_factory=list)  # path, coord or None
    metadata: dict[str, bytes] = field(default_factory=dict)
    registry_hash: int = 0
    hash: int = 0


def number(value, fallback: int = 0) -> int:
    """An unsigned 64-bit number from a TOML integer or hex digits; anything else is the fallback."""
    if isinstance(value, int) and not isinstance(value, bool):
        return value & ((1 << 64) - 1)
    if isinstance(value, str) and re.fullmatch(r"(0[xX])?[0-9A-Fa-f]{1,16}", value):
        return int(re.sub("^0[xX]", "", value), 16)
    return fallback


def registry_hash(entries: list[Entry]) -> int:
    return fnv1a64(np.array([(e.key, e.material_id, 0, e.flags, e.name_hash) for e in entries], ENTRY).tobytes())


def _three(value, what: str, kind=int) -> tuple:
    if not isinstance(value, list) or len(value) != 3 or not all(isinstance(v, (int, float) if kind is float else int) for v in value):
        raise ManifestError(f"{what} must be three numbers")
    return tuple(map(kind, value))


def _entry(row: dict) -> Entry:
    if not isinstance(row.get("voxel_key"), int):
        raise ManifestError("a registry entry needs a voxel_key")
    strange = [f for f in row.get("flags", []) if f not in FLAGS]
    if strange:
        raise ManifestError(f"unknown registry flag {strange[0]!r}")
    name = row.get("name", "")
    hashed = fnv1a64(name.encode()) if "name" in row else number(row.get("name_hash"))
    return Entry(row["voxel_key"], number(row.get("material_id")) & 0xFFFFFFFF, sum(FLAGS[f] for f in set(row.get("flags", []))), name, hashed, number(row.get("color")) & 0xFFFFFFFF)


def _bytes(key: str, value) -> bytes:
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, dict) and isinstance(value.get("hex"), str) and re.fullmatch("([0-9A-Fa-f]{2})*", value["hex"]):
        return bytes.fromhex(value["hex"])
    raise ManifestError(f"metadata {key!r} must be text or hex")


def parse(data: bytes) -> Manifest:
    """The manifest of raw bytes; its hash is that of the bytes, whatever they say."""
    t = tomllib.loads(data.decode())
    g = t.get("geometry")
    if not g:
        raise ManifestError("a manifest needs [geometry]")
    m = Manifest(Geometry(_three(g.get("chunk_size"), "chunk_size"), _three(g.get("region_size"), "region_size")))
    if g.get("voxel_schema", SCHEMA) != SCHEMA:
        raise ManifestError(f"unknown voxel schema {g['voxel_schema']!r}")
    known = {n: k for k, n in AXES.items()} | CONVENTION_NAMES
    if "axis_convention" in g:
        if g["axis_convention"] not in known:
            raise ManifestError(f"unknown axis convention {g['axis_convention']!r}")
        m.convention = known[g["axis_convention"]]
    about = t.get("world", {})
    m.name, m.uuid = t.get("name", about.get("name", "")), t.get("uuid", about.get("uuid", ""))
    b = t.get("bounds", {})
    if b.get("mode", "unbounded") == "explicit":
        m.bounds = _three(b.get("min_region"), "min_region"), _three(b.get("max_region"), "max_region")
    elif b.get("mode", "unbounded") != "unbounded":
        raise ManifestError("bounds are explicit or unbounded")
    paths = t.get("paths", {}) | {k: t[k] for k in ("regions_dir", "textures_dir") if k in t}
    m.regions_dir, m.textures_dir = paths.get("regions_dir", m.regions_dir), paths.get("textures_dir", m.textures_dir)
    u = t.get("units", {})
    if "voxel_size" in u:
        m.size = (float(u["voxel_size"]),) * 3 if isinstance(u["voxel_size"], (int, float)) else _three(u["voxel_size"], "voxel_size", float)
    if "origin" in u:
        m.origin = _three(u["origin"], "origin", float)
    m.metadata = {k: _bytes(k, v) for k, v in t.get("metadata", {}).items()}
    m.registry = [_entry(e) for e in t.get("registry", [])]
    m.registry_hash = number(t.get("hashes", {}).get("registry")) or registry_hash(m.registry)
    for x in t.get("textures", []):
        if not isinstance(x.get("path"), str):
            raise ManifestError("a texture needs a path")
        stem = x["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
        m.textures.append({"id": x.get("id") or stem, "path": x["path"], "content_hash": number(x.get("content_hash"))})
    for x in t.get("regions", []):
        if not isinstance(x.get("path"), str):
            raise ManifestError("a region needs a path")
        m.regions.append({"path": x["path"], "coord": _three(x["coord"], "coord") if "coord" in x else None})
    m.hash = fnv1a64(data)
    return m


def printable(data: bytes) -> bool:
    try:
        return not re.search("[\x00-\x1f\x7f]", data.decode())
    except UnicodeDecodeError:
        return False


def _text(value) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace('"', '\\"')
        return '"' + re.sub("[\x00-\x1f\x7f]", lambda c: f"\\u{ord(c[0]):04X}", escaped) + '"'
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_text, value)) + "]"
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{_text(k)} = {_text(v)}" for k, v in value.items()) + " }"
    return repr(value)


def _hex(n: int) -> str:
    return f"0x{n:X}"


def emit(m: Manifest) -> str:
    """The manifest as text, the same for the same world. ``parse`` gives the world back."""
    lines = ["format_version = 1", *(f"{k} = {_text(v)}" for k, v in (("name", m.name), ("uuid", m.uuid)) if v)]

    def table(head: str, values: dict) -> None:
        lines.extend(["", head, *(f"{k if re.fullmatch('[A-Za-z0-9_-]+', k) else _text(k)} = {_text(v)}" for k, v in values.items())])

    table("[geometry]", {"chunk_size": m.geometry.chunk, "region_size": m.geometry.region, "voxel_schema": SCHEMA, "axis_convention": AXES[m.convention]})
    table("[bounds]", {"mode": "explicit", "min_region": m.bounds[0], "max_region": m.bounds[1]} if m.bounds else {"mode": "unbounded"})
    table("[paths]", {"regions_dir": m.regions_dir, "textures_dir": m.textures_dir})
    table("[hashes]", {"registry": _hex(registry_hash(m.registry))})
    if (m.size, m.origin) != ((1.0,) * 3, (0.0,) * 3):
        table("[units]", {"voxel_size": m.size[0] if len(set(m.size)) == 1 else m.size, "origin": m.origin})
    if m.metadata:
        table("[metadata]", {k: v.decode() if printable(v) else {"hex": v.hex()} for k, v in sorted(m.metadata.items())})
    for e in m.registry:
        row = {"voxel_key": e.key, "material_id": e.material_id, "flags": [n for n, b in FLAGS.items() if e.flags & b]}
        table("[[registry]]", row | ({"name": e.name} if e.name else {}) | {"name_hash": _hex(e.name_hash)} | ({"color": _hex(e.rgba)} if e.rgba else {}))
    for x in m.textures:
        table("[[textures]]", {"id": x["id"], "path": x["path"]} | ({"content_hash": _hex(x["content_hash"])} if x.get("content_hash") else {}))
    for x in m.regions:
        table("[[regions]]", {"path": x["path"]} | ({"coord": x["coord"]} if x.get("coord") else {}))
    return "\n".join(lines) + "\n"
