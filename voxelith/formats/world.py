"""The description of a world that a region file carries when it stands alone."""

from __future__ import annotations

import numpy as np

from ..functions.address import Geometry
from . import region
from .manifest import ENTRY, Entry, Manifest, registry_hash

# Layouts of the description, its version and schema.
VERSION, SCHEMA = 2, 1
HEAD = np.dtype([("version", "<u2"), ("chunk", "<u2", 3), ("region", "<u2", 3), ("schema", "<u2"), ("convention", "<u2"), ("bounded", "<u2"), ("reserved", "<u2", 2), ("low", "<i4", 3), ("high", "<i4", 3), ("textures", "<u4"), ("entries", "<u4"), ("name_hash", "<u8"), ("registry_hash", "<u8"), ("manifest_hash", "<u8")])
MORE = np.dtype([("size", "<u4"), ("names", "<u4"), ("voxel", "<f8", 3), ("origin", "<f8", 3), ("strings", "<u4"), ("colours", "<u4")])
TEXTURE = np.dtype([("path", "S128"), ("path_hash", "<u8"), ("content_hash", "<u8")])
#: Longest path of a texture.
PATH = 127


def description(m: Manifest) -> bytes:
    from .bytes_hash import fnv1a64

    head = np.zeros(1, HEAD)
    low, high = m.bounds or ((0, 0, 0), (0, 0, 0))
    for k, v in (("version", VERSION), ("chunk", m.geometry.chunk), ("region", m.geometry.region), ("schema", SCHEMA), ("convention", m.convention), ("bounded", int(m.bounds is not None)), ("low", low), ("high", high), ("textures", len(m.textures)), ("entries", len(m.registry)), ("name_hash", fnv1a64(m.name.encode()) if m.name else 0), ("registry_hash", registry_hash(m.registry)), ("manifest_hash", 0)):
        head[k] = v
    refs = np.zeros(len(m.textures), TEXTURE)
    for r, t in zip(refs, m.textures, strict=True):
        path = f"{m.textures_dir}/{t['path']}".encode()
        if len(path) > PATH:
            raise ValueError(f"the path of texture {t['id']} is longer than {PATH} bytes")
        r["path"], r["path_hash"], r["content_hash"] = path, fnv1a64(t["path"].encode()), t.get("content_hash", 0)
    entries = np.array([(e.key, e.material_id, 0, e.flags, e.name_hash) for e in m.registry], ENTRY)
    strings, offsets = bytearray(1), []  # offset 0 is no name
    for e in m.registry:
        offsets.append(len(strings) if e.name else 0)
        if e.name:
            strings += e.name.encode() + b"\0"
    more = np.zeros(1, MORE)
    for k, v in (("size", MORE.itemsize), ("names", len(offsets)), ("voxel", m.size), ("origin", m.origin), ("strings", len(strings)), ("colours", len(m.registry))):
        more[k] = v
    colours = np.array([e.rgba for e in m.registry], "<u4")
    return head.tobytes() + refs.tobytes() + entries.tobytes() + more.tobytes() + np.array(offsets, "<u4").tobytes() + colours.tobytes() + bytes(strings)


def described(blob: bytes) -> Manifest:
    """The world of a description; of a longer, newer one what is known."""
    h = np.frombuffer(blob, HEAD, 1)[0]
    m = Manifest(Geometry(tuple(map(int, h["chunk"])), tuple(map(int, h["region"]))), convention=int(h["convention"]), registry_hash=int(h["registry_hash"]))
    if int(h["bounded"]):
        m.bounds = tuple(map(int, h["low"])), tuple(map(int, h["high"]))
    at = HEAD.itemsize
    if at + int(h["textures"]) * TEXTURE.itemsize + int(h["entries"]) * ENTRY.itemsize > len(blob):
        raise region.RegionError("a description of a world is cut off")
    for t in np.frombuffer(blob, TEXTURE, int(h["textures"]), at):
        path = t["path"].decode(errors="replace")
        m.textures.append({"id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": path, "content_hash": int(t["content_hash"])})
    at += int(h["textures"]) * TEXTURE.itemsize
    m.registry = [Entry(int(e["key"]), int(e["material_id"]), int(e["flags"]), "", int(e["name_hash"])) for e in np.frombuffer(blob, ENTRY, int(h["entries"]), at)]
    at += int(h["entries"]) * ENTRY.itemsize
    if int(h["version"]) < 2 or at + MORE.itemsize > len(blob):
        return m
    size = int(np.frombuffer(blob, "<u4", 1, at)[0])
    if size < 8 or at + size > len(blob):
        raise region.RegionError("a description of a world is cut off")
    x = np.frombuffer(blob[at:at + min(size, MORE.itemsize)].ljust(MORE.itemsize, b"\0"), MORE)[0]
    at += size
    m.size, m.origin = tuple(map(float, x["voxel"])), tuple(map(float, x["origin"]))
    if at + 4 * (int(x["names"]) + int(x["colours"])) + int(x["strings"]) > len(blob):
        raise region.RegionError("names of a description are cut off")
    offsets = np.frombuffer(blob, "<u4", int(x["names"]), at)
    at += offsets.nbytes
    colours = np.frombuffer(blob, "<u4", int(x["colours"]), at)
    at += colours.nbytes
    strings = blob[at:at + int(x["strings"])]
    for e, c in zip(m.registry, colours.tolist(), strict=False):
        e.rgba = c
    for e, o in zip(m.registry, offsets.tolist(), strict=False):
        if 0 < o < len(strings):
            e.name = strings[o:].split(b"\0", 1)[0].decode(errors="replace")
    return m


def embedded(file: bytes, blob: bytes, metadata: dict[str, bytes]) -> bytes:
    """A region file that carries its world's description."""
    r = region.of_bytes(file)
    r.world, r.metadata = blob, r.metadata | metadata
    return region.to_bytes(r)
