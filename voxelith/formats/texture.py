"""Texture archives: samplers, textures, subresources and materials, and a blob of texels."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .bytes_hash import fnv1a64
from .region import align

# Layouts and magic number of the file format.
MAGIC, VERSION = 0x5845544C49534142, 1
HEADER = np.dtype([("magic", "<u8"), ("version", "<u2"), ("endian", "u1"), ("flags", "u1"), ("samplers", "<u4"), ("textures", "<u4"), ("subresources", "<u4"), ("materials", "<u4"), ("pad", "<u4"), ("samplers_at", "<u8"), ("textures_at", "<u8"), ("subresources_at", "<u8"), ("materials_at", "<u8"), ("blob_at", "<u8"), ("blob_size", "<u8"), ("blob_hash", "<u8")])
SAMPLER = np.dtype([("id", "<u4"), ("min_filter", "u1"), ("mag_filter", "u1"), ("mip_filter", "u1"), ("u", "u1"), ("v", "u1"), ("w", "u1"), ("anisotropic", "u1"), ("pad", "u1"), ("anisotropy", "<u2"), ("compare", "u1"), ("compare_op", "u1"), ("lod_bias", "<i2"), ("min_lod", "<u2"), ("max_lod", "<u2"), ("border", "u1"), ("reserved", "u1", 5)])
TEXTURE = np.dtype([("id", "<u4"), ("kind", "u1"), ("reserved", "u1", 3), ("format", "<u4"), ("usage", "<u4"), ("width", "<u2"), ("height", "<u2"), ("depth", "<u2"), ("layers", "<u2"), ("mips", "<u2"), ("sampler", "<u2"), ("first", "<u4"), ("count", "<u4"), ("pad", "<u4"), ("name_hash", "<u8"), ("source_hash", "<u8")])
SUBRESOURCE = np.dtype([("texture", "<u4"), ("mip", "<u2"), ("layer", "<u2"), ("extent_x", "<u2"), ("extent_y", "<u2"), ("extent_z", "<u2"), ("row_length", "<u2"), ("image_height", "<u2"), ("pad", "<u2", 3), ("blob_offset", "<u8"), ("blob_size", "<u8"), ("checksum", "<u8")])
SIDES = [f"{s}{a}" for a in "xyz" for s in "pn"]
MATERIAL = np.dtype([("id", "<u4"), ("flags", "<u4"), ("albedo", "<u4"), ("normal", "<u4"), ("orm", "<u4"), ("emissive", "<u4"), *((f"albedo_{s}", "<u2") for s in SIDES), *((f"normal_{s}", "<u2") for s in SIDES), ("tint", "<u4"), ("reserved", "<u4")])
FLAT, RGBA8 = 0, 37
#: Bytes of a block, and its edge in texels, by format.
WHITE = 0xFFFFFFFF


class TextureError(ValueError):
    """A file that is no texture archive, or texels that fit no texture."""


def _none(kind: np.dtype):
    return field(default_factory=lambda: np.zeros(0, kind))


@dataclass
class Archive:
    samplers: np.ndarray = _none(SAMPLER)
    textures: np.ndarray = _none(TEXTURE)
    subresources: np.ndarray = _none(SUBRESOURCE)
    materials: np.ndarray = _none(MATERIAL)
    blob: bytes = b""

    def _add(self, table: str, kind: np.dtype, values: dict) -> int:
        rows = getattr(self, table)
        row = np.zeros(1, kind)
        for k, v in values.items():
            row[k] = v
        if "id" in kind.names:
            row["id"] = len(rows)
        setattr(self, table, np.concatenate([rows, row]))
        return len(rows)

    def add_sampler(self, **values) -> int:
        return self._add("samplers", SAMPLER, {"anisotropy": 100} | values)

    def add_texture(self, **values) -> int:
        return self._add("textures", TEXTURE, {"width": 1, "height": 1, "depth": 1, "layers": 1, "mips": 1} | values)

    def add_material(self, **values) -> int:
        return self._add("materials", MATERIAL, {"tint": WHITE} | values)

    def add_texels(self, texture: int, mip: int, layer: int, width: int, height: int, texels: bytes, row_length: int = 0, image_height: int = 0) -> int:
        """Texels of one level of one layer; rows and images may be padded to a length and a height."""
        from ..operators.textures import FORMATS

        if texture >= len(self.textures):
            raise TextureError(f"no texture {texture}")
        t = self.textures[texture]
        if int(t["kind"]) != FLAT or mip >= int(t["mips"]) or layer >= int(t["layers"]):
            raise TextureError(f"texture {texture} has no level {mip} of layer {layer}")
        if int(t["format"]) not in FORMATS:
            raise TextureError(f"unknown format {int(t['format'])}")
        size, edge = FORMATS[int(t["format"])]
        wide, high = row_length or width, image_height or height
        if len(texels) != -(-wide // edge) * -(-high // edge) * size:
            raise TextureError(f"{len(texels)} bytes of texels for {wide} by {high}")
        at = self._add("subresources", SUBRESOURCE, {"texture": texture, "mip": mip, "layer": layer, "extent_x": width, "extent_y": height, "extent_z": 1, "row_length": row_length, "image_height": image_height, "blob_offset": len(self.blob), "blob_size": len(texels), "checksum": fnv1a64(texels)})
        self.blob += texels
        return at

    def add_mips(self, texture: int) -> None:
        """Make all levels above 0 anew, each by means of two by two texels of the one below."""
        from ..operators.textures import BYTE_FORMATS, FORMATS

        t = self.textures[texture]
        if int(t["kind"]) != FLAT or int(t["format"]) not in BYTE_FORMATS:
            raise TextureError("smaller levels are made of flat textures with byte channels")
        s = self.subresources
        if int(t["mips"]) > 1:
            self.subresources = s[(s["texture"] != texture) | (s["mip"] == 0)]
        channels = FORMATS[int(t["format"])][0]
        for base in self.subresources[self.subresources["texture"] == texture]:
            image = np.frombuffer(self.blob, np.uint8, int(base["blob_size"]), int(base["blob_offset"])).reshape(int(base["extent_y"]), int(base["extent_x"]), channels)
            for mip in range(1, int(t["mips"])):
                image = halved(image)
                self.add_texels(texture, mip, int(base["layer"]), image.shape[1], image.shape[0], image.tobytes())


def halved(image: np.ndarray) -> np.ndarray:
    """Half an image each way: means of two by two, rounded half up; an edge of one texel is its own neighbour."""
    h, w = (max(1, n >> 1) for n in image.shape[:2])
    rows = [np.minimum(2 * np.arange(h) + i, image.shape[0] - 1) for i in (0, 1)]
    cols = [np.minimum(2 * np.arange(w) + i, image.shape[1] - 1) for i in (0, 1)]
    total = sum(image[r][:, c].astype(np.uint16) for r in rows for c in cols)
    return ((total + 2) // 4).astype(np.uint8)


def palette(colours: list[int], edge: int = 1) -> Archive:
    """A layer of one colour and a material with it for each colour (0xRRGGBBAA)."""
    a = Archive()
    if colours:
        a.add_sampler()
        t = a.add_texture(format=RGBA8, width=edge, height=edge, layers=len(colours))
        for i, c in enumerate(colours):
            a.add_texels(t, 0, i, edge, edge, c.to_bytes(4, "big") * (edge * edge))
            a.add_material(albedo=t, tint=c, **{f"albedo_{s}": i for s in SIDES})
    return a


def problems(a: Archive) -> list[str]:
    """What is wrong with an archive's structure."""
    from ..operators.textures import BUFFER, FORMATS, SOLID

    out = []
    for t in a.textures:
        kind, layers = int(t["kind"]), int(t["layers"])
        out += [p for p, bad in (("no width or height", not t["width"] or not t["height"]), ("no mip levels", not t["mips"]), ("no layers", kind == FLAT and not layers), ("a solid has one layer", kind == SOLID and layers != 1), ("unknown format", int(t["format"]) not in FORMATS and kind != BUFFER)) if bad]
    for s in a.subresources:
        if int(s["texture"]) >= len(a.textures):
            out.append("no such texture")
            continue
        t = a.textures[int(s["texture"])]
        out += [p for p, bad in (("mip out of range", s["mip"] >= t["mips"]), ("layer out of range", int(t["kind"]) == FLAT and s["layer"] >= t["layers"]), ("beyond the blob", int(s["blob_offset"]) + int(s["blob_size"]) > len(a.blob)), ("no extent", not (s["extent_x"] and s["extent_y"] and s["extent_z"]))) if bad]
    for m in a.materials:
        out += [f"no such {k} texture" for k in ("albedo", "normal", "orm", "emissive") if int(m[k]) and int(m[k]) >= len(a.textures)]
    return out


def to_bytes(a: Archive) -> bytes:
    """The file: subresources by texture, level and layer, each texture's range of them, parts on boundaries of 16 bytes."""
    if found := problems(a):
        raise TextureError(found[0])
    order = np.lexsort((a.subresources["layer"], a.subresources["mip"], a.subresources["texture"]))
    subresources, textures = a.subresources[order], a.textures.copy()
    textures["count"] = np.bincount(subresources["texture"], minlength=len(textures))
    textures["first"] = np.where(textures["count"] > 0, np.searchsorted(subresources["texture"], np.arange(len(textures))), 0)
    head = np.zeros(1, HEADER)
    head["magic"], head["version"] = MAGIC, VERSION
    end, parts = HEADER.itemsize, []
    for name, data, n in (("samplers", a.samplers.tobytes(), len(a.samplers)), ("textures", textures.tobytes(), len(textures)), ("subresources", subresources.tobytes(), len(subresources)), ("materials", a.materials.tobytes(), len(a.materials)), ("blob", a.blob, None)):
        at = align(end)
        head[f"{name}_at"] = at
        if n is not None:
            head[name] = n
        parts.append((at, data))
        end = at + len(data)
    head["blob_size"], head["blob_hash"] = len(a.blob), fnv1a64(a.blob)
    out = bytearray(end)
    out[:HEADER.itemsize] = head.tobytes()
    for at, data in parts:
        out[at:at + len(data)] = data
    return bytes(out)


def of_bytes(data: bytes) -> Archive:
    """The archive of a file whose blob hashes to what its header says and whose structure is sound."""
    if len(data) < HEADER.itemsize:
        raise TextureError("too short for a texture archive")
    h = np.frombuffer(data, HEADER, 1)[0]
    if int(h["magic"]) != MAGIC or int(h["version"]) != VERSION:
        raise TextureError("not a texture archive of a known version")

    def part(at, n: int) -> bytes:
        if int(at) + n > len(data):
            raise TextureError("a texture archive is cut off")
        return data[int(at):int(at) + n]

    tables = {name: np.frombuffer(part(h[f"{name}_at"], int(h[name]) * kind.itemsize), kind).copy() for name, kind in (("samplers", SAMPLER), ("textures", TEXTURE), ("subresources", SUBRESOURCE), ("materials", MATERIAL))}
    a = Archive(**tables, blob=part(h["blob_at"], int(h["blob_size"])))
    if fnv1a64(a.blob) != int(h["blob_hash"]):
        raise TextureError("texels that do not hash to what their header says")
    if found := problems(a):
        raise TextureError(found[0])
    return a
