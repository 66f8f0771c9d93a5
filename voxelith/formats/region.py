"""Region files: a header, tables of chunks and summaries, a directory of sections, and each section's entries and bytes.

Tables come before bytes, so all that describes a region can be read without its payloads. Layouts are NumPy record types.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .bytes_hash import fnv1a64

# Layouts, magic number and codes of the file format.
MAGIC, VERSION, NOWHERE = 0x584F564C49534142, 1, 0xFFFFFFFFFFFFFFFF
HEADER = np.dtype([("magic", "<u8"), ("version", "<u2"), ("flags", "<u2"), ("rx", "<i4"), ("ry", "<i4"), ("rz", "<i4"), ("chunks", "<u4"), ("sections", "<u2"), ("reserved", "<u2"), ("chunks_at", "<u8"), ("summaries_at", "<u8"), ("directory_at", "<u8"), ("file_size", "<u8"), ("manifest_hash", "<u8"), ("registry_hash", "<u8"), ("file_hash", "<u8")])
CHUNK = np.dtype([("cx", "<u2"), ("cy", "<u2"), ("cz", "<u2"), ("flags", "<u2"), ("summary", "<u4"), ("user", "<u4")])
SUMMARY = np.dtype([("non_air", "<u4"), ("opaque", "<u4"), ("emissive", "<u2"), ("special", "<u2"), ("min_x", "u1"), ("min_y", "u1"), ("min_z", "u1"), ("max_x", "u1"), ("max_y", "u1"), ("max_z", "u1"), ("face_px", "u1"), ("face_nx", "u1"), ("face_py", "u1"), ("face_ny", "u1"), ("face_pz", "u1"), ("face_nz", "u1"), ("macro", "<u8"), *((f"top_key_{i}", "<u4") for i in range(4)), *((f"top_count_{i}", "<u2") for i in range(4))])
SECTION = np.dtype([("type", "<u4"), ("codec", "<u2"), ("stride", "<u2"), ("entries", "<u4"), ("flags", "<u4"), ("entries_at", "<u8"), ("blob_at", "<u8"), ("blob_size", "<u8")])
ENTRY = np.dtype([("offset", "<u8"), ("size", "<u4"), ("flags", "<u2"), ("codec", "<u2")])
STANDALONE = 1
PRESENT, CHUNK_EMPTY, HAS_VOXELS, HAS_SURFACE, HAS_COLLISION, HAS_DISTANCE, HAS_LIGHT = 1, 2, 4, 8, 16, 32, 64
WORLD_DESC, VOXELS, SURFACE, COLLISION, DISTANCE, LIGHT, METADATA = 1, 2, 3, 4, 5, 6, 7
FLAGS_KNOWN, BY_CHUNK = 1, 2
ALIGN = 16
#: The flag that a section's payload sets on its chunk.
FLAG_OF = {VOXELS: HAS_VOXELS, SURFACE: HAS_SURFACE, COLLISION: HAS_COLLISION, DISTANCE: HAS_DISTANCE, LIGHT: HAS_LIGHT}


class RegionError(ValueError):
    """A file that is no region, is cut off, or does not hash to what its header says."""


@dataclass
class Section:
    """Payloads of one type: ``entries`` in the order of the chunks, ranges of ``blob``."""

    type: int
    codec: int = 0
    by_chunk: bool = True
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, ENTRY))
    blob: bytes = b""


@dataclass
class Region:
    coord: tuple[int, int, int]
    chunks: np.ndarray = field(default_factory=lambda: np.zeros(0, CHUNK))
    summaries: np.ndarray = field(default_factory=lambda: np.zeros(0, SUMMARY))
    sections: list[Section] = field(default_factory=list)
    manifest_hash: int = 0
    registry_hash: int = 0
    world: bytes | None = None  # description of the world, in a file that stands alone
    metadata: dict[str, bytes] = field(default_factory=dict)


def align(n: int) -> int:
    return n + -n % ALIGN


def _described(kind: int, blob: bytes) -> Section:
    return Section(kind, 0, False, np.array([(0, len(blob), 0, 0)], ENTRY), blob)


def metadata_blob(metadata: dict[str, bytes]) -> bytes:
    """Keys in order: how many, each one's lengths, then each one's bytes."""
    if not metadata:
        return b""
    pairs = [(k.encode(), v) for k, v in sorted(metadata.items(), key=lambda kv: kv[0].encode())]
    sizes = np.array([(len(k), len(v)) for k, v in pairs], "<u4")
    return np.array(len(pairs), "<u4").tobytes() + sizes.tobytes() + b"".join(k + v for k, v in pairs)


def metadata_of(blob: bytes) -> dict[str, bytes]:
    if not blob:
        return {}
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    if 4 + 8 * n > len(blob):
        raise RegionError("metadata is cut off")
    at, out = 4 + 8 * n, {}
    for k, v in np.frombuffer(blob, "<u4", 2 * n, 4).reshape(-1, 2).tolist():
        if at + k + v > len(blob):
            raise RegionError("metadata is cut off")
        out.setdefault(blob[at:at + k].decode(errors="replace"), blob[at + k:at + k + v])
        at += k + v
    return out


def to_bytes(r: Region) -> bytes:
    """The file: sections by type, every part on a boundary of 16 bytes, gaps zero; the same region gives the same bytes."""
    sections = list(r.sections)
    if r.world is not None:
        sections.append(_described(WORLD_DESC, r.world))
    if r.metadata:
        sections.append(_described(METADATA, metadata_blob(r.metadata)))
    sections.sort(key=lambda s: s.type)
    head = np.zeros(1, HEADER)
    directory = np.zeros(len(sections), SECTION)
    parts: list[tuple[int, bytes]] = []
    end = HEADER.itemsize

    def place(data: bytes) -> int:
        nonlocal end
        at = align(end)
        parts.append((at, data))
        end = at + len(data)
        return at

    for name, value in (("magic", MAGIC), ("version", VERSION), ("flags", STANDALONE if r.world is not None else 0), ("rx", r.coord[0]), ("ry", r.coord[1]), ("rz", r.coord[2]), ("chunks", len(r.chunks)), ("sections", len(sections)), ("manifest_hash", r.manifest_hash), ("registry_hash", r.registry_hash)):
        head[name] = value
    head["chunks_at"], head["summaries_at"] = place(r.chunks.tobytes()), place(r.summaries.tobytes())
    head["directory_at"] = place(bytes(directory.nbytes))
    own = len(parts) - 1
    for d, s in zip(directory, sections, strict=True):
        d["type"], d["codec"], d["stride"], d["entries"], d["flags"] = s.type, s.codec, ENTRY.itemsize, len(s.entries), FLAGS_KNOWN | (BY_CHUNK if s.by_chunk else 0)
        d["entries_at"], d["blob_at"], d["blob_size"] = place(s.entries.tobytes()), place(s.blob), len(s.blob)
    parts[own] = parts[own][0], directory.tobytes()
    head["file_size"] = end
    out = bytearray(end)
    out[:HEADER.itemsize] = head.tobytes()
    for at, data in parts:
        out[at:at + len(data)] = data
    head["file_hash"] = fnv1a64(bytes(out))
    out[:HEADER.itemsize] = head.tobytes()
    return bytes(out)


def sound(data: bytes) -> bool:
    """Whether a file hashes to what its header says, with that field zero."""
    if len(data) < HEADER.itemsize:
        return False
    at = HEADER.fields["file_hash"][1]
    return fnv1a64(data[:at] + bytes(8) + data[at + 8:]) == int.from_bytes(data[at:at + 8], "little")


class Reader:
    """What describes a region, read through ``read(offset, size)``; payload bytes only when they are asked for."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        if size < HEADER.itemsize:
            raise RegionError("too short for a region")
        h = np.frombuffer(read(0, HEADER.itemsize), HEADER)[0]
        if int(h["magic"]) != MAGIC or int(h["version"]) != VERSION:
            raise RegionError("not a region of a known version")
        if int(h["file_size"]) != size:
            raise RegionError("a region of another size than its header says")
        self.header = h
        self.coord = int(h["rx"]), int(h["ry"]), int(h["rz"])
        self.chunks = self._table(CHUNK, h["chunks_at"], h["chunks"])
        self.summaries = self._table(SUMMARY, h["summaries_at"], h["chunks"])
        self.directory = self._table(SECTION, h["directory_at"], h["sections"])
        self.entries = []
        self.world: bytes | None = None
        self.metadata: dict[str, bytes] = {}
        for d in self.directory:
            if int(d["stride"]) != ENTRY.itemsize:
                raise RegionError("entries of an unknown layout")
            if int(d["blob_at"]) + int(d["blob_size"]) > size:
                raise RegionError("a section beyond the file's end")
            e = self._table(ENTRY, d["entries_at"], d["entries"])
            self.entries.append(e)
            if int(d["type"]) in (WORLD_DESC, METADATA):
                if len(e) != 1 or int(e[0]["offset"]) or int(e[0]["size"]) != int(d["blob_size"]):
                    raise RegionError("a malformed description")
                blob = bytes(read(int(d["blob_at"]), int(d["blob_size"])))
                if int(d["type"]) == WORLD_DESC:
                    self.world = blob
                else:
                    self.metadata = metadata_of(blob)
        if int(h["flags"]) & STANDALONE and self.world is None:
            raise RegionError("a file that stands alone has no description of its world")

    def _table(self, kind: np.dtype, at, count) -> np.ndarray:
        at, n = int(at), int(count) * kind.itemsize
        if at + n > self.size:
            raise RegionError("a table beyond the file's end")
        return np.frombuffer(self.read(at, n), kind)

    def resident(self) -> int:
        """Bytes that are held without any payload."""
        return HEADER.itemsize + self.chunks.nbytes + self.summaries.nbytes + self.directory.nbytes + sum(e.nbytes for e in self.entries) + sum(len(k.encode()) + len(v) for k, v in self.metadata.items())

    def by_chunk(self, k: int) -> bool:
        d = self.directory[k]
        return bool(int(d["flags"]) & BY_CHUNK) if int(d["flags"]) & FLAGS_KNOWN else len(self.entries[k]) == len(self.chunks)

    def payload(self, k: int, i: int) -> bytes | None:
        """The bytes of entry ``i`` of section ``k``; None if it has none."""
        e, d = self.entries[k][i], self.directory[k]
        if int(e["offset"]) == NOWHERE:
            return None
        if int(e["offset"]) + int(e["size"]) > int(d["blob_size"]):
            raise RegionError("a payload beyond its section's end")
        return bytes(self.read(int(d["blob_at"]) + int(e["offset"]), int(e["size"])))


def of_bytes(data: bytes, check: bool = True) -> Region:
    """The whole region; ``check``: refuse a file that does not hash to what its header says."""
    r = Reader(lambda at, n: data[at:at + n], len(data))
    if check and not sound(data):
        raise RegionError("a region that does not hash to what its header says")
    sections = [Section(int(d["type"]), int(d["codec"]), r.by_chunk(k), r.entries[k].copy(), bytes(r.read(int(d["blob_at"]), int(d["blob_size"])))) for k, d in enumerate(r.directory) if int(d["type"]) not in (WORLD_DESC, METADATA)]
    return Region(r.coord, r.chunks.copy(), r.summaries.copy(), sections, int(r.header["manifest_hash"]), int(r.header["registry_hash"]), r.world, dict(r.metadata))


def compact(r: Region) -> int:
    """Drop dead bytes of all sections, ranges that entries share once each; returns how many bytes went."""
    gone = 0
    for s in r.sections:
        moved: dict[tuple[int, int], int] = {}
        blob = bytearray()
        for e in s.entries:
            at, n = int(e["offset"]), int(e["size"])
            if at == NOWHERE:
                continue
            if at + n > len(s.blob):
                raise RegionError("a payload beyond its section's end")
            if (at, n) not in moved:
                moved[at, n] = len(blob)
                blob += s.blob[at:at + n]
            e["offset"] = moved[at, n]
        gone += len(s.blob) - len(blob)
        s.blob = bytes(blob)
    return gone
