"""Regions from voxels and back, with NumPy: what one task does with one region's cells."""

from __future__ import annotations

import numpy as np

from ..functions.address import Geometry
from . import payload, region

#: Counts of the four commonest keys stop here.
MOST = 65535


def summary(dense: np.ndarray, size: tuple[int, int, int], flags: dict[int, int]) -> np.ndarray:
    """The summary record of a chunk; keys that ``flags`` does not know are opaque."""
    out = np.zeros(1, region.SUMMARY)
    at = np.flatnonzero(dense)
    if not len(at):
        return out
    sx, sy, sz = size
    x, y, z = at % sx, at // sx % sy, at // (sx * sy)
    keys, counts = np.unique(dense[at], return_counts=True)
    bits = np.array([flags.get(int(k), 1) for k in keys], np.int64)
    s = out[0]
    s["non_air"] = len(at)
    s["opaque"] = counts[bits & 1 != 0].sum()
    s["emissive"], s["special"] = (int(counts[bits & b != 0].sum()) % 65536 for b in (2, 4))
    for n, v, e in (("x", x, sx), ("y", y, sy), ("z", z, sz)):
        s[f"min_{n}"], s[f"max_{n}"] = v.min(), v.max()
        for side, edge in (("n", 0), ("p", e - 1)):
            c = int((v == edge).sum())
            s[f"face_{side}{n}"] = 0 if not c else 1 if c == sx * sy * sz // e else 2
    macro = x * 4 // sx + 4 * (y * 4 // sy + 4 * (z * 4 // sz))
    s["macro"] = np.bitwise_or.reduce(np.uint64(1) << macro.astype(np.uint64))
    for i, k in enumerate(np.lexsort((keys, -counts))[:4]):
        s[f"top_key_{i}"], s[f"top_count_{i}"] = keys[k], min(MOST, int(counts[k]))
    return out


def build(coord: tuple[int, int, int], cells: np.ndarray, g: Geometry, flags: dict[int, int], codec: int = payload.AUTO, manifest_hash: int = 0, registry_hash: int = 0) -> region.Region:
    """A region of ``cells`` (rows x, y, z, key, all in the region, the last of a cell counting): chunks by x, y and z."""
    size = np.array(g.chunk)
    local = cells[:, :3] - np.array(coord) * np.array(g.span)
    chunk = local // size
    place = local - chunk * size
    index = place[:, 0] + size[0] * (place[:, 1] + size[1] * place[:, 2])
    order = np.lexsort((chunk[:, 2], chunk[:, 1], chunk[:, 0]))
    chunk, index, keys = chunk[order], index[order], cells[order, 3]
    starts = np.flatnonzero(np.r_[True, (np.diff(chunk, axis=0) != 0).any(1)]) if len(chunk) else np.zeros(0, int)
    out = region.Region(tuple(int(c) for c in coord), manifest_hash=manifest_hash, registry_hash=registry_hash)
    out.chunks, out.summaries = np.zeros(len(starts), region.CHUNK), np.zeros(len(starts), region.SUMMARY)
    entries, blob = np.zeros(len(starts), region.ENTRY), bytearray()
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(chunk)], strict=True)):
        dense = np.zeros(g.volume, "<u4")
        dense[index[a:b]] = keys[a:b]
        used, data = payload.encode(dense, g.chunk, codec)
        out.summaries[i] = summary(dense, g.chunk, flags)[0]
        empty = region.CHUNK_EMPTY if not out.summaries[i]["non_air"] else 0
        out.chunks[i] = (*chunk[a], region.PRESENT | region.HAS_VOXELS | empty, i, 0)
        entries[i] = len(blob), len(data), 0, used
        blob += data
    if len(starts):
        out.sections.append(region.Section(region.VOXELS, payload.PALETTE, True, entries, bytes(blob)))
    return out


def cells_of(r: region.Reader, g: Geometry, chunk: tuple[int, int, int] | None = None):
    """Rows x, y, z, key of each chunk that has voxels, chunk by chunk; of one ``chunk`` only, if given."""
    where = [k for k, d in enumerate(r.directory) if int(d["type"]) == region.VOXELS and r.by_chunk(k)]
    size = np.array(g.chunk)
    for i, c in enumerate(r.chunks):
        at = int(c["cx"]), int(c["cy"]), int(c["cz"])
        if chunk is not None and at != chunk:
            continue
        for k in where:
            data = r.payload(k, i) if i < len(r.entries[k]) else None
            if data is None:
                continue
            dense = payload.decode(int(r.entries[k][i]["codec"]), data, g.chunk)
            n = np.flatnonzero(dense)
            base = np.array(r.coord) * np.array(g.span) + np.array(at) * size
            place = np.stack([n % size[0], n // size[0] % size[1], n // (size[0] * size[1])], 1)
            yield np.column_stack([place + base, dense[n].astype(np.int64)])
