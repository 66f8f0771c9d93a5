"""Payloads of a chunk's voxels: seven codecs between dense key arrays and bytes, with NumPy.

A dense array holds the keys of a chunk in linear order, x fastest, then y; 0 is air. All numbers are little-endian.
"""

from __future__ import annotations

import numpy as np

# Numbers of the codecs.
EMPTY, UNIFORM, PALETTE, LIST, COLUMNS, RAW, PACKED, AUTO = 1, 2, 3, 4, 5, 6, 7, 0xFFFF
#: Keys that a palette can count.
MOST_KEYS = 65535
#: What AUTO weighs, in this order: of equally short payloads the first is taken.
TRIED = (RAW, PALETTE, LIST, PACKED, COLUMNS)


class PayloadError(ValueError):
    """A payload that is cut off or points outside its chunk, or voxels that a codec cannot hold."""


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, lowest bit first, the last byte filled with zeros."""
    if not 1 <= width <= 32:
        raise PayloadError(f"a width of {width} bits")
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    if not 1 <= width <= 32:
        raise PayloadError(f"a width of {width} bits")
    if 8 * len(data) < count * width:
        raise PayloadError("packed bits are cut off")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


def index_bits(n: int) -> int:
    """Bits that tell ``n`` values apart, one at least."""
    return max(1, (n - 1).bit_length())


def _palette(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys by first appearance, and the number of each key among them."""
    distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
    if len(distinct) > MOST_KEYS:
        raise PayloadError(f"{len(distinct)} keys are too many for a palette")
    order = np.argsort(first)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return distinct[order], number[back]


def _runs(dense: np.ndarray, size: tuple[int, int, int]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(x, z, [(y, length, key), ...]) of each column that holds a voxel, z outside, x inside."""
    sx, sy, sz = size
    out = []
    cube = dense.reshape(sz, sy, sx)
    for z, x in np.argwhere(cube.any(1)):
        line = cube[z, :, x]
        cuts = np.flatnonzero(np.diff(line)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [sy]])
        out.append((int(x), int(z), [(int(a), int(b - a), int(line[a])) for a, b in zip(starts, ends, strict=True) if line[a]]))
    return out


def encode(dense: np.ndarray, size: tuple[int, int, int], codec: int = AUTO) -> tuple[int, bytes]:
    """The codec and the bytes of a chunk. AUTO: empty or uniform if it is, else the shortest."""
    dense = np.ascontiguousarray(dense, "<u4")
    if len(dense) != size[0] * size[1] * size[2]:
        raise PayloadError(f"{len(dense)} voxels for a chunk of {size}")
    if codec == AUTO:
        if not dense.any():
            return EMPTY, b""
        if (dense == dense[0]).all():
            return UNIFORM, encode(dense, size, UNIFORM)[1]
        best: tuple[int, bytes] | None = None
        for c in TRIED:
            try:
                data = encode(dense, size, c)[1]
            except PayloadError:  # too many keys: other codecs are left
                continue
            if best is None or len(data) < len(best[1]):
                best = c, data
        return best
    at = np.flatnonzero(dense)
    if codec == EMPTY:
        data = b""
    elif codec == UNIFORM:
        data = dense[:1].tobytes()
    elif codec == RAW:
        data = dense.tobytes()
    elif codec == LIST:
        data = np.array(len(at), "<u4").tobytes() + np.stack([at.astype("<u4"), dense[at]], 1).tobytes()
    elif codec == PALETTE:
        keys, number = _palette(dense)
        width = max(1, len(keys).bit_length())
        data = np.array(len(keys), "<u2").tobytes() + bytes([width, 0]) + keys.astype("<u4").tobytes() + pack_bits(number, width)
    elif codec == PACKED:
        keys, number = _palette(dense[at])
        wide, narrow = index_bits(len(dense)), index_bits(len(keys))
        data = np.array(len(keys), "<u2").tobytes() + bytes([wide, narrow]) + np.array(len(at), "<u4").tobytes() + keys.astype("<u4").tobytes() + pack_bits(at, wide) + pack_bits(number, narrow)
    elif codec == COLUMNS:
        columns = _runs(dense, size)
        parts = [np.array(len(columns), "<u4").tobytes()]
        for x, z, runs in columns:
            parts.append(np.array([x, z, len(runs)], "<u2").tobytes())
            parts += [np.array([y, n], "<u2").tobytes() + np.array(key, "<u4").tobytes() for y, n, key in runs]
        data = b"".join(parts)
    else:
        raise PayloadError(f"unknown codec {codec}")
    return codec, data


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str, count: int = 1) -> np.ndarray:
        step = np.dtype(kind).itemsize * count
        if self.at + step > len(self.data):
            raise PayloadError("a payload is cut off")
        out = np.frombuffer(self.data, kind, count, self.at)
        self.at += step
        return out


def _inside(index: np.ndarray, n: int) -> None:
    if len(index) and int(index.max()) >= n:
        raise PayloadError("a payload points outside its chunk or palette")


def decode(codec: int, data: bytes, size: tuple[int, int, int]) -> np.ndarray:
    """The dense keys of a chunk; what a codec does not mention is air."""
    sx, sy, sz = size
    n = sx * sy * sz
    out, c = np.zeros(n, "<u4"), _Cursor(data)
    if codec == EMPTY:
        return out
    if codec == UNIFORM:
        out[:] = c.take("<u4")[0]
    elif codec == RAW:
        if len(data) != 4 * n:
            raise PayloadError("a dense payload of the wrong length")
        out[:] = np.frombuffer(data, "<u4")
    elif codec == LIST:
        pairs = c.take("<u4", 2 * int(c.take("<u4")[0])).reshape(-1, 2)
        _inside(pairs[:, 0], n)
        out[pairs[:, 0]] = pairs[:, 1]
    elif codec == PALETTE:
        many, width = int(c.take("<u2")[0]), int(c.take("u1", 2)[0])
        keys = c.take("<u4", many)
        number = unpack_bits(data[c.at:], n, width)
        _inside(number, many)
        out[:] = keys[number]
    elif codec == PACKED:
        many = int(c.take("<u2")[0])
        wide, narrow = map(int, c.take("u1", 2))
        count = int(c.take("<u4")[0])
        keys = c.take("<u4", many)
        if count:
            step = (count * wide + 7) // 8
            at, number = unpack_bits(data[c.at:c.at + step], count, wide), unpack_bits(data[c.at + step:], count, narrow)
            _inside(at, n)
            _inside(number, many)
            out[at] = keys[number]
    elif codec == COLUMNS:
        cube = out.reshape(sz, sy, sx)
        for _ in range(int(c.take("<u4")[0])):
            x, z, runs = map(int, c.take("<u2", 3))
            if x >= sx or z >= sz:
                raise PayloadError("a column outside its chunk")
            for _ in range(runs):
                y, length = map(int, c.take("<u2", 2))
                if y + length > sy:
                    raise PayloadError("a run outside its column")
                cube[z, y:y + length, x] = c.take("<u4")[0]
    else:
        raise PayloadError(f"unknown codec {codec}")
    return out
