"""Scenes of the public ``.vox`` format: models of coloured voxels, a palette, and a graph that places them."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Levels of a scene's graph at most: deeper ones are taken for cycles.
DEPTH = 256
#: Highest numbers of nodes and layers.
NODES, LAYERS = 1_000_000, 100_000


class SceneError(ValueError):
    """A file that is no scene, is cut off, or whose graph leads nowhere."""


@dataclass
class Instance:
    model: int
    rotation: np.ndarray  # 3 by 3, a signed permutation
    translation: np.ndarray
    name: str = ""
    hidden: bool = False


@dataclass
class Scene:
    models: list[tuple[tuple[int, int, int], np.ndarray]] = field(default_factory=list)  # size; rows x, y, z, colour
    palette: np.ndarray = field(default_factory=lambda: np.zeros((256, 4), np.uint8))
    instances: list[Instance] = field(default_factory=list)


class _Content:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise SceneError("a chunk is cut off")
        self.at += n
        return self.data[self.at - n:self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.bytes(4))[0]

    def count(self) -> int:
        return struct.unpack("<I", self.bytes(4))[0]

    def pairs(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for _ in range(self.count()):
            key, value = (self.bytes(self.count()).decode(errors="replace") for _ in range(2))
            out.setdefault(key, value)
        return out


def rotation(byte: int) -> np.ndarray:
    """The signed permutation of a packed byte: two bits each for the columns of the first rows, then three signs."""
    a, b = byte & 3, byte >> 2 & 3
    if a > 2 or b > 2 or a == b:
        raise SceneError(f"no rotation is packed as {byte}")
    out = np.zeros((3, 3), np.int64)
    for row, column in enumerate((a, b, 3 - a - b)):
        out[row, column] = -1 if byte >> (4 + row) & 1 else 1
    return out


def _transform(c: _Content) -> dict:
    about = c.pairs()
    node = {"kind": "move", "child": c.number(), "name": about.get("_name", ""), "hidden": about.get("_hidden") == "1"}
    c.number()
    node["layer"] = c.number()
    frames = [c.pairs() for _ in range(c.count())]
    first = frames[0] if frames else {}
    node["rotation"] = rotation(int(first["_r"])) if "_r" in first else np.eye(3, dtype=np.int64)
    step = first.get("_t", "0 0 0").split()
    if len(step) != 3:
        raise SceneError("a translation needs three numbers")
    node["translation"] = np.array(list(map(int, step)), np.int64)
    return node


def _group(c: _Content) -> dict:
    c.pairs()
    return {"kind": "group", "children": [c.number() for _ in range(c.count())]}


def _shape(c: _Content) -> dict:
    c.pairs()
    models = []
    for _ in range(c.count()):
        models.append(c.number())
        c.pairs()
    return {"kind": "shape", "children": models}


_NODES = {b"nTRN": _transform, b"nGRP": _group, b"nSHP": _shape}


def parse(data: bytes) -> Scene:
    """A scene; chunks of other kinds are passed over. Without a graph each model stands where it is."""
    if len(data) < 8 or data[:4] != b"VOX ":
        raise SceneError("not a scene")
    scene, nodes, hidden_layers, at = Scene(), {}, set(), 8
    while at + 12 <= len(data):
        kind, (size, _) = data[at:at + 4], struct.unpack_from("<II", data, at + 4)
        at += 12
        if at + size > len(data):
            raise SceneError("a chunk runs over the file's end")
        c = _Content(data[at:at + size])  # what follows it are its children, walked like any other
        at += size
        if kind == b"SIZE":
            scene.models.append(((c.number(), c.number(), c.number()), np.zeros((0, 4), np.uint8)))
        elif kind == b"XYZI":
            if not scene.models:
                raise SceneError("voxels before their model's size")
            n = c.count()
            scene.models[-1] = scene.models[-1][0], np.frombuffer(c.bytes(4 * n), np.uint8).reshape(n, 4)
        elif kind == b"RGBA":
            scene.palette = np.frombuffer(c.bytes(1024), np.uint8).reshape(256, 4)
        elif kind in _NODES:
            number = c.number()
            if not 0 <= number <= NODES:
                raise SceneError(f"no node is numbered {number}")
            nodes[number] = _NODES[kind](c)
        elif kind == b"LAYR":
            number = c.number()
            if 0 <= number < LAYERS and c.pairs().get("_hidden") == "1":
                hidden_layers.add(number)
    one, none = np.eye(3, dtype=np.int64), np.zeros(3, np.int64)
    scene.instances = _placed(nodes, hidden_layers, len(scene.models)) if nodes else [Instance(i, one, none) for i in range(len(scene.models))]
    return scene


def _placed(nodes: dict[int, dict], hidden_layers: set[int], models: int) -> list[Instance]:
    """Instances in the graph's order, all moves on the way from the root in one; the innermost name, and hidden if
    anything above is."""
    out = []
    waiting = [(0, np.eye(3, dtype=np.int64), np.zeros(3, np.int64), "", False, 0)]
    while waiting:
        number, r, t, name, hidden, depth = waiting.pop()
        if depth > DEPTH:
            raise SceneError("a graph that is too deep, or turns back on itself")
        node = nodes.get(number)
        if node is None:
            raise SceneError(f"no node {number}")
        if node["kind"] == "move":
            waiting.append((node["child"], r @ node["rotation"], r @ node["translation"] + t, node["name"] or name, hidden or node["hidden"] or node["layer"] in hidden_layers, depth + 1))
        elif node["kind"] == "group":
            waiting += [(c, r, t, name, hidden, depth + 1) for c in reversed(node["children"])]
        else:
            for m in node["children"]:
                if not 0 <= m < models:
                    raise SceneError(f"no model {m}")
                out.append(Instance(m, r, t, name, hidden))
    return out


def _chunk(kind: bytes, content: bytes, children: bytes = b"") -> bytes:
    return kind + struct.pack("<II", len(content), len(children)) + content + children


def emit(scene: Scene) -> bytes:
    """A file of the models and the palette, each model where it is."""
    parts = [_chunk(b"PACK", struct.pack("<I", len(scene.models)))] if len(scene.models) > 1 else []
    for size, voxels in scene.models:
        parts += [_chunk(b"SIZE", struct.pack("<3i", *size)), _chunk(b"XYZI", struct.pack("<I", len(voxels)) + np.ascontiguousarray(voxels, np.uint8).tobytes())]
    parts.append(_chunk(b"RGBA", np.ascontiguousarray(scene.palette, np.uint8).tobytes()))
    return b"VOX " + struct.pack("<I", 150) + _chunk(b"MAIN", b"", b"".join(parts))
