"""Where a cell lies: region, chunk and local coordinates, linear indices, packed keys and axis conventions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Numbers of the axis conventions.
Y_UP, Z_UP, Z_BACK = 0, 1, 2
CONVENTION_NAMES = {"canonical": Y_UP, "blender": Z_UP, "z_up": Z_UP, "unity": Z_BACK}


@dataclass(frozen=True)
class Geometry:
    """Edges of a chunk in cells and of a region in chunks."""

    chunk: tuple[int, int, int] = (8, 8, 8)
    region: tuple[int, int, int] = (2, 2, 2)

    def __post_init__(self):
        if min(*self.chunk, *self.region) < 1:
            raise ValueError("a geometry needs positive edges")

    @property
    def span(self) -> tuple[int, int, int]:
        return tuple(c * r for c, r in zip(self.chunk, self.region, strict=True))

    @property
    def volume(self) -> int:
        a, b, c = self.chunk
        return a * b * c


def floor_div(x: Column, n: int) -> Column:
    """Rounds towards minus infinity, exactly."""
    n_ = F.lit(n).cast("bigint")
    return F.call_function("div", x - F.pmod(x, n_), n_)


def locate(g: Geometry, x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """rx, ry, rz, cx, cy, cz, lx, ly, lz and the local index, from world coordinates of either sign."""
    at = [F.col(c).cast("bigint") for c in (x, y, z)]
    r = [floor_div(v, s) for v, s in zip(at, g.span, strict=True)]
    c = [floor_div(F.pmod(v, F.lit(s).cast("bigint")), e) for v, s, e in zip(at, g.span, g.chunk, strict=True)]
    loc = [F.pmod(v, F.lit(e).cast("bigint")) for v, e in zip(at, g.chunk, strict=True)]
    index = linear_index(*loc, g.chunk)
    names = [f"{p}{a}" for p in "rcl" for a in "xyz"]
    return [v.alias(n) for v, n in zip([*r, *c, *loc], names, strict=True)] + [index.alias("li")]


def world(g: Geometry) -> list[Column]:
    """Back from the columns of ``locate`` to x, y, z."""
    return [(F.col(f"r{a}") * s + F.col(f"c{a}") * e + F.col(f"l{a}")).alias(a) for a, s, e in zip("xyz", g.span, g.chunk, strict=True)]


def linear_index(x: Column, y: Column, z: Column, size: tuple[int, int, int]) -> Column:
    return x + size[0] * (y + size[1] * z)


def from_linear(i: Column, size: tuple[int, int, int]) -> list[Column]:
    sx, sy, _ = size
    return [F.pmod(i, F.lit(sx)), F.pmod(floor_div(i, sx), F.lit(sy)), floor_div(i, sx * sy)]


def chunk_key(cx: Column, cy: Column, cz: Column) -> Column:
    return cx.bitwiseOR(F.shiftleft(cy, 16)).bitwiseOR(F.shiftleft(cz, 32))


def convert(source: int, target: int, x: Column, y: Column, z: Column, cells: bool) -> tuple[Column, Column, Column]:
    """From one convention to another; a mirrored cell c is -c - 1, a mirrored position -p."""
    def mirror(v: Column) -> Column:
        return -v - 1 if cells else -v

    for n in (source, target):
        if n not in (Y_UP, Z_UP, Z_BACK):
            raise ValueError(f"unknown axis convention {n}")
    if source == Z_UP:
        x, y, z = x, z, mirror(y)
    elif source == Z_BACK:
        z = mirror(z)
    if target == Z_UP:
        x, y, z = x, mirror(z), y
    elif target == Z_BACK:
        z = mirror(z)
    return x, y, z
