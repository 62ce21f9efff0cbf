"""3-D vectors as STRUCT<x,y,z> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ionframe.functions.rng import between, draw


def vec(x, y, z) -> Column:
    as_col = [c if isinstance(c, Column) else (F.col(c) if isinstance(c, str) else F.lit(float(c))) for c in (x, y, z)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(as_col, "xyz", strict=True)])


def parts(a: Column) -> tuple[Column, Column, Column]:
    return a["x"], a["y"], a["z"]


def _both(a: Column, b: Column, f) -> Column:
    return vec(*[f(p, q) for p, q in zip(parts(a), parts(b), strict=True)])


def add(a: Column, b: Column) -> Column:
    return _both(a, b, lambda p, q: p + q)


def sub(a: Column, b: Column) -> Column:
    return _both(a, b, lambda p, q: p - q)


def scale(a: Column, k) -> Column:
    return vec(*[p * k for p in parts(a)])


def over(a: Column, k: Column) -> Column:
    """Division by a number; division by 0 raises."""
    safe = F.when(k == 0, F.raise_error(F.lit("division of a vector by zero")).cast("double")).otherwise(k)
    return vec(*[p / safe for p in parts(a)])


def negate(a: Column) -> Column:
    return scale(a, -1)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def times(a: Column, b: Column) -> Column:
    """The elementwise product."""
    return _both(a, b, lambda p, q: p * q)


def module(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return module(sub(a, b))


def normalised(a: Column) -> Column:
    """Length 1; the null vector stays."""
    m = module(a)
    return F.when(m == 0, vec(0, 0, 0)).otherwise(vec(*[p / F.when(m != 0, m) for p in parts(a)]))


def signs(a: Column) -> Column:
    return vec(*[F.signum(p) for p in parts(a)])


def is_null(a: Column) -> Column:
    return (a["x"] == 0) & (a["y"] == 0) & (a["z"] == 0)


def is_parallel(a: Column, b: Column) -> Column:
    return is_null(cross(a, b))


def is_orthogonal(a: Column, b: Column) -> Column:
    return dot(a, b) == 0


def item(a: Column, i: int) -> Column:
    if i not in (0, 1, 2):
        raise IndexError(f"a vector has components 0 to 2, not {i}")
    return a["xyz"[i]]


def beta_gamma(a: Column) -> tuple[Column, Column]:
    """The angles (around Y, around Z) that turn the Z axis to ``a``; the null vector raises."""
    m = module(a)
    safe = F.when(m == 0, F.raise_error(F.lit("no angles of a null vector")).cast("double")).otherwise(m)
    return F.acos(a["z"] / safe), F.atan2(a["y"], a["x"])


def rotated(a: Column, beta: Column, gamma: Column) -> Column:
    """Turned around Y by beta, then around Z by gamma."""
    x, z = F.cos(beta) * a["x"] + F.sin(beta) * a["z"], F.cos(beta) * a["z"] - F.sin(beta) * a["x"]
    return vec(F.cos(gamma) * x - F.sin(gamma) * a["y"], F.sin(gamma) * x + F.cos(gamma) * a["y"], z)


def area_xy(a: Column, b: Column, c: Column) -> Column:
    """The area of the projection of a triangle to the XY plane."""
    return F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])) / 2


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return module(cross(sub(b, a), sub(c, a))) / 2


def centroid(*points: Column) -> Column:
    total = points[0]
    for p in points[1:]:
        total = add(total, p)
    return scale(total, 1.0 / len(points))


def signed_volume(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a tetrahedron: positive when d lies where the right hand's thumb points from the turn a, b, c."""
    return dot(sub(d, a), cross(sub(b, a), sub(c, a))) / 6


def to_text(a: Column) -> Column:
    return F.concat_ws(" ", *[p.cast("string") for p in parts(a)])


def from_text(text: Column, separator: str = r"\s*,\s*") -> Column:
    """A vector from exactly three numbers; anything else raises."""
    cells = F.split(F.trim(text), separator)
    checked = F.when(F.size(cells) == 3, cells).otherwise(F.raise_error(F.concat(F.lit("three coordinates are needed: "), text)).cast("array<string>"))
    return vec(*[checked[i].cast("double") for i in range(3)])


def affine(a: Column, matrix: list[list[float]]) -> Column:
    """A point under a 4x4 matrix (rows of numbers; the last is not used)."""
    return vec(*[a["x"] * r[0] + a["y"] * r[1] + a["z"] * r[2] + r[3] for r in matrix[:3]])


def random(seed: int, key: Column, step, low: float, high: float) -> Column:
    """A vector of three draws in [low, high), the same for a key and step on any retry."""
    return vec(*[between(draw(seed, key, step, i), low, high) for i in range(3)])


def same_matrix(a: list[list[float]], b: list[list[float]]) -> bool:
    """Whether two matrices have the same shape and entries."""
    return [list(r) for r in a] == [list(r) for r in b]
