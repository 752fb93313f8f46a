"""Column helpers for vectors, quaternions, cameras and polygons. Vectors are lists of columns; all stays in codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


class Later(Sequence):
    """A vector of columns by name, made when used, so that modules can be imported without a session."""

    def __init__(self, prefix: str, names: str = "xyz"):
        self.columns = [prefix + n for n in names]

    def __len__(self) -> int:
        return len(self.columns)

    def __getitem__(self, i):
        return [F.col(c) for c in self.columns[i]] if isinstance(i, slice) else F.col(self.columns[i])


def vec(prefix: str, names: str = "xyz") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def lits(values: Sequence[float]) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def dot(a: Vec, b: Vec) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def unit(a: Vec) -> list[Column]:
    """Null for the zero vector."""
    n = norm(a)
    return [F.when(n > 0, x / n) for x in a]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def rotation_of(q: Vec) -> list[list[Column]]:
    """Rows of the rotation of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    one = F.lit(1.0)
    return [
        [one - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), one - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), one - 2 * (x * x + y * y)],
    ]


def apply(r: Sequence[Vec], v: Vec) -> list[Column]:
    return [dot(row, v) for row in r]


def transpose(r: Sequence[Vec]) -> list[list[Column]]:
    return [[r[i][j] for i in range(3)] for j in range(3)]


def quaternion_of(r: Sequence[Vec]) -> list[Column]:
    """Unit quaternion with w >= 0 of a rotation, by its largest diagonal form."""
    t = r[0][0] + r[1][1] + r[2][2]
    a = F.sqrt(F.greatest(1 + t, F.lit(0.0))) * 2
    bs = [F.sqrt(F.greatest(1 + r[i][i] - r[j][j] - r[k][k], F.lit(0.0))) * 2 for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))]
    s, d = (lambda i, j: r[i][j] + r[j][i]), (lambda i, j: r[i][j] - r[j][i])
    forms = [
        [a / 4, d(2, 1) / a, d(0, 2) / a, d(1, 0) / a],
        [d(2, 1) / bs[0], bs[0] / 4, s(0, 1) / bs[0], s(0, 2) / bs[0]],
        [d(0, 2) / bs[1], s(0, 1) / bs[1], bs[1] / 4, s(1, 2) / bs[1]],
        [d(1, 0) / bs[2], s(0, 2) / bs[2], s(1, 2) / bs[2], bs[2] / 4],
    ]
    big = lambda i, j, k: (r[i][i] >= r[j][j]) & (r[i][i] >= r[k][k])
    pick = lambda c: F.when(t > 0, forms[0][c]).when(big(0, 1, 2), forms[1][c]).when(big(1, 0, 2), forms[2][c]).otherwise(forms[3][c])
    q = [pick(c) for c in range(4)]
    return [F.when(q[0] < 0, -c).otherwise(c) for c in q]


def quaternion_product(a: Vec, b: Vec) -> list[Column]:
    return [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]


def slerp(a: Vec, b: Vec, t: Column) -> list[Column]:
    """Between unit quaternions on the shorter way; a straight line where they nearly agree."""
    d0 = dot(a, b)
    b = [F.when(d0 < 0, -c).otherwise(c) for c in b]
    d = F.least(F.abs(d0), F.lit(1.0))
    angle = F.acos(d)
    s = F.sin(angle)
    straight = d > 0.9995
    wa = F.when(straight, 1 - t).otherwise(F.sin((1 - t) * angle) / s)
    wb = F.when(straight, t).otherwise(F.sin(t * angle) / s)
    q = [wa * x + wb * y for x, y in zip(a, b)]
    n = norm(q)
    return [c / n for c in q]


def angle_of(r: Sequence[Vec]) -> Column:
    """Rotation angle in radians."""
    return F.acos(F.least(F.greatest((r[0][0] + r[1][1] + r[2][2] - 1) / 2, F.lit(-1.0)), F.lit(1.0)))


def to_camera(point: Vec, centre: Vec, q: Vec) -> list[Column]:
    """World point in the camera's axes; q turns world to camera, centre is the camera's place."""
    return apply(rotation_of(q), minus(point, centre))


def project(cam: Vec, k: dict) -> tuple[Column, Column]:
    """Sensor pixel of a point in camera axes; null behind the camera (z <= 0.001)."""
    ok = cam[2] > 1e-3
    return F.when(ok, k["fx"] * cam[0] / cam[2] + k["cx"]), F.when(ok, k["fy"] * cam[1] / cam[2] + k["cy"])


def unproject(u: Column, v: Column, z: Column, k: dict, q: Vec, centre: Vec, pixel_centre: float = 0.0) -> list[Column]:
    """World point of a depth pixel; pixel_centre is 0.5 where pixel (0, 0) has its middle at (0.5, 0.5)."""
    ray = [(u + pixel_centre - k["cx"]) / k["fx"] * z, (v + pixel_centre - k["cy"]) / k["fy"] * z, z]
    return [c + p for c, p in zip(apply(transpose(rotation_of(q)), ray), centre)]


def upright(sx: Column, sy: Column, height: int) -> tuple[Column, Column]:
    """Sensor pixel in the upright picture of a sensor mounted sideways."""
    return (height - 1) - sy, sx


def similarity(point: Vec, s: float, r: Sequence[Sequence[float]], t: Sequence[float]) -> list[Column]:
    return [s * dot(lits(row), point) + float(b) for row, b in zip(r, t)]


def polygon_of(kind: str, pts: Sequence[Sequence[float]]) -> list[tuple[float, float]]:
    """Corners of a region: a rectangle by two corners, a circle (centre, point on it) as 40 corners, a polygon as is."""
    if kind == "rect":
        (ax, ay), (bx, by) = pts[0], pts[1]
        return [(ax, ay), (bx, ay), (bx, by), (ax, by)]
    if kind == "circle":
        (cx, cy), (ex, ey) = pts[0], pts[1]
        r = math.hypot(ex - cx, ey - cy)
        return [(cx + r * math.cos(2 * math.pi * i / 40), cy + r * math.sin(2 * math.pi * i / 40)) for i in range(40)]
    return [tuple(p) for p in pts]


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule, after the cheap test against the polygon's bounding box."""
    crossed = None
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay + 1e-12) + ax)
        crossed = hit.cast("int") if crossed is None else crossed + hit.cast("int")
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    inside = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return inside & (crossed % 2 == 1)


def box_corners(t: Vec, r: Sequence[Vec], size: Vec) -> Column:
    """The eight corners of an oriented box (columns of r: its axes; size: its lengths) as an array of structs."""
    out = []
    for signs in ((a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)):
        half = [s * e / 2 for s, e in zip(signs, size)]
        out.append(F.struct(*[(p + c).alias(n) for n, p, c in zip("xyz", t, apply(r, half))]))
    return F.array(*out)


def bearing(dx: Column, dz: Column) -> Column:
    return F.atan2(dx, dz)


def angle_between(a: Column, b: Column) -> Column:
    """Absolute difference of two directions in radians, 0..pi."""
    return F.abs(F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi)


def sector(theta: Column, n: int) -> Column:
    return F.pmod(F.floor((theta + math.pi) / (2 * math.pi) * n), F.lit(n)).cast("int")


def fov_degrees(width: Column, focal: Column) -> Column:
    return F.degrees(2 * F.atan(width / (2 * focal)))


def voxel_key(p: Vec, side: float) -> Column:
    """63-bit key of a point's voxel, 21 bits an axis around the origin."""
    cells = [(F.floor(c / side) + (1 << 20)).cast("long") for c in p]
    return F.shiftleft(cells[0], 42).bitwiseOR(F.shiftleft(cells[1], 21)).bitwiseOR(cells[2])


def clip_byte(c: Column) -> Column:
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))).cast("int")
