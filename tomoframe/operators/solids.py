"""Lines against solids as columns: cylinders along z, planes, and the clip of a tube between two crystals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.functions.scalars import Vector, dot, norm

#: Least size of a product by which two directions count as not parallel.
PARALLEL = 1e-7


@dataclass(frozen=True)
class Cylinder:
    radius: float
    length: float
    centre: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def crossings(self, p: Vector, q: Vector, finite: bool = True) -> tuple[Column, Column]:
        """Parameters from p (0) to q (1) at which the line meets the mantle, the lower one first; null where it does not.

        finite: both places have to lie within the cylinder's length.  A line
        along the axis does not meet the mantle.
        """
        dx, dy, dz = (b - a for a, b in zip(p, q, strict=True))
        ox, oy, oz = (a - F.lit(c) for a, c in zip(p, self.centre, strict=True))
        square, half = dx * dx + dy * dy, ox * dx + oy * dy
        rest = half * half - square * (ox * ox + oy * oy - F.lit(self.radius**2))
        root = F.sqrt(F.greatest(rest, F.lit(0.0)))
        hit = (square > 0) & (rest >= 0)
        low, high = (F.try_divide(-half + sign * root, square) for sign in (-1, 1))
        if finite:
            inside = [F.abs(oz + t * dz) <= self.length / 2 for t in (low, high)]
            hit = hit & inside[0] & inside[1]
        return F.when(hit, low), F.when(hit, high)


@dataclass(frozen=True)
class Plane:
    """The plane through three points."""

    points: tuple[tuple[float, float, float], ...]

    def __post_init__(self) -> None:
        if sum(c * c for c in self.normal) < 1e-14:
            raise ValueError("the three points are on one line")

    @property
    def normal(self) -> tuple[float, float, float]:
        p, q, r = self.points
        u, v = ([b - a for a, b in zip(p, o, strict=True)] for o in (q, r))
        return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]

    def _side(self, p: Vector) -> Column:
        return dot(tuple(map(F.lit, self.normal)), tuple(a - F.lit(c) for a, c in zip(p, self.points[0], strict=True)))

    def holds(self, p: Vector) -> Column:
        return F.abs(self._side(p)) < 1.1920929e-7

    def parallel(self, p: Vector, q: Vector) -> Column:
        return F.abs(self._side(q) - self._side(p)) < PARALLEL

    def crossing(self, p: Vector, q: Vector) -> Column:
        """Parameter from p (0) to q (1) at which the line meets the plane, null for a parallel one."""
        a, b = self._side(p), self._side(q)
        return F.when(~self.parallel(p, q), F.try_divide(a, a - b))


def along(p: Vector, q: Vector, t: Column) -> Vector:
    return tuple(a + t * (b - a) for a, b in zip(p, q, strict=True))


def tube_clip(lors: DataFrame, solid: Cylinder, trans: float, axial: float) -> DataFrame:
    """Adds whole, cx1 .. cz2 to rows with x1 .. z2 and the crystals' normals nx1 .. nz2.

    Four lines join the middles of the crystals' left, right, front and back
    edges; each is cut at the cylinder where it meets it, and the tube's new
    ends are the averages of theirs.  whole tells whether all four met it.
    """
    p, q = (tuple(F.col(f"{a}{k}") for a in "xyz") for k in "12")
    side = [(F.col(f"ny{k}"), -F.col(f"nx{k}")) for k in "12"]  # the normal times the z axis
    met, ends = F.lit(True), [[F.lit(0.0)] * 3, [F.lit(0.0)] * 3]
    for sign in (1, -1):
        lateral = tuple((*(a + s * (way * sign * trans / 2) for a, s in zip(o, own, strict=False)), o[2]) for o, own, way in ((p, side[0], 1), (q, side[1], -1)))
        level = tuple((o[0], o[1], o[2] + F.lit(sign * axial / 2)) for o in (p, q))
        for a, b in (lateral, level):
            low, high = solid.crossings(a, b)
            met = met & low.isNotNull()
            for k, (t, own) in enumerate(((low, F.lit(0.0)), (high, F.lit(1.0)))):
                at = along(a, b, F.coalesce(t, own))
                ends[k] = [x + y / 4 for x, y in zip(ends[k], at, strict=True)]
    return lors.withColumns({"whole": met} | {f"c{a}{k + 1}": ends[k][i] for k in (0, 1) for i, a in enumerate("xyz")})


def plane_distance(plane: Plane, p: Vector) -> Column:
    """Distance of a point from a plane, with the sign of the normal's side."""
    return plane._side(p) / norm(tuple(map(F.lit, plane.normal)))
