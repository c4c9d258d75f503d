"""Scalar functions as column expressions: indices, special functions, ray parameters, rotations; and Gaussian kernels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]

#: Coefficients of the rational approximation of erfc, from the constant term on.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Fixed value: full width at half maximum of a Gaussian in units of its sigma.
SIGMA_TO_FWHM = 2 * math.sqrt(2 * math.log(2))


def erfc(x: Column) -> Column:
    """Complementary error function, within 1.2e-7 of its size."""
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    tail = t * F.exp(poly - z * z)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def reflect(size: int, i: Column) -> Column:
    """Index mirrored at the borders, the border cell twice."""
    return F.when(i < 0, -1 - i).when(i >= size, 2 * size - 1 - i).otherwise(i)


def circular(size: int, i: Column) -> Column:
    """Index wrapped once."""
    return F.when(i < 0, i + size).when(i >= size, i - size).otherwise(i)


def digits(i: Column) -> Column:
    """Decimal digits of a whole number that is not negative."""
    return F.length(i.cast("string"))


def alpha_range(low: float, high: float, p1: Column, p2: Column) -> tuple[Column, Column]:
    """Part of the segment p1 -> p2 within [low, high] along one axis: (from, to); (1, 0) for a parallel line outside."""
    a, b = (F.lit(low) - p1) / (p2 - p1), (F.lit(high) - p1) / (p2 - p1)
    outside = (p1 < low) | (p1 > high)
    begin = F.when(p1 != p2, F.least(a, b)).when(outside, F.lit(1.0)).otherwise(F.lit(0.0))
    end = F.when(p1 != p2, F.greatest(a, b)).when(outside, F.lit(0.0)).otherwise(F.lit(1.0))
    return begin, end


def kernel_integral(kernel: Sequence[float], step: float, x0: Column, x1: Column) -> Column:
    """Integral from x0 to x1 of the piecewise linear function through a centred kernel; 0 where x0 >= x1.

    Each sample is a hat of width 2 steps, whose integral has a closed form.
    """
    half = (len(kernel) - 1) // 2

    def below(u: Column) -> Column:
        u = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u))
        return F.when(u < 0, (1 + u) * (1 + u) / 2).otherwise(1 - (1 - u) * (1 - u) / 2)

    parts = [F.lit(v * step) * (below(x1 / step - (i - half)) - below(x0 / step - (i - half))) for i, v in enumerate(kernel)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(x0 < x1, total).otherwise(F.lit(0.0))


def gaussian_kernel(sigma: float, voxel: float, size: int | None = None) -> list[float]:
    """Normalised samples of a Gaussian; by default 5 sigma / voxel of them, rounded to even at halves."""
    n = round(5 * sigma / voxel) if size is None else size
    raw = [math.exp(-0.5 * ((i - n // 2) * voxel / sigma) ** 2) for i in range(n)]
    return [v / sum(raw) for v in raw]


def gaussian_kernel_fwhm(fwhm: float, voxel: float, size: int | None = None) -> list[float]:
    return gaussian_kernel(fwhm / SIGMA_TO_FWHM, voxel, size)


def euler_matrix(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Rotation about x, then y, then z."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a), F.sin(a)) for a in (rx, ry, rz))
    return [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def apply_rigid(m: list[list[Column]], t: Vector, p: Vector) -> Vector:
    return tuple(dot(tuple(row), p) + t[i] for i, row in enumerate(m))


def invert_rigid(m: list[list[Column]], t: Vector) -> tuple[list[list[Column]], Vector]:
    """The transform that undoes x -> m x + t for a rotation m."""
    back = [list(col) for col in zip(*m, strict=True)]
    return back, tuple(-dot(tuple(row), t) for row in back)


def argmax_axis(v: Vector) -> Column:
    """0, 1 or 2: the axis of the greatest component, the first of equal ones."""
    return F.when((v[0] >= v[1]) & (v[0] >= v[2]), 0).when(v[1] >= v[2], 1).otherwise(2)


def axis_angle(degrees: Column, axis: Vector) -> Quaternion:
    """Unit quaternion (w, x, y, z) of a turn about an axis of any length."""
    half, size = F.radians(degrees) / 2, norm(axis)
    return F.cos(half), *(a / size * F.sin(half) for a in axis)


def quaternion_product(p: Quaternion, q: Quaternion) -> Quaternion:
    """The turn q followed by p."""
    u, v = p[1:], q[1:]
    turned = cross(u, v)
    return p[0] * q[0] - dot(u, v), *(p[0] * v[i] + q[0] * u[i] + turned[i] for i in range(3))


def quaternion_rotate(q: Quaternion, p: Vector) -> Vector:
    """p turned by a unit quaternion."""
    u = q[1:]
    turned, along = cross(u, p), dot(u, p)
    return tuple(2 * along * u[i] + (q[0] * q[0] - dot(u, u)) * p[i] + 2 * q[0] * turned[i] for i in range(3))
