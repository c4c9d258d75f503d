"""Kernels that vary over the image: Gaussians on a grid of positions, and the projection-space choice by distance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.functions import scalars
from tomoframe.operators.image import coords
from tomoframe.sources.formats import read_numbers
from tomoframe.sources.views import GRID, Grid

Triple = tuple[float, float, float]
Tap = tuple[int, int, int, float]


def gaussian_box(sigma: Triple, stds: Triple, g: Grid = GRID, other: Triple | None = None, share: float = 0.0) -> list[Tap]:
    """Normalised taps (dx, dy, dz, w); with a second Gaussian of the given share, the mixture of both.

    The box reaches one voxel less than stds standard deviations of the wider
    one, and one voxel at least.
    """
    if min(*sigma, *(other or sigma)) <= 0 or not 0 <= share <= 1:
        raise ValueError("sigmas must be positive and the share within 0 and 1")
    size = (g.vx, g.vy, g.vz)
    reach = [max(1, math.floor(max(a, b) * n / v) - 1) for a, b, n, v in zip(sigma, other or sigma, stds, size, strict=True)]
    box = list(itertools.product(*(range(-r, r + 1) for r in reach)))

    def shape(s: Triple) -> list[float]:
        raw = [math.exp(-sum((k * v / a) ** 2 for k, v, a in zip(at, size, s, strict=True)) / 2) for at in box]
        return [x / sum(raw) for x in raw]

    w = shape(sigma)
    if other:
        w = [(1 - share) * a + share * b for a, b in zip(w, shape(other), strict=True)]
    return [(*at, x) for at, x in zip(box, w, strict=True)]


@dataclass(frozen=True)
class VariantPsf:
    """Kernels on a grid over one octant: those for |x|, |y|, |z| at multiples of gap up to reach, x fastest."""

    reach: Triple
    gap: Triple
    kernels: tuple[list[Tap], ...]

    def __post_init__(self) -> None:
        if len(self.kernels) != math.prod(self.counts):
            raise ValueError("the number of kernels does not fit the grid")

    @property
    def counts(self) -> tuple[int, int, int]:
        return tuple(math.floor(r / d) + 1 for r, d in zip(self.reach, self.gap, strict=True))

    def nearest(self, vox: Column, g: Grid = GRID) -> Column:
        """Number of the kernel nearest to a voxel, by distance from the middle of the image; halves away from it."""
        index, step = F.lit(0), 1
        for i, size, v, d, n in zip(coords(vox, g), (g.nx, g.ny, g.nz), (g.vx, g.vy, g.vz), self.gap, self.counts, strict=True):
            at = F.abs((i + F.lit(0.5)) * v - F.lit(size * v / 2))
            index = index + F.least(F.floor(at / d + F.lit(0.5)), F.lit(n - 1)) * step
            step *= n
        return index.cast("int")


def read_variant_psf(text: str, g: Grid = GRID) -> VariantPsf:
    """Reach, gap and standard deviations in three lines; then one kernel a line: 3 sigmas, or 3 + 3 and the second's share."""
    rows = [[float(x) for x in line.split(",") if x.strip()] for line in text.splitlines() if line.strip()]
    if len(rows) < 4 or {len(r) for r in rows[3:]} not in ({3}, {7}):
        raise ValueError("three lines of settings and at least one kernel of 3 or 7 numbers are needed")
    reach, gap, stds = (tuple(r[:3]) for r in rows[:3])
    kernels = tuple(gaussian_box(tuple(r[:3]), stds, g, tuple(r[3:6]) or None, r[6] if len(r) == 7 else 0.0) for r in rows[3:])
    return VariantPsf(reach, gap, kernels)


def variant(image: DataFrame, psf: VariantPsf, g: Grid = GRID, adjoint: bool = False) -> DataFrame:
    """(t, vox, value): each voxel gathers its neighbours' values with its own kernel; the adjoint spreads it with that kernel.

    Indices wrap at the borders.  A voxel sends its value out, weighted with
    the receiver's kernel (the adjoint: its own), which meets it by an equi
    join with the table of taps, whose size is that of the settings.  So the
    image is exchanged once, by the aggregate, and never joined with itself.
    """
    taps = image.sparkSession.createDataFrame([(n, *t) for n, k in enumerate(psf.kernels) for t in k], "kernel int, dx int, dy int, dz int, w double")

    def moved(sign: int) -> Column:
        i = coords(F.col("vox"), g)
        to = [F.pmod(a + sign * F.col(f"d{c}"), F.lit(n)) for a, c, n in zip(i, "xyz", (g.nx, g.ny, g.nz), strict=True)]
        return (to[0] + to[1] * g.nx + to[2] * (g.nx * g.ny)).cast("long")

    if adjoint:
        e = image.withColumn("kernel", psf.nearest(F.col("vox"), g)).join(taps, "kernel").withColumn("to", moved(1))
    else:
        box = sorted({t[:3] for k in psf.kernels for t in k})
        e = image.withColumn("d", F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for x, c in zip(at, "xyz", strict=True)]) for at in box])))
        e = e.select("t", "vox", "value", "d.*").withColumn("to", moved(-1))
        e = e.withColumn("kernel", psf.nearest(F.col("to"), g)).join(taps, ["kernel", "dx", "dy", "dz"])
    return e.groupBy("t", F.col("to").alias("vox")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


@dataclass(frozen=True)
class ProjectionPsf:
    """Kernels across a line, one for each step of its distance from the axis, with the spacing of their samples."""

    step: float
    spacing: float
    kernels: tuple[list[float], ...]

    @property
    def half_width(self) -> float:
        return (len(self.kernels[0]) + 1) // 2 * self.spacing

    def number(self, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        """Number of a line's kernel; 0 for a line along the axis."""
        size = F.hypot(x2 - x1, y2 - y1)
        away = F.abs(x1 * (y2 - y1) - y1 * (x2 - x1)) / size
        return F.when(size == 0, 0).otherwise(F.least(F.floor(away / self.step), F.lit(len(self.kernels) - 1))).cast("int")

    def weight(self, number: Column, x0: Column, x1: Column, flipped: bool = False) -> Column:
        """Integral of a kernel from x0 to x1, 0 beyond its half width and where x0 >= x1."""
        out = F.lit(0.0)
        for k, taps in enumerate(self.kernels):
            out = F.when(number == k, scalars.kernel_integral(taps[::-1] if flipped else taps, self.spacing, x0, x1)).otherwise(out)
        return F.when((x0 > self.half_width) | (x1 < -self.half_width), F.lit(0.0)).otherwise(out)


def read_projection_psf(text: str) -> ProjectionPsf:
    """One line: step, spacing, odd size of a kernel, then the kernels."""
    step, spacing, size, *rest = read_numbers(text)[0].tolist()
    n = int(size)
    if n % 2 == 0:
        raise ValueError("kernels must be of odd length")
    return ProjectionPsf(step, spacing, tuple(rest[i : i + n] for i in range(0, len(rest) // n * n, n)))
