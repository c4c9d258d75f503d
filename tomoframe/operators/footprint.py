"""Distance-driven projector as column expressions: overlap of the detectors' footprint with the pixels of each slice across the line.

A line's slices lie along x or y, whichever it runs along.  In each slice the
edges of both crystals cast a shadow across the line and along z; a pixel's
weight is its share of that shadow, times the slice's length along the line.
With time of flight a slice is weighted by a Gaussian about the measured place;
with a projection-space PSF the overlap across the line is the integral of the
line's kernel over it, and the kernel is reversed for the adjoint.

Slices, pixels and planes are generated row by row, so nothing is shuffled
before the sum, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.operators.project import C_MM_PS, tof_sigma
from tomoframe.operators.psf import ProjectionPsf
from tomoframe.sources.views import GRID, Grid

ENDS = ("x1", "y1", "z1", "x2", "y2", "z2")
NORMALS = ("nx1", "ny1", "nz1", "nx2", "ny2", "nz2")


def _pin(e: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """keep and new columns behind a generator, which keeps the optimizer from writing them out again at each use."""
    made = F.struct(*[c.alias(k) for k, c in cols.items()])
    return e.select(*keep, F.explode(F.array(made)).alias("__p")).select(*keep, "__p.*")


def _cells(e: DataFrame, keep: list[str], name: str, first: Column, last: Column) -> DataFrame:
    """One row for each whole number from first to last; none if last is less."""
    return e.where(first <= last).select(*keep, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias(name))


def distance_driven(
    lors: DataFrame,
    g: Grid = GRID,
    trans: float = 1.0,
    axial: float = 1.0,
    keep: tuple[str, ...] = ("bin",),
    tof: tuple[float, float] | None = None,
    psf: ProjectionPsf | None = None,
    adjoint: bool = False,
) -> DataFrame:
    """Rows (keep, vox, w) of lines with x1 .. z2 and the crystals' normals nx1 .. nz2.

    trans and axial are the crystal's sizes; tof = (FWHM in ps, number of
    sigmas, 0 for all) needs tof_ps.  Lines along z and of no length have no
    slices and so no rows.
    """
    own = list(keep)
    e = lors.select(*own, *[(F.col(c) - F.lit(o)).alias(f"__{c}") for c, o in zip(ENDS, (g.ox, g.oy, g.oz) * 2, strict=True)], *[F.col(c).alias(f"__{c}") for c in NORMALS], (F.col("tof_ps") * (C_MM_PS * 0.5) if tof else F.lit(0.0)).alias("__at"))
    dx, dy, dz = (F.col(f"__{a}2") - F.col(f"__{a}1") for a in "xyz")
    length, along_y = F.sqrt(dx * dx + dy * dy + dz * dz), F.abs(dy) > F.abs(dx)
    e = e.where((dx != 0) | (dy != 0))
    of = lambda x, y: F.when(along_y, x).otherwise(y)
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for a, d, n, v in (("x", dx, g.nx, g.vx), ("y", dy, g.ny, g.vy), ("z", dz, g.nz, g.vz)):
        half, p = (n * v - v) / 2, F.col(f"__{a}1")
        one, two = F.try_divide(F.lit(-half) - p, d), F.try_divide(F.lit(half) - p, d)
        inside = p.between(-half, half)
        low.append(F.when(d != 0, F.least(one, two)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)))
        high.append(F.when(d != 0, F.greatest(one, two)).otherwise(F.lit(1.0)))
    if tof and tof[1] > 0:
        reach = tof[1] * tof_sigma(tof[0])
        low.append(F.lit(0.5) + (F.col("__at") - reach) / length)
        high.append(F.lit(0.5) + (F.col("__at") + reach) / length)
    made = {"length": length, "low": F.greatest(*low), "high": F.least(*high), "along_y": along_y, "at": F.col("__at")}
    for k in "12":
        nx, ny, nz = (F.col(f"__n{a}{k}") for a in "xyz")
        flat = F.sqrt(nx * nx + ny * ny)
        # across the normal in the plane: (ny, -nx, 0) / flat; across both: their cross product, of length |n|
        size = flat * F.sqrt(nx * nx + ny * ny + nz * nz)
        made |= {
            f"m{k}": of(F.col(f"__y{k}"), F.col(f"__x{k}")), f"c{k}": of(F.col(f"__x{k}"), F.col(f"__y{k}")), f"z{k}": F.col(f"__z{k}"),
            f"sm{k}": of(-nx, ny) / flat * (trans / 2), f"sc{k}": of(ny, -nx) / flat * (trans / 2),
            f"tm{k}": of(ny, nx) * nz / size * (axial / 2), f"tz{k}": -flat * flat / size * (axial / 2),
        }
    if psf is not None:
        made["kernel"] = psf.number(*(F.col(f"__{c}") for c in ("x1", "y1", "x2", "y2")))
    lines = list(made) + own
    e = _pin(e, own, **made).where("low <= high")
    n_main, d_main, n_cross, d_cross = (F.when(F.col("along_y"), F.lit(a)).otherwise(F.lit(b)) for a, b in ((g.ny, g.nx), (g.vy, g.vx), (g.nx, g.ny), (g.vx, g.vy)))
    m1, m2 = F.col("m1"), F.col("m2")
    place = lambda t: F.floor((m1 + F.col(t) * (m2 - m1)) / d_main + n_main / 2)
    e = _cells(e, lines, "i", F.greatest(F.lit(0), F.least(place("low"), place("high"))), F.least(n_main - 1, F.greatest(place("low"), place("high"))))

    pix = (F.col("i") + F.lit(0.5) - n_main / 2) * d_main

    def shadow(main: str, over: str, side: str, edge: int, other: int) -> Column:
        """Where the line from one crystal's edge to the other's crosses the slice."""
        p, q = (F.col(f"m{k}") + s * F.col(f"{main}{k}") for k, s in ((1, edge), (2, other)))
        a, b = (F.col(f"{over}{k}") + s * F.col(f"{side}{k}") for k, s in ((1, edge), (2, other)))
        return a + F.try_divide(pix - p, q - p) * (b - a)

    cut = [shadow("sm", "c", "sc", s, -s) for s in (-1, 1)]
    level = [shadow("tm", "z", "tz", s, s) for s in (-1, 1)]
    slice_at = {"c0": F.least(*cut), "c1": F.greatest(*cut), "k0": F.least(*level), "k1": F.greatest(*level), "step": d_main * F.col("length") / F.abs(m2 - m1)}
    if tof:
        sigma = tof_sigma(tof[0])
        off = ((pix - m1) / (m2 - m1) - F.lit(0.5)) * F.col("length") - F.col("at")
        slice_at["step"] = slice_at["step"] * F.exp(F.lit(-0.5) * (off / sigma) * (off / sigma)) * F.lit(1 / ((2 * 3.141592653589793) ** 0.5 * sigma))
    kept = [*own, "along_y", "i"] + ["kernel"] * (psf is not None)
    e = _pin(e, kept, **slice_at).where(" AND ".join(f"{c} IS NOT NULL" for c in ("c0", "c1", "k0", "k1")) + " AND c1 > c0 AND k1 > k0")
    wide = psf.half_width if psf is not None else 0.0
    cell = lambda x, n, d: F.least(F.greatest(F.floor(x / d + n / 2), F.lit(0)), n - 1)
    e = _cells(e, [*kept, *slice_at], "j", cell(F.col("c0") - wide, n_cross, d_cross), cell(F.col("c1") + wide, n_cross, d_cross))
    left = (F.col("j") - n_cross / 2) * d_cross
    if psf is not None:
        across = psf.weight(F.col("kernel"), left - F.col("c1"), left + d_cross - F.col("c0"), flipped=adjoint)
    else:
        across = F.least(left + d_cross, F.col("c1")) - F.greatest(left, F.col("c0"))
    e = e.select(*own, "along_y", "i", "j", "k0", "k1", (across / (F.col("c1") - F.col("c0")) * F.col("step")).alias("wc")).where("wc > 0")
    n_z, d_z = F.lit(g.nz), F.lit(g.vz)
    e = _cells(e, [*own, "along_y", "i", "j", "k0", "k1", "wc"], "k", cell(F.col("k0"), n_z, d_z), cell(F.col("k1"), n_z, d_z))
    bottom = (F.col("k") - n_z / 2) * d_z
    part = (F.least(bottom + d_z, F.col("k1")) - F.greatest(bottom, F.col("k0"))) / (F.col("k1") - F.col("k0"))
    vox = F.when(F.col("along_y"), F.col("j") + F.col("i") * g.nx).otherwise(F.col("i") + F.col("j") * g.nx) + F.col("k") * (g.nx * g.ny)
    return e.select(*own, vox.cast("long").alias("vox"), (F.col("wc") * part).alias("w")).where("w > 0")


def back_lors(lors: DataFrame, g: Grid = GRID, trans: float = 1.0, axial: float = 1.0, tof: tuple[float, float] | None = None, psf: ProjectionPsf | None = None) -> DataFrame:
    """(vox, value): sum of w * y over lines with their value, the adjoint of the forward projection."""
    m = distance_driven(lors.where("value <> 0"), g, trans, axial, ("value",), tof, psf, adjoint=True)
    return m.groupBy("vox").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
