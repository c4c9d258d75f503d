"""Projectors as system-matrix tables (bin, vox, w), and what is built on them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.sources.views import GRID, Grid

#: Speed of light in mm / ps; single-precision epsilon; smallest segment kept, as a share of the line.
C_MM_PS, EPS, LEAST = 0.299792458, 1.1920929e-7, 1e-9


def tof_sigma(fwhm_ps: float) -> float:
    return float(fwhm_ps * C_MM_PS * 0.5 / (2 * np.sqrt(2 * np.log(2))))


def siddon(lors: DataFrame, g: Grid = GRID, tof: tuple[float, float] | None = None, keep: tuple[str, ...] = ("bin",)) -> DataFrame:
    """Rows (keep, vox, w): the length of each line in each voxel, inside the cylinder of the field of view.

    lors has x1 .. z2 (and tof_ps with tof = (FWHM in ps, number of sigmas)).
    All plane crossings of a line are one sorted array, neighbours are its
    segments, and a segment's midpoint names its voxel: no join and no shuffle.
    """
    e, segment = _crossed(lors, g, tof, keep)
    e = e.select(*keep, *_LINE, *(["tof_ps"] if tof and "tof_ps" not in keep else []), F.explode_outer("__pairs").alias("s")).where(F.col("s.b") - F.col("s.a") > LEAST)
    vox, w = segment(F.col("s.a"), F.col("s.b"))
    return e.select(*keep, vox.alias("vox"), w.alias("w"))


def siddon_segments(lors: DataFrame, g: Grid = GRID, tof: tuple[float, float] | None = None, keep: tuple[str, ...] = ("bin",)) -> DataFrame:
    """(keep, segments): one row a line that meets the field of view, with the (vox, w) of siddon as an array."""
    e, segment = _crossed(lors, g, tof, keep)

    def one(s: Column) -> Column:
        vox, w = segment(s["a"], s["b"])
        return F.struct(vox.alias("vox"), w.alias("w"))

    return e.select(*keep, F.transform(F.filter("__pairs", lambda s: s["b"] - s["a"] > LEAST), one).alias("segments"))


_LINE = [*[f"__p{a}1" for a in "xyz"], *[f"__d{a}" for a in "xyz"], "__len"]


def _crossed(lors: DataFrame, g: Grid, tof: tuple[float, float] | None, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[Column, Column], tuple[Column, Column]]]:
    """(lines with their neighbouring crossings as __pairs (a, b), (voxel, weight) of a pair)."""
    n, v, o = (g.nx, g.ny, g.nz), (g.vx, g.vy, g.vz), (g.ox, g.oy, g.oz)
    carried = (*keep, "tof_ps") if tof and "tof_ps" not in keep else keep
    # the work is in the crossings, not in the rows read: lines are dealt out first, however few files hold them
    e = lors.select(*carried, *[c for c in ("x1", "y1", "z1", "x2", "y2", "z2") if c not in carried]).hint("rebalance")
    e = e.withColumns({f"__p{a}{k}": F.col(f"{a}{k}") - F.lit(o[i]) for i, a in enumerate("xyz") for k in "12"})
    e = e.withColumns({f"__d{a}": F.col(f"__p{a}2") - F.col(f"__p{a}1") for a in "xyz"})
    e = e.withColumn("__len", F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy") + F.col("__dz") * F.col("__dz")))
    qa = F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy")
    qb = F.lit(2e0) * (F.col("__dx") * F.col("__px1") + F.col("__dy") * F.col("__py1"))
    qc = F.col("__px1") * F.col("__px1") + F.col("__py1") * F.col("__py1") - F.lit(g.fov * g.fov)
    e = e.withColumns({"__qa": qa, "__qb": qb, "__disc": qb * qb - F.lit(4e0) * qa * qc})
    meets = (F.col("__len") > 0) & ((F.col("__qa") == 0) | (F.col("__disc") > 0))
    lo = [F.lit(0e0), F.when(F.col("__qa") != 0, (-F.col("__qb") - F.sqrt("__disc")) / (F.lit(2e0) * F.col("__qa"))).otherwise(F.lit(0e0))]
    hi = [F.lit(1e0), F.when(F.col("__qa") != 0, (-F.col("__qb") + F.sqrt("__disc")) / (F.lit(2e0) * F.col("__qa"))).otherwise(F.lit(1e0))]
    for i, a in enumerate("xyz"):
        half = n[i] * v[i] / 2
        p, d = F.col(f"__p{a}1"), F.col(f"__d{a}")
        one, two = (F.lit(-half) - p) / d, (F.lit(half) - p) / d
        meets = meets & ((d != 0) | p.between(-half, half))
        lo.append(F.when(d != 0, F.least(one, two)).otherwise(F.lit(0e0)))
        hi.append(F.when(d != 0, F.greatest(one, two)).otherwise(F.lit(1e0)))
    if tof:
        sigma = tof_sigma(tof[0])
        at = F.col("tof_ps") * (C_MM_PS * 0.5)
        lo.append(F.lit(0.5) + F.try_divide(at - tof[1] * sigma, F.col("__len")))
        hi.append(F.lit(0.5) + F.try_divide(at + tof[1] * sigma, F.col("__len")))
    # the generator keeps the optimizer from writing these out again in a condition that it moves towards the files
    ends = F.struct(F.greatest(*lo).alias("lo"), F.least(*hi).alias("hi"), meets.alias("meets"))
    e = e.withColumn("__ends", F.explode(F.array(ends))).where("__ends.meets AND __ends.hi > __ends.lo")
    e = e.select(*carried, *_LINE, F.col("__ends.lo").alias("__lo"), F.col("__ends.hi").alias("__hi"))

    def crossings(i: int, a: str) -> Column:
        at = lambda k: (k * F.lit(v[i]) - F.lit(n[i] * v[i] / 2) - F.col(f"__p{a}1")) / F.col(f"__d{a}")
        return F.transform(F.sequence(F.lit(0), F.lit(n[i])), lambda k: F.when(F.col(f"__d{a}") != 0, at(k)))

    cuts = [crossings(i, a) for i, a in enumerate("xyz")]
    inside = F.filter(F.concat(*cuts), lambda x: x.isNotNull() & (x > F.col("__lo")) & (x < F.col("__hi")))
    e = e.withColumn("__cut", F.sort_array(F.concat(F.array("__lo", "__hi"), inside)))
    pairs = F.transform(F.sequence(F.lit(1), F.size("__cut") - 1), lambda k: F.struct(F.get("__cut", k - 1).alias("a"), F.get("__cut", k).alias("b")))
    e = e.select(*carried, *_LINE, pairs.alias("__pairs"))

    def segment(a: Column, b: Column) -> tuple[Column, Column]:
        mid = (a + b) / 2
        index = [F.least(F.greatest(F.floor((F.col(f"__p{c}1") + mid * F.col(f"__d{c}") + F.lit(n[i] * v[i] / 2)) / v[i]), F.lit(0)), F.lit(n[i] - 1)) for i, c in enumerate("xyz")]
        w = (b - a) * F.col("__len")
        if tof:
            off = (mid - F.lit(0.5)) * F.col("__len") - F.col("tof_ps") * (C_MM_PS * 0.5)
            w = w * F.exp(F.lit(-0.5) * (off / sigma) * (off / sigma)) * (1 / ((2 * 3.141592653589793) ** 0.5 * sigma))
        return index[0] + index[1] * g.nx + index[2] * g.nx * g.ny, w

    return e, segment


def multi_ray(lors: DataFrame, rays: int, size: float = 1.0, key: str = "bin") -> DataFrame:
    """Each line several times: the first as it is, the others with endpoints moved by hashes of (key, ray) within the crystal.

    The average over rays is the sum of their weights over the number of rays.
    """
    e = lors.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))))
    shift = lambda c: F.when(F.col("ray") == 0, F.lit(0e0)).otherwise((F.pmod(F.xxhash64(key, "ray", F.lit(c)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * size)
    return e.withColumns({c: F.col(c) + shift(c) for c in ("x1", "y1", "z1", "x2", "y2", "z2")})


#: Irrational steps of the additive recurrences that place rays within the crystals, one for each of six coordinates.
RAY_STEPS = (0.8566748838545029, 0.7338918566271260, 0.6287067210378087, 0.5385972572236101, 0.4614027427763899, 0.3952761212186013)


def crystal_rays(lors: DataFrame, rays: int, axial: float, trans: float, depth: float = 0.0, parallel: bool = False, key: str = "bin") -> DataFrame:
    """Each line several times, with ray: the first as it is, the others from a place within one crystal to one within the other.

    lors has x1 .. z2 and the detectors' normals nx1 .. nz2; a place lies up to
    half of axial along z, of trans across the normal and of depth along it;
    parallel rays are moved alike at both ends along the first two.  Places follow from
    (key, ray) alone, so a task that is run again draws the same ones.
    """
    e = lors.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))))
    number = F.pmod(F.col(key) * rays + F.col("ray"), F.lit(1_000_003))
    e = e.withColumns({f"__u{i}": F.when(F.col("ray") == 0, F.lit(0.0)).otherwise(number * F.lit(s) - F.floor(number * F.lit(s)) - F.lit(0.5)) for i, s in enumerate(RAY_STEPS)})
    out = {}
    for k, side, (i, j, m) in (("1", 1, (0, 1, 4)), ("2", -1, (0, 1, 5) if parallel else (2, 3, 5))):
        nx, ny, nz = (F.col(f"n{a}{k}") for a in "xyz")
        across = F.col(f"__u{j}") * F.lit(side * trans) / F.hypot(nx, ny)
        deep = F.col(f"__u{m}") * F.lit(depth)
        out |= {f"x{k}": F.col(f"x{k}") + ny * across + nx * deep, f"y{k}": F.col(f"y{k}") - nx * across + ny * deep, f"z{k}": F.col(f"z{k}") + F.col(f"__u{i}") * F.lit(axial) + nz * deep}
    # the generator keeps the optimizer from writing the ends out again wherever a projector uses them
    e = e.withColumn("__e", F.explode(F.array(F.struct(*[v.alias(c) for c, v in out.items()]))))
    return e.withColumns({c: F.col(f"__e.{c}") for c in out}).drop("__e", *[f"__u{i}" for i in range(6)])


def forward(matrix: DataFrame, image: DataFrame, key: str = "bin") -> DataFrame:
    """(key, value): sum of w * x."""
    return matrix.join(image.select("vox", F.col("value").alias("__x")), "vox").groupBy(key).agg(F.sum(F.col("w") * F.col("__x")).alias("value"))


def back(matrix: DataFrame, data: DataFrame, key: str = "bin") -> DataFrame:
    """(vox, value): sum of w * y; rows of value 0 are skipped."""
    y = data.where("value <> 0").select(key, F.col("value").alias("__y"))
    return matrix.join(y, key).groupBy("vox").agg(F.sum(F.col("w") * F.col("__y")).alias("value"))


def back_lors(lors: DataFrame, g: Grid = GRID, tof: tuple[float, float] | None = None) -> DataFrame:
    """(vox, value): sum of w * y over lines with their value: it travels with the line, so nothing is joined."""
    m = siddon(lors.where("value <> 0"), g, tof, keep=("value",))
    return m.groupBy("vox").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def attenuation(value: Column) -> Column:
    """Survival factor of a line integral of an attenuation image (1/cm, lengths in mm)."""
    return F.exp(F.lit(-0.1) * value)
