"""Plain three-dimensional convolution by blocks of voxels: each block gets its own voxels and a halo of its neighbours'.

A voxel is sent once to each block that needs it (one, or a few near a border
between blocks), not once for each tap of the kernel; within a block the taps
are added up in numpy.  A block's size is a setting, so a task's memory is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.functions.cluster import ship
from tomoframe.operators.image import coords
from tomoframe.sources.views import GRID, Grid

#: Voxels of a block along x, y and z.
BLOCK = (64, 64, 64)


def _copies(c: Column, n: int, border: str, low: int, high: int) -> list[Column]:
    """Places, beyond the borders too, at which the voxel with index c is read."""
    if border == "inside":
        return [c]
    if max(low, high) > n:
        raise ValueError("the kernel reaches further than the image is wide")
    return [c, -1 - c, 2 * n - 1 - c] if border == "mirror" else [c, c - n, c + n]


def _at(p: Column, size: int, low: int):  # noqa: ANN202
    """From a block's number to (block, place in it with its halo)."""
    return lambda b: F.struct(b.alias("b"), (p - b * size + low).cast("int").alias("at"))


def convolve(image: DataFrame, kernel: np.ndarray, g: Grid = GRID, border: str = "inside", block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(t, vox, value): sums of kernel (z, y, x) times the image about each voxel.

    inside: the kernel's first tap lies on the voxel, and only voxels about
    which all of it lies within the image have a value.  mirror, circular: the
    kernel's middle lies on the voxel, and indices beyond a border are mirrored
    at it or wrap.  Absent voxels count 0.  The kernel is not reversed.
    """
    if border not in ("inside", "mirror", "circular"):
        raise ValueError(f"unknown border {border}")
    ship(image.sparkSession)
    taps = kernel.shape[::-1]
    size = (g.nx, g.ny, g.nz)
    low = [0 if border == "inside" else k // 2 for k in taps]
    high = [k - 1 - a for k, a in zip(taps, low, strict=True)]
    count = [-(-n // b) for n, b in zip(size, block, strict=True)]
    e = image.select("t", "value", *[c.alias(f"c{i}") for i, c in enumerate(coords(F.col("vox"), g))])
    for i in range(3):
        put = []
        for p in _copies(F.col(f"c{i}"), size[i], border, low[i], high[i]):
            first = F.greatest(F.floor((p - high[i]) / block[i]), F.lit(0))
            last = F.least(F.floor((p + low[i]) / block[i]), F.lit(count[i] - 1))
            seen = (p >= -low[i]) & (p < size[i] + high[i]) & (first <= last)
            blocks = F.sequence(F.when(seen, first).otherwise(F.lit(0)), F.when(seen, last).otherwise(F.lit(0)))
            put.append(F.when(seen, F.transform(blocks, _at(p, block[i], low[i]))).otherwise(F.array().cast("array<struct<b:bigint,at:int>>")))
        e = e.select(*[c for c in e.columns if c != f"c{i}"], F.explode(F.concat(*put)).alias("s")).select(*[c for c in e.columns if c != f"c{i}"], F.col("s.b").alias(f"b{i}"), F.col("s.at").alias(f"a{i}"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        t, b = key[0].as_py(), [k.as_py() for k in key[1:]]
        own = [min(n, size[i] - b[i] * n) for i, n in enumerate(block)]
        held = np.zeros([own[i] + low[i] + high[i] for i in (2, 1, 0)])
        x, y, z, v = (rows.column(c).to_numpy() for c in ("a0", "a1", "a2", "value"))
        fits = (x < held.shape[2]) & (y < held.shape[1]) & (z < held.shape[0])
        np.add.at(held, (z[fits], y[fits], x[fits]), v[fits])
        out = np.zeros(own[::-1])
        for (z, y, x), w in np.ndenumerate(kernel):
            out += w * held[z : z + own[2], y : y + own[1], x : x + own[0]]
        last = [size[i] - taps[i] + 1 if border == "inside" else size[i] for i in range(3)]
        z, y, x = (a.ravel() for a in np.indices(out.shape))
        x, y, z = (c + b[i] * block[i] for i, c in enumerate((x, y, z)))
        keep = (x < last[0]) & (y < last[1]) & (z < last[2])
        vox = (x + y * g.nx + z * g.nx * g.ny)[keep]
        return pa.Table.from_arrays([pa.repeat(pa.scalar(t, pa.int32()), len(vox)), pa.array(vox, pa.int64()), pa.array(out.ravel()[keep])], ["t", "vox", "value"])

    e = e.select(F.col("t").cast("int").alias("t"), "b0", "b1", "b2", "a0", "a1", "a2", F.col("value").cast("double").alias("value"))
    return e.groupBy("t", "b0", "b1", "b2").applyInArrow(run, "t int, vox long, value double")
