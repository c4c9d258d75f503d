"""Images as voxel tables (t, vox, value): point operations, filters, transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.sources.views import GRID, Grid


def coords(vox: Column, g: Grid = GRID) -> tuple[Column, Column, Column]:
    return vox % g.nx, F.floor(vox / g.nx) % g.ny, F.floor(vox / (g.nx * g.ny))


def centres(vox: Column, g: Grid = GRID) -> tuple[Column, Column, Column]:
    ix, iy, iz = coords(vox, g)
    return (ix - F.lit((g.nx - 1) / 2)) * g.vx + g.ox, (iy - F.lit((g.ny - 1) / 2)) * g.vy + g.oy, (iz - F.lit((g.nz - 1) / 2)) * g.vz + g.oz


def threshold_select(image: DataFrame, mask: DataFrame, at: float, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """low[0] * x + low[1] where mask <= at, else high[0] * x + high[1]; the 3-D mask serves all frames."""
    e = image.join(mask.select("vox", F.col("value").alias("__m")), "vox")
    x = F.when(F.col("__m") <= at, low[0] * F.col("value") + low[1]).otherwise(high[0] * F.col("value") + high[1])
    return e.select("t", "vox", x.alias("value"))


def em_update(image: DataFrame, update: DataFrame, sens: DataFrame, threshold: float = 0.0, scaling: DataFrame | None = None) -> DataFrame:
    """x *= (u / c) / s where s > threshold / c; else x stays. scaling: (t, c) by frame or rank, 1 without it."""
    e = image.join(update.select("t", "vox", F.col("value").alias("u")), ["t", "vox"]).join(sens.select("vox", "sens"), "vox")
    e = e.join(scaling, "t") if scaling is not None else e.withColumn("c", F.lit(1.0))
    x = F.when(F.col("sens") > threshold / F.col("c"), F.col("value") * (F.col("u") / F.col("c")) / F.col("sens")).otherwise(F.col("value"))
    return e.select("t", "vox", x.alias("value"))


def em_update_4d(image: DataFrame, update: DataFrame, sens: DataFrame, threshold: float = 0.0) -> DataFrame:
    """x *= u / s where s > threshold, by frame and voxel; sens is (t, vox, sens)."""
    e = image.join(update.select("t", "vox", F.col("value").alias("u")), ["t", "vox"]).join(sens.select("t", "vox", "sens"), ["t", "vox"])
    return e.select("t", "vox", F.when(F.col("sens") > threshold, F.col("value") * F.col("u") / F.col("sens")).otherwise(F.col("value")).alias("value"))


def convolve_axis(image: DataFrame, kernel: list[float], axis: int, g: Grid = GRID, adjoint: bool = False) -> DataFrame:
    """Circular convolution along one axis: each voxel sends its weighted value to its neighbours, one partial aggregate."""
    n, step = (g.nx, g.ny, g.nz)[axis], (1, g.nx, g.nx * g.ny)[axis]
    half = len(kernel) // 2
    taps = [(k - half, w) for k, w in enumerate(kernel[::-1] if adjoint else kernel)]
    i = coords(F.col("vox"), g)[axis]
    sent = F.explode(F.array(*[F.struct((F.col("vox") + (F.pmod(i + k, F.lit(n)) - i) * step).cast("long").alias("vox"), (F.col("value") * w).alias("value")) for k, w in taps])).alias("o")
    return image.select("t", sent).groupBy("t", "o.vox").agg(F.sum("o.value").alias("value"))


def psf(image: DataFrame, kernels: tuple[list[float], list[float], list[float]], g: Grid = GRID, adjoint: bool = False) -> DataFrame:
    for axis, kernel in enumerate(kernels):
        image = convolve_axis(image, kernel, axis, g, adjoint)
    return image


def variant_psf(image: DataFrame, g: Grid = GRID, gap: float = 60.0, most: int = 1, adjoint: bool = False) -> DataFrame:
    """Per-voxel kernels: the weight of a neighbour within one step along x is that of the nearest grid point of |x|.

    forward gathers with the kernel of the target, adjoint scatters with it.
    """
    x, _, _ = centres(F.col("vox"), g)
    k = F.least(F.round(F.abs(x) / gap), F.lit(float(most)))
    side = F.lit(0.1) + F.lit(0.05) * k
    ix = coords(F.col("vox"), g)[0]
    targets = F.array(*[F.struct((F.col("vox") + F.pmod(ix + d, F.lit(g.nx)) - ix).cast("long").alias("other"), (F.lit(1.0) - 2 * side if d == 0 else side).alias("w")) for d in (-1, 0, 1)])
    rows = image.select("t", F.col("vox"), "value", F.explode(targets).alias("o")).select("t", "vox", "value", "o.other", "o.w")
    if adjoint:
        return rows.groupBy("t", F.col("other").alias("vox")).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    src = image.select("t", F.col("vox").alias("other"), F.col("value").alias("__v"))
    return rows.drop("value").join(src, ["t", "other"]).groupBy("t", "vox").agg(F.sum(F.col("w") * F.col("__v")).alias("value"))


def corners(rows: DataFrame, x: Column, y: Column, z: Column, g: Grid = GRID) -> DataFrame:
    """Explodes rows into the up to 8 voxels around a point, with trilinear weights: columns src, w."""
    cx, cy, cz = ((p - F.lit(o) + F.lit((n - 1) / 2 * v)) / v for p, o, n, v in ((x, g.ox, g.nx, g.vx), (y, g.oy, g.ny, g.vy), (z, g.oz, g.nz, g.vz)))
    e = rows.withColumns({"__cx": cx, "__cy": cy, "__cz": cz})
    e = e.withColumns({f"__i{a}": F.floor(f"__c{a}") for a in "xyz"}).withColumns({f"__f{a}": F.col(f"__c{a}") - F.floor(f"__c{a}") for a in "xyz"})
    out = []
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                w = (F.col("__fx") if dx else 1 - F.col("__fx")) * (F.col("__fy") if dy else 1 - F.col("__fy")) * (F.col("__fz") if dz else 1 - F.col("__fz"))
                i, j, k = F.col("__ix") + dx, F.col("__iy") + dy, F.col("__iz") + dz
                inside = i.between(0, g.nx - 1) & j.between(0, g.ny - 1) & k.between(0, g.nz - 1)
                out.append(F.when(inside, F.struct((i + j * g.nx + k * g.nx * g.ny).alias("src"), w.alias("w"))))
    e = e.withColumn("__o", F.explode(F.filter(F.array(*out), lambda o: o.isNotNull())))
    return e.withColumns({"src": F.col("__o.src"), "w": F.col("__o.w")}).drop("__o", *[f"__{p}{a}" for p in "cif" for a in "xyz"])


def transform(image: DataFrame, spark_range: DataFrame, moves: DataFrame, g: Grid = GRID) -> DataFrame:
    """(vox, value): sum over moves (c, s, tx, ty, tz, weight) of weight * image, moved: inverse transform, trilinear, frame 0.

    spark_range has one row a target voxel (vox).  moves is a short table.
    """
    x, y, z = centres(F.col("vox"), g)
    e = spark_range.crossJoin(moves)  # target voxels times a few moves
    e = e.withColumns({"__x": x - F.col("tx"), "__y": y - F.col("ty"), "__z": z - F.col("tz")})
    back = corners(e, F.col("c") * F.col("__x") + F.col("s") * F.col("__y"), F.col("c") * F.col("__y") - F.col("s") * F.col("__x"), F.col("__z"), g)
    src = image.where("t = 0").select(F.col("vox").alias("src"), F.col("value").alias("__v"))
    return back.join(src, "src").groupBy("vox").agg(F.sum(F.col("weight") * F.col("w") * F.col("__v")).alias("value"))


def transform_rigid(image: DataFrame, targets: DataFrame, moves: DataFrame, g: Grid = GRID) -> DataFrame:
    """(vox, value): sum over moves (t, r00 .. tz, weight) of weight * frame t of the image, moved by its 3 x 4 transform.

    targets has one row a voxel (vox).  The value at a voxel is read, by
    trilinear interpolation, where the inverse transform takes its centre.
    """
    p = centres(F.col("vox"), g)
    e = targets.crossJoin(moves)  # target voxels times one row a frame
    e = e.withColumns({f"__{a}": c - F.col(f"t{a}") for a, c in zip("xyz", p, strict=True)})
    at = [F.col(f"r0{j}") * F.col("__x") + F.col(f"r1{j}") * F.col("__y") + F.col(f"r2{j}") * F.col("__z") for j in range(3)]
    back = corners(e, *at, g)
    src = image.select("t", F.col("vox").alias("src"), F.col("value").alias("__v"))
    return back.join(src, ["t", "src"]).groupBy("vox").agg(F.sum(F.col("weight") * F.col("w") * F.col("__v")).alias("value"))


def motion_correct(image: DataFrame, targets: DataFrame, motion: DataFrame, g: Grid = GRID) -> DataFrame:
    """(vox, value): frame images, one a motion row, moved by its transform and averaged by its share of the time.

    motion has frame, duration and the 3 x 4 transform.
    """
    total = motion.agg(F.sum("duration").alias("__d"))
    moves = motion.crossJoin(total).withColumn("weight", F.col("duration") / F.col("__d"))  # one row
    return transform_rigid(image, targets, moves.withColumnRenamed("frame", "t"), g)


def resample(image: DataFrame, targets: DataFrame, to: Grid, g: Grid = GRID) -> DataFrame:
    """(vox, value): frame 0 of an image on grid g, read by trilinear interpolation at the voxel centres of another grid.

    targets has one row a voxel of that grid (vox); voxels that no voxel of g reaches are 0.
    """
    back = corners(targets, *centres(F.col("vox"), to), g)
    src = image.where("t = 0").select(F.col("vox").alias("src"), F.col("value").alias("__v"))
    got = back.join(src, "src").groupBy("vox").agg(F.sum(F.col("w") * F.col("__v")).alias("__s"))
    return targets.join(got, "vox", "left").select("vox", F.coalesce("__s", F.lit(0.0)).alias("value"))
