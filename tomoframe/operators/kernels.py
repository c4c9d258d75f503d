"""Kernel matrices (i, j, k) over a voxel grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomoframe.operators.aggregate import exclusive_prefix_all


def _coords(v: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    return v % nx, F.floor(v / nx) % ny, F.floor(v / (nx * ny))


def _offsets(w: int) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for z in range(-w, w + 1) for y in range(-w, w + 1) for x in range(-w, w + 1)])


def neighbours(image: DataFrame, nx: int, ny: int, nz: int, w: int, sigma2: float) -> DataFrame:
    """(n, i, j, k): the cube of half-width w, clamped at the borders (so neighbours repeat there), exp(-d^2 / (2 sigma2))."""
    x, y, z = _coords(F.col("i"), nx, ny)
    e = image.select(F.col("vox").alias("i"), F.col("value").alias("vi")).select("i", "vi", F.posexplode(_offsets(w)).alias("n", "o"))
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c))
    j = clamp(z + F.col("o.z"), nz) * (nx * ny) + clamp(y + F.col("o.y"), ny) * nx + clamp(x + F.col("o.x"), nx)
    e = e.select("n", "i", "vi", j.cast("long").alias("j"))
    d = F.col("vi") - F.col("vj")
    return e.join(image.select(F.col("vox").alias("j"), F.col("value").alias("vj")), "j").select("n", "i", "j", F.exp(F.lit(-1 / (2 * sigma2)) * d * d).alias("k"))


def nearest_in_window(image: DataFrame, nx: int, ny: int, nz: int, w: int, p: int, most: int, sigma2: float) -> DataFrame:
    """(i, j, k): the `most` nearest voxels of a window by patch distance (borders mirrored), exp(-d / sigma2), rows sum to 1; ties by j."""
    mirror = lambda c, n: F.when(c < 0, -c - 1).when(c >= n, 2 * n - 1 - c).otherwise(c)
    x, y, z = _coords(F.col("vox"), nx, ny)
    patch = image.select("vox", F.posexplode(_offsets(p)).alias("n", "o")).withColumn("src", (mirror(z + F.col("o.z"), nz) * (nx * ny) + mirror(y + F.col("o.y"), ny) * nx + mirror(x + F.col("o.x"), nx)).cast("long"))
    patch = patch.join(image.select(F.col("vox").alias("src"), "value"), "src").groupBy("vox").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda s: s["value"]).alias("patch"))
    e = patch.select(F.col("vox").alias("i"), F.col("patch").alias("a"), F.explode(_offsets(w)).alias("o"))
    x, y, z = _coords(F.col("i"), nx, ny)
    e = e.where((x + F.col("o.x")).between(0, nx - 1) & (y + F.col("o.y")).between(0, ny - 1) & (z + F.col("o.z")).between(0, nz - 1))
    e = e.withColumn("j", (F.col("i") + F.col("o.x") + F.col("o.y") * nx + F.col("o.z") * nx * ny).cast("long")).join(patch.select(F.col("vox").alias("j"), F.col("patch").alias("b")), "j")
    # beside voxels that the image lacks, patches are shorter: what only one of two has counts nothing
    d = F.aggregate(F.zip_with("a", "b", lambda s, t: (s - t) * (s - t)), F.lit(0e0), lambda acc, v: acc + F.coalesce(v, F.lit(0e0)))
    e = e.select("i", "j", d.alias("d")).withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rn") <= most)
    e = e.withColumn("__k", F.exp(F.lit(-1 / sigma2) * F.col("d")))
    return e.select("i", "j", (F.col("__k") / F.sum("__k").over(Window.partitionBy("i").orderBy("d", "j").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("k"))


#: Distinct intensities that one task orders.
BLOCK = 4096


def nearest_by_value(image: DataFrame, most: int, sigma2: float, block: int = BLOCK) -> DataFrame:
    """(i, j, k): the `most` voxels nearest in intensity over the whole image, exp(-d^2 / (2 sigma2)); ties by j.

    In order of intensity the nearest of a voxel lie among the `most` distinct
    intensities before and after its own, with at most the `most` smallest ids
    of each.  The intensities are numbered by a range shuffle and cut into
    blocks of consecutive ones; each block also gets the `most` beyond either
    border, so no task sees more than a block and its halo.
    """
    if most >= block:
        raise ValueError(f"at most {block - 1} neighbours with blocks of {block}")
    # at most `most` of an intensity's voxels can be among the nearest: the smallest ids, cut per task before the exchange
    low = Window.partitionBy("value").orderBy("vox")
    some = image.select("vox", "value").withColumn("c", F.row_number().over(low)).where(F.col("c") <= most)
    kinds = some.groupBy("value").agg(F.array_sort(F.collect_list("vox")).alias("ids")).withColumn("one", F.lit(1))
    kinds = exclusive_prefix_all(kinds, ["value"], "one").select("value", "ids", F.col("start").cast("long").alias("pos"))
    first, last = F.greatest(F.floor((F.col("pos") - most) / block), F.lit(0)), F.floor((F.col("pos") + most) / block)
    held = kinds.withColumn("b", F.explode(F.sequence(first, last)))
    order = Window.partitionBy("b").orderBy("pos").rowsBetween(-most, most)
    near = held.withColumn("near", F.collect_list(F.struct("value", "ids")).over(order)).where(F.col("b") == F.floor(F.col("pos") / block))
    e = image.select(F.col("vox").alias("i"), "value").join(near.select("value", "near"), "value")
    e = e.select("i", "value", F.explode("near").alias("m")).select("i", F.abs(F.col("value") - F.col("m.value")).alias("d"), F.explode("m.ids").alias("j"))
    e = e.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rn") <= most)
    return e.select("i", "j", F.exp(F.lit(-1 / (2 * sigma2)) * F.col("d") * F.col("d")).alias("k"))
