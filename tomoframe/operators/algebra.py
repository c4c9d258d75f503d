"""Arithmetic on aligned tables, histogram cells and image points."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomoframe.sources.views import GRID, Grid

OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, b),
}


def combine(left: DataFrame, right: DataFrame, keys: Sequence[str], operation: str, outer: bool = False) -> DataFrame:
    """(keys of left, value): left's value with right's of the same keys; a 3-D right serves all frames of a 4-D left.

    With outer, cells of one side only meet 0; else they are left out.
    """
    r = right.select(*keys, F.col("value").alias("__r"))
    own = [c for c in left.columns if c not in ("value", *keys)]
    e = left.join(r, list(keys), "full" if outer else "inner")
    a, b = (F.coalesce(c, F.lit(0.0)) for c in ("value", "__r")) if outer else (F.col("value"), F.col("__r"))
    return e.select(*own, *keys, OPERATIONS[operation](a, b).alias("value"))


def scaled(table: DataFrame, factor: float) -> DataFrame:
    return table.withColumn("value", F.col("value") * F.lit(factor))


def inverted(table: DataFrame) -> DataFrame:
    """1 / value; 0 stays 0."""
    return table.withColumn("value", F.when(F.col("value") != 0, 1 / F.col("value")).otherwise(F.lit(0.0)))


def filled(table: DataFrame, value: float) -> DataFrame:
    return table.withColumn("value", F.lit(float(value)))


def set_cells(hist: DataFrame, cells: DataFrame, key: str = "bin", increment: bool = False) -> DataFrame:
    """(key, value): hist with the values of cells in place of its own, or added to them; other cells stay."""
    c = cells.groupBy(key).agg((F.sum if increment else F.max)("value").alias("__c"))
    e = hist.select(key, "value").join(c, key, "full")
    old = F.coalesce("value", F.lit(0.0))
    new = old + F.coalesce("__c", F.lit(0.0)) if increment else F.coalesce(F.col("__c"), old)
    return e.select(key, new.alias("value"))


def sum_images(images: Sequence[DataFrame]) -> DataFrame:
    """(vox, value): the sum of images (vox, value), as of subset sensitivities."""
    return reduce(DataFrame.unionByName, images).groupBy("vox").agg(F.sum("value").alias("value"))


def nearest_voxel(x: Column, y: Column, z: Column, g: Grid = GRID) -> Column:
    """Number of the voxel that holds a point, null outside the grid."""
    i, j, k = (F.floor((p - F.lit(o)) / F.lit(v) + F.lit(n / 2)) for p, o, v, n in ((x, g.ox, g.vx, g.nx), (y, g.oy, g.vy, g.ny), (z, g.oz, g.vz, g.nz)))
    inside = i.between(0, g.nx - 1) & j.between(0, g.ny - 1) & k.between(0, g.nz - 1)
    return F.when(inside, i + j * g.nx + k * (g.nx * g.ny))


def read_points(image: DataFrame, points: DataFrame, g: Grid = GRID) -> DataFrame:
    """points (x, y, z, ...) with the value of the voxel around each, 0 outside."""
    at = points.withColumn("vox", nearest_voxel(F.col("x"), F.col("y"), F.col("z"), g))
    e = at.join(image.select("vox", F.col("value").alias("__v")), "vox", "left")
    return e.withColumn("value", F.coalesce("__v", F.lit(0.0))).drop("__v", "vox")


def update_points(image: DataFrame, points: DataFrame, multiply: bool = False, g: Grid = GRID) -> DataFrame:
    """(vox, value): image with each point's amount added to its voxel, or multiplied in; points outside count for nothing.

    Amounts that are decimals are added up exactly, so the order of addition does not show.
    """
    at = points.select(nearest_voxel(F.col("x"), F.col("y"), F.col("z"), g).alias("vox"), "amount").where("vox IS NOT NULL")
    per = at.groupBy("vox").agg((F.product if multiply else F.sum)("amount").cast("double").alias("__a"))
    e = image.select("vox", "value").join(per, "vox", "left")
    new = F.col("value") * F.coalesce("__a", F.lit(1.0)) if multiply else F.col("value") + F.coalesce("__a", F.lit(0.0))
    return e.select("vox", new.alias("value"))
