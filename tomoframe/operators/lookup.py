"""Correction lookups and aligned column operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_pair(rows: DataFrame, hist: DataFrame, name: str, default: float = 0.0) -> DataFrame:
    """Adds the histogram's value of each row's canonical pair (0 for the pair (0, 0)); default where there is none.

    The canonical keys drive a plain equi join: Spark broadcasts the histogram
    if its size allows, and else shuffles both sides on the pair.
    """
    h = hist.select(F.col("d1").alias("__a"), F.col("d2").alias("__b"), F.col("value").alias("__v"))
    e = rows.withColumns({"__a": F.least("d1", "d2"), "__b": F.greatest("d1", "d2")}).join(h, ["__a", "__b"], "left")
    off = (F.col("__a") == 0) & (F.col("__b") == 0)
    return e.withColumn(name, F.when(off, F.lit(0.0)).otherwise(F.coalesce("__v", F.lit(default)))).drop("__a", "__b", "__v")


def lookup_bin(rows: DataFrame, hist: DataFrame, name: str, default: float = 0.0) -> DataFrame:
    h = hist.select("bin", F.col("value").alias("__v"))
    return rows.join(h, "bin", "left").withColumn(name, F.coalesce("__v", F.lit(default))).drop("__v")


def divide(measured: DataFrame, projected: DataFrame) -> DataFrame:
    """(bin, value): measured / projected where projected is not 0, else projected."""
    p = projected.select("bin", F.col("value").alias("p"))
    return measured.select("bin", F.col("value").alias("m")).join(p, "bin").select("bin", F.when(F.col("p") != 0, F.col("m") / F.col("p")).otherwise(F.col("p")).alias("value"))


def em_ratio(rows: DataFrame, floor: float = 1e-35, scale: float = 1.0) -> DataFrame:
    """Adds ratio to rows with (value, proj, sens, atten, randoms, scatter, invivo): 0 where the estimate is at the floor."""
    q = (F.col("proj") * F.col("sens") * F.col("atten") * scale + F.col("randoms") + F.col("scatter")) * F.col("invivo")
    back = F.col("value") / q * F.col("sens") * F.col("atten") * scale
    return rows.withColumn("ratio", F.when(F.abs(q) > floor, back).otherwise(F.lit(0.0)))
