"""Kinetic basis fits per pixel: weighted least squares on each basis, best cost wins; of one scan, or of two jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(*arrays: Column | str) -> Column:
    """Sum over frames of the product of arrays."""
    first, *rest = [F.col(a) if isinstance(a, str) else a for a in arrays]
    for r in rest:
        first = F.zip_with(first, r, lambda a, b: a * b)
    return F.aggregate(first, F.lit(0e0), lambda acc, x: acc + x)


def srtm2(tac: DataFrame, bases: DataFrame, weights: Column, k2p: float) -> DataFrame:
    """One-parameter fit. bases: (k, kappa, a array), a short table. Returns pix, k, r1, bp, cost; ties go to the smaller k."""
    e = tac.crossJoin(bases.select("k", "kappa", "a")).withColumn("wt", weights)
    e = e.withColumn("theta", dot("a", "wt", "tac") / dot("a", "a", "wt"))
    res = F.zip_with("tac", "a", lambda y, a: y - a * F.col("theta"))
    e = e.withColumn("cost", F.lit(0.5) * dot("wt", res, res))
    e = e.select("pix", F.struct("cost", "k").alias("key"), F.struct("k", F.col("theta").alias("r1"), (F.col("theta") * k2p / F.col("kappa") - 1).alias("bp"), "cost").alias("fit"))
    return e.groupBy("pix").agg(F.min_by("fit", "key").alias("fit")).select("pix", "fit.*")


def srtm(tac: DataFrame, bases: DataFrame, weights: Column) -> DataFrame:
    """Two-parameter fit. bases: (k, kappa, a, b arrays), a short table. Returns pix, k, r1, k2, bp, cost."""
    e = tac.crossJoin(bases).withColumn("wt", weights)
    e = e.withColumns({"y0": dot("a", "wt", "tac"), "y1": dot("b", "wt", "tac"), "aa": dot("a", "a", "wt"), "ab": dot("a", "b", "wt"), "bb": dot("b", "b", "wt")})
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    e = e.withColumns({"t0": (F.col("bb") * F.col("y0") - F.col("ab") * F.col("y1")) / det, "t1": (F.col("aa") * F.col("y1") - F.col("ab") * F.col("y0")) / det})
    fit = F.zip_with("a", "b", lambda a, b: a * F.col("t0") + b * F.col("t1"))
    res = F.zip_with("tac", fit, lambda y, f: y - f)
    e = e.withColumn("cost", F.lit(0.5) * dot("wt", res, res))
    k2 = F.col("t0") * F.col("kappa") + F.col("t1")
    e = e.select("pix", F.struct("cost", "k").alias("key"), F.struct("k", F.col("t0").alias("r1"), k2.alias("k2"), (k2 / F.col("kappa") - 1).alias("bp"), "cost").alias("fit"))
    return e.groupBy("pix").agg(F.min_by("fit", "key").alias("fit")).select("pix", "fit.*")


#: The kinetic parameters of a joint fit, in the order of a prior's and its weights' entries.
JOINT = ("bp_b", "k2_b", "r1_b", "bp_d", "k2_d", "r1_d")


def joint_inverse(a: np.ndarray, w: np.ndarray, kappa: tuple[float, float], alpha: float = 0.0, trust: np.ndarray | None = None) -> np.ndarray:
    """Inverse of the normal matrix of a joint fit: a is (2 scans, 2 columns, frames), w (2 scans, frames).

    With alpha and trust (six weights) the prior's part is added.
    """
    normal = np.zeros((4, 4))
    for scan in range(2):
        at = slice(2 * scan, 2 * scan + 2)
        normal[at, at] = (a[scan] * w[scan]) @ a[scan].T
    if alpha > 0 and trust is not None:
        slope = np.zeros((6, 4))
        for scan in range(2):
            slope[3 * scan, 2 * scan], slope[3 * scan + 1, 2 * scan], slope[3 * scan + 2, 2 * scan + 1] = 1 / kappa[scan], 1.0, 1.0
        normal += alpha * slope.T @ np.diag(trust) @ slope
    return np.linalg.inv(normal)


def srtm_joint(tacs: DataFrame, bases: DataFrame, weights: tuple[Column, Column], alpha: float = 0.0, trust: tuple[float, ...] = ()) -> DataFrame:
    """Four-parameter fit of two scans of a pixel: (pix, k, JOINT without bp_d but with its share ro, cost).

    tacs: (pix, tac0, tac1), and with alpha prior, an array of the parameters
    in the order of JOINT.  bases: (k, kappa0, kappa1, a0, b0, a1, b1 arrays,
    inverse: 16 numbers), a short table.  ro is 1 - bp_d / bp_b; the smallest
    cost wins, of equal ones the smaller k.
    """
    e = tacs.crossJoin(bases).withColumns({f"w{s}": weights[s] for s in (0, 1)})
    y = [dot(f"{c}{s}", f"w{s}", f"tac{s}") for s in (0, 1) for c in "ab"]
    if alpha > 0:
        p = [F.get("prior", F.lit(i)) for i in range(6)]
        for s in (0, 1):
            y[2 * s] = y[2 * s] + F.lit(alpha * trust[3 * s]) * (p[3 * s] + 1) / F.col(f"kappa{s}") + F.lit(alpha * trust[3 * s + 1]) * p[3 * s + 1]
            y[2 * s + 1] = y[2 * s + 1] + F.lit(alpha * trust[3 * s + 2]) * p[3 * s + 2]
    e = e.withColumns({f"y{i}": c for i, c in enumerate(y)})
    e = e.withColumns({f"t{i}": sum((F.get("inverse", F.lit(4 * i + j)) * F.col(f"y{j}") for j in range(1, 4)), F.get("inverse", F.lit(4 * i)) * F.col("y0")) for i in range(4)})
    cost = F.lit(0e0)
    for s in (0, 1):
        first, second = F.col(f"t{2 * s}"), F.col(f"t{2 * s + 1}")
        parts = F.transform(f"a{s}", lambda x: x * first), F.transform(f"b{s}", lambda x: x * second)  # noqa: B023
        fit = F.zip_with(*parts, lambda x, z: x + z)
        res = F.zip_with(f"tac{s}", fit, lambda v, f: v - f)
        cost = cost + dot(f"w{s}", res, res)
    got = {"bp_b": F.col("t0") / F.col("kappa0") - 1, "k2_b": F.col("t0"), "r1_b": F.col("t1"), "bp_d": F.col("t2") / F.col("kappa1") - 1, "k2_d": F.col("t2"), "r1_d": F.col("t3")}
    e = e.withColumns(got)
    if alpha > 0:
        for i, c in enumerate(JOINT):
            cost = cost + F.lit(alpha * trust[i]) * (p[i] - F.col(c)) * (p[i] - F.col(c))
    e = e.withColumn("cost", F.lit(0.5) * cost)
    whole = F.when(F.abs("bp_b") < 1e-8, F.when(F.col("bp_b") >= 0, F.lit(1e-8)).otherwise(F.lit(-1e-8))).otherwise(F.col("bp_b"))
    e = e.select("pix", F.struct("cost", "k").alias("key"), F.struct("k", "bp_b", "k2_b", "r1_b", (1 - F.col("bp_d") / whole).alias("ro"), "k2_d", "r1_d", "cost").alias("fit"))
    return e.groupBy("pix").agg(F.min_by("fit", "key").alias("fit")).select("pix", "fit.*")
