"""Scatter space: cylindrical cells, lookups, tails, single-scatter physics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Space:
    tofs: int = 1
    planes: int = 6
    angles: int = 16
    axial: float = 200.0
    max_tof: float = 1000.0


SPACE = Space()


def wrap(angle: Column) -> Column:
    return F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle)


def cells(lors: DataFrame, s: Space = SPACE) -> DataFrame:
    """Adds p1, a1, p2, a2: the nearest cell of each end (planes clamped, angles wrapped); with bins of time of flight also tof."""
    step, turn = s.axial / s.planes, 2 * F.pi() / s.angles
    out = {}
    for e in "12":
        lowest = -s.axial / 2 + step / 2
        plane = F.greatest(F.lit(lowest), F.least(F.lit(-lowest), F.col(f"z{e}")))
        out[f"p{e}"] = F.round((plane + F.lit(s.axial / 2)) / step - F.lit(0.5)).cast("long")
        out[f"a{e}"] = F.pmod(F.round(wrap(F.atan2(f"y{e}", f"x{e}")) / turn - F.lit(0.5)).cast("long"), F.lit(s.angles))
    if s.tofs > 1:
        out["tof"] = F.round(tof_place(s)).cast("long")
    return lors.withColumns(out)


def tof_place(s: Space) -> Column:
    """Place of tof_ps among the bins of time of flight, clamped to their middles."""
    step = s.max_tof / s.tofs
    return F.greatest(F.lit(step / 2), F.least(F.lit(s.max_tof - step / 2), F.col("tof_ps"))) / step - F.lit(0.5)


def interpolate(lors: DataFrame, values: DataFrame, s: Space = SPACE, key: str = "event_id") -> DataFrame:
    """(key, value): linear in both planes (clamped) and both angles (wrapped): 16 corners, one join, one sum.

    values is (p1, a1, p2, a2, value); absent cells count 0.  A space with bins
    of time of flight has tof in values and tof_ps in lors: 32 corners.
    """
    step, turn = s.axial / s.planes, 2 * F.pi() / s.angles
    e = lors
    for k in "12":
        lowest = -s.axial / 2 + step / 2
        plane = (F.greatest(F.lit(lowest), F.least(F.lit(-lowest), F.col(f"z{k}"))) + F.lit(s.axial / 2)) / step - F.lit(0.5)
        angle = wrap(F.atan2(f"y{k}", f"x{k}")) / turn - F.lit(0.5)
        e = e.withColumns({f"__p{k}": plane, f"__a{k}": angle})
    # the generator keeps the optimizer from writing these four out again in each of the 16 corners
    timed = ["tof", "__wt"] if s.tofs > 1 else []
    if timed:
        at = tof_place(s)
        e = e.withColumn("__t", F.explode(F.array(*[F.struct(F.least(F.floor(at) + d, F.lit(s.tofs - 1)).alias("tof"), (at - F.floor(at) if d else 1 - (at - F.floor(at))).alias("__wt")) for d in (0, 1)])))
        e = e.withColumns({c: F.col(f"__t.{c}") for c in timed})
    base = F.struct(*[f"__{c}{k}" for k in "12" for c in "pa"])
    e = e.select(key, *timed, F.explode(F.array(base)).alias("__b")).select(key, *timed, "__b.*")
    corner = lambda k: [
        F.struct(
            F.least(F.floor(f"__p{k}") + dp, F.lit(s.planes - 1)).alias("p"),
            F.pmod(F.floor(f"__a{k}") + da, F.lit(s.angles)).alias("a"),
            ((F.col(f"__p{k}") - F.floor(f"__p{k}") if dp else 1 - (F.col(f"__p{k}") - F.floor(f"__p{k}"))) * (F.col(f"__a{k}") - F.floor(f"__a{k}") if da else 1 - (F.col(f"__a{k}") - F.floor(f"__a{k}")))).alias("w"),
        )
        for dp in (0, 1)
        for da in (0, 1)
    ]
    e = e.select(key, *timed, F.explode(F.array(*corner("1"))).alias("u"), F.array(*corner("2")).alias("vs")).select(key, *timed, "u", F.explode("vs").alias("v"))
    w = F.col("u.w") * F.col("v.w")
    e = e.select(key, *timed[:1], F.col("u.p").alias("p1"), F.col("u.a").alias("a1"), F.col("v.p").alias("p2"), F.col("v.a").alias("a2"), (w * F.col("__wt") if timed else w).alias("w"))
    return e.join(values, [*timed[:1], "p1", "a1", "p2", "a2"], "left").groupBy(key).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))


def tails(inside: DataFrame, width: int, s: Space = SPACE) -> DataFrame:
    """(p1, a1, p2, a2) of tail cells: from each change of inside along a2 (from 2 up to a1), `width` cells on its outer side."""
    w = Window.partitionBy("p1", "a1", "p2").orderBy("a2")
    e = inside.where((F.col("a2") >= 1) & ((F.col("a2") < F.col("a1")) | (F.col("a2") == 1))).withColumn("was", F.lag("inside").over(w))
    e = e.where((F.col("a2") >= 2) & (F.col("was") != F.col("inside")))
    e = e.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    a2 = F.when(F.col("inside"), F.col("a2") - F.col("b")).otherwise(F.col("a2") + F.col("b"))
    return e.select("p1", "a1", "p2", F.pmod(a2, F.lit(s.angles)).alias("a2")).distinct()


def klein_nishina(cos_theta: Column) -> Column:
    """Differential cross section at 511 keV in units of half the squared classical electron radius."""
    p = 1 / (F.lit(2.0) - cos_theta)
    return p * p * (p + (F.lit(2.0) - cos_theta) - (1 - cos_theta * cos_theta))


def mu_scaling(energy: Column) -> Column:
    """Total Compton cross section at an energy in keV over that at 511 keV."""
    a = energy / F.lit(511.0)
    one = (1 + a) / (a * a) * (F.lit(2.0) * (1 + a) / (1 + F.lit(2.0) * a) - F.log(1 + F.lit(2.0) * a) / a)
    two = F.log(1 + F.lit(2.0) * a) / (F.lit(2.0) * a) - (1 + F.lit(3.0) * a) / ((1 + F.lit(2.0) * a) * (1 + F.lit(2.0) * a))
    return (one + two) / (F.lit(20.0) / 9 - F.lit(1.5) * F.log(F.lit(3.0)))


def single_scatter(lors: DataFrame, points: DataFrame, mu: float = 0.0096, key: str = "event_id") -> DataFrame:
    """(key, value): sum over scatter points of emission weight, Klein-Nishina factor, attenuation and solid angles.

    points (x, y, z, density, emission) is a short sampled table; attenuation
    of the two paths is that of uniform matter.
    """
    e = lors.crossJoin(points)  # a stated short set of points against all rows
    v = {}
    for k in "12":
        for a in "xyz":
            v[f"{a}{k}"] = F.col(f"{a}{k}") - F.col(f"s{a}")
    r1 = F.sqrt(v["x1"] * v["x1"] + v["y1"] * v["y1"] + v["z1"] * v["z1"])
    r2 = F.sqrt(v["x2"] * v["x2"] + v["y2"] * v["y2"] + v["z2"] * v["z2"])
    e = e.withColumns({"__r1": r1, "__r2": r2, "__dot": v["x1"] * v["x2"] + v["y1"] * v["y2"] + v["z1"] * v["z2"]})
    cos = -F.col("__dot") / (F.col("__r1") * F.col("__r2"))
    energy = F.lit(511.0) / (F.lit(2.0) - cos)
    part = F.col("emission") * F.col("density") * klein_nishina(cos) * F.exp(F.lit(-mu / 10) * (F.col("__r1") + mu_scaling(energy) * F.col("__r2"))) / (F.col("__r1") * F.col("__r1") * F.col("__r2") * F.col("__r2"))
    return e.groupBy(key).agg(F.sum(part).alias("value"))
