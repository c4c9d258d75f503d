"""All legal projections of a scanner of two layers, in a fixed order, and the number of an event's pair among them.

The order: axial difference, lower axial place, pair of layers, then the basis
of radial pairs, whose own order is that of its indices or that of the angle of
its lines.  A projection's number follows from the four in closed form, so the
table is generated in parallel, row by row, and never counted up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.operators.aggregate import exclusive_prefix_all

#: Pairs of layers of the rows: both inner, inner and outer, outer and inner, both outer.
INNER, MIXED, TURNED, OUTER = range(4)


@dataclass(frozen=True)
class Rings:
    """Crystals of a layer (axial x radial), the largest axial difference, and the fan of partners of a crystal:
    `coverage` of a ring and `spare` more about its opposite, or all with coverage None."""

    axial: int = 144
    radial: int = 896
    most: int = 24
    coverage: float | None = 0.4646
    spare: int = 0

    @property
    def fan(self) -> tuple[int, int]:
        """First and last partner of the radial place 0."""
        if self.coverage is None:
            return 0, self.radial
        reach, middle = int(math.ceil(self.radial * self.coverage) + self.spare) // 2, math.ceil(self.radial / 2)
        return middle - reach, middle + reach

    @property
    def width(self) -> int:
        return self.fan[1] - self.fan[0] + 1

    @property
    def same(self) -> int:
        """Radial pairs within one ring."""
        low, high = self.fan
        return sum(max(0, min(high, self.radial - 1 - d) - low + 1) for d in range(high))

    @property
    def other(self) -> int:
        """Radial pairs between two rings."""
        return self.radial * self.width

    @property
    def projections(self) -> int:
        return self.axial * (2 * self.same + self.other) + 4 * self.other * sum(self.axial - d for d in range(1, self.most + 1))

    @property
    def layer(self) -> int:
        return self.axial * self.radial


def radial_basis(spark: SparkSession, s: Rings, within: bool, places: DataFrame | None = None) -> DataFrame:
    """(b1, b2, place): the radial pairs within a ring, or between two; place is their order.

    places (radial, x, y) asks for the order of the lines' angle, 0 to pi
    counter-clockwise from the x axis; equal angles (to 6 digits) go by b1, b2.
    """
    low, high = s.fan
    i = F.col("id")
    b1 = F.floor(i / s.width)
    far = low + i % s.width + b1
    e = spark.range((high if within else s.radial) * s.width).select(b1.alias("b1"), (far if within else far % s.radial).alias("b2"), (i % s.width).alias("f"))
    if within:
        e = e.where(F.col("b2") < s.radial)
    if places is not None:
        a, b = (F.broadcast(places.select(F.col("radial").alias(f"b{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))) for k in "12")  # one ring's crystals
        e = e.join(a, "b1").join(b, "b2")
        dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
        turn = F.round(F.acos(F.when(dy < 0, -dx).otherwise(dx) / F.hypot(dx, dy)), 6)
        e = e.select("b1", "b2", turn.alias("beta"), F.lit(1).alias("one"))
        return exclusive_prefix_all(e, ["beta", "b1", "b2"], "one").select("b1", "b2", F.col("start").alias("place"))
    if not within:
        return e.select("b1", "b2", (F.col("b1") * s.width + F.col("f")).alias("place"))
    # rows of b1 up to `whole` have all partners, each further one has one fewer
    whole = max(0, min(high, s.radial - high))
    k = F.greatest(F.col("b1") - whole, F.lit(0))
    before = F.least(F.col("b1"), F.lit(whole)) * s.width + k * (s.radial - low - whole) - F.floor(k * (k - 1) / 2)
    return e.select("b1", "b2", (before + F.col("f")).alias("place"))


def first_of(layers: Column, axial: Column, diff: Column, s: Rings) -> Column:
    """Number of the first projection of a block."""
    level = s.axial * (2 * s.same + s.other)
    flat = axial * (2 * s.same + s.other) + F.when(layers == INNER, 0).when(layers == OUTER, s.same + s.other).otherwise(s.same)
    before = (diff - 1) * s.axial - F.floor(diff * (diff - 1) / 2)
    return F.when(diff == 0, flat).otherwise(F.lit(level) + ((before + axial) * 4 + layers) * s.other)


def legal_projections(spark: SparkSession, s: Rings, places: DataFrame | None = None) -> DataFrame:
    """(proj_id, d1, d2): all projections; d1, d2 are flat ids (layer, axial, radial), d1 of the lower layer."""
    within, between = (radial_basis(spark, s, k, places) for k in (True, False))
    a = F.col("axial")
    block = F.explode(F.sequence(F.lit(0), F.lit(2 * s.axial - 1)))
    same = within.select("*", block.alias("n")).select("*", F.floor(F.col("n") / 2).alias("axial"), F.when(F.col("n") % 2 == 0, INNER).otherwise(OUTER).alias("layers"), F.lit(0).alias("diff"))
    flat = between.select("*", F.explode(F.sequence(F.lit(0), F.lit(s.axial - 1))).alias("axial")).select("*", F.lit(MIXED).alias("layers"), F.lit(0).alias("diff"))
    out = [same.drop("n"), flat]
    if s.most:
        steps = F.explode(F.sequence(F.lit(1), F.lit(s.most)))
        apart = between.select("*", steps.alias("diff")).where(F.col("diff") < s.axial)
        apart = apart.select("*", F.explode(F.sequence(F.lit(0), F.lit(s.axial - 1) - F.col("diff"))).alias("axial")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layers"))
        out.append(apart)
    cols = ["b1", "b2", "place", "axial", "layers", "diff"]
    e = out[0].select(cols)
    for o in out[1:]:
        e = e.unionByName(o.select(cols))
    near, far = a * s.radial + F.col("b1"), (a + F.col("diff")) * s.radial + F.col("b2")
    turned, outer = F.col("layers") == TURNED, F.col("layers") == OUTER
    d1 = F.when(turned, far).when(outer, near + s.layer).otherwise(near)
    d2 = F.when(turned, near + s.layer).when(F.col("layers") == INNER, far).otherwise(far + s.layer)
    number = first_of(F.col("layers"), a, F.col("diff"), s) + F.col("place")
    return e.select(number.cast("long").alias("proj_id"), d1.cast("long").alias("d1"), d2.cast("long").alias("d2"))


def projection_numbers(events: DataFrame, s: Rings, places: DataFrame | None = None) -> DataFrame:
    """Adds proj_id to rows with d1, d2 (flat ids in any order): its number among the legal projections, -1 for others.

    The block's first number is computed; the pair's place in the radial basis
    is looked up in the two bases, whose size is that of one ring's pairs.
    """
    spark = events.sparkSession
    low, high = F.least("d1", "d2"), F.greatest("d1", "d2")
    l1, l2 = F.floor(low / s.layer), F.floor(high / s.layer)
    (a1, r1), (a2, r2) = ((F.floor(d % s.layer / s.radial), d % s.radial) for d in (low, high))
    turned = (l1 < l2) & (a1 > a2)
    layers = F.when(turned, TURNED).when(l1 < l2, MIXED).when(l1 == 0, INNER).otherwise(OUTER)
    within = (a1 == a2) & (l1 == l2)
    made = {"__layers": layers, "__axial": F.least(a1, a2), "__diff": F.abs(a1 - a2), "__within": within, "__b1": F.when(turned, r2).otherwise(r1), "__b2": F.when(turned, r1).otherwise(r2)}
    basis = None
    for k in (True, False):
        own = radial_basis(spark, s, k, places).select(F.lit(k).alias("__within"), F.col("b1").alias("__b1"), F.col("b2").alias("__b2"), F.col("place").alias("__place"))
        basis = own if basis is None else basis.unionByName(own)
    e = events.withColumns(made).join(basis, ["__within", "__b1", "__b2"], "left")
    legal = F.col("__place").isNotNull() & (F.col("__diff") <= s.most)
    number = F.when(legal, first_of(F.col("__layers"), F.col("__axial"), F.col("__diff"), s) + F.col("__place")).otherwise(-1)
    return e.withColumn("proj_id", number.cast("long")).drop(*made, "__place")
