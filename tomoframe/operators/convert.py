"""Detector and projection ids of vendor event records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Blocks:
    """Crystals of a scanner made of modules of 2 x 2 sub-modules; the defaults are a 56-sector, 18-module one."""

    sub_axial: int = 4
    sub_radial: int = 8
    axial: int = 144
    radial: int = 896

    @property
    def per_layer(self) -> int:
        return self.axial * self.radial


BLOCKS = Blocks()


def crystal_index(sector: Column, module: Column, sub: Column, crystal: Column, b: Blocks = BLOCKS) -> tuple[Column, Column]:
    """(axial, radial) crystal of a hierarchical id; the layer is the id's own last level."""
    row, col = F.floor(sub / 2), sub % 2
    axial = (module * 2 + row) * b.sub_axial + F.floor(crystal / b.sub_radial)
    return axial, (sector * 2 + col) * b.sub_radial + crystal % b.sub_radial


def flat_id(layer: Column, axial: Column, radial: Column, b: Blocks = BLOCKS) -> Column:
    return layer * b.per_layer + axial * b.radial + radial


def sorted_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def emission_time(first: Column, second: Column) -> Column:
    """The earlier of the two arrivals."""
    return F.least(first, second)


def block_ids(events: DataFrame, after: int | None = None, before: int | None = None, b: Blocks = BLOCKS) -> DataFrame:
    """Adds layers, axial, axial_diff to rows with d1, d2 (ids of flat_id); with bounds only after < ts_ms < before.

    layers is 2 * layer of d1 + layer of d2, and one more for the pair of the
    two different layers whose first crystal lies further round its layer.
    """
    e = events if after is None else events.where((F.col("ts_ms") > after) & (F.col("ts_ms") < before))
    place = {k: F.col(k) % b.per_layer for k in ("d1", "d2")}
    axial = {k: F.floor(v / b.radial) for k, v in place.items()}
    layers = 2 * F.floor(F.col("d1") / b.per_layer) + F.floor(F.col("d2") / b.per_layer)
    layers = layers + F.when((layers == 1) & (place["d2"] < place["d1"]), 1).otherwise(0)
    low, high = F.least(*axial.values()), F.greatest(*axial.values())
    return e.withColumns({"layers": layers, "axial": low, "axial_diff": high - low})


def projection_ids(events: DataFrame, basis: DataFrame, first: DataFrame, most: int) -> DataFrame:
    """Adds proj_id: the basis projection of the row's pair plus its block's first one; -1 outside the field of view or beyond `most` axial steps.

    events has pair, axial, axial_diff; basis (pair, basis_id); first (axial, axial_diff, first_id).
    """
    e = events.join(basis, "pair", "left").join(first, ["axial", "axial_diff"], "left")
    got = F.when(F.col("axial_diff") <= most, F.col("basis_id") + F.col("first_id"))
    return e.withColumn("proj_id", F.coalesce(got, F.lit(-1))).drop("basis_id", "first_id")


def position_bins(positions: DataFrame, start: int, stop: int, step: int) -> DataFrame:
    """(k, edge): scan start, midpoints of neighbouring positions moved to the next tick of the scan, scan end.

    positions has t_start and is short.  A midpoint at or beyond the last tick has none after it and goes to the start.
    """
    from pyspark.sql import Window

    w = Window.orderBy("t_start")
    e = positions.select(F.row_number().over(w).alias("k"), ((F.col("t_start") + F.lead("t_start").over(w)) / 2).alias("mid"))
    tick = F.greatest(F.lit(start), F.lit(start) + (F.floor((F.col("mid") - start) / step) + 1) * step)
    edge = F.when(F.col("mid").isNull() | (F.col("mid") < F.lit(stop)), F.least(tick, F.lit(stop))).otherwise(F.lit(start))
    ends = positions.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(start).cast("long").alias("edge")), F.struct(F.col("n").alias("k"), F.lit(stop).cast("long").alias("edge")))).alias("s")).select("s.*")
    return e.where("mid IS NOT NULL").select(F.col("k").cast("long").alias("k"), edge.cast("long").alias("edge")).unionByName(ends)
