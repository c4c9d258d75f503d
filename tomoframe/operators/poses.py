"""Motion parameters relative to a reference frame, as unit quaternions and translations, with the frames' weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomoframe.functions.scalars import axis_angle, quaternion_product, quaternion_rotate


def motion_parameters(positions: DataFrame, reference: int, half_life: float = 0.0) -> DataFrame:
    """(frame, t_start, weight, qw, qx, qy, qz, tx, ty, tz) of positions (frame, t_start, t_stop, degrees, ax, ay, az, px, py, pz).

    A position is a turn by degrees about (ax, ay, az) and a translation; the
    result is the move that takes the reference frame's position to it: its
    turn after the inverse of the reference's, and what is left of the
    translation once that turn has taken the reference's along.  The weight is
    the frame's share of the time, or with a half-life of the decays.  Raises
    an error if there is not exactly one reference frame.
    """
    q = axis_angle(F.col("degrees"), tuple(F.col(f"a{c}") for c in "xyz"))
    e = positions.select("frame", "t_start", "t_stop", *[v.alias(f"q{i}") for i, v in enumerate(q)], *[F.col(f"p{c}") for c in "xyz"])
    ref = e.where(F.col("frame") == reference).select(*[F.col(f"q{i}").alias(f"r{i}") for i in range(4)], *[F.col(f"p{c}").alias(f"o{c}") for c in "xyz"])
    if ref.limit(2).count() != 1:
        raise ValueError(f"there is not one reference frame {reference}")
    e = e.crossJoin(F.broadcast(ref))  # one row
    inverse = (F.col("r0"), -F.col("r1"), -F.col("r2"), -F.col("r3"))
    turn = quaternion_product(inverse, tuple(F.col(f"q{i}") for i in range(4)))
    names = ("qw", "qx", "qy", "qz")
    e = e.withColumns(dict(zip(names, turn, strict=True)))
    taken = quaternion_rotate(tuple(F.col(c) for c in names), tuple(F.col(f"o{c}") for c in "xyz"))
    if half_life > 0:
        part = F.pow(F.lit(0.5), F.col("t_start") / half_life) - F.pow(F.lit(0.5), F.col("t_stop") / half_life)
    else:
        part = (F.col("t_stop") - F.col("t_start")).cast("double")
    moved = {f"t{c}": F.col(f"p{c}") - taken[i] for i, c in enumerate("xyz")}
    e = e.withColumns(moved | {"__part": part})
    total = e.agg(F.sum("__part").alias("__total"))
    e = e.crossJoin(F.broadcast(total))  # one row
    return e.select("frame", "t_start", (F.col("__part") / F.col("__total")).alias("weight"), *names, "tx", "ty", "tz")


def frame_bounds(positions: DataFrame, edges: DataFrame) -> DataFrame:
    """positions (t_start, ...) with frame and the bounds t_start, t_stop that edges (k, edge) of position_bins give them; short tables."""
    w = Window.orderBy("t_start")
    e = positions.withColumn("frame", F.row_number().over(w) - 1).drop("t_start")
    low = edges.select(F.col("k").cast("int").alias("frame"), F.col("edge").alias("t_start"))
    high = edges.select((F.col("k") - 1).cast("int").alias("frame"), F.col("edge").alias("t_stop"))
    return e.join(low, "frame").join(high, "frame")
