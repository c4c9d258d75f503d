"""Dynamic frames, motion frames and moved lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a motion row: a rotation about z with a translation, and a whole 3 x 4 transform.
TURN = ("c", "s", "tx", "ty", "tz")
RIGID = ("r00", "r01", "r02", "tx", "r10", "r11", "r12", "ty", "r20", "r21", "r22", "tz")


def assign_frames(rows: DataFrame, frames: DataFrame, most: int = 10_000) -> DataFrame:
    """Adds frame: t_start <= ts_ms < t_stop, -1 outside.

    Up to `most` frames become one expression that is searched per row without
    a join; more of them are met by a join on time buckets.
    """
    bounds = [tuple(r) for r in frames.select("frame", "t_start", "t_stop").orderBy("t_start").limit(most + 1).collect()]
    if len(bounds) > most:
        return _frames_by_bucket(rows, frames)
    table = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(f).cast("int").alias("f")) for f, a, b in bounds])
    hit = F.filter(table, lambda x: (F.col("ts_ms") >= x["a"]) & (F.col("ts_ms") < x["b"]))
    return rows.withColumn("frame", F.coalesce(F.get(hit, F.lit(0))["f"], F.lit(-1)))


def _frames_by_bucket(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Each frame stands in the buckets that it touches, as wide as a frame lasts on average; an equi join on the bucket."""
    low, high, n = frames.agg(F.min("t_start"), F.max("t_stop"), F.count("*")).first()
    width = max(1, (high - low) // n)
    bucket = lambda t: F.floor((t - low) / width)
    f = frames.select(F.col("frame").cast("int").alias("__f"), "t_start", "t_stop").withColumn("__b", F.explode(F.sequence(bucket(F.col("t_start")), bucket(F.col("t_stop") - 1))))
    e = rows.withColumn("__b", bucket(F.col("ts_ms"))).alias("e")
    on = (F.col("e.__b") == F.col("f.__b")) & (F.col("ts_ms") >= F.col("t_start")) & (F.col("ts_ms") < F.col("t_stop"))
    out = e.join(f.alias("f"), on, "left").withColumn("frame", F.coalesce("__f", F.lit(-1)))
    return out.drop(F.col("e.__b"), F.col("f.__b")).drop("__f", "t_start", "t_stop")


def frame_durations(frames: DataFrame) -> DataFrame:
    return frames.select("frame", "t_start", (F.col("t_stop") - F.col("t_start")).alias("duration"))


def motion_intervals(motion: DataFrame) -> DataFrame:
    """Adds t_next (null for the last) and duration: to the next row, the last takes the one before; 1 for a single row.

    Motion tables are short (one row a position), so one window over all is meant.
    """
    w = Window.orderBy("t_start")
    nxt, prev = F.lead("t_start").over(w), F.lag("t_start").over(w)
    return motion.withColumns({"t_next": nxt, "duration": F.coalesce(nxt - F.col("t_start"), F.col("t_start") - prev, F.lit(1))})


#: Ranges of time that an as-of join makes of either side, and the share of rows that their bounds are drawn from.
RANGES, SAMPLED = 32, 0.05


def _range_bounds(rows: DataFrame, motion: DataFrame, ranges: int, share: float) -> list[int]:
    """Bounds of time at the quantiles of a sample of the rows, and at those of the motion rows; they decide the balance, never the result."""
    at = [k / ranges for k in range(1, ranges)]
    of = lambda d, c: d.agg(F.percentile_approx(F.col(c), at, 1000)).first()[0] or []
    return sorted({*of(rows.select("ts_ms").sample(share, 17), "ts_ms"), *of(motion, "t_start")})


def motion_asof(rows: DataFrame, motion: DataFrame, carry: tuple[str, ...] = TURN, ranges: int = RANGES, share: float = SAMPLED) -> DataFrame:
    """Adds motion_frame (-1 before the first) and the transform of the latest row that began: a backward as-of join.

    Time is cut into ranges at quantiles of both sides, so that neither crowded
    motion rows nor the many rows after the last one share a range.  Each
    motion row stands in the ranges that its interval touches, at most as many
    rows as there are motion rows and bounds, and rows meet it by an equi join
    on their range; Spark may broadcast or shuffle as sizes suggest.
    """
    bounds = _range_bounds(rows, motion, ranges, share)
    table = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = lambda t: F.size(F.filter(table, lambda b: b <= t))
    m = motion_intervals(motion)
    last = F.when(F.col("t_next").isNull(), F.lit(len(bounds))).otherwise(bucket(F.col("t_next") - 1))
    m = m.where("t_next IS NULL OR t_next > t_start").withColumn("__b", F.explode(F.sequence(bucket(F.col("t_start")), last)))
    m = m.select("__b", F.col("frame").alias("__f"), "t_start", "t_next", *carry)
    e = rows.withColumn("__b", bucket(F.col("ts_ms"))).alias("e")
    on = (F.col("e.__b") == F.col("m.__b")) & (F.col("ts_ms") >= F.col("t_start")) & (F.col("t_next").isNull() | (F.col("ts_ms") < F.col("t_next")))
    out = e.join(m.alias("m"), on, "left").withColumn("motion_frame", F.coalesce("__f", F.lit(-1)))
    return out.drop(F.col("e.__b"), F.col("m.__b")).drop("__f", "t_start", "t_next")


def move(rows: DataFrame) -> DataFrame:
    """Applies each row's rotation about z and translation to both endpoints; identity where there is none."""
    c, s = F.coalesce("c", F.lit(1.0)), F.coalesce("s", F.lit(0.0))
    t = {k: F.coalesce(k, F.lit(0.0)) for k in ("tx", "ty", "tz")}
    out = {}
    for e in "12":
        out |= {f"x{e}": c * F.col(f"x{e}") - s * F.col(f"y{e}") + t["tx"], f"y{e}": s * F.col(f"x{e}") + c * F.col(f"y{e}") + t["ty"], f"z{e}": F.col(f"z{e}") + t["tz"]}
    return rows.withColumns(out)


def move_rigid(rows: DataFrame) -> DataFrame:
    """Applies each row's 3 x 4 transform (RIGID) to both endpoints; identity where there is none."""
    v = {k: F.coalesce(k, F.lit(float(k in ("r00", "r11", "r22")))) for k in RIGID}
    out = {}
    for e in "12":
        for i, a in enumerate("xyz"):
            out[f"{a}{e}"] = v[f"r{i}0"] * F.col(f"x{e}") + v[f"r{i}1"] * F.col(f"y{e}") + v[f"r{i}2"] * F.col(f"z{e}") + v[f"t{a}"]
    return rows.withColumns(out)
