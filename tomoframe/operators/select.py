"""Row selection: subsets, constraints, time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions.geometry import FAKE, Scanner, block, in_plane_angle_diff, periodic_diff, ring, ring_pos


def time_range(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """start <= ts_ms < stop."""
    return rows.where((F.col("ts_ms") >= start) & (F.col("ts_ms") < stop))


def interleaved(rows: DataFrame, subsets: int, k: int, ordinal: str = "event_id") -> DataFrame:
    return rows.where(F.col(ordinal) % subsets == k)


def chronological(rows: DataFrame, subsets: int, k: int, count: int, ordinal: str = "event_id", first: int = 0) -> DataFrame:
    """Contiguous equal chunks by ordinal; the last takes the remainder."""
    if not 0 <= k < subsets:
        raise ValueError("the subset's number must be below the number of subsets")
    size = count // subsets
    low, high = first + k * size, first + (count if k == subsets - 1 else (k + 1) * size)
    return rows.where((F.col(ordinal) >= low) & (F.col(ordinal) < high))


def strided(rows: DataFrame, first: int, last: int, stride: int, ordinal: str) -> DataFrame:
    return rows.where(F.col(ordinal).between(first, last) & ((F.col(ordinal) - first) % stride == 0))


def angle_index(n: int, s: Scanner = FAKE) -> Column:
    return periodic_diff(ring_pos(F.col("d1"), s), ring_pos(F.col("d2"), s), s.dets_per_ring) >= n


def block_index(n: int, s: Scanner = FAKE) -> Column:
    return periodic_diff(block(F.col("d1"), s), block(F.col("d2"), s), s.dets_per_ring // s.dets_per_block) >= n


def angle_degrees(theta: float) -> Column:
    """On rows that have an LOR."""
    return in_plane_angle_diff() >= theta


def ring_difference(most: int, s: Scanner = FAKE) -> Column:
    return F.abs(ring(F.col("d1"), s) - ring(F.col("d2"), s)) <= most


def both_enabled(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows whose detectors are both enabled in mask (det_id, enabled)."""
    on = mask.where("enabled").select("det_id")
    return rows.join(on.withColumnRenamed("det_id", "d1"), "d1", "left_semi").join(on.withColumnRenamed("det_id", "d2"), "d2", "left_semi")


def mark_disabled(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """Keeps all rows; those with a disabled detector get the pair (0, 0)."""
    m = F.broadcast(mask.select("det_id", "enabled"))  # a scanner's detectors: fixed size
    a = m.select(F.col("det_id").alias("d1"), F.col("enabled").alias("__on1"))
    b = m.select(F.col("det_id").alias("d2"), F.col("enabled").alias("__on2"))
    on = F.coalesce(F.col("__on1"), F.lit(False)) & F.coalesce(F.col("__on2"), F.lit(False))
    out = rows.join(a, "d1", "left").join(b, "d2", "left").withColumn("__on", on)
    return out.withColumns({"d1": F.when(F.col("__on"), F.col("d1")).otherwise(0), "d2": F.when(F.col("__on"), F.col("d2")).otherwise(0)}).drop("__on", "__on1", "__on2")


def range_2d(spark: SparkSession, slices: int, size: int, stride: int, first: int = 0) -> DataFrame:
    """(bin): first + slice * stride + i for all i below size."""
    i = F.col("id")
    return spark.range(slices * size).select((F.lit(first) + F.floor(i / size) * stride + i % size).alias("bin"))


def scanner_constraint(rows: DataFrame, mask: DataFrame | None) -> DataFrame:
    """The constraint that a scanner implies: both detectors enabled, if it has a mask."""
    return rows if mask is None else both_enabled(rows, mask)


def zeroed(rows: DataFrame, valid: Column, columns: list[str]) -> DataFrame:
    """Keeps all rows; the columns are 0 where valid is not true."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.withColumns({c: F.when(ok, F.col(c)).otherwise(F.lit(0).cast(t)) for c, t in rows.dtypes if c in columns})


def parse_ranges(text: Column) -> Column:
    """Array of (lo, hi) from text like '0-5, 8, 10-12'."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda x: F.length(x) > 0)
    return F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("long").alias("lo"), F.element_at(F.split(x, "-"), -1).cast("long").alias("hi")))


def in_ranges(value: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda x: value.between(x["lo"], x["hi"]))
