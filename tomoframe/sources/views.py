"""Event, histogram, frame, motion and voxel views over the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = datetime(2024, 1, 1)
FRAMES = (0, 86400000, 259200000, 604800000, 1209600000, 1814400000, 2505600000)
LATE_FRAMES = (3600000, *FRAMES[1:])
#: Starts of the poses that some queries take.
POSE_STARTS = (3600000, 432000000, 864000000, 1296000000, 1728000000)


@dataclass(frozen=True)
class Grid:
    nx: int = 8
    ny: int = 8
    nz: int = 4
    nt: int = 1
    vx: float = 25.0
    vy: float = 25.0
    vz: float = 50.0
    ox: float = 0.37
    oy: float = -0.29
    oz: float = 0.13
    fov: float = 95.0

    @property
    def voxels(self) -> int:
        return self.nx * self.ny * self.nz


GRID = Grid()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lm(spark: SparkSession, sf_dir: str, wrap: int = 1152, between: tuple[int, int] | None = None) -> DataFrame:
    """(event_id, ts_ms, d1, d2, tof_ps, randoms); between: bounds of ts_ms, a millisecond wide of the mark, that the file scan uses."""
    e = table(spark, sf_dir, "events")
    if between:
        low, high = (EPOCH + timedelta(milliseconds=t) for t in (between[0] - 1, between[1] + 1))
        e = e.where(f"ts >= TIMESTAMP_NTZ'{low}' AND ts < TIMESTAMP_NTZ'{high}'")
    ts = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) DIV 1000")
    return e.select(
        "event_id",
        ts.alias("ts_ms"),
        ((F.col("event_id") * 31 + F.col("user_id") * 17) % wrap).alias("d1"),
        ((F.col("event_id") * 57 + F.col("user_id") * 5 + 576) % wrap).alias("d2"),
        F.round((F.col("value") - 245) * 2, 2).alias("tof_ps"),
        F.round(F.col("value") / 1000, 5).alias("randoms"),
    )


def hist(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """(d1, d2, value); with shift some values are negative or zero."""
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_partkey") % 1152).alias("d1"), ((F.col("l_suppkey") * 11 + F.col("l_linenumber") * 97) % 1152).alias("d2"), (F.col("l_quantity").cast("double") - F.lit(shift)).alias("value"))


def frames(spark: SparkSession, bounds: tuple[int, ...] = FRAMES) -> DataFrame:
    """(frame, t_start, t_stop): some literal rows."""
    return spark.createDataFrame([(i, bounds[i], bounds[i + 1]) for i in range(len(bounds) - 1)], "frame int, t_start long, t_stop long")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, t_start, t_stop): one frame for each day that has events."""
    days = lm(spark, sf_dir).select(F.floor(F.col("ts_ms") / 86400000).alias("b")).distinct()
    w = Window.orderBy("b")  # one row a day
    return days.select((F.row_number().over(w) - 1).alias("frame"), (F.col("b") * 86400000).alias("t_start"), ((F.col("b") + 1) * 86400000).alias("t_stop"))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, t_start, c, s, tx, ty, tz): rotation about z and translation, one row for each quarter of a day with events."""
    e = lm(spark, sf_dir).where("ts_ms >= 3600000").groupBy(F.floor(F.col("ts_ms") / 21600000).alias("b")).agg(F.min("ts_ms").alias("t_start"), (F.min("event_id") % 64).alias("k"))
    k, w = F.col("k"), Window.orderBy("b")  # one row a quarter
    return e.select((F.row_number().over(w) - 1).alias("frame"), "t_start", F.cos(k * F.lit(0.05)).alias("c"), F.sin(k * F.lit(0.05)).alias("s"), ((k % 7 - 3) * F.lit(0.5)).alias("tx"), ((k % 5 - 2) * F.lit(0.75)).alias("ty"), ((k % 3 - 1) * F.lit(1.25)).alias("tz"))


def amounts(spark: SparkSession, sf_dir: str, key: Column, cells: int) -> DataFrame:
    """(id, q): whole quantities of the line items added up by key, 0 where there is none; id is below cells."""
    own = table(spark, sf_dir, "lineitem").groupBy((key % cells).alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return spark.range(cells).join(own, "id", "left").select("id", F.coalesce("q", F.lit(0)).alias("q"))


def voxels(spark: SparkSession, sf_dir: str, g: Grid = GRID, nt: int = 1) -> DataFrame:
    """(t, vox, value): an image of the line items' quantities."""
    e = amounts(spark, sf_dir, F.expr("l_orderkey * 31 + l_suppkey * 7 + l_linenumber"), g.voxels * nt)
    return e.select(F.floor(F.col("id") / g.voxels).cast("int").alias("t"), (F.col("id") % g.voxels).alias("vox"), (F.lit(1e0) + F.col("q") % 101 / F.lit(1e1)).alias("value"))


def sens(spark: SparkSession, sf_dir: str, g: Grid = GRID) -> DataFrame:
    """(vox, sens), some of it zero or negative."""
    e = amounts(spark, sf_dir, F.expr("l_partkey * 13 + l_suppkey + l_linenumber * 5"), g.voxels)
    return e.select(F.col("id").alias("vox"), ((F.col("q") * 29 % 23 - F.lit(3e0)) / F.lit(2e0)).alias("sens"))


def hbasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, frame, h): a basis of 3 ranks over 6 frames."""
    e = amounts(spark, sf_dir, F.col("l_orderkey"), 18)
    return e.select(F.floor(F.col("id") / 6).cast("int").alias("rank"), (F.col("id") % 6).cast("int").alias("frame"), ((F.lit(1e0) + F.col("q") % 16) / F.lit(8e0)).alias("h"))


def usage(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(det_id, n): events of every detector at one end."""
    own = lm(spark, sf_dir).groupBy(F.col(column).alias("det_id")).agg(F.count("*").alias("n"))
    return spark.range(1152).withColumnRenamed("id", "det_id").join(own, "det_id", "left").select("det_id", F.coalesce("n", F.lit(0)).alias("n"))


def tac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pix, tac): time-activity curves of 64 frames."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pix"), F.col("embedding").cast("array<double>").alias("tac"))


def sql_lm(wrap: int = 1152) -> str:
    return (
        "lm AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000 AS ts_ms, "
        f"(event_id * 31 + user_id * 17) % {wrap} AS d1, (event_id * 57 + user_id * 5 + 576) % {wrap} AS d2, "
        "round((value - 245) * 2, 2) AS tof_ps, round(value / 1000, 5) AS randoms FROM events)"
    )


def sql_hist(shift: float = 0.0) -> str:
    return f"hist AS (SELECT l_partkey % 1152 AS d1, (l_suppkey * 11 + l_linenumber * 97) % 1152 AS d2, CAST(l_quantity AS DOUBLE) - {shift:e} AS value FROM lineitem)"


def _e(x: float) -> str:
    return repr(float(x)) + ("e0" if "e" not in repr(float(x)) else "")


def sql_values(name: str, cols: str, rows: list[tuple], casts: str) -> str:
    """A literal table; casts has a type for each column."""
    body = ", ".join("(" + ", ".join(_e(v) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    names = [c.strip() for c in cols.split(",")]
    return f"{name} AS (SELECT " + ", ".join(f"CAST({c} AS {t.strip()}) AS {c}" for c, t in zip(names, casts.split(","), strict=True)) + f" FROM (VALUES {body}) AS v({cols}))"


def sql_frames(bounds: tuple[int, ...] = FRAMES) -> str:
    return sql_values("frames", "frame, t_start, t_stop", [(i, bounds[i], bounds[i + 1]) for i in range(len(bounds) - 1)], "INTEGER, BIGINT, BIGINT")


SQL_EVENT_FRAMES = "frames AS (SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS frame, b * 86400000 AS t_start, (b + 1) * 86400000 AS t_stop FROM (SELECT DISTINCT ts_ms // 86400000 AS b FROM lm))"
#: Needs lm.
SQL_MOTION = (
    "motion AS (SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS frame, t_start, cos(k * 0.05e0) AS c, sin(k * 0.05e0) AS s, (k % 7 - 3) * 0.5e0 AS tx, (k % 5 - 2) * 0.75e0 AS ty, (k % 3 - 1) * 1.25e0 AS tz FROM "
    "(SELECT ts_ms // 21600000 AS b, min(ts_ms) AS t_start, min(event_id) % 64 AS k FROM lm WHERE ts_ms >= 3600000 GROUP BY ALL))"
)


def sql_amounts(name: str, key: str, cells: int) -> str:
    return f"{name} AS (SELECT id, coalesce(q, 0) AS q FROM range({cells}) AS r(id) LEFT JOIN (SELECT ({key}) % {cells} AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY ALL) USING (id))"


def sql_voxels(nt: int = 1, g: Grid = GRID, name: str = "voxels", frame: str = "t") -> str:
    return sql_amounts(f"{name}_q", "l_orderkey * 31 + l_suppkey * 7 + l_linenumber", g.voxels * nt) + f", {name} AS (SELECT CAST(id // {g.voxels} AS INTEGER) AS {frame}, id % {g.voxels} AS vox, 1e0 + q % 101 / 1e1 AS value FROM {name}_q)"


def sql_sens(g: Grid = GRID) -> str:
    return sql_amounts("sens_q", "l_partkey * 13 + l_suppkey + l_linenumber * 5", g.voxels) + ", sens AS (SELECT id AS vox, (q * 29 % 23 - 3e0) / 2e0 AS sens FROM sens_q)"


def sql_hbasis() -> str:
    return sql_amounts("hb_q", "l_orderkey", 18) + ", hbasis AS (SELECT CAST(id // 6 AS INTEGER) AS rank, CAST(id % 6 AS INTEGER) AS frame, (1e0 + q % 16) / 8e0 AS h FROM hb_q)"


def sql_usage(name: str, column: str) -> str:
    return f"{name} AS (SELECT id AS det_id, coalesce(n, 0) AS n FROM range(1152) AS r(id) LEFT JOIN (SELECT {column} AS id, count(*) AS n FROM lm GROUP BY ALL) USING (id))"


SQL_DET = (
    "det0 AS (SELECT id AS det_id, 2e0 * pi() * ((id % 48) // 4) / 12 AS a, 200e0 + 10e0 * (id // 576) + 10e0 / 2 AS rad, "
    "(-0.5e0 + ((id % 48) % 4 + 0.5e0) / 4) * 4e0 AS ins, (id // 48) % 12 AS ring FROM range(1152) AS r(id)), "
    "det AS (SELECT det_id, round(rad * cos(a) + ins * cos(a + pi() / 2), 5) + 0e0 AS x, round(rad * sin(a) + ins * sin(a + pi() / 2), 5) + 0e0 AS y, "
    "round(-100e0 + (ring + 0.5e0) * (200e0 / 12), 5) + 0e0 AS z, round(cos(a), 5) + 0e0 AS nx, round(sin(a), 5) + 0e0 AS ny, 0e0 AS nz FROM det0)"
)
SQL_RING_MAP = (
    "rm0 AS (SELECT id, id // 19 AS phi, id % 19 AS r_ring, (id % 19) - 12 + 3 AS base FROM range(912) AS r(id)), "
    "rm1 AS (SELECT id, phi, r_ring, base AS p, CASE WHEN phi % 2 <> 0 THEN 25 ELSE 24 END - base AS q FROM rm0), "
    "rm2 AS (SELECT id, phi, r_ring, (CASE WHEN p < 0 THEN p + 48 ELSE p END + phi // 2) % 48 AS a, (CASE WHEN q < 0 THEN q + 48 ELSE q END + phi // 2) % 48 AS b FROM rm1), "
    "ring_map AS (SELECT least(a, b) AS d1r, greatest(a, b) AS d2r, arg_max(r_ring, id) AS r_ring, arg_max(phi, id) AS phi FROM rm2 GROUP BY ALL)"
)
SQL_LOR = (
    "lor AS (SELECT lm.*, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2 FROM lm JOIN det a ON a.det_id = lm.d1 JOIN det b ON b.det_id = lm.d2)"
)


def sql_binned(source: str) -> str:
    """binned: the rows of source (with d1, d2) that have a bin, with r, phi, z_bin, bin."""
    return (
        f"bo AS (SELECT *, (least(d1, d2) % 48) > (greatest(d1, d2) % 48) AS sw FROM {source}), "
        "ab AS (SELECT *, CASE WHEN sw THEN greatest(d1, d2) ELSE least(d1, d2) END AS a, CASE WHEN sw THEN least(d1, d2) ELSE greatest(d1, d2) END AS b FROM bo), "
        "az AS (SELECT *, (a // 48) % 12 AS z1, (b // 48) % 12 AS z2, abs((b // 48) % 12 - (a // 48) % 12) AS dz FROM ab), "
        "bz AS (SELECT az.*, m.phi, m.r_ring * 4 + a // 576 + (b // 576) * 2 AS r, dz * 12 + least(z1, z2) - (dz * (dz - 1)) // 2 + CASE WHEN z1 > z2 THEN 60 ELSE 0 END AS z_bin "
        "FROM az JOIN ring_map m ON m.d1r = a % 48 AND m.d2r = b % 48 WHERE dz <= 8), "
        "binned AS (SELECT *, z_bin * 48 * 76 + phi * 76 + r AS bin FROM bz)"
    )
