"""The named queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions import geometry as geo
from tomoframe.operators import aggregate, image, kernels, kinetic, lookup, project, recon, scatter, select, temporal
from tomoframe.sources import views
from tomoframe.streaming import frames as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, *ctes: str) -> Callable[[Query], Query]:
    """Registers a query under its name; ctes come before sql in one WITH clause."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


def r(c, places: int = 4):  # noqa: ANN001, ANN201
    """Rounded, with -0 as 0."""
    return F.round(c, places) + F.lit(0e0)


LM, RING, DET, LOR = views.sql_lm(), views.sql_lm(48), views.SQL_DET, views.SQL_LOR
HIST, SIGNED, RM = views.sql_hist(), views.sql_hist(25.0), views.SQL_RING_MAP
MASK = "mask AS (SELECT id AS det_id, id % 48 >= 10 AS enabled FROM range(1152) AS r(id))"


def mask_table(spark: SparkSession, at: int = 10) -> DataFrame:
    return spark.range(1152).select(F.col("id").alias("det_id"), (F.col("id") % 48 >= at).alias("enabled"))


def lors(spark: SparkSession, sf: str) -> DataFrame:
    return geo.with_lor(views.lm(spark, sf), geo.det_lut(spark))


# --- scans and subsets


@query("SELECT * FROM lm WHERE ts_ms >= 432000000 AND ts_ms < 864000000", LM)
def time_bounded_scan(spark, sf):
    return select.time_range(views.lm(spark, sf, between=(432000000, 864000000)), 432000000, 864000000)


@query("SELECT event_id, d1, d2 FROM lm WHERE event_id % 4 = 1", LM)
def subset_interleaved(spark, sf):
    return select.interleaved(views.lm(spark, sf), 4, 1).select("event_id", "d1", "d2")


@query("SELECT event_id, d1, d2 FROM lm, (SELECT min(event_id) AS f, count(*) AS n FROM lm) WHERE event_id >= f + 2 * (n // 3) AND event_id < f + n", LM)
def subset_chronological(spark, sf):
    e = views.lm(spark, sf)
    first, n = e.agg(F.min("event_id"), F.count("*")).first()
    return select.chronological(e, 3, 2, n, first=first).select("event_id", "d1", "d2")


@query("SELECT event_id, d1 FROM lm WHERE event_id BETWEEN 100 AND 900 AND (event_id - 100) % 7 = 0", LM)
def subset_range_stride(spark, sf):
    return select.strided(views.lm(spark, sf), 100, 900, 7, "event_id").select("event_id", "d1")


@query("SELECT event_id, bin, phi FROM binned WHERE phi % 4 = 2", LM, RM, views.sql_binned("lm"))
def subset_phi(spark, sf):
    return geo.pair_to_bin(views.lm(spark, sf), geo.ring_map(spark)).where("phi % 4 = 2").select("event_id", "bin", "phi")


@query("SELECT event_id, CAST(event_id // 1000 AS BIGINT) AS batch FROM lm WHERE event_id // 1000 IN (0, 2)", LM)
def batched_view(spark, sf):
    return views.lm(spark, sf).withColumn("batch", F.floor(F.col("event_id") / 1000)).where("batch IN (0, 2)").select("event_id", "batch")


@query("SELECT lm.event_id, lm.d1 FROM lm WHERE event_id IN (SELECT o_orderkey FROM orders)", LM)
def subset_explicit_ids(spark, sf):
    ids = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"))
    return views.lm(spark, sf).join(ids, "event_id", "left_semi").select("event_id", "d1")


# --- geometry


@query("SELECT det.*, n FROM det JOIN used USING (det_id) WHERE n > 0", LM, DET, views.sql_usage("used", "d1"))
def det_lut(spark, sf):
    """Places and normals of the detectors that events start from, with their events."""
    return geo.det_lut(spark).join(views.usage(spark, sf, "d1").where("n > 0"), "det_id")


@query("SELECT d1r, d2r, r_ring, phi, n FROM ring_map JOIN (SELECT least(d1 % 48, d2 % 48) AS d1r, greatest(d1 % 48, d2 % 48) AS d2r, count(*) AS n FROM lm GROUP BY ALL) USING (d1r, d2r)", LM, RM)
def ring_map(spark, sf):
    """The pairs of one ring's positions that events have, with their coordinates."""
    a, b = F.col("d1") % 48, F.col("d2") % 48
    pairs = views.lm(spark, sf).groupBy(F.least(a, b).alias("d1r"), F.greatest(a, b).alias("d2r")).agg(F.count("*").alias("n"))
    return geo.ring_map(spark).join(pairs, ["d1r", "d2r"]).select("d1r", "d2r", "r_ring", "phi", "n")


@query("SELECT event_id, r, phi, z_bin, bin FROM binned", LM, RM, views.sql_binned("lm"))
def pair_to_bin(spark, sf):
    return geo.pair_to_bin(views.lm(spark, sf), geo.ring_map(spark)).select("event_id", "r", "phi", "z_bin", "bin")


ZMAP = "zm AS (SELECT i // 12 AS z1, i % 12 AS z2, abs(i % 12 - i // 12) * 12 + least(i // 12, i % 12) - (abs(i % 12 - i // 12) * (abs(i % 12 - i // 12) - 1)) // 2 + CASE WHEN i // 12 > i % 12 THEN 60 ELSE 0 END AS z_bin FROM range(144) AS r(i) WHERE abs(i % 12 - i // 12) <= 8)"


@query(
    "SELECT q.bin, q.r, q.phi, q.z_bin, m.d1r + z.z1 * 48 + (q.r % 4 % 2) * 576 AS d1, m.d2r + z.z2 * 48 + (q.r % 4 // 2) * 576 AS d2 "
    "FROM (SELECT bin, bin // 3648 AS z_bin, bin % 3648 // 76 AS phi, bin % 3648 % 76 AS r FROM (SELECT DISTINCT bin FROM binned)) q "
    "JOIN ring_map m ON m.r_ring = q.r // 4 AND m.phi = q.phi JOIN zm z ON z.z_bin = q.z_bin",
    LM, RM, views.sql_binned("lm"), ZMAP,
)
def bin_to_pair(spark, sf):
    pairs = geo.ring_map(spark)
    bins = geo.pair_to_bin(views.lm(spark, sf), pairs).select("bin").distinct()
    return geo.bin_to_pair(bins, pairs, geo.z_map(spark))


@query("SELECT event_id, x1, y1, z1, x2, y2, z2 FROM lor", LM, DET, LOR)
def native_lor(spark, sf):
    return lors(spark, sf).select("event_id", "x1", "y1", "z1", "x2", "y2", "z2")


@query(
    "SELECT event_id, round(a.x + (floor(event_id % 256 / 32e0) * 10 / 8 - 5) * a.nx, 4) + 0e0 AS x1, round(a.y + (floor(event_id % 256 / 32e0) * 10 / 8 - 5) * a.ny, 4) + 0e0 AS y1, "
    "round(b.x + (floor((event_id * 7) % 256 / 32e0) * 10 / 8 - 5) * b.nx, 4) + 0e0 AS x2 FROM lm JOIN det a ON a.det_id = d1 JOIN det b ON b.det_id = d2",
    LM, DET,
)
def doi_lor(spark, sf):
    """Endpoints moved along the normals by the depth code: 8 layers of a 10 mm crystal."""
    d = geo.det_lut(spark)
    a, b = (F.broadcast(d.select(F.col("det_id").alias(f"d{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "nx", "ny")])) for k in "12")
    e = views.lm(spark, sf).join(a, "d1").join(b, "d2")
    depth = lambda c: F.floor(c / F.lit(32e0)) * 10 / 8 - F.lit(5e0)
    one, two = depth(F.col("event_id") % 256), depth(F.col("event_id") * 7 % 256)
    return e.select("event_id", r(F.col("x1") + one * F.col("nx1")).alias("x1"), r(F.col("y1") + one * F.col("ny1")).alias("y1"), r(F.col("x2") + two * F.col("nx2")).alias("x2"))


@query("SELECT event_id, round(degrees(atan2(y1, x1)), 4) + 0e0 AS beta, round(sqrt(x1 * x1 + y1 * y1), 4) + 0e0 AS u FROM lor", LM, DET, LOR)
def endpoint_polar(spark, sf):
    return lors(spark, sf).select("event_id", r(F.degrees(F.atan2("y1", "x1"))).alias("beta"), r(F.sqrt(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1"))).alias("u"))


@query(
    "SELECT event_id, round(atan2(x1 - x2, y2 - y1), 4) + 0e0 AS beta, round((x1 * y2 - x2 * y1) / sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 4) + 0e0 AS u FROM lor WHERE x1 <> x2 OR y1 <> y2",
    LM, DET, LOR,
)
def radon_parameters(spark, sf):
    """Angle and signed distance of each pair's line in the plane."""
    e = lors(spark, sf).where("x1 <> x2 OR y1 <> y2")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return e.select("event_id", r(F.atan2(F.col("x1") - F.col("x2"), dy)).alias("beta"), r((F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / F.sqrt(dx * dx + dy * dy)).alias("u"))


# --- constraints


@query("SELECT event_id FROM lm WHERE least(abs(d1 % 48 - d2 % 48) % 48, 48 - abs(d1 % 48 - d2 % 48) % 48) >= 6", LM)
def constraint_angle_idx(spark, sf):
    return views.lm(spark, sf).where(select.angle_index(6)).select("event_id")


ANGLE = "degrees(pi() - abs(abs(atan2(y1, x1) - atan2(y2, x2)) - pi()))"


@query(f"SELECT event_id, round({ANGLE}, 3) + 0e0 AS angle FROM lor WHERE {ANGLE} >= 47.3", LM, DET, LOR)
def constraint_angle_deg(spark, sf):
    return lors(spark, sf).where(select.angle_degrees(47.3)).select("event_id", r(geo.in_plane_angle_diff(), 3).alias("angle"))


@query("SELECT event_id FROM lm WHERE least(abs((d1 % 48) // 4 - (d2 % 48) // 4) % 12, 12 - abs((d1 % 48) // 4 - (d2 % 48) // 4) % 12) >= 2", LM)
def constraint_block(spark, sf):
    return views.lm(spark, sf).where(select.block_index(2)).select("event_id")


@query("SELECT event_id FROM lm WHERE d1 % 48 >= 10 AND d2 % 48 >= 10", LM)
def constraint_detmask(spark, sf):
    return select.both_enabled(views.lm(spark, sf), mask_table(spark)).select("event_id")


@query("SELECT event_id FROM lm WHERE abs((d1 // 48) % 12 - (d2 // 48) % 12) <= 3", LM)
def constraint_ring_diff(spark, sf):
    return views.lm(spark, sf).where(select.ring_difference(3)).select("event_id")


@query(
    "SELECT event_id FROM lm WHERE d1 % 48 >= 10 AND d2 % 48 >= 10 AND least(abs(d1 % 48 - d2 % 48) % 48, 48 - abs(d1 % 48 - d2 % 48) % 48) >= 6 "
    "AND least(abs((d1 % 48) // 4 - (d2 % 48) // 4) % 12, 12 - abs((d1 % 48) // 4 - (d2 % 48) // 4) % 12) >= 2",
    LM,
)
def constraint_all(spark, sf):
    e = views.lm(spark, sf).where(select.angle_index(6) & select.block_index(2))
    return select.both_enabled(e, mask_table(spark)).select("event_id")


# --- frames and motion


@query("SELECT event_id, coalesce(f.frame, -1) AS frame FROM lm LEFT JOIN frames f ON ts_ms >= t_start AND ts_ms < t_stop", LM, views.sql_frames(views.LATE_FRAMES))
def dynamic_frame_assign(spark, sf):
    return temporal.assign_frames(views.lm(spark, sf), views.frames(spark, views.LATE_FRAMES)).select("event_id", "frame")


@query("SELECT frame, t_start, t_stop - t_start AS duration FROM frames", LM, views.SQL_EVENT_FRAMES)
def frame_durations(spark, sf):
    return temporal.frame_durations(views.event_frames(spark, sf))


@query("SELECT min(t_start - prev) > 0 AS rising FROM (SELECT t_start, lag(t_start) OVER (ORDER BY frame) AS prev FROM frames)", LM, views.SQL_EVENT_FRAMES)
def framing_valid(spark, sf):
    from pyspark.sql import Window

    f = views.event_frames(spark, sf)
    return f.select((F.col("t_start") - F.lag("t_start").over(Window.orderBy("frame"))).alias("d")).agg((F.min("d") > 0).alias("rising"))


INTERVALS = "mi AS (SELECT *, lead(t_start) OVER (ORDER BY t_start) AS t_next, coalesce(lead(t_start) OVER (ORDER BY t_start) - t_start, t_start - lag(t_start) OVER (ORDER BY t_start), 1) AS duration FROM motion)"


@query("SELECT frame, t_start, duration FROM mi", LM, views.SQL_MOTION, INTERVALS)
def motion_durations(spark, sf):
    return temporal.motion_intervals(views.motion(spark, sf)).select("frame", "t_start", "duration")


ASOF = "asof_lm AS (SELECT lm.*, coalesce(m.frame, -1) AS motion_frame, coalesce(c, 1e0) AS c, coalesce(s, 0e0) AS s, coalesce(tx, 0e0) AS tx, coalesce(ty, 0e0) AS ty, coalesce(tz, 0e0) AS tz FROM lm LEFT JOIN mi m ON ts_ms >= t_start AND (t_next IS NULL OR ts_ms < t_next))"


@query("SELECT event_id, motion_frame FROM asof_lm", LM, views.SQL_MOTION, INTERVALS, ASOF)
def motion_asof(spark, sf):
    return temporal.motion_asof(views.lm(spark, sf), views.motion(spark, sf)).select("event_id", "motion_frame")


@query(
    "SELECT event_id, round(c * a.x - s * a.y + tx, 4) + 0e0 AS x1, round(s * a.x + c * a.y + ty, 4) + 0e0 AS y1, round(a.z + tz, 4) + 0e0 AS z1, "
    "round(c * b.x - s * b.y + tx, 4) + 0e0 AS x2, round(s * b.x + c * b.y + ty, 4) + 0e0 AS y2, round(b.z + tz, 4) + 0e0 AS z2 "
    "FROM asof_lm JOIN det a ON a.det_id = d1 JOIN det b ON b.det_id = d2",
    LM, DET, views.SQL_MOTION, INTERVALS, ASOF,
)
def moved_lor(spark, sf):
    e = temporal.move(geo.with_lor(temporal.motion_asof(views.lm(spark, sf), views.motion(spark, sf)), geo.det_lut(spark)))
    return e.select("event_id", *[r(F.col(c)).alias(c) for c in ("x1", "y1", "z1", "x2", "y2", "z2")])


@query("SELECT f.frame AS dyn, m.frame AS mot FROM frames f JOIN motion m ON m.t_start >= f.t_start AND m.t_start <= f.t_stop", LM, views.SQL_EVENT_FRAMES, views.SQL_MOTION)
def motion_in_frames(spark, sf):
    f, m = views.event_frames(spark, sf).withColumnRenamed("t_start", "f_start"), views.motion(spark, sf).withColumnRenamed("frame", "mot")
    return f.join(m, (F.col("t_start") >= F.col("f_start")) & (F.col("t_start") <= F.col("t_stop"))).select(F.col("frame").alias("dyn"), "mot")


@query(
    "SELECT frame, duration / sum(duration) OVER () AS share, round(exp(-t_start / 6.6e8) - exp(-t_stop / 6.6e8), 6) + 0e0 AS decay FROM (SELECT frame, t_start, t_stop, CAST(t_stop - t_start AS DOUBLE) AS duration FROM frames)",
    LM, views.SQL_EVENT_FRAMES,
)
def frame_weights(spark, sf):
    """Share of the scan, and share of decays, of each frame."""
    f = views.event_frames(spark, sf)
    total = f.agg(F.sum((F.col("t_stop") - F.col("t_start")).cast("double")).alias("total"))
    return f.crossJoin(F.broadcast(total)).select("frame", ((F.col("t_stop") - F.col("t_start")).cast("double") / F.col("total")).alias("share"), r(F.exp(-F.col("t_start") / F.lit(6.6e8)) - F.exp(-F.col("t_stop") / F.lit(6.6e8)), 6).alias("decay"))


@query("SELECT max(ts_ms) - min(ts_ms) AS duration FROM (SELECT arg_min(ts_ms, event_id) AS ts_ms FROM lm UNION ALL SELECT arg_max(ts_ms, event_id) FROM lm)", LM)
def scan_duration(spark, sf):
    return views.lm(spark, sf).agg((F.max_by("ts_ms", "event_id") - F.min_by("ts_ms", "event_id")).alias("duration"))


FRAMED = "framed AS (SELECT lm.*, coalesce(f.frame, -1) AS frame FROM lm LEFT JOIN frames f ON ts_ms >= t_start AND ts_ms < t_stop)"


@query("SELECT frame, least(d1, d2) AS d1, greatest(d1, d2) AS d2, CAST(count(*) AS DOUBLE) AS value FROM framed WHERE frame >= 0 GROUP BY ALL", RING, views.sql_frames(), FRAMED)
def frame_pair_histogram(spark, sf):
    return streaming.frame_histogram(views.lm(spark, sf, 48), views.frames(spark))


# --- histograms


@query("SELECT least(d1, d2) AS d1, greatest(d1, d2) AS d2, CAST(count(*) AS DOUBLE) AS value FROM lm GROUP BY ALL", LM)
def sparse_histogram(spark, sf):
    return aggregate.sparse_histogram(views.lm(spark, sf))


@query("SELECT least(d1, d2) AS d1, greatest(d1, d2) AS d2, sum(value) AS value FROM hist WHERE value <> 0 GROUP BY ALL", SIGNED)
def sparse_histogram_signed(spark, sf):
    return aggregate.sparse_histogram(views.hist(spark, sf, 25.0), F.col("value"))


@query("SELECT bin, sum(value) AS value FROM binned WHERE d1 <> d2 AND value > 0 GROUP BY bin", SIGNED, RM, views.sql_binned("hist"))
def dense_histogram(spark, sf):
    return aggregate.dense_histogram(geo.pair_to_bin(views.hist(spark, sf, 25.0), geo.ring_map(spark)), F.col("value"))


@query("SELECT bin, sum(value) AS value FROM binned WHERE d1 <> d2 AND value > 0 AND d1 % 48 >= 10 AND d2 % 48 >= 10 GROUP BY bin", SIGNED, RM, views.sql_binned("hist"))
def dense_histogram_masked(spark, sf):
    kept = select.both_enabled(views.hist(spark, sf, 25.0), mask_table(spark))
    return aggregate.dense_histogram(geo.pair_to_bin(kept, geo.ring_map(spark)), F.col("value"))


@query("SELECT bin, 2.5e0 AS value FROM (SELECT DISTINCT bin FROM binned)", LM, RM, views.sql_binned("lm"))
def uniform_histogram_lookup(spark, sf):
    bins = geo.pair_to_bin(views.lm(spark, sf), geo.ring_map(spark)).select("bin").distinct()
    return recon.generated(spark, geo.FAKE.bins, 2.5).join(bins, "bin", "left_semi")


@query("SELECT det_id, CAST(count(*) AS DOUBLE) AS value FROM (SELECT unnest([d1, d2]) AS det_id FROM lm) GROUP BY det_id", LM)
def detector_usage(spark, sf):
    return aggregate.detector_usage(views.lm(spark, sf))


@query(
    "SELECT least(d1, d2) AS d1, greatest(d1, d2) AS d2, sum(value) AS value FROM (SELECT d1, d2, value FROM hist UNION ALL SELECT d1, d2, 1e0 FROM lm UNION ALL SELECT d2, d1, value FROM hist) WHERE value <> 0 GROUP BY ALL",
    LM, HIST,
)
def cumulate_histograms(spark, sf):
    h = views.hist(spark, sf)
    return aggregate.cumulate([h, views.lm(spark, sf).select("d1", "d2", F.lit(1e0).alias("value")), h.select(F.col("d2").alias("d1"), F.col("d1").alias("d2"), "value")])


SH = "sh AS (SELECT least(d1, d2) AS d1, greatest(d1, d2) AS d2, sum(value) AS value FROM hist WHERE value <> 0 GROUP BY ALL)"


@query(
    "SELECT d1, d2, unnest(generate_series(1, n)) AS copy FROM (SELECT d1, d2, CAST(trunc(round(value / (SELECT sum(value) FROM sh) * 20000)) AS BIGINT) AS n FROM sh) WHERE n > 0",
    HIST, SH,
)
def histogram_to_listmode(spark, sf):
    return aggregate.to_listmode(aggregate.sparse_histogram(views.hist(spark, sf), F.col("value")), 20000)


@query("SELECT d1, d2, CAST(coalesce(sum(value) OVER (PARTITION BY d1 ORDER BY d2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start FROM sh", HIST, SH)
def exclusive_prefix_sum(spark, sf):
    h = aggregate.sparse_histogram(views.hist(spark, sf), F.col("value"))
    return aggregate.exclusive_prefix(h, "d1", "d2", "value").select("d1", "d2", F.col("start").cast("double").alias("start"))


@query("SELECT event_id, CASE WHEN d1 % 48 >= 10 AND d2 % 48 >= 10 THEN d1 ELSE 0 END AS d1, CASE WHEN d1 % 48 >= 10 AND d2 % 48 >= 10 THEN d2 ELSE 0 END AS d2 FROM lm", LM)
def listmode_copy_masked(spark, sf):
    return select.mark_disabled(views.lm(spark, sf), mask_table(spark)).select("event_id", "d1", "d2")


@query(
    "SELECT count(*) AS rows, CAST(sum(CASE WHEN a.d1 IS NOT DISTINCT FROM b.d1 THEN 0 ELSE 1 END) AS BIGINT) AS diff_d1, CAST(sum(CASE WHEN a.d2 IS NOT DISTINCT FROM b.d2 THEN 0 ELSE 1 END) AS BIGINT) AS diff_d2, "
    "CAST(sum(CASE WHEN a.tof_ps IS NOT DISTINCT FROM b.tof_ps THEN 0 ELSE 1 END) AS BIGINT) AS diff_tof_ps FROM lm a JOIN other b USING (event_id)",
    LM, "other AS (SELECT event_id, d1, CASE WHEN event_id % 10 = 0 THEN d2 + 1 ELSE d2 END AS d2, tof_ps FROM lm)",
)
def listmode_compare(spark, sf):
    e = views.lm(spark, sf)
    return aggregate.compare(e, e.withColumn("d2", F.when(F.col("event_id") % 10 == 0, F.col("d2") + 1).otherwise(F.col("d2"))), "event_id", ["d1", "d2", "tof_ps"])


@query("SELECT (event_id * 2654435761 + 7 * 40503) % 1000003 % 4 AS part, count(*) AS rows, round(sum(randoms / 4), 3) AS randoms FROM lm WHERE d1 % 48 >= 10 AND d2 % 48 >= 10 GROUP BY part", LM)
def low_count_split(spark, sf):
    e = recon.bootstrap_split(select.both_enabled(views.lm(spark, sf), mask_table(spark)), 4, 7)
    return e.groupBy("part").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("randoms") / 4), 3).alias("randoms"))


# --- corrections


@query("SELECT event_id, CASE WHEN least(lm.d1, lm.d2) = 0 AND greatest(lm.d1, lm.d2) = 0 THEN 0e0 ELSE coalesce(sh.value, 0e0) END AS correction FROM lm LEFT JOIN sh ON sh.d1 = least(lm.d1, lm.d2) AND sh.d2 = greatest(lm.d1, lm.d2)", LM, HIST, SH)
def correction_lookup_sparse(spark, sf):
    return lookup.lookup_pair(views.lm(spark, sf), aggregate.sparse_histogram(views.hist(spark, sf), F.col("value")), "correction").select("event_id", "correction")


BINNED_HIST = views.sql_binned("hist").replace("bo AS", "hbo AS").replace("FROM bo", "FROM hbo").replace("ab AS", "hab AS").replace("FROM ab", "FROM hab").replace("az AS", "haz AS").replace("az.*", "haz.*").replace("FROM az", "FROM haz").replace("bz AS", "hbz AS").replace("FROM bz", "FROM hbz").replace("binned AS", "hbinned AS")
DH = "dh AS (SELECT bin, sum(value) AS value FROM hbinned WHERE d1 <> d2 AND value > 0 GROUP BY bin)"


@query("SELECT event_id, b.bin, coalesce(dh.value, 0e0) AS correction FROM binned b LEFT JOIN dh USING (bin)", LM, HIST, RM, views.sql_binned("lm"), BINNED_HIST, DH)
def correction_lookup_dense(spark, sf):
    rm = geo.ring_map(spark)
    dense = aggregate.dense_histogram(geo.pair_to_bin(views.hist(spark, sf), rm), F.col("value"))
    return lookup.lookup_bin(geo.pair_to_bin(views.lm(spark, sf), rm), dense, "correction").select("event_id", "bin", "correction")


FACTORS = (
    "sn AS (SELECT d1, d2, 0.5e0 + value / 1e2 AS value FROM sh WHERE d1 % 2 = 0), att AS (SELECT d1, d2, exp(-0.1e0 * value / 1e1) AS value FROM sh WHERE d1 % 3 = 0), sc AS (SELECT d1, d2, value / 1e3 AS value FROM sh), "
    "z AS (SELECT lm.*, least(d1, d2) AS a, greatest(d1, d2) AS b FROM lm), "
    "fac AS (SELECT z.event_id, z.d1, z.d2, z.randoms, CASE WHEN b = 0 THEN 0e0 ELSE coalesce(sn.value, 1e0) END AS sens, CASE WHEN b = 0 THEN 0e0 ELSE coalesce(att.value, 1e0) END AS atten, CASE WHEN b = 0 THEN 0e0 ELSE coalesce(sc.value, 0e0) END AS scatter "
    "FROM z LEFT JOIN sn ON sn.d1 = a AND sn.d2 = b LEFT JOIN att ON att.d1 = a AND att.d2 = b LEFT JOIN sc ON sc.d1 = a AND sc.d2 = b)"
)


def factors(spark, sf):
    h = aggregate.sparse_histogram(views.hist(spark, sf), F.col("value"))
    sens = h.where("d1 % 2 = 0").select("d1", "d2", (F.lit(0.5e0) + F.col("value") / F.lit(1e2)).alias("value"))
    acf = h.where("d1 % 3 = 0").select("d1", "d2", project.attenuation(F.col("value") / F.lit(1e1)).alias("value"))
    return recon.correction_factors(views.lm(spark, sf), sens, acf, h.select("d1", "d2", (F.col("value") / F.lit(1e3)).alias("value")))


@query("SELECT event_id, round(sens, 5) + 0e0 AS sens, round(atten, 5) + 0e0 AS atten, round(scatter, 5) + 0e0 AS scatter FROM fac", LM, HIST, SH, FACTORS)
def correction_factors_wide(spark, sf):
    return factors(spark, sf).select("event_id", r("sens", 5).alias("sens"), r("atten", 5).alias("atten"), r("scatter", 5).alias("scatter"))


@query("SELECT bin, CASE WHEN p <> 0 THEN m / p ELSE p END AS value FROM (SELECT dh.bin, dh.value AS m, CAST(dh.bin % 5 AS DOUBLE) AS p FROM dh)", HIST, RM, BINNED_HIST, DH)
def divide_measurements(spark, sf):
    dense = aggregate.dense_histogram(geo.pair_to_bin(views.hist(spark, sf), geo.ring_map(spark)), F.col("value"))
    return lookup.divide(dense, dense.select("bin", (F.col("bin") % 5).cast("double").alias("value")))


@query("SELECT bin, round(exp(-0.1e0 * value), 6) + 0e0 AS acf FROM dh", HIST, RM, BINNED_HIST, DH)
def acf_from_projection(spark, sf):
    dense = aggregate.dense_histogram(geo.pair_to_bin(views.hist(spark, sf), geo.ring_map(spark)), F.col("value"))
    return dense.select("bin", r(project.attenuation(F.col("value")), 6).alias("acf"))


# --- masks and ranges

MASKS = (LM, views.sql_usage("u1", "d1"), views.sql_usage("u2", "d2"), "m1 AS (SELECT det_id, n % 2 = 0 AS a FROM u1), m2 AS (SELECT det_id, n % 3 <> 0 AS b FROM u2)")


def _masks(spark, sf):
    """Two masks that follow from how often events have a detector."""
    a, b = (views.usage(spark, sf, d) for d in ("d1", "d2"))
    return a.select("det_id", (F.col("n") % 2 == 0).alias("a")).join(b.select("det_id", (F.col("n") % 3 != 0).alias("b")), "det_id")


@query("SELECT det_id, a AND b AS m_and, a OR b AS m_or, a <> b AS m_xor, NOT (a AND b) AS m_nand FROM m1 JOIN m2 USING (det_id)", *MASKS)
def mask_algebra(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _masks(spark, sf).select("det_id", (a & b).alias("m_and"), (a | b).alias("m_or"), (a != b).alias("m_xor"), (~(a & b)).alias("m_nand"))


@query("SELECT CAST(sum(CASE WHEN enabled THEN 1 ELSE 0 END) AS BIGINT) AS enabled, CAST(sum(CASE WHEN enabled THEN 0 ELSE 1 END) AS BIGINT) AS disabled, bool_and(enabled) AS all_on, NOT bool_or(enabled) AS none_on FROM (SELECT a AS enabled FROM m1)", *MASKS)
def mask_counts(spark, sf):
    on = F.col("a")
    return _masks(spark, sf).agg(F.sum(F.when(on, 1).otherwise(0)).alias("enabled"), F.sum(F.when(on, 0).otherwise(1)).alias("disabled"), F.bool_and(on).alias("all_on"), (~F.bool_or(on)).alias("none_on"))


@query(
    "SELECT g, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END AS new FROM "
    "(SELECT g, lo, hi, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rg))) GROUP BY g, k",
    LM, "rg AS (SELECT DISTINCT d1 % 16 AS g, event_id AS lo, event_id + d2 % 40 AS hi FROM lm)",
)
def range_merge(spark, sf):
    e = views.lm(spark, sf).select((F.col("d1") % 16).alias("g"), F.col("event_id").alias("lo"), (F.col("event_id") + F.col("d2") % 40).alias("hi")).distinct()
    return aggregate.merge_ranges(e)


# --- images

VOX, SENS = views.sql_voxels(), views.sql_sens()
VOX2 = views.sql_voxels(2)


@query("SELECT t, vox, CASE WHEN m <= 4.5e0 THEN 2e0 * value + 1e0 ELSE 0.5e0 * value - 1e0 END AS value FROM voxels JOIN (SELECT vox, sens AS m FROM sens) USING (vox)", VOX2, SENS)
def threshold_select(spark, sf):
    return image.threshold_select(views.voxels(spark, sf, nt=2), views.sens(spark, sf).withColumnRenamed("sens", "value"), 4.5, (2e0, 1e0), (0.5e0, -1e0))


@query("SELECT t, vox, CASE WHEN sens > 0 THEN value * (value * 0.5e0 / 1e0) / sens ELSE value END AS value FROM voxels JOIN sens USING (vox)", VOX, SENS)
def em_update_static(spark, sf):
    v = views.voxels(spark, sf)
    return image.em_update(v, v.withColumn("value", F.col("value") * 0.5), views.sens(spark, sf))


@query("SELECT t, vox, CASE WHEN sens > 2e0 / c THEN value * (value * 0.5e0 / c) / sens ELSE value END AS value FROM voxels JOIN sens USING (vox) JOIN (SELECT frame AS t, sum(h) AS c FROM hbasis GROUP BY frame) USING (t)", VOX2, SENS, views.sql_hbasis())
def em_update_dynamic(spark, sf):
    v = views.voxels(spark, sf, nt=2)
    c = views.hbasis(spark, sf).groupBy(F.col("frame").alias("t")).agg(F.sum("h").alias("c"))
    return image.em_update(v, v.withColumn("value", F.col("value") * 0.5), views.sens(spark, sf), 2.0, c)


@query("SELECT round(sum(value), 4) AS total, round(sum(value * sens), 4) AS dot, max(value) AS top FROM voxels JOIN sens USING (vox)", VOX2, SENS)
def voxel_sum_dot(spark, sf):
    e = views.voxels(spark, sf, nt=2).join(views.sens(spark, sf), "vox")
    return e.agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("value") * F.col("sens")), 4).alias("dot"), F.max("value").alias("top"))


@query(
    "SELECT round(sqrt(avg(d * d)), 6) AS rmse, round(sqrt(sum(d * d) / sum(b * b)), 6) AS nrmse, max(abs(d)) AS linf, CAST(sum(CASE WHEN abs(d) > 5e0 THEN 1 ELSE 0 END) AS BIGINT) AS far, round(quantile_cont(abs(d), 0.5), 6) AS median FROM (SELECT value - sens AS d, sens AS b FROM voxels JOIN sens USING (vox))",
    VOX, SENS,
)
def quality_metrics(spark, sf):
    e = views.voxels(spark, sf).join(views.sens(spark, sf), "vox").select((F.col("value") - F.col("sens")).alias("d"), F.col("sens").alias("b"))
    d = F.col("d")
    return e.agg(F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.round(F.sqrt(F.sum(d * d) / F.sum(F.col("b") * F.col("b"))), 6).alias("nrmse"), F.max(F.abs(d)).alias("linf"), F.sum(F.when(F.abs(d) > 5, 1).otherwise(0)).alias("far"), F.round(F.percentile(F.abs(d), 0.5), 6).alias("median"))


def _sql_axis(src: str, dst: str, axis: int, taps: list[float]) -> str:
    n, step = (8, 8, 4)[axis], (1, 8, 64)[axis]
    i = f"(vox // {step} % {n})"
    vals = ", ".join(f"({k - len(taps) // 2}, {w!r}e0)" for k, w in enumerate(taps))
    return f"{dst} AS (SELECT t, vox + (({i} + k + {n}) % {n} - {i}) * {step} AS vox, sum(value * w) AS value FROM {src}, (VALUES {vals}) AS taps(k, w) GROUP BY ALL)"


PSF = ([0.25, 0.5, 0.125], [0.1, 0.8, 0.1], [0.3, 0.4, 0.2])


@query("SELECT t, vox, round(value, 6) AS value FROM pz", VOX2, _sql_axis("voxels", "px", 0, PSF[0]), _sql_axis("px", "py", 1, PSF[1]), _sql_axis("py", "pz", 2, PSF[2]))
def psf_separable(spark, sf):
    return image.psf(views.voxels(spark, sf, nt=2), PSF).select("t", "vox", F.round("value", 6).alias("value"))


@query("SELECT t, vox, round(value, 6) AS value FROM pz", VOX2, _sql_axis("voxels", "px", 0, PSF[0][::-1]), _sql_axis("px", "py", 1, PSF[1][::-1]), _sql_axis("py", "pz", 2, PSF[2][::-1]))
def psf_adjoint(spark, sf):
    return image.psf(views.voxels(spark, sf, nt=2), PSF, adjoint=True).select("t", "vox", F.round("value", 6).alias("value"))


VPSF = "vk AS (SELECT vox, 0.1e0 + 0.05e0 * least(round(abs((vox % 8 - 3.5e0) * 25e0 + 0.37e0) / 60e0), 1e0) AS side FROM sens), vt AS (SELECT vox, vox + ((vox % 8 + d + 8) % 8 - vox % 8) AS other, CASE WHEN d = 0 THEN 1e0 - 2 * side ELSE side END AS w FROM vk, (VALUES (-1), (0), (1)) AS ds(d))"


@query("SELECT v.t, k.vox, round(sum(w * v.value), 6) AS value FROM vt k JOIN voxels v ON v.vox = k.other GROUP BY ALL", VOX2, SENS, VPSF)
def psf_variant(spark, sf):
    return image.variant_psf(views.voxels(spark, sf, nt=2)).select("t", "vox", F.round("value", 6).alias("value"))


@query("SELECT v.t, k.other AS vox, round(sum(w * v.value), 6) AS value FROM vt k JOIN voxels v ON v.vox = k.vox GROUP BY ALL", VOX2, SENS, VPSF)
def psf_variant_adjoint(spark, sf):
    return image.variant_psf(views.voxels(spark, sf, nt=2), adjoint=True).select("t", "vox", F.round("value", 6).alias("value"))


SQL_MOVE = (
    "pt AS (SELECT vox, (vox % 8 - 3.5e0) * 25e0 + 0.37e0 AS x, (vox // 8 % 8 - 3.5e0) * 25e0 + -0.29e0 AS y, (vox // 64 - 1.5e0) * 50e0 + 0.13e0 AS z FROM sens), "
    "bk AS (SELECT vox, weight, (c * (x - tx) + s * (y - ty) - 0.37e0 + 3.5e0 * 25e0) / 25e0 AS cx, (c * (y - ty) - s * (x - tx) - -0.29e0 + 3.5e0 * 25e0) / 25e0 AS cy, (z - tz - 0.13e0 + 1.5e0 * 50e0) / 50e0 AS cz FROM pt, moves), "
    "co AS (SELECT vox, weight, floor(cx) + dx AS i, floor(cy) + dy AS j, floor(cz) + dz AS k, (CASE WHEN dx = 1 THEN cx - floor(cx) ELSE 1 - (cx - floor(cx)) END) * (CASE WHEN dy = 1 THEN cy - floor(cy) ELSE 1 - (cy - floor(cy)) END) * (CASE WHEN dz = 1 THEN cz - floor(cz) ELSE 1 - (cz - floor(cz)) END) AS w "
    "FROM bk, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy), (VALUES (0), (1)) AS d(dz)), "
    "moved AS (SELECT co.vox, sum(weight * w * v.value) AS value FROM co JOIN voxels v ON v.t = 0 AND v.vox = i + j * 8 + k * 64 WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 3 GROUP BY co.vox)"
)


def _targets(spark):
    return spark.range(views.GRID.voxels).withColumnRenamed("id", "vox")


@query("SELECT vox, round(value, 5) AS value FROM moved", VOX, SENS, "moves AS (SELECT 0.8e0 AS c, 0.6e0 AS s, 3.5e0 AS tx, -7.25e0 AS ty, 11e0 AS tz, 1e0 AS weight)", SQL_MOVE)
def image_transform(spark, sf):
    moves = spark.createDataFrame([(0.8, 0.6, 3.5, -7.25, 11.0, 1.0)], "c double, s double, tx double, ty double, tz double, weight double")
    return image.transform(views.voxels(spark, sf), _targets(spark), moves).select("vox", F.round("value", 5).alias("value"))


@query(
    "SELECT vox, round(value, 5) AS value FROM moved",
    LM, VOX, SENS, views.SQL_MOTION, INTERVALS,
    "win AS (SELECT * FROM mi WHERE t_start >= 86400000 AND t_start <= 1814400000)", "moves AS (SELECT c, s, tx, ty, tz, duration / (SELECT CAST(sum(duration) AS DOUBLE) FROM win) AS weight FROM win)", SQL_MOVE,
)
def time_average_move(spark, sf):
    """Sum over the motion rows that begin in the window of their share of it times the moved image."""
    m = temporal.motion_intervals(views.motion(spark, sf)).where("t_start >= 86400000 AND t_start <= 1814400000")
    total = m.agg(F.sum("duration").cast("double").alias("total"))
    moves = m.crossJoin(F.broadcast(total)).select("c", "s", "tx", "ty", "tz", (F.col("duration") / F.col("total")).alias("weight"))
    return image.transform(views.voxels(spark, sf), _targets(spark), moves).select("vox", F.round("value", 5).alias("value"))


@query("SELECT vox, round(value, 5) AS value FROM moved", VOX, SENS, "moves AS (SELECT 1e0 AS c, 0e0 AS s, 6.3e0 AS tx, -3.1e0 AS ty, 12.7e0 AS tz, 1e0 AS weight)", SQL_MOVE)
def image_resample(spark, sf):
    """Onto a grid of the same size that is shifted by part of a voxel."""
    moves = spark.createDataFrame([(1.0, 0.0, 6.3, -3.1, 12.7, 1.0)], "c double, s double, tx double, ty double, tz double, weight double")
    return image.transform(views.voxels(spark, sf), _targets(spark), moves).select("vox", F.round("value", 5).alias("value"))


# --- projectors


def _sql_siddon(source: str, key: str, tof: tuple[float, float] | None = None) -> str:
    """sm: rows (key, vox, w) of the lines of source."""
    n, v, o = (8, 8, 4), (25.0, 25.0, 50.0), (0.37, -0.29, 0.13)
    sigma = project.tof_sigma(tof[0]) if tof else 0
    half = [a * b / 2 for a, b in zip(n, v, strict=True)]
    p = ", ".join(f"{a}{k} - {o[i]!r}e0 AS p{a}{k}" for i, a in enumerate("xyz") for k in "12")
    lo, hi = ["0e0", "CASE WHEN qa <> 0 THEN (-qb - sqrt(disc)) / (2e0 * qa) ELSE 0e0 END"], ["1e0", "CASE WHEN qa <> 0 THEN (-qb + sqrt(disc)) / (2e0 * qa) ELSE 1e0 END"]
    where = ["(qa = 0 OR disc > 0)"]
    for i, a in enumerate("xyz"):
        one, two = f"(-{half[i]!r}e0 - p{a}1) / d{a}", f"({half[i]!r}e0 - p{a}1) / d{a}"
        where.append(f"(d{a} <> 0 OR p{a}1 BETWEEN -{half[i]!r} AND {half[i]!r})")
        lo.append(f"CASE WHEN d{a} <> 0 THEN least({one}, {two}) ELSE 0e0 END")
        hi.append(f"CASE WHEN d{a} <> 0 THEN greatest({one}, {two}) ELSE 1e0 END")
    if tof:
        at = f"tof_ps * {project.C_MM_PS * 0.5!r}::DOUBLE"
        lo.append(f"0.5e0 + ({at} - {tof[1] * sigma!r}::DOUBLE) / len")
        hi.append(f"0.5e0 + ({at} + {tof[1] * sigma!r}::DOUBLE) / len")
    cuts = ", ".join(f"list_transform(range({n[i] + 1}), lambda k: CASE WHEN d{a} <> 0 THEN (k * {v[i]!r}e0 - {half[i]!r}e0 - p{a}1) / d{a} END)" for i, a in enumerate("xyz"))
    index = " + ".join(f"CAST(least(greatest(floor((p{a}1 + (a + b) / 2 * d{a} + {half[i]!r}e0) / {v[i]!r}e0), 0), {n[i] - 1}) AS BIGINT) * {(1, 8, 64)[i]}" for i, a in enumerate("xyz"))
    w = "(b - a) * len"
    if tof:
        off = f"(((a + b) / 2 - 0.5e0) * len - {at}) / {sigma!r}::DOUBLE"
        w += f" * exp(-0.5e0 * ({off}) * ({off})) * {1 / ((2 * 3.141592653589793) ** 0.5 * sigma)!r}::DOUBLE"
    extra = ", tof_ps" if tof else ""
    return (
        f"s1 AS (SELECT {key}{extra}, {p} FROM {source}), s2 AS (SELECT *, px2 - px1 AS dx, py2 - py1 AS dy, pz2 - pz1 AS dz FROM s1), "
        "s3 AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS len, dx * dx + dy * dy AS qa, 2e0 * (dx * px1 + dy * py1) AS qb, px1 * px1 + py1 * py1 - 9025e0 AS qc FROM s2), s4 AS (SELECT *, qb * qb - 4e0 * qa * qc AS disc FROM s3), "
        f"s5 AS (SELECT *, greatest({', '.join(lo)}) AS amin, least({', '.join(hi)}) AS amax FROM s4 WHERE {' AND '.join(where)}), "
        f"s6 AS (SELECT *, list_sort(list_concat([amin, amax], list_filter(flatten([{cuts}]), lambda c: c IS NOT NULL AND c > amin AND c < amax))) AS cut FROM s5 WHERE amax > amin), "
        "s7 AS (SELECT *, unnest(cut[:-2]) AS a, unnest(cut[2:]) AS b FROM s6), "
        f"sm AS (SELECT {key}, {index} AS vox, {w} AS w FROM s7 WHERE b - a > 1e-9)"
    )


SIDDON = _sql_siddon("lor", "event_id")


def matrix(spark, sf):
    return project.siddon(lors(spark, sf), keep=("event_id",))


@query("SELECT event_id, vox, round(w, 4) + 0e0 AS w FROM sm", LM, DET, LOR, SIDDON)
def siddon_system_matrix(spark, sf):
    return matrix(spark, sf).select("event_id", "vox", r("w").alias("w"))


@query("SELECT event_id, vox, round(w, 6) + 0e0 AS w FROM sm", LM, DET, LOR, _sql_siddon("lor", "event_id", (500.0, 3.0)))
def tof_weights(spark, sf):
    return project.siddon(lors(spark, sf), tof=(500.0, 3.0), keep=("event_id",)).select("event_id", "vox", r("w", 6).alias("w"))


@query("SELECT event_id, round(sum(w * value), 3) + 0e0 AS value FROM sm JOIN voxels USING (vox) GROUP BY event_id", LM, DET, LOR, SIDDON, VOX)
def forward_project(spark, sf):
    return project.forward(matrix(spark, sf), views.voxels(spark, sf), "event_id").select("event_id", r("value", 3).alias("value"))


@query("SELECT vox, round(sum(w * randoms), 3) + 0e0 AS value FROM sm JOIN lm USING (event_id) WHERE randoms <> 0 GROUP BY vox", LM, DET, LOR, SIDDON)
def back_project(spark, sf):
    return project.back_lors(lors(spark, sf).withColumnRenamed("randoms", "value")).select("vox", r("value", 3).alias("value"))


@query("SELECT abs(a - b) <= 1e-9 * abs(a) AS adjoint FROM (SELECT sum(p * randoms) AS a FROM (SELECT event_id, sum(w * value) AS p FROM sm JOIN voxels USING (vox) GROUP BY event_id) JOIN lm USING (event_id)), (SELECT sum(u * value) AS b FROM (SELECT vox, sum(w * randoms) AS u FROM sm JOIN lm USING (event_id) GROUP BY vox) JOIN voxels USING (vox))", LM, DET, LOR, SIDDON, VOX)
def adjoint_check(spark, sf):
    """<A x, y> = <x, At y> within 1e-9 of its size."""
    m, x = matrix(spark, sf), views.voxels(spark, sf)
    y = views.lm(spark, sf).select("event_id", F.col("randoms").alias("y"))
    a = project.forward(m, x, "event_id").join(y, "event_id").agg(F.sum(F.col("value") * F.col("y")).alias("a"))
    b = project.back(m, y.withColumnRenamed("y", "value"), "event_id").withColumnRenamed("value", "u").join(x, "vox").agg(F.sum(F.col("u") * F.col("value")).alias("b"))
    return a.crossJoin(b).select((F.abs(F.col("a") - F.col("b")) <= F.lit(1e-9) * F.abs("a")).alias("adjoint"))


@query("SELECT least(d1, d2) AS d1, greatest(d1, d2) AS d2, round(sum(p), 3) + 0e0 AS value FROM (SELECT event_id, sum(w * value) AS p FROM sm JOIN voxels USING (vox) GROUP BY event_id) JOIN lm USING (event_id) WHERE abs(p) > 1.1920929e-7 GROUP BY ALL", LM, DET, LOR, SIDDON, VOX)
def sparse_forward(spark, sf):
    p = project.forward(matrix(spark, sf), views.voxels(spark, sf), "event_id").where(F.abs("value") > project.EPS)
    e = views.lm(spark, sf).join(p, "event_id")
    return aggregate.sparse_histogram(e, F.col("value"), keep_zeros=True).select("d1", "d2", r("value", 3).alias("value"))


@query("SELECT vox, round(CASE WHEN s > 5e0 THEN s * 0.5e0 ELSE 0e0 END, 3) + 0e0 AS sens FROM (SELECT vox, sum(w * sens * atten) AS s FROM sm JOIN fac USING (event_id) WHERE sens * atten <> 0 GROUP BY vox)", LM, DET, LOR, SIDDON, HIST, SH, FACTORS)
def sensitivity_image(spark, sf):
    f = factors(spark, sf).select("event_id", "d1", "d2", (F.col("sens") * F.col("atten")).alias("value"))
    return recon.sensitivity_lors(geo.with_lor(f, geo.det_lut(spark)), 5.0, 0.5).select("vox", r("sens", 3).alias("sens"))


EM = (
    "se AS (SELECT vox, sum(w * sens * atten) AS s FROM sm JOIN fac USING (event_id) WHERE sens * atten <> 0 GROUP BY vox), x0 AS (SELECT vox, CASE WHEN s > 0 THEN 0.125e0 ELSE 0e0 END AS x, s FROM se), "
    "pr AS (SELECT event_id, sum(w * x) AS p FROM sm JOIN x0 USING (vox) GROUP BY event_id), q AS (SELECT event_id, sens, atten, (coalesce(p, 0e0) * sens * atten * 1e0 + randoms + scatter) * 1e0 AS q FROM fac LEFT JOIN pr USING (event_id)), "
    "ra AS (SELECT event_id, CASE WHEN abs(q) > 1e-35 THEN 1e0 / q * sens * atten ELSE 0e0 END AS ratio FROM q), up AS (SELECT vox, sum(w * ratio) AS u FROM sm JOIN ra USING (event_id) WHERE ratio <> 0 GROUP BY vox)"
)


def em_data(spark, sf):
    return factors(spark, sf).withColumns({"value": F.lit(1e0), "invivo": F.lit(1e0)})


def em_lines(spark, sf):
    """Each event with its corrections and its segments."""
    return recon.em_lines(geo.with_lor(em_data(spark, sf), geo.det_lut(spark)))


@query("SELECT event_id, round(ratio, 5) + 0e0 AS ratio FROM ra", LM, DET, LOR, SIDDON, HIST, SH, FACTORS, EM)
def em_ratio(spark, sf):
    m, d = matrix(spark, sf), em_data(spark, sf)
    s = recon.sensitivity(m, d.select("event_id", (F.col("sens") * F.col("atten")).alias("value")), key="event_id")
    p = project.forward(m, recon.start_image(s), "event_id").withColumnRenamed("value", "proj")
    e = d.join(p, "event_id", "left").withColumn("proj", F.coalesce("proj", F.lit(0e0)))
    return lookup.em_ratio(e).select("event_id", r("ratio", 5).alias("ratio"))


@query("SELECT vox, round(CASE WHEN s > 0 THEN x * coalesce(u, 0e0) / s ELSE x END, 5) + 0e0 AS value FROM x0 LEFT JOIN up USING (vox)", LM, DET, LOR, SIDDON, HIST, SH, FACTORS, EM)
def osem_one_iteration(spark, sf):
    lines = recon.cut(em_lines(spark, sf), "lines")
    return recon.osem_lines(lines, recon.sensitivity_of(lines), 1, 1).select("vox", r("value", 5).alias("value"))


@query(None)
def osem_subsets(spark, sf):
    """Two iterations of two subsets; checked against numpy in the tests."""
    lines = recon.cut(em_lines(spark, sf), "lines")
    return recon.osem_lines(lines, recon.sensitivity_of(lines), 2, 2).select("vox", r("value", 5).alias("value"))


def _dd_lors(spark, sf):
    d = geo.det_lut(spark)
    a, b = (F.broadcast(d.select(F.col("det_id").alias(f"d{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "z", "nx", "ny", "nz")])) for k in "12")
    return views.lm(spark, sf).join(a, "d1").join(b, "d2")


@query(None)
def multiray_forward(spark, sf):
    rays = project.multi_ray(lors(spark, sf), 4, 1.0, "event_id")
    m = project.siddon(rays, keep=("event_id",)).withColumn("w", F.col("w") / 4)
    return project.forward(m, views.voxels(spark, sf), "event_id").select("event_id", r("value", 3).alias("value"))


# --- low rank

HB = views.sql_hbasis()
WIMG = views.sql_voxels(3, name="wimg", frame="rank")
EF = "ef AS (SELECT event_id AS bin, frame FROM framed WHERE frame >= 0)"


def _rank_parts(spark, sf):
    m = project.siddon(lors(spark, sf), keep=("event_id",)).withColumnRenamed("event_id", "bin")
    f = temporal.assign_frames(views.lm(spark, sf), views.frames(spark)).where("frame >= 0").select(F.col("event_id").alias("bin"), "frame")
    w = views.voxels(spark, sf, nt=3).select(F.col("t").alias("rank"), "vox", "value")
    y = views.lm(spark, sf).select(F.col("event_id").alias("bin"), F.col("randoms").alias("value"))
    return m, f, w, views.hbasis(spark, sf), y


LR = (LM, DET, LOR, SIDDON, views.sql_frames(), FRAMED, EF, HB, WIMG)


@query("SELECT bin, round(sum(w * wi.value * h), 3) + 0e0 AS value FROM sm JOIN ef ON ef.bin = event_id JOIN hbasis USING (frame) JOIN wimg wi ON wi.vox = sm.vox AND wi.rank = hbasis.rank GROUP BY bin", *LR)
def lr_forward(spark, sf):
    m, f, w, h, _ = _rank_parts(spark, sf)
    return recon.low_rank_forward(m, w, h, f).select("bin", r("value", 3).alias("value"))


@query("SELECT hbasis.rank, sm.vox, round(sum(w * randoms * h), 3) + 0e0 AS value FROM sm JOIN ef ON ef.bin = event_id JOIN hbasis USING (frame) JOIN lm ON lm.event_id = sm.event_id WHERE randoms <> 0 GROUP BY ALL", *LR)
def lr_back_w(spark, sf):
    m, f, _, h, y = _rank_parts(spark, sf)
    return recon.low_rank_back_w(m, y, h, f).select("rank", "vox", r("value", 3).alias("value"))


@query("SELECT wi.rank, ef.frame, round(sum(w * randoms * wi.value), 2) + 0e0 AS value FROM sm JOIN ef ON ef.bin = event_id JOIN wimg wi ON wi.vox = sm.vox JOIN lm ON lm.event_id = sm.event_id WHERE randoms <> 0 GROUP BY ALL", *LR)
def lr_back_h(spark, sf):
    m, f, w, _, y = _rank_parts(spark, sf)
    return recon.low_rank_back_h(m, y, w, f).select("rank", "frame", r("value", 2).alias("value"))


@query("SELECT rank, sum(h) AS c FROM hbasis GROUP BY rank", HB)
def lr_scaling(spark, sf):
    return recon.low_rank_scaling(views.hbasis(spark, sf))


# --- kernels

KIMG = "kimg AS (SELECT vec_id AS vox, round(CAST(embedding[1] AS DOUBLE), 4) AS value FROM embeddings), kz AS (SELECT max(vec_id) // 100 + 1 AS nz FROM embeddings)"


def _kernel_image(spark, sf):
    return views.table(spark, sf, "embeddings").select(F.col("vec_id").alias("vox"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("value"))


def _kernel_slices(image) -> int:
    """Slices of 10 x 10 voxels of the whole table."""
    return image.agg(F.max("vox")).first()[0] // 100 + 1


OFFS = "offs AS (SELECT (z + 1) * 9 + (y + 1) * 3 + x + 1 AS n, x, y, z FROM (VALUES (-1), (0), (1)) a(z), (VALUES (-1), (0), (1)) b(y), (VALUES (-1), (0), (1)) c(x))"


@query(
    "SELECT CAST(n AS INTEGER) AS n, i.vox AS i, j.vox AS j, round(exp(-0.5e0 / 0.09e0 * (i.value - j.value) * (i.value - j.value)), 6) + 0e0 AS k FROM kimg i, offs o JOIN kimg j ON j.vox = "
    "greatest(0, least((SELECT nz FROM kz) - 1, i.vox // 100 + o.z)) * 100 + greatest(0, least(9, i.vox // 10 % 10 + o.y)) * 10 + greatest(0, least(9, i.vox % 10 + o.x))",
    KIMG, OFFS,
)
def kernel_neighbors(spark, sf):
    e = _kernel_image(spark, sf)
    return kernels.neighbours(e, 10, 10, _kernel_slices(e), 1, 0.09).select("n", "i", "j", r("k", 6).alias("k"))


@query(
    "SELECT i, j, round(k / sum(k) OVER (PARTITION BY i), 6) + 0e0 AS k FROM (SELECT i, j, exp(-1e0 / 0.5e0 * d) AS k FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM dist) WHERE rn <= 6)",
    KIMG, OFFS,
    "mir AS (SELECT v.vox, o.n, s.value FROM (SELECT vox, vox % 10 AS x, vox // 10 % 10 AS y, vox // 100 AS z, (SELECT nz FROM kz) AS nz FROM kimg) v, offs o JOIN kimg s ON s.vox = "
    "(CASE WHEN v.z + o.z < 0 THEN -(v.z + o.z) - 1 WHEN v.z + o.z >= nz THEN 2 * nz - 1 - (v.z + o.z) ELSE v.z + o.z END) * 100 + (CASE WHEN v.y + o.y < 0 THEN -(v.y + o.y) - 1 WHEN v.y + o.y >= 10 THEN 19 - (v.y + o.y) ELSE v.y + o.y END) * 10 "
    "+ (CASE WHEN v.x + o.x < 0 THEN -(v.x + o.x) - 1 WHEN v.x + o.x >= 10 THEN 19 - (v.x + o.x) ELSE v.x + o.x END))",
    "pat AS (SELECT vox, list(value ORDER BY n) AS p FROM mir GROUP BY vox)",
    "dist AS (SELECT a.vox AS i, b.vox AS j, list_sum(list_transform(range(1, 28), lambda q: (a.p[q] - b.p[q]) * (a.p[q] - b.p[q]))) AS d FROM pat a, offs o JOIN pat b ON b.vox = a.vox + o.x + o.y * 10 + o.z * 100 "
    "WHERE a.vox % 10 + o.x BETWEEN 0 AND 9 AND a.vox // 10 % 10 + o.y BETWEEN 0 AND 9 AND a.vox // 100 + o.z BETWEEN 0 AND (SELECT nz FROM kz) - 1)",
)
def kernel_knn(spark, sf):
    e = _kernel_image(spark, sf)
    return kernels.nearest_in_window(e, 10, 10, _kernel_slices(e), 1, 1, 6, 0.5).select("i", "j", r("k", 6).alias("k"))


@query("SELECT i, j, round(exp(-0.5e0 / 0.09e0 * d * d), 6) + 0e0 AS k FROM (SELECT a.vox AS i, b.vox AS j, abs(a.value - b.value) AS d, row_number() OVER (PARTITION BY a.vox ORDER BY abs(a.value - b.value), b.vox) AS rn FROM kimg a, kimg b) WHERE rn <= 5", KIMG)
def kernel_full(spark, sf):
    return kernels.nearest_by_value(_kernel_image(spark, sf), 5, 0.09).select("i", "j", r("k", 6).alias("k"))


# --- kinetics

TAC = "tac AS (SELECT vec_id AS pix, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS tac FROM embeddings)"
BASES = "bases AS (SELECT CAST(k AS INTEGER) AS k, 0.05e0 * (k + 1) AS kappa, list_transform(range(64), lambda t: 1e0 / (1 + ((t + k * 3) % 7))) AS a, list_transform(range(64), lambda t: 0.5e0 + ((t * (k + 2)) % 11) / 1e1) AS b FROM range(5) AS r(k)), wt AS (SELECT list_transform(range(64), lambda t: 1e0 + t % 3) AS wt)"


def _bases(spark):
    return spark.createDataFrame([(k, 0.05 * (k + 1), [1.0 / (1 + ((t + k * 3) % 7)) for t in range(64)], [0.5 + ((t * (k + 2)) % 11) / 1e1 for t in range(64)]) for k in range(5)], "k int, kappa double, a array<double>, b array<double>")


def _weights():
    return F.array(*[F.lit(1.0 + t % 3) for t in range(64)])


@query(
    "SELECT pix, k, round(r1, 5) + 0e0 AS r1, round(bp, 4) + 0e0 AS bp, round(cost, 5) + 0e0 AS cost FROM (SELECT *, row_number() OVER (PARTITION BY pix ORDER BY cost, k) AS rn FROM ("
    "SELECT pix, k, theta AS r1, theta * 0.1e0 / kappa - 1 AS bp, 0.5e0 * list_sum(list_transform(range(1, 65), lambda i: wt[i] * (tac[i] - a[i] * theta) * (tac[i] - a[i] * theta))) AS cost FROM ("
    "SELECT *, list_sum(list_transform(range(1, 65), lambda i: a[i] * wt[i] * tac[i])) / list_sum(list_transform(range(1, 65), lambda i: a[i] * a[i] * wt[i])) AS theta FROM tac, bases, wt))) WHERE rn = 1",
    TAC, BASES,
)
def srtm2_fit(spark, sf):
    return kinetic.srtm2(views.tac(spark, sf), _bases(spark), _weights(), 0.1).select("pix", "k", r("r1", 5).alias("r1"), r("bp").alias("bp"), r("cost", 5).alias("cost"))


@query(
    "SELECT pix, k, round(t0, 5) + 0e0 AS r1, round(t0 * kappa + t1, 5) + 0e0 AS k2, round((t0 * kappa + t1) / kappa - 1, 4) + 0e0 AS bp, round(cost, 5) + 0e0 AS cost FROM (SELECT *, row_number() OVER (PARTITION BY pix ORDER BY cost, k) AS rn FROM ("
    "SELECT pix, k, kappa, t0, t1, 0.5e0 * list_sum(list_transform(range(1, 65), lambda i: wt[i] * (tac[i] - (a[i] * t0 + b[i] * t1)) * (tac[i] - (a[i] * t0 + b[i] * t1)))) AS cost FROM ("
    "SELECT *, (bb * y0 - ab * y1) / (aa * bb - ab * ab) AS t0, (aa * y1 - ab * y0) / (aa * bb - ab * ab) AS t1 FROM ("
    "SELECT *, list_sum(list_transform(range(1, 65), lambda i: a[i] * wt[i] * tac[i])) AS y0, list_sum(list_transform(range(1, 65), lambda i: b[i] * wt[i] * tac[i])) AS y1, list_sum(list_transform(range(1, 65), lambda i: a[i] * a[i] * wt[i])) AS aa, "
    "list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i] * wt[i])) AS ab, list_sum(list_transform(range(1, 65), lambda i: b[i] * b[i] * wt[i])) AS bb FROM tac, bases, wt)))) WHERE rn = 1",
    TAC, BASES,
)
def srtm_fit(spark, sf):
    return kinetic.srtm(views.tac(spark, sf), _bases(spark), _weights()).select("pix", "k", r("r1", 5).alias("r1"), r("k2", 5).alias("k2"), r("bp").alias("bp"), r("cost", 5).alias("cost"))


# --- scatter

TURN, STEP = "(2e0 * pi() / 16)", "(200e0 / 6)"
_ang = "(CASE WHEN atan2(y{k}, x{k}) < 0 THEN atan2(y{k}, x{k}) + 2e0 * pi() ELSE atan2(y{k}, x{k}) END)"
_pla = f"((greatest(-100e0 + {STEP} / 2, least(100e0 - {STEP} / 2, z{{k}})) + 100e0) / {STEP} - 0.5e0)"
CELLS = "cells AS (SELECT event_id, " + ", ".join(f"CAST(trunc(round({_pla.format(k=k)})) AS BIGINT) AS p{k}, CAST(trunc(round({_ang.format(k=k)} / {TURN} - 0.5e0)) AS BIGINT) % 16 AS a{k}" for k in "12") + " FROM lor)"


@query("SELECT event_id, p1, a1, p2, a2 FROM cells", LM, DET, LOR, CELLS)
def scs_nearest_bin(spark, sf):
    return scatter.cells(lors(spark, sf)).select("event_id", "p1", "a1", "p2", "a2")


@query("SELECT p1, a1, p2, a2, round(sum(randoms), 5) AS randoms, count(*) AS prompts FROM cells JOIN lm USING (event_id) GROUP BY ALL", LM, DET, LOR, CELLS)
def scs_accumulate(spark, sf):
    return scatter.cells(lors(spark, sf)).groupBy("p1", "a1", "p2", "a2").agg(F.round(F.sum("randoms"), 5).alias("randoms"), F.count("*").alias("prompts"))


CELL_KEY = "l_orderkey * 37 + l_partkey * 11 + l_linenumber"
SCV = views.sql_amounts("scv_q", CELL_KEY, 9216) + ", scv AS (SELECT id // 1536 AS p1, id // 96 % 16 AS a1, id // 16 % 6 AS p2, id % 16 AS a2, 1e0 + q % 13 AS value FROM scv_q)"


def cell_values(spark, sf, tofs=1):
    """A value in every cell of the scatter space, from the line items' quantities."""
    i = F.col("id")
    e = views.amounts(spark, sf, F.expr(CELL_KEY), 9216 * tofs)
    return e.select(F.floor(i / 9216).alias("tof"), (F.floor(i / 1536) % 6).alias("p1"), (F.floor(i / 96) % 16).alias("a1"), (F.floor(i / 16) % 6).alias("p2"), (i % 16).alias("a2"), (F.lit(1e0) + F.col("q") % 13).alias("value"))


def _cell_values(spark, sf):
    return cell_values(spark, sf).drop("tof")


@query(
    "SELECT event_id, round(sum(wp * wq * coalesce(value, 0e0)), 4) + 0e0 AS value FROM (SELECT event_id, least(floor(pl1) + dp, 5) AS p1, (floor(an1) + da + 16) % 16 AS a1, (CASE WHEN dp = 1 THEN pl1 - floor(pl1) ELSE 1 - (pl1 - floor(pl1)) END) * (CASE WHEN da = 1 THEN an1 - floor(an1) ELSE 1 - (an1 - floor(an1)) END) AS wp, "
    "least(floor(pl2) + dq, 5) AS p2, (floor(an2) + db + 16) % 16 AS a2, (CASE WHEN dq = 1 THEN pl2 - floor(pl2) ELSE 1 - (pl2 - floor(pl2)) END) * (CASE WHEN db = 1 THEN an2 - floor(an2) ELSE 1 - (an2 - floor(an2)) END) AS wq "
    f"FROM (SELECT event_id, {_pla.format(k=1)} AS pl1, {_ang.format(k=1)} / {TURN} - 0.5e0 AS an1, {_pla.format(k=2)} AS pl2, {_ang.format(k=2)} / {TURN} - 0.5e0 AS an2 FROM lor), (VALUES (0), (1)) a(dp), (VALUES (0), (1)) b(da), (VALUES (0), (1)) c(dq), (VALUES (0), (1)) d(db)) LEFT JOIN scv USING (p1, a1, p2, a2) GROUP BY event_id",
    LM, DET, LOR, SCV,
)
def scs_linear_interp(spark, sf):
    return scatter.interpolate(lors(spark, sf), _cell_values(spark, sf)).select("event_id", r("value").alias("value"))


INSIDE = "ins AS (SELECT p1, a1, p2, a2, value > 6e0 AS inside FROM scv)"
TAILS = (
    "tl AS (SELECT DISTINCT p1, a1, p2, (CASE WHEN inside THEN a2 - b ELSE a2 + b END + 16) % 16 AS a2 FROM (SELECT *, lag(inside) OVER (PARTITION BY p1, a1, p2 ORDER BY a2) AS was FROM ins WHERE a2 >= 1 AND (a2 < a1 OR a2 = 1)), (VALUES (0), (1), (2)) AS bs(b) "
    "WHERE a2 >= 2 AND was <> inside)"
)


@query("SELECT * FROM tl", SCV, INSIDE, TAILS)
def scatter_tail_mask(spark, sf):
    return scatter.tails(_cell_values(spark, sf).select("p1", "a1", "p2", "a2", (F.col("value") > 6).alias("inside")), 3)


@query("SELECT round(sum(prompts - randoms) / sum(value), 6) AS factor FROM (SELECT p1, a1, p2, a2, sum(randoms) AS randoms, count(*) AS prompts FROM cells JOIN lm USING (event_id) GROUP BY ALL) JOIN tl USING (p1, a1, p2, a2) JOIN scv USING (p1, a1, p2, a2)", LM, DET, LOR, CELLS, SCV, INSIDE, TAILS)
def scatter_tail_fit(spark, sf):
    v = _cell_values(spark, sf)
    tail = scatter.tails(v.select("p1", "a1", "p2", "a2", (F.col("value") > 6).alias("inside")), 3)
    got = scatter.cells(lors(spark, sf)).groupBy("p1", "a1", "p2", "a2").agg(F.sum("randoms").alias("randoms"), F.count("*").alias("prompts"))
    e = got.join(tail, ["p1", "a1", "p2", "a2"]).join(v, ["p1", "a1", "p2", "a2"])
    return e.agg(F.round(F.sum(F.col("prompts") - F.col("randoms")) / F.sum("value"), 6).alias("factor"))


@query(
    "SELECT event_id, round(p * p * (p + 2e0 - c - (1 - c * c)), 6) AS kn, round(((1 + a) / (a * a) * (2e0 * (1 + a) / (1 + 2e0 * a) - ln(1 + 2e0 * a) / a) + ln(1 + 2e0 * a) / (2e0 * a) - (1 + 3e0 * a) / ((1 + 2e0 * a) * (1 + 2e0 * a))) / (20e0 / 9 - 1.5e0 * ln(3e0)), 6) AS mu "
    "FROM (SELECT event_id, c, 1 / (2e0 - c) AS p, (511e0 / (2e0 - c)) / 511e0 AS a FROM (SELECT event_id, cos(tof_ps / 1e2) AS c FROM lm))",
    LM,
)
def klein_nishina(spark, sf):
    c = F.cos(F.col("tof_ps") / F.lit(1e2))
    return views.lm(spark, sf).select("event_id", F.round(scatter.klein_nishina(c), 6).alias("kn"), F.round(scatter.mu_scaling(F.lit(511e0) / (F.lit(2e0) - c)), 6).alias("mu"))


@query(None)
def single_scatter(spark, sf):
    pts = [(20.0 * (i % 4) - 30.0, 20.0 * (i // 4 % 4) - 30.0, 30.0 * (i // 16) - 30.0, 1.0 + i % 3, 0.5 + (i * 7 % 5)) for i in range(48)]
    points = spark.createDataFrame(pts, "sx double, sy double, sz double, density double, emission double")
    return scatter.single_scatter(lors(spark, sf), points).select("event_id", F.round(F.col("value") * 1e9, 4).alias("value"))


def entry(spark: SparkSession) -> DataFrame:
    return sparse_histogram(spark, "/root/testdata/sf0.001")
