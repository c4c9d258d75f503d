"""More named queries with their SQL: scalars, arithmetic, converters, low rank; registered beside those of slate."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tomoframe.functions import geometry as geo
from tomoframe.functions import scalars
from tomoframe.operators import aggregate, algebra, convert, image, project, recon, select
from tomoframe.plans.slate import BINNED_HIST, DET, DH, EM, FACTORS, HB, HIST, INTERVALS, LM, LOR, LR, RM, SENS, SH, SIDDON, VOX, VOX2, _rank_parts, _sql_axis, em_data, lors, mask_table, matrix, query, r
from tomoframe.sources import views

# --- scalars

_POLY = f"{scalars.ERFC[-1]!r}e0"
for _c in scalars.ERFC[-2::-1]:
    _POLY = f"({_c!r}e0 + t * {_POLY})"


@query(f"SELECT event_id, round(CASE WHEN x >= 0 THEN e ELSE 2e0 - e END, 7) + 0e0 AS value FROM (SELECT event_id, x, t * exp(-x * x + {_POLY}) AS e FROM (SELECT event_id, x, 1e0 / (1 + 0.5e0 * abs(x)) AS t FROM (SELECT event_id, tof_ps / 1e2 AS x FROM lm)))", LM)
def scalar_erfc(spark, sf):
    return views.lm(spark, sf).select("event_id", r(scalars.erfc(F.col("tof_ps") / F.lit(1e2)), 7).alias("value"))


@query("SELECT event_id, CASE WHEN i < 0 THEN -1 - i WHEN i >= 24 THEN 47 - i ELSE i END AS reflected, CASE WHEN i < 0 THEN i + 24 WHEN i >= 24 THEN i - 24 ELSE i END AS wrapped, CAST(length(CAST(d1 * d2 AS VARCHAR)) AS INTEGER) AS digits FROM (SELECT event_id, d1, d2, d1 % 64 - 20 AS i FROM lm)", LM)
def scalar_index(spark, sf):
    i = F.col("d1") % 64 - 20
    return views.lm(spark, sf).select("event_id", scalars.reflect(24, i).alias("reflected"), scalars.circular(24, i).alias("wrapped"), scalars.digits(F.col("d1") * F.col("d2")).alias("digits"))


@query("SELECT event_id, round(CASE WHEN y1 <> y2 THEN least((-100e0 - y1) / (y2 - y1), (100e0 - y1) / (y2 - y1)) WHEN y1 < -100e0 OR y1 > 100e0 THEN 1e0 ELSE 0e0 END, 6) + 0e0 AS a0, round(CASE WHEN y1 <> y2 THEN greatest((-100e0 - y1) / (y2 - y1), (100e0 - y1) / (y2 - y1)) WHEN y1 < -100e0 OR y1 > 100e0 THEN 0e0 ELSE 1e0 END, 6) + 0e0 AS a1 FROM lor", LM, DET, LOR)
def ray_alpha(spark, sf):
    begin, end = scalars.alpha_range(-100.0, 100.0, F.col("y1"), F.col("y2"))
    return lors(spark, sf).select("event_id", r(begin, 6).alias("a0"), r(end, 6).alias("a1"))


TAPS = (0.1, 0.2, 0.4, 0.25, 0.05)


@query(
    # trapezoids between the knots of the kernel and the two ends
    "SELECT id, round(coalesce(sum((hi - lo) * (f0 + f1) / 2), 0e0), 7) + 0e0 AS value FROM p LEFT JOIN (SELECT id AS q, lo, hi, va + (vb - va) * (lo / 2e0 - k) AS f0, va + (vb - va) * (hi / 2e0 - k) AS f1 FROM ("
    "SELECT id, k, greatest(x0, k * 2e0) AS lo, least(x1, (k + 1) * 2e0) AS hi, coalesce(a.v, 0e0) AS va, coalesce(b.v, 0e0) AS vb FROM p CROSS JOIN range(-3, 3) AS s(k) LEFT JOIN taps a ON a.i = k LEFT JOIN taps b ON b.i = k + 1) WHERE lo < hi) ON q = id GROUP BY id",
    LM, "p AS (SELECT event_id AS id, (event_id % 41 - 20) / 2e0 AS x0, (event_id % 41 - 20) / 2e0 + (d1 % 7 - 1) * 1.3e0 AS x1 FROM lm)",
    "taps AS (SELECT i, v FROM (VALUES " + ", ".join(f"({i - 2}, {v}e0)" for i, v in enumerate(TAPS)) + ") AS t(i, v))",
)
def kernel_integral(spark, sf):
    x0 = (F.col("event_id") % 41 - 20) / F.lit(2e0)
    return views.lm(spark, sf).select(F.col("event_id").alias("id"), r(scalars.kernel_integral(TAPS, 2.0, x0, x0 + (F.col("d1") % 7 - 1) * F.lit(1.3)), 7).alias("value"))


ROT = "ro AS (SELECT event_id, x1, y1, z1, 0.1e0 * (event_id % 5) AS a, 0.07e0 * (event_id % 7) - 0.2e0 AS b, 0.3e0 * (event_id % 11) AS c FROM lor)"


def _rotated(spark, sf):
    e, i = lors(spark, sf), F.col("event_id")
    m = scalars.euler_matrix(F.lit(0.1) * (i % 5), F.lit(0.07) * (i % 7) - F.lit(0.2), F.lit(0.3) * (i % 11))
    t = (F.lit(3.5), F.lit(-1.25), F.lit(0.5))
    p = tuple(F.col(f"{c}1") for c in "xyz")
    return e, m, t, p


@query(
    # three turns one after the other
    "SELECT event_id, round(cos(c) * x2 - sin(c) * y1 + 3.5e0, 4) + 0e0 AS x, round(sin(c) * x2 + cos(c) * y1 - 1.25e0, 4) + 0e0 AS y, round(z2 + 0.5e0, 4) + 0e0 AS z FROM "
    "(SELECT *, cos(b) * x0 + sin(b) * z0 AS x2, cos(b) * z0 - sin(b) * x0 AS z2 FROM (SELECT event_id, b, c, x1 AS x0, cos(a) * y1 - sin(a) * z1 AS y1, sin(a) * y1 + cos(a) * z1 AS z0 FROM ro))",
    LM, DET, LOR, ROT,
)
def rigid_transform(spark, sf):
    e, m, t, p = _rotated(spark, sf)
    return e.select("event_id", *[r(c).alias(n) for n, c in zip("xyz", scalars.apply_rigid(m, t, p), strict=True)])


@query("SELECT event_id, round(x1, 4) + 0e0 AS x, round(y1, 4) + 0e0 AS y, round(z1, 4) + 0e0 AS z FROM lor", LM, DET, LOR)
def rigid_inverse(spark, sf):
    """A transform and its inverse give the point back."""
    e, m, t, p = _rotated(spark, sf)
    there = scalars.apply_rigid(m, t, p)
    e = e.select("event_id", *[c.alias(n) for n, c in zip("xyz", there, strict=True)])
    back, shift = scalars.invert_rigid(m, t)
    return e.select("event_id", *[r(c).alias(n) for n, c in zip("xyz", scalars.apply_rigid(back, shift, tuple(F.col(c) for c in "xyz")), strict=True)])


@query(
    # the rotation matrix of a turn about an axis, on a point turned by 90 degrees about z
    "SELECT event_id, round(co * px + si * (uy * pz - uz * py) + (1 - co) * ux * d, 4) + 0e0 AS x, round(co * py + si * (uz * px - ux * pz) + (1 - co) * uy * d, 4) + 0e0 AS y, round(co * pz + si * (ux * py - uy * px) + (1 - co) * uz * d, 4) + 0e0 AS z FROM "
    "(SELECT *, ux * px + uy * py + uz * pz AS d FROM (SELECT event_id, -y1 AS px, x1 AS py, z1 AS pz, cos(radians(event_id % 360)) AS co, sin(radians(event_id % 360)) AS si, 1e0 / n AS ux, (1e0 + event_id % 3) / n AS uy, -2e0 / n AS uz FROM (SELECT *, sqrt(5e0 + (1e0 + event_id % 3) * (1e0 + event_id % 3)) AS n FROM lor)))",
    LM, DET, LOR,
)
def quaternion_rotation(spark, sf):
    i = F.col("event_id")
    turn = scalars.axis_angle(i % 360, (F.lit(1e0), F.lit(1e0) + i % 3, F.lit(-2e0)))
    quarter = scalars.axis_angle(F.lit(90e0), (F.lit(0e0), F.lit(0e0), F.lit(2e0)))
    got = scalars.quaternion_rotate(scalars.quaternion_product(turn, quarter), tuple(F.col(f"{c}1") for c in "xyz"))
    return lors(spark, sf).select("event_id", *[r(c).alias(n) for n, c in zip("xyz", got, strict=True)])


@query("SELECT event_id, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS INTEGER) AS axis FROM (SELECT event_id, abs(x2 - x1) AS a, abs(y2 - y1) AS b, abs(z2 - z1) AS c FROM lor)", LM, DET, LOR)
def dominant_axis(spark, sf):
    return lors(spark, sf).select("event_id", scalars.argmax_axis(tuple(F.abs(F.col(f"{c}2") - F.col(f"{c}1")) for c in "xyz")).alias("axis"))


def _bell(sigma: float, voxel: float, n: int) -> list[float]:
    raw = [math.exp(-((k * voxel) ** 2) / (2 * sigma**2)) for k in range(-(n // 2), n - n // 2)]
    return [x / math.fsum(raw) for x in raw]


@query("SELECT t, vox, round(value, 6) AS value FROM pz", VOX2, _sql_axis("voxels", "px", 0, _bell(15.0, 25.0, 3)), _sql_axis("px", "py", 1, _bell(25.0, 25.0, 5)), _sql_axis("py", "pz", 2, _bell(30.0, 50.0, 3)))
def psf_gaussian(spark, sf):
    kernels = (scalars.gaussian_kernel(15.0, 25.0), scalars.gaussian_kernel_fwhm(25.0 * scalars.SIGMA_TO_FWHM, 25.0), scalars.gaussian_kernel(30.0, 50.0))
    return image.psf(views.voxels(spark, sf, nt=2), kernels).select("t", "vox", F.round("value", 6).alias("value"))


# --- arithmetic


@query("SELECT t, vox, round(value + sens, 6) + 0e0 AS added, round(value - sens, 6) + 0e0 AS taken, round(value * sens, 6) + 0e0 AS times, round(CASE WHEN sens <> 0 THEN value / sens END, 6) + 0e0 AS ratio FROM voxels JOIN sens USING (vox)", VOX2, SENS)
def array_arithmetic(spark, sf):
    """A 3-D image combined into every frame of a 4-D one."""
    v, s = views.voxels(spark, sf, nt=2), views.sens(spark, sf).withColumnRenamed("sens", "value")
    out = None
    for name, op in (("added", "add"), ("taken", "subtract"), ("times", "multiply"), ("ratio", "divide")):
        e = algebra.combine(v, s, ["vox"], op).select("t", "vox", r("value", 6).alias(name))
        out = e if out is None else out.join(e, ["t", "vox"])
    return out


@query("SELECT vox, 2e0 * value + coalesce(s, 0e0) AS value FROM voxels LEFT JOIN (SELECT vox, sens AS s FROM sens WHERE vox % 3 = 0) USING (vox) UNION ALL SELECT vox + 1000, sens FROM sens WHERE vox % 50 = 0", VOX, SENS)
def attenuation_sum(spark, sf):
    """Hardware and in-vivo attenuation images added, cells of one alone included."""
    s = views.sens(spark, sf)
    other = s.where("vox % 3 = 0").unionByName(s.where("vox % 50 = 0").withColumn("vox", F.col("vox") + 1000)).withColumnRenamed("sens", "value")
    return algebra.combine(algebra.scaled(views.voxels(spark, sf).drop("t"), 2e0), other, ["vox"], "add", outer=True)


def _dense(spark, sf):
    return aggregate.dense_histogram(geo.pair_to_bin(views.hist(spark, sf), geo.ring_map(spark)), F.col("value"))


@query("SELECT bin, round(CASE WHEN value - 5e0 <> 0 THEN 1 / (value - 5e0) ELSE 0e0 END, 8) + 0e0 AS inverse, value * 0.25e0 AS scaled, 7.5e0 AS filled FROM dh", HIST, RM, BINNED_HIST, DH)
def projection_columns(spark, sf):
    h = _dense(spark, sf)
    inverse = algebra.inverted(h.withColumn("value", F.col("value") - 5)).select("bin", r("value", 8).alias("inverse"))
    return inverse.join(algebra.scaled(h, 0.25).withColumnRenamed("value", "scaled"), "bin").join(algebra.filled(h, 7.5).withColumnRenamed("value", "filled"), "bin")


@query("SELECT bin, CASE WHEN bin % 11 = 0 THEN 0e0 WHEN bin % 7 = 0 THEN 9e0 ELSE value END + CASE WHEN bin % 5 = 0 THEN 2e0 ELSE 0e0 END AS value FROM dh", HIST, RM, BINNED_HIST, DH)
def histogram_cells(spark, sf):
    """Cells set, cleared, and incremented twice."""
    h = _dense(spark, sf)
    own = h.select("bin")
    h = algebra.set_cells(h, own.where("bin % 7 = 0").withColumn("value", F.lit(9e0)))
    h = algebra.set_cells(h, own.where("bin % 11 = 0").withColumn("value", F.lit(0e0)))
    once = own.where("bin % 5 = 0").withColumn("value", F.lit(1e0))
    return algebra.set_cells(h, once.unionByName(once), increment=True)


PTS = "pts AS (SELECT event_id, (event_id % 230 - 115) * 1e0 + 0.3e0 AS x, (event_id % 210 - 105) * 1e0 + 0.7e0 AS y, (event_id % 190 - 95) * 1e0 + 0.1e0 AS z, randoms AS amount FROM lm), pv AS (SELECT *, floor((x - 0.37e0) / 25e0 + 4e0) AS i, floor((y + 0.29e0) / 25e0 + 4e0) AS j, floor((z - 0.13e0) / 50e0 + 2e0) AS k FROM pts), pn AS (SELECT event_id, amount, CASE WHEN i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 3 THEN CAST(i + j * 8 + k * 64 AS BIGINT) END AS vox FROM pv)"


def _points(spark, sf):
    i = F.col("event_id")
    return views.lm(spark, sf).select("event_id", ((i % 230 - 115) * F.lit(1e0) + F.lit(0.3)).alias("x"), ((i % 210 - 105) * F.lit(1e0) + F.lit(0.7)).alias("y"), ((i % 190 - 95) * F.lit(1e0) + F.lit(0.1)).alias("z"), F.col("randoms").alias("amount"))


@query("SELECT event_id, coalesce(value, 0e0) AS value FROM pn LEFT JOIN voxels USING (vox)", LM, VOX, PTS)
def image_point_read(spark, sf):
    return algebra.read_points(views.voxels(spark, sf), _points(spark, sf)).select("event_id", "value")


@query("SELECT vox, value + coalesce(a, 0e0) AS value FROM voxels LEFT JOIN (SELECT vox, CAST(sum(CAST(amount AS DECIMAL(18, 5))) AS DOUBLE) AS a FROM pn GROUP BY vox) USING (vox)", LM, VOX, PTS)
def image_point_update(spark, sf):
    """The amounts are whole in the fifth place, so their sum is exact as decimals, in whatever order."""
    points = _points(spark, sf).withColumn("amount", F.col("amount").cast("decimal(18, 5)"))
    return algebra.update_points(views.voxels(spark, sf), points).select("vox", "value")


@query("SELECT t, vox, CASE WHEN sens - t > 1e0 THEN value * (value * 0.5e0) / (sens - t) ELSE value END AS value FROM voxels JOIN sens USING (vox)", VOX2, SENS)
def em_update_4d(spark, sf):
    v = views.voxels(spark, sf, nt=2)
    s = v.select("t", "vox").join(views.sens(spark, sf), "vox").select("t", "vox", (F.col("sens") - F.col("t")).alias("sens"))
    return image.em_update_4d(v, v.withColumn("value", F.col("value") * 0.5), s, 1.0)


@query("SELECT vox, round(sum(w * randoms), 3) + 0e0 AS value FROM sm JOIN lm USING (event_id) WHERE randoms <> 0 GROUP BY vox", LM, DET, LOR, SIDDON)
def subset_sensitivity_sum(spark, sf):
    """The images of four interleaved subsets add up to that of all rows."""
    e = lors(spark, sf).withColumnRenamed("randoms", "value")
    parts = [project.back_lors(select.interleaved(e, 4, k)) for k in range(4)]
    return algebra.sum_images(parts).select("vox", r("value", 3).alias("value"))


# --- low rank


@query("SELECT rank, round(sum(value * sens), 4) + 0e0 AS c FROM wimg JOIN sens USING (vox) GROUP BY rank", LR[-1], SENS)
def lr_h_scaling(spark, sf):
    w = views.voxels(spark, sf, nt=3).select(F.col("t").alias("rank"), "vox", "value")
    return recon.low_rank_sensitivity_h(w, views.sens(spark, sf)).select("rank", r("c").alias("c"))


@query(
    "SELECT CAST(rank AS INTEGER) AS rank, vox, CAST(NULL AS INTEGER) AS frame, round(sum(w * randoms * h), 2) + 0e0 AS value FROM du GROUP BY rank, vox UNION ALL SELECT CAST(rank AS INTEGER), NULL, CAST(frame AS INTEGER), round(sum(w * randoms * x), 1) + 0e0 FROM du GROUP BY rank, frame",
    *LR, "du AS (SELECT hbasis.rank, sm.vox, ef.frame, w, randoms, h, wi.value AS x FROM sm JOIN ef ON ef.bin = event_id JOIN hbasis USING (frame) JOIN wimg wi ON wi.vox = sm.vox AND wi.rank = hbasis.rank JOIN lm ON lm.event_id = sm.event_id WHERE randoms <> 0)",
)
def lr_dual_update(spark, sf):
    m, f, w, h, y = _rank_parts(spark, sf)
    e = recon.low_rank_dual(m, y, w, h, f)
    return e.select("rank", "vox", "frame", F.when(F.col("frame").isNull(), r("value", 2)).otherwise(r("value", 1)).alias("value"))


def _lrem_step(n: int, x: str, h: str) -> str:
    """The ratio of the frames' events and the update of W of pass n, from W in table x and H in table h."""
    return (
        f"lp{n} AS (SELECT event_id, sum(w * wi.value * {h}.h) AS p FROM sm JOIN ef ON ef.bin = event_id JOIN {h} USING (frame) JOIN {x} wi ON wi.vox = sm.vox AND wi.rank = {h}.rank GROUP BY event_id), "
        f"lq{n} AS (SELECT event_id, frame, sens * atten AS f, coalesce(p, 0e0) * sens * atten + randoms + scatter AS q FROM fac JOIN ef ON ef.bin = event_id LEFT JOIN lp{n} USING (event_id)), "
        f"lr{n} AS (SELECT event_id, frame, f / q AS ratio FROM lq{n} WHERE abs(q) > 1e-35 AND f <> 0), "
        f"uw{n} AS (SELECT {h}.rank, sm.vox, sum(w * ratio * {h}.h) AS u FROM sm JOIN lr{n} USING (event_id) JOIN {h} USING (frame) GROUP BY ALL), "
        f"cw{n} AS (SELECT rank, sum(h) AS c FROM {h} GROUP BY rank), "
        f"x{n} AS (SELECT rank, vox, CASE WHEN coalesce(s, 0e0) > 1e-8 / c THEN value * (coalesce(u, 0e0) / c) / s ELSE value END AS value FROM {x} JOIN cw{n} USING (rank) LEFT JOIN se USING (vox) LEFT JOIN uw{n} USING (rank, vox))"
    )


def _lrem(spark, sf, **how):
    m, f, w, h, _ = _rank_parts(spark, sf)
    m, d = recon.cut(m, "matrix"), recon.cut(em_data(spark, sf).withColumnRenamed("event_id", "bin"), "data")
    s = recon.sensitivity(m, d.select("bin", (F.col("sens") * F.col("atten")).alias("value")))
    w, h = recon.low_rank_em(m, d, w, h, recon.cut(f, "frames"), s, **how)
    w = w.select("rank", "vox", F.lit(None).cast("int").alias("frame"), r("value", 4).alias("value"))
    return w.unionByName(h.select("rank", F.lit(None).cast("long").alias("vox"), "frame", r("h", 5).alias("value")))


LREM = (*LR, HIST, SH, FACTORS, EM)


@query(
    "SELECT rank, vox, CAST(NULL AS INTEGER) AS frame, round(value, 4) + 0e0 AS value FROM x2 UNION ALL SELECT rank, NULL, frame, round(h, 5) + 0e0 FROM h2",
    *LREM, _lrem_step(1, "wimg", "hbasis"), _lrem_step(2, "x1", "hbasis"),
    "uh2 AS (SELECT wi.rank, frame, sum(w * ratio * wi.value) AS u FROM sm JOIN lr2 USING (event_id) JOIN x1 wi ON wi.vox = sm.vox GROUP BY ALL)",
    "ch2 AS (SELECT rank, sum(value * coalesce(s, 0e0)) AS c FROM x1 LEFT JOIN se USING (vox) GROUP BY rank)",
    "h2 AS (SELECT rank, frame, h * coalesce(u, 0e0) / greatest(c, 1e-8) AS h FROM hbasis JOIN ch2 USING (rank) LEFT JOIN uh2 USING (rank, frame))",
)
def lrem_dual(spark, sf):
    """Two iterations of both factors; H follows from the second on."""
    return _lrem(spark, sf, iterations=2)


@query(
    "SELECT rank, CAST(NULL AS BIGINT) AS vox, frame, round(h * coalesce(u, 0e0) / greatest(c, 1e-8), 5) + 0e0 AS value FROM hbasis JOIN ch USING (rank) LEFT JOIN uh USING (rank, frame) UNION ALL SELECT rank, vox, NULL, round(value, 4) + 0e0 FROM wimg",
    *LREM, _lrem_step(1, "wimg", "hbasis"),
    "uh AS (SELECT wi.rank, frame, sum(w * ratio * wi.value) AS u FROM sm JOIN lr1 USING (event_id) JOIN wimg wi ON wi.vox = sm.vox GROUP BY ALL)",
    "ch AS (SELECT rank, sum(value * coalesce(s, 0e0)) AS c FROM wimg LEFT JOIN se USING (vox) GROUP BY rank)",
)
def lrem_basis(spark, sf):
    """One iteration of H with W held."""
    return _lrem(spark, sf, iterations=1, update="h")


# --- orders and comparisons


@query("SELECT bin, round(coalesce(sum(value) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 3) + 0e0 AS start FROM dh", HIST, RM, BINNED_HIST, DH)
def prefix_all_bins(spark, sf):
    """Running sum over all bins, as a histogram is laid out as events."""
    return aggregate.exclusive_prefix_all(_dense(spark, sf), ["bin"], "value").select("bin", r("start", 3).alias("start"))


@query(
    "SELECT count(a.event_id) AS left_rows, count(b.event_id) AS right_rows, count(*) FILTER (WHERE b.event_id IS NULL) AS left_only, count(*) FILTER (WHERE a.event_id IS NULL) AS right_only, count(*) FILTER (WHERE a.event_id IS NOT NULL AND b.event_id IS NOT NULL AND a.d1 IS DISTINCT FROM b.d1) AS diff_d1 FROM "
    "(SELECT event_id, d1 FROM lm WHERE event_id % 9 <> 0) a FULL JOIN (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE d1 END AS d1 FROM lm WHERE event_id % 5 <> 0) b USING (event_id)",
    LM,
)
def listmode_compare_whole(spark, sf):
    """Rows that one side alone has are counted, not lost."""
    e = views.lm(spark, sf)
    other = e.where("event_id % 5 <> 0").withColumn("d1", F.when(F.col("event_id") % 4 != 0, F.col("d1")))
    return aggregate.compare_whole(e.where("event_id % 9 <> 0"), other, "event_id", ["d1"])


# --- enumeration and selection


@query("SELECT CAST(5 + id // 12 * 40 + id % 12 AS BIGINT) AS bin FROM range((SELECT count(*) // 12 * 12 FROM events)) AS r(id)")
def range_2d(spark, sf):
    """As many slices of 12 bins as the events fill."""
    return select.range_2d(spark, views.table(spark, sf, "events").count() // 12, 12, 40, 5)


@query("SELECT event_id, CASE WHEN d1 % 48 >= 10 AND d2 % 48 >= 10 THEN tof_ps ELSE 0e0 END AS tof_ps, CASE WHEN d1 % 48 >= 10 AND d2 % 48 >= 10 THEN randoms ELSE 0e0 END AS randoms FROM lm", LM)
def collect_zeroed(spark, sf):
    """All rows; the columns of those that the filter refuses are 0."""
    ok = (F.col("d1") % 48 >= 10) & (F.col("d2") % 48 >= 10)
    return select.zeroed(views.lm(spark, sf), ok, ["tof_ps", "randoms"]).select("event_id", "tof_ps", "randoms")


@query("SELECT event_id, 'masked' AS kind FROM lm WHERE d1 % 48 >= 10 AND d2 % 48 >= 10 UNION ALL SELECT event_id, 'plain' FROM lm", LM)
def scanner_constraint(spark, sf):
    e = views.lm(spark, sf)
    masked = select.scanner_constraint(e, mask_table(spark)).select("event_id", F.lit("masked").alias("kind"))
    return masked.unionByName(select.scanner_constraint(e, None).select("event_id", F.lit("plain").alias("kind")))


@query("SELECT event_id FROM lm WHERE d1 BETWEEN 0 AND 99 OR d1 = 250 OR d1 BETWEEN 600 AND 700 OR d1 = 1151", LM)
def range_list(spark, sf):
    return views.lm(spark, sf).where(select.in_ranges(F.col("d1"), select.parse_ranges(F.lit("0-99, 250,600-700 ,1151")))).select("event_id")


# --- converters

GATE = (
    "ga AS (SELECT event_id, user_id % 2 AS l1, (event_id % 18 * 2 + event_id % 4 // 2) * 4 + event_id * 7 % 32 // 8 AS a1, (event_id % 56 * 2 + event_id % 4 % 2) * 8 + event_id * 7 % 32 % 8 AS r1, event_id % 2 AS l2, "
    "(user_id % 18 * 2 + user_id % 4 // 2) * 4 + user_id * 5 % 32 // 8 AS a2, (user_id % 56 * 2 + user_id % 4 % 2) * 8 + user_id * 5 % 32 % 8 AS r2 FROM events), "
    "gd AS (SELECT *, l1 * 129024 + a1 * 896 + r1 AS g1, l2 * 129024 + a2 * 896 + r2 AS g2 FROM ga)"
)


def _gate(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    a1, r1 = convert.crystal_index(e % 56, e % 18, e % 4, e * 7 % 32)
    a2, r2 = convert.crystal_index(u % 56, u % 18, u % 4, u * 5 % 32)
    ev = views.table(spark, sf, "events").select("event_id", (u % 2).alias("l1"), a1.alias("a1"), r1.alias("r1"), (e % 2).alias("l2"), a2.alias("a2"), r2.alias("r2"))
    return ev.withColumns({f"g{k}": convert.flat_id(F.col(f"l{k}"), F.col(f"a{k}"), F.col(f"r{k}")) for k in "12"})


@query("SELECT event_id, a1, r1, a2, r2, least(g1, g2) AS d1, greatest(g1, g2) AS d2 FROM gd", GATE)
def gate_detectors(spark, sf):
    low, high = convert.sorted_pair(F.col("g1"), F.col("g2"))
    return _gate(spark, sf).select("event_id", "a1", "r1", "a2", "r2", low.alias("d1"), high.alias("d2"))


@query("SELECT event_id, least(ts_ms, ts_ms + d1 - d2) AS emitted FROM lm", LM)
def emission_time(spark, sf):
    return views.lm(spark, sf).select("event_id", convert.emission_time(F.col("ts_ms"), F.col("ts_ms") + F.col("d1") - F.col("d2")).alias("emitted"))


BLK = (
    "bk AS (SELECT event_id, ts_ms, g1, g2, l, least(x1, x2) AS axial, greatest(x1, x2) - least(x1, x2) AS axial_diff, l + CASE WHEN l = 1 AND g2 % 129024 < g1 % 129024 THEN 1 ELSE 0 END AS layers FROM "
    "(SELECT gd.event_id, ts_ms, g1, g2, g1 // 129024 * 2 + g2 // 129024 AS l, g1 % 129024 // 896 AS x1, g2 % 129024 // 896 AS x2 FROM gd JOIN lm USING (event_id)) WHERE ts_ms > 432000000 AND ts_ms < 1728000000)"
)


def _blocks(spark, sf):
    e = _gate(spark, sf).join(views.lm(spark, sf).select("event_id", "ts_ms"), "event_id")
    return convert.block_ids(e.select("event_id", "ts_ms", F.col("g1").alias("d1"), F.col("g2").alias("d2")), 432000000, 1728000000)


@query("SELECT event_id, layers, axial, axial_diff FROM bk", LM, GATE, BLK)
def event_blocks(spark, sf):
    return _blocks(spark, sf).select("event_id", "layers", "axial", "axial_diff")


@query("SELECT event_id, CASE WHEN axial_diff <= 40 AND (g1 + g2) % 1000 < 700 THEN (g1 + g2) % 1000 * 3 + axial * 100000 + axial_diff * 1000 ELSE -1 END AS proj_id FROM bk", LM, GATE, BLK)
def event_projections(spark, sf):
    pairs = spark.range(700).select(F.col("id").alias("pair"), (F.col("id") * 3).alias("basis_id"))
    first = spark.range(144 * 41).select(F.floor(F.col("id") / 41).alias("axial"), (F.col("id") % 41).alias("axial_diff")).withColumn("first_id", F.col("axial") * 100000 + F.col("axial_diff") * 1000)
    e = _blocks(spark, sf).withColumn("pair", (F.col("d1") + F.col("d2")) % 1000)
    return convert.projection_ids(e, pairs, first, 40).select("event_id", "proj_id")


@query(
    "SELECT CAST(row_number() OVER (ORDER BY t_start) AS BIGINT) AS k, CAST(CASE WHEN mid >= 1209600000 THEN 0 ELSE least(1209600000, (mid // 3600000 + 1) * 3600000) END AS BIGINT) AS edge FROM (SELECT t_start, (t_start + t_next) // 2 AS mid FROM mi WHERE t_next IS NOT NULL) "
    "UNION ALL SELECT 0, 0 UNION ALL SELECT count(*), 1209600000 FROM motion",
    LM, views.SQL_MOTION, INTERVALS,
)
def position_bins(spark, sf):
    return convert.position_bins(views.motion(spark, sf), 0, 1209600000, 3600000)
