"""Named queries on images and scatter, with their SQL: kernels on a grid, whole rigid motion, other grids, single scatter."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tomoframe.functions import geometry as geo
from tomoframe.functions.scalars import ERFC
from tomoframe.operators import footprint, image, project, psf, sss, temporal
from tomoframe.plans.slate import CELLS, DET, INTERVALS, LM, LOR, SQL, VOX, VOX2, _sql_siddon, _targets, lors, query, r
from tomoframe.sources import views

# --- kernels

#: One kernel an octant corner: sigmas of two Gaussians and the share of the second.
SIGMAS = [(20.0 + 2 * k, 26.0 + k, 34.0 + 3 * k, 38.0 - k, 22.0 + k, 50.0 - 2 * k, 0.05 * k) for k in range(8)]
VARIANT = psf.VariantPsf((60.0, 60.0, 60.0), (60.0, 60.0, 60.0), tuple(psf.gaussian_box(s[:3], (3.0, 3.0, 3.0), other=s[3:6], share=s[6]) for s in SIGMAS))

_REACH = ", ".join(f"greatest(1, floor(greatest(s{a}, q{a}) * 3 / {v}) - 1) AS r{a}" for a, v in (("x", 25), ("y", 25), ("z", 50)))
_BELL = "exp(-0.5e0 * (pow(dx * 25 / {k}x, 2) + pow(dy * 25 / {k}y, 2) + pow(dz * 50 / {k}z, 2)))"
_OCTANT = " + ".join(f"CAST(least(round(abs(({i} + 0.5e0) * {v} - {n * v / 2}) / 60e0), 1) AS INTEGER) * {step}" for i, v, n, step in (("(vox % 8)", 25, 8, 1), ("(vox // 8 % 8)", 25, 8, 2), ("(vox // 64)", 50, 4, 4)))
TAPS = (
    views.sql_values("kern", "kernel, sx, sy, sz, qx, qy, qz, share", [(k, *s) for k, s in enumerate(SIGMAS)], "INTEGER" + ", DOUBLE" * 7),
    f"box AS (SELECT *, {_BELL.format(k='s')} AS g1, {_BELL.format(k='q')} AS g2 FROM (SELECT *, {_REACH} FROM kern), range(-5, 6) AS a(dx), range(-5, 6) AS b(dy), range(-5, 6) AS c(dz) WHERE abs(dx) <= rx AND abs(dy) <= ry AND abs(dz) <= rz)",
    "taps AS (SELECT kernel, dx, dy, dz, (1 - share) * g1 / sum(g1) OVER (PARTITION BY kernel) + share * g2 / sum(g2) OVER (PARTITION BY kernel) AS w FROM box)",
    f"own AS (SELECT vox, {_OCTANT} AS kernel FROM voxels WHERE t = 0)",
    "near AS (SELECT vox, (vox % 8 + dx + 16) % 8 + (vox // 8 % 8 + dy + 16) % 8 * 8 + (vox // 64 + dz + 16) % 4 * 64 AS other, w FROM own JOIN taps USING (kernel))",
)


@query("SELECT v.t, near.vox, round(sum(w * v.value), 6) AS value FROM near JOIN voxels v ON v.vox = near.other GROUP BY ALL", VOX2, *TAPS)
def psf_kernel_grid(spark, sf):
    """Every voxel gathers with the Gaussian mixture of the nearest point of the kernel grid."""
    return psf.variant(views.voxels(spark, sf, nt=2), VARIANT).select("t", "vox", F.round("value", 6).alias("value"))


@query("SELECT v.t, near.other AS vox, round(sum(w * v.value), 6) AS value FROM near JOIN voxels v ON v.vox = near.vox GROUP BY ALL", VOX2, *TAPS)
def psf_kernel_grid_adjoint(spark, sf):
    return psf.variant(views.voxels(spark, sf, nt=2), VARIANT, adjoint=True).select("t", "vox", F.round("value", 6).alias("value"))


ACROSS = psf.ProjectionPsf(30.0, 2.0, ([0.5, 1.0, 0.25], [0.75, 1.5, 0.5], [1.0, 2.0, 0.125]))
_HAT = "(CASE WHEN u <= -1 THEN 0e0 WHEN u >= 1 THEN 1e0 WHEN u < 0 THEN (1 + u) * (1 + u) / 2 ELSE 1 - (1 - u) * (1 - u) / 2 END)"


@query(
    "SELECT event_id, kernel, round(sum(2e0 * v * (CASE side WHEN 0 THEN -1 ELSE 1 END) * " + _HAT + "), 6) + 0e0 AS value FROM (SELECT *, (CASE side WHEN 0 THEN x0 ELSE x1 END) / 2e0 - i AS u FROM pw JOIN across USING (kernel), (VALUES (0), (1)) AS sides(side)) GROUP BY ALL",
    LM, DET, LOR,
    views.sql_values("across", "kernel, i, v", [(k, i - 1, v) for k, taps in enumerate(ACROSS.kernels) for i, v in enumerate(taps)], "INTEGER, INTEGER, DOUBLE"),
    "pw AS (SELECT event_id, CAST(CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(floor(abs(x1 * (y2 - y1) - y1 * (x2 - x1)) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 30e0), 2) END AS INTEGER) AS kernel, event_id % 9 - 4.5e0 AS x0, event_id % 9 - 3.25e0 AS x1 FROM (SELECT event_id, x1, y1, x2, y2 FROM lor))",
)
def projection_psf_weight(spark, sf):
    """Weight of a stretch across each line, with the kernel for the line's distance from the axis."""
    e = lors(spark, sf).withColumn("kernel", ACROSS.number(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    i = F.col("event_id") % 9
    return e.select("event_id", "kernel", r(ACROSS.weight(F.col("kernel"), i - F.lit(4.5), i - F.lit(3.25)), 6).alias("value"))


# --- motion and grids


def _rigid(i: int) -> tuple[float, ...]:
    """Row i of the literal motion: turns about x, y and z, and a translation."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(a * i), math.sin(a * i)) for a in (0.1, -0.05, 0.2))
    return (cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, 1.5 * i, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -0.75 * i, -sy, cy * sx, cy * cx, 0.25 * i)


POSES = [(i, t, *_rigid(i)) for i, t in enumerate(views.POSE_STARTS)]
SQL_POSES = views.sql_values("motion", "frame, t_start, " + ", ".join(temporal.RIGID), POSES, "INTEGER, BIGINT" + ", DOUBLE" * 12)


def _poses(spark):
    return spark.createDataFrame(POSES, "frame int, t_start long, " + ", ".join(f"{c} double" for c in temporal.RIGID))


_MOVED = ", ".join(f"round(coalesce(r{i}0 * x{k} + r{i}1 * y{k} + r{i}2 * z{k} + t{a}, {a}{k}), 4) + 0e0 AS {a}{k}" for k in "12" for i, a in enumerate("xyz"))


@query(f"SELECT lor.event_id, {_MOVED} FROM lor JOIN (SELECT event_id AS e, ts_ms AS ms FROM lm) ON e = lor.event_id LEFT JOIN mi ON ms >= t_start AND (t_next IS NULL OR ms < t_next)", LM, DET, LOR, SQL_POSES, INTERVALS)
def moved_lor_rigid(spark, sf):
    """Both ends of every event moved by the whole 3 x 4 transform of its motion row."""
    e = temporal.move_rigid(temporal.motion_asof(lors(spark, sf), _poses(spark), temporal.RIGID))
    return e.select("event_id", *[r(f"{a}{k}").alias(f"{a}{k}") for k in "12" for a in "xyz"])


_CORNERS = (
    "co AS (SELECT * EXCLUDE (cx, cy, cz), floor(cx) + dx AS i, floor(cy) + dy AS j, floor(cz) + dz AS k, "
    + " * ".join(f"(CASE WHEN d{a} = 1 THEN c{a} - floor(c{a}) ELSE 1 - (c{a} - floor(c{a})) END)" for a in "xyz")
    + " AS w FROM bk, (VALUES (0), (1)) AS a(dx), (VALUES (0), (1)) AS b(dy), (VALUES (0), (1)) AS d(dz))"
)
_BACK = ", ".join(f"(r0{j} * (x - tx) + r1{j} * (y - ty) + r2{j} * (z - tz) - {o}e0 + {h}e0) / {v}e0 AS c{a}" for j, (a, o, h, v) in enumerate((("x", 0.37, 87.5, 25), ("y", -0.29, 87.5, 25), ("z", 0.13, 75, 50))))
VOX5 = views.sql_voxels(len(POSES))


@query(
    "SELECT co.vox, round(sum(weight * w * v.value), 5) AS value FROM co JOIN voxels v ON v.t = frame AND v.vox = i + j * 8 + k * 64 WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 3 GROUP BY co.vox",
    VOX5, SQL_POSES, INTERVALS,
    "pt AS (SELECT vox, (vox % 8 - 3.5e0) * 25e0 + 0.37e0 AS x, (vox // 8 % 8 - 3.5e0) * 25e0 + -0.29e0 AS y, (vox // 64 - 1.5e0) * 50e0 + 0.13e0 AS z FROM voxels WHERE t = 0)",
    f"bk AS (SELECT vox, frame, duration / (SELECT CAST(sum(duration) AS DOUBLE) FROM mi) AS weight, {_BACK} FROM pt, mi)",
    _CORNERS,
)
def motion_correction(spark, sf):
    """One image a motion row, each moved by its transform and weighted by its share of the time."""
    m = temporal.motion_intervals(_poses(spark))
    return image.motion_correct(views.voxels(spark, sf, nt=len(POSES)), _targets(spark), m).select("vox", F.round("value", 5).alias("value"))


FINE = views.Grid(nx=13, ny=11, nz=7, vx=17.0, vy=19.0, vz=31.0, ox=3.1, oy=-4.2, oz=5.3)


@query(
    "SELECT g.vox, round(coalesce(s, 0e0), 5) AS value FROM pt g LEFT JOIN (SELECT co.vox, sum(w * v.value) AS s FROM co JOIN voxels v ON v.vox = i + j * 8 + k * 64 WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 3 GROUP BY co.vox) USING (vox)",
    VOX,
    "pt AS (SELECT id AS vox, (id % 13 - 6e0) * 17e0 + 3.1e0 AS x, (id // 13 % 11 - 5e0) * 19e0 - 4.2e0 AS y, (id // 143 - 3e0) * 31e0 + 5.3e0 AS z FROM range(1001) AS r(id))",
    "bk AS (SELECT vox, (x - 0.37e0 + 87.5e0) / 25e0 AS cx, (y + 0.29e0 + 87.5e0) / 25e0 AS cy, (z - 0.13e0 + 75e0) / 50e0 AS cz FROM pt)",
    _CORNERS,
)
def resample_grid(spark, sf):
    """Onto a grid of other counts, voxel sizes and origin."""
    to = spark.range(FINE.voxels).withColumnRenamed("id", "vox")
    return image.resample(views.voxels(spark, sf), to, FINE).select("vox", F.round("value", 5).alias("value"))


# --- scatter

#: A crystal by a rule in place of a measured table: attenuation falls with the energy.
DETECTION = sss.Detection([0.08 * (511.0 / (k + 1)) ** 1.5 for k in range(1000)])
WIDTH, LEAST_LINE = 3, 4.0
MU = "mu AS (SELECT vox, (value - 1e0) * 0.0115e0 AS value FROM voxels)"


def _mu(spark, sf):
    return views.voxels(spark, sf).select("vox", ((F.col("value") - F.lit(1e0)) * F.lit(0.0115)).alias("value"))


def _sample(spark, sf):
    return sss.sample_points(spark, _mu(spark, sf), DETECTION, 0.5)


_AT = [f"({i} + {s!r}::DOUBLE * (id + 1) - floor({s!r}::DOUBLE * (id + 1))) * {n * v / 5!r}e0 + {o + v / 2 - n * v / 2!r}e0 AS s{a}" for a, i, s, n, v, o in zip("xyz", ("id % 5", "id // 5 % 5", "id // 25"), sss.SHIFTS, (8, 8, 4), (25.0, 25.0, 50.0), (0.37, -0.29, 0.13), strict=True)]
POINTS = (
    f"sp AS (SELECT id AS point, {', '.join(_AT)} FROM range(125) AS r(id))",
    "points AS (SELECT sp.*, value AS density FROM sp JOIN mu ON vox = floor((sx - 0.37e0) / 25e0 + 4e0) + floor((sy + 0.29e0) / 25e0 + 4e0) * 8 + floor((sz - 0.13e0) / 50e0 + 2e0) * 64 "
    "WHERE floor((sx - 0.37e0) / 25e0 + 4e0) BETWEEN 0 AND 7 AND floor((sy + 0.29e0) / 25e0 + 4e0) BETWEEN 0 AND 7 AND floor((sz - 0.13e0) / 50e0 + 2e0) BETWEEN 0 AND 3 AND value > 0.005e0 AND sqrt(sx * sx + sy * sy + sz * sz) < 190e0)",
)


@query("SELECT point, round(sx, 6) + 0e0 AS sx, round(sy, 6) + 0e0 AS sy, round(sz, 6) + 0e0 AS sz, round(density, 6) AS density FROM points", VOX, MU, *POINTS)
def scatter_points(spark, sf):
    return _sample(spark, sf).select("point", *[r(c, 6).alias(c) for c in ("sx", "sy", "sz", "density")])


def _sql_end(k: str) -> str:
    return f"cos((a{k} + 0.5e0) * 2e0 * pi() / 16) * 200e0 AS x{k}, sin((a{k} + 0.5e0) * 2e0 * pi() / 16) * 200e0 AS y{k}, (p{k} + 0.5e0) * 200e0 / 6 - 100e0 AS z{k}"


def _sql_erfc(x: str) -> str:
    """By the error integral's own approximation, as in the operator."""
    t = f"(1e0 / (1 + abs({x}) / 2))"
    poly = f"{ERFC[-1]!r}e0"
    for c in ERFC[-2::-1]:
        poly = f"({c!r}e0 + {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN {t} * exp({poly} - {x} * {x}) ELSE 2e0 - {t} * exp({poly} - {x} * {x}) END)"


def _sql_stop(path: str, energy: str) -> str:
    return f"(1 - exp(-({path}) * 0.08e0 * pow(511e0 / floor({energy}), 1.5e0)))"


def _sql_ring(ox: str, oy: str, dx: str, dy: str, dz: str) -> str:
    """Path through the crystals of a ray."""
    leave = lambda radius: f"(-({ox} * {dx} + {oy} * {dy}) + sqrt(pow({ox} * {dx} + {oy} * {dy}, 2) - ({dx} * {dx} + {dy} * {dy}) * ({ox} * {ox} + {oy} * {oy} - {radius * radius}e0))) / ({dx} * {dx} + {dy} * {dy})"
    return f"({leave(220)} - {leave(200)}) * sqrt({dx} * {dx} + {dy} * {dy} + {dz} * {dz})"


_SIG = f"{math.sqrt(2) * DETECTION.sigma!r}::DOUBLE"
_W = f"((400e0 - energy) / {_SIG})"
_W511 = f"((400e0 - 511e0) / {_SIG})"
WAYS = (
    f"wl AS (SELECT *, sx AS x2, sy AS y2, sz AS z2, x1 - sx AS ex, y1 - sy AS ey, z1 - sz AS ez FROM (SELECT p1 * 16 + a1 AS f, p1 * 16 + a1 + 1000 * point AS way, point, density, sx, sy, sz, {_sql_end('1')} FROM (SELECT id // 16 AS p1, id % 16 AS a1 FROM range(96) AS r(id)), points))",
    _sql_siddon("wl", "way"),
    "wi AS (SELECT way, sum(w * mu.value) / 10 AS att, sum(w * voxels.value) AS lam FROM sm JOIN mu USING (vox) JOIN voxels USING (vox) GROUP BY way)",
    f"wy AS (SELECT wl.*, sqrt(ex * ex + ey * ey + ez * ez) AS dist, {_sql_ring('sx', 'sy', 'ex', 'ey', 'ez')} AS depth, coalesce(att, 0e0) AS att, coalesce(lam, 0e0) AS lam, abs(sz) <= 100e0 OR sqrt(pow(sx + ((CASE WHEN sz < 0 THEN -100e0 ELSE 100e0 END) - sz) / ez * ex, 2) + pow(sy + ((CASE WHEN sz < 0 THEN -100e0 ELSE 100e0 END) - sz) / ez * ey, 2)) < 190e0 AS clear FROM wl LEFT JOIN wi USING (way))",
    "wz AS (SELECT *, abs(x1 * ex + y1 * ey) / 200e0 / dist AS facing FROM wy WHERE clear)",
    "wc AS (SELECT a.f AS f, b.f AS h, a.density, a.dist AS d1, b.dist AS d2, a.facing * b.facing AS facing, a.att AS t1, b.att AS t2, a.lam AS l1, b.lam AS l2, a.depth AS q1, b.depth AS q2, -(a.ex * b.ex + a.ey * b.ey + a.ez * b.ez) / a.dist / b.dist AS c FROM wz a JOIN wz b ON a.point = b.point AND a.f <> b.f)",
    "we AS (SELECT *, 511e0 / (2e0 - c) AS energy, 1 / (2e0 - c) AS p FROM wc WHERE 511e0 / (2e0 - c) > 400e0)",
    "wm AS (SELECT *, ((1 + p) / (p * p) * (2e0 * (1 + p) / (1 + 2e0 * p) - ln(1 + 2e0 * p) / p) + ln(1 + 2e0 * p) / (2e0 * p) - (1 + 3e0 * p) / ((1 + 2e0 * p) * (1 + 2e0 * p))) / (20e0 / 9 - 1.5e0 * ln(3e0)) AS m FROM we)",
    f"wv AS (SELECT f, h, sum(density * p * p * (p + 2e0 - c - (1 - c * c)) * facing / (d1 * d1 * d2 * d2 * 4 * pi()) * {_sql_erfc(_W511)} * {_sql_erfc(_W)} * (l1 * exp(-t1 - t2 * m) * {_sql_stop('q1', '511e0')} * {_sql_stop('q2', 'energy')} + l2 * exp(-t1 * m - t2) * {_sql_stop('q2', '511e0')} * {_sql_stop('q1', 'energy')})) AS v FROM wm GROUP BY f, h)",
    f"wx AS (SELECT *, x2 - x1 AS gx, y2 - y1 AS gy, z2 - z1 AS gz, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my FROM (SELECT *, {_sql_end('1')}, {_sql_end('2')} FROM (SELECT id // 96 AS f, id % 96 AS h, id // 1536 AS p1, id // 96 % 16 AS a1, id // 16 % 6 AS p2, id % 16 AS a2 FROM range(9216) AS r(id))))",
    f"wo AS (SELECT *, pow({_sql_erfc(_W511)}, 2) * {_sql_stop(_sql_ring('mx', 'my', '(-gx / 2)', '(-gy / 2)', '(-gz / 2)'), '511e0')} * {_sql_stop(_sql_ring('mx', 'my', '(gx / 2)', '(gy / 2)', '(gz / 2)'), '511e0')} * abs(x1 * gx + y1 * gy) / 200e0 * abs(x2 * gx + y2 * gy) / 200e0 / (4 * pi()) / pow(gx * gx + gy * gy + gz * gz, 2) AS own FROM wx WHERE f <> h AND (gx <> 0 OR gy <> 0))",
    "sv AS (SELECT wx.p1, wx.a1, wx.p2, wx.a2, coalesce(v / own, 0e0) AS value FROM wx LEFT JOIN wo USING (f, h) LEFT JOIN wv USING (f, h))",
)


@query("SELECT p1, a1, p2, a2, round(value, 5) AS value FROM sv", VOX, MU, *POINTS, *WAYS)
def scatter_simulated(spark, sf):
    """Single scatter in every cell, through the attenuation image and from the emission image."""
    got = sss.simulate(_sample(spark, sf), _mu(spark, sf), views.voxels(spark, sf), DETECTION)
    return got.select("p1", "a1", "p2", "a2", r("value", 5).alias("value"))


IN_MASK = (
    "cl AS (SELECT f * 100 + h AS cell, p1, a1, p2, a2, x1, y1, z1, x2, y2, z2 FROM wx WHERE f <> h)",
    f"cm AS (WITH {_sql_siddon('cl', 'cell')} SELECT * FROM sm)",
    f"ins AS (SELECT wx.p1, wx.a1, wx.p2, wx.a2, coalesce(s, 0e0) > {LEAST_LINE}e0 AS inside FROM wx LEFT JOIN (SELECT cell, sum(w * mu.value) AS s FROM cm JOIN mu USING (vox) GROUP BY cell) ON cell = f * 100 + h)",
    f"tl AS (SELECT DISTINCT p1, a1, p2, (CASE WHEN inside THEN a2 - b ELSE a2 + b END + 16) % 16 AS a2 FROM (SELECT *, lag(inside) OVER (PARTITION BY p1, a1, p2 ORDER BY a2) AS was FROM ins WHERE a2 >= 1 AND (a2 < a1 OR a2 = 1)), range({WIDTH}) AS bs(b) WHERE a2 >= 2 AND was <> inside)",
)
WX = WAYS[-3]


@query("SELECT * FROM ins", VOX, MU, WX, *IN_MASK[:3])
def scatter_inside(spark, sf):
    """Cells whose line passes through the object."""
    return sss.inside(_mu(spark, sf), DETECTION.radius, LEAST_LINE)


MEASURED = "ms AS (SELECT p1, a1, p2, a2, sum(CASE WHEN sens > 1.1920929e-7 THEN 1e0 / sens ELSE 0e0 END) AS prompts, sum(CASE WHEN randoms > 0 AND sens > 1.1920929e-7 THEN randoms / sens ELSE 0e0 END) AS randoms FROM cells JOIN (SELECT event_id, randoms, (event_id % 5) * 0.5e0 AS sens FROM lm) USING (event_id) GROUP BY ALL)"
FIT = "ft AS (SELECT sum(coalesce(prompts, 0e0) - coalesce(randoms, 0e0)) / sum(value) AS factor FROM tl JOIN sv USING (p1, a1, p2, a2) LEFT JOIN ms USING (p1, a1, p2, a2))"


def _prompts(spark, sf):
    return lors(spark, sf).withColumns({"prompts": F.lit(1.0), "sens": (F.col("event_id") % 5) * F.lit(0.5)})


@query("SELECT p1, a1, p2, a2, round(prompts, 7) + 0e0 AS prompts, round(randoms, 7) + 0e0 AS randoms FROM ms", LM, DET, LOR, CELLS, MEASURED)
def scatter_measured(spark, sf):
    """Prompts and randoms by nearest cell, over the sensitivity."""
    return sss.measured(_prompts(spark, sf)).select("p1", "a1", "p2", "a2", r("prompts", 7).alias("prompts"), r("randoms", 7).alias("randoms"))


@query("SELECT p1, a1, p2, a2, round(value * factor, 5) + 0e0 AS value FROM sv, ft", VOX, MU, *POINTS, *WAYS, *IN_MASK, LM, DET, LOR, CELLS, MEASURED, FIT)
def scatter_estimate(spark, sf):
    """From images and events to the scaled scatter of every cell."""
    got = sss.estimate(_prompts(spark, sf), _sample(spark, sf), _mu(spark, sf), views.voxels(spark, sf), DETECTION, WIDTH, LEAST_LINE)
    return got.select("p1", "a1", "p2", "a2", r("value", 5).alias("value"))


SQL["single_scatter"] = (
    f"WITH {LM}, {DET}, {LOR}, "
    "pts AS (SELECT 20e0 * (i % 4) - 30e0 AS sx, 20e0 * (i // 4 % 4) - 30e0 AS sy, 30e0 * (i // 16) - 30e0 AS sz, 1e0 + i % 3 AS density, 0.5e0 + i * 7 % 5 AS emission FROM range(48) AS r(i)), "
    "tw AS (SELECT event_id, density, emission, x1 - sx AS ax, y1 - sy AS ay, z1 - sz AS az, x2 - sx AS bx, y2 - sy AS b_y, z2 - sz AS bz FROM lor, pts), "
    "tr AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS r1, sqrt(bx * bx + b_y * b_y + bz * bz) AS r2, ax * bx + ay * b_y + az * bz AS d FROM tw), "
    "tc AS (SELECT *, -d / (r1 * r2) AS c, 1 / (2e0 + d / (r1 * r2)) AS p FROM tr), "
    "tm AS (SELECT *, ((1 + p) / (p * p) * (2e0 * (1 + p) / (1 + 2e0 * p) - ln(1 + 2e0 * p) / p) + ln(1 + 2e0 * p) / (2e0 * p) - (1 + 3e0 * p) / ((1 + 2e0 * p) * (1 + 2e0 * p))) / (20e0 / 9 - 1.5e0 * ln(3e0)) AS m FROM tc) "
    "SELECT event_id, round(sum(emission * density * p * p * (p + 2e0 - c - (1 - c * c)) * exp(-0.00096e0 * (r1 + m * r2)) / (r1 * r1 * r2 * r2)) * 1e9, 4) AS value FROM tm GROUP BY event_id"
)


# --- the distance-driven projector


def sql_footprint(source: str, tof: tuple[float, float] | None = None, taps: bool = False, flipped: bool = False) -> str:
    """dd: rows (event_id, vox, w) of the lines of source, written slice by slice; crystals of 12 mm x 9 mm.

    With taps the overlap across the line is a sum over the samples of table across, each a hat.
    """
    sigma = project.tof_sigma(tof[0]) if tof else 1.0
    at = f"tof_ps * {project.C_MM_PS * 0.5!r}::DOUBLE" if tof else "0e0"
    lo, hi = [], []
    for a, half in (("x", 87.5), ("y", 87.5), ("z", 75.0)):
        one, two = f"(-{half}e0 - {a}1) / ({a}2 - {a}1)", f"({half}e0 - {a}1) / ({a}2 - {a}1)"
        lo.append(f"CASE WHEN {a}1 <> {a}2 THEN least({one}, {two}) WHEN abs({a}1) <= {half} THEN 0e0 ELSE 2e0 END")
        hi.append(f"CASE WHEN {a}1 <> {a}2 THEN greatest({one}, {two}) ELSE 1e0 END")
    if tof:
        lo.append(f"0.5e0 + (pos - {tof[1] * sigma!r}::DOUBLE) / len")
        hi.append(f"0.5e0 + (pos + {tof[1] * sigma!r}::DOUBLE) / len")
    ends = ", ".join(f"{a}{k} - {o}e0 AS {a}{k}" for a, o in (("x", 0.37), ("y", -0.29), ("z", 0.13)) for k in "12")
    turned = ", ".join(
        f"CASE WHEN up THEN y{k} ELSE x{k} END AS m{k}, CASE WHEN up THEN x{k} ELSE y{k} END AS c{k}, (CASE WHEN up THEN -nx{k} ELSE ny{k} END) / h{k} * 6e0 AS p{k}, (CASE WHEN up THEN ny{k} ELSE -nx{k} END) / h{k} * 6e0 AS q{k}, "
        f"(CASE WHEN up THEN ny{k} ELSE nx{k} END) * nz{k} / h{k} / l{k} * 4.5e0 AS u{k}, -h{k} / l{k} * 4.5e0 AS v{k}"
        for k in "12"
    )
    cut = lambda s: f"c1 + {s} * q1 + (pix - m1 - {s} * p1) / (m2 - {s} * p2 - m1 - {s} * p1) * (c2 - {s} * q2 - c1 - {s} * q1)"
    lev = lambda s: f"z1 + {s} * v1 + (pix - m1 - {s} * u1) / (m2 + {s} * u2 - m1 - {s} * u1) * (z2 + {s} * v2 - z1 - {s} * v1)"
    weight = f"* exp(-0.5e0 * pow((((pix - m1) / (m2 - m1) - 0.5e0) * len - pos) / {sigma!r}::DOUBLE, 2)) * {1 / ((2 * math.pi) ** 0.5 * sigma)!r}::DOUBLE" if tof else ""
    if taps:
        hat = lambda x: _HAT.replace("u", f"(({x}) / 2e0 - i)")
        own = "-i" if flipped else "i"
        across = f"(SELECT sum(2e0 * v * ({hat('pe + 25e0 - s0')} - {hat('pe - s1')})) FROM (SELECT {own} AS i, v FROM across WHERE across.kernel = f4.kernel))"
        wide, kernel = f"{ACROSS.half_width}e0", ", CAST(least(floor(abs(x1 * (y2 - y1) - y1 * (x2 - x1)) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 30e0), 2) AS INTEGER) AS kernel"
    else:
        across, wide, kernel = "least(pe + 25e0, s1) - greatest(pe, s0)", "0e0", ", 0 AS kernel"
    return (
        f"f0 AS (SELECT event_id, {ends}, {', '.join(f'n{a}{k}' for k in '12' for a in 'xyz')}, {at} AS pos FROM {source}), "
        "f1 AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2) + pow(z2 - z1, 2)) AS len, abs(y2 - y1) > abs(x2 - x1) AS up, " + ", ".join(f"sqrt(nx{k} * nx{k} + ny{k} * ny{k}) AS h{k}, sqrt(nx{k} * nx{k} + ny{k} * ny{k} + nz{k} * nz{k}) AS l{k}" for k in "12") + f"{kernel} FROM f0 WHERE x1 <> x2 OR y1 <> y2), "
        f"f2 AS (SELECT event_id, kernel, len, pos, up, z1, z2, {turned}, greatest(0e0, {', '.join(lo)}) AS a0, least(1e0, {', '.join(hi)}) AS a1 FROM f1), "
        "f3 AS (SELECT *, (i - 3.5e0) * 25e0 AS pix FROM (SELECT *, unnest(generate_series(CAST(greatest(0, least(b0, b1)) AS BIGINT), CAST(least(7, greatest(b0, b1)) AS BIGINT))) AS i FROM (SELECT *, floor((m1 + a0 * (m2 - m1)) / 25e0 + 4) AS b0, floor((m1 + a1 * (m2 - m1)) / 25e0 + 4) AS b1 FROM f2 WHERE a0 <= a1))), "
        f"g3 AS (SELECT event_id, kernel, up, i, least({cut(-1)}, {cut(1)}) AS s0, greatest({cut(-1)}, {cut(1)}) AS s1, least({lev(-1)}, {lev(1)}) AS t0, greatest({lev(-1)}, {lev(1)}) AS t1, 25e0 * len / abs(m2 - m1) {weight} AS step FROM f3), "
        f"f4 AS (SELECT *, (j - 4e0) * 25e0 AS pe FROM (SELECT *, unnest(generate_series(CAST(least(7, greatest(0, floor((s0 - {wide}) / 25e0 + 4))) AS BIGINT), CAST(least(7, greatest(0, floor((s1 + {wide}) / 25e0 + 4))) AS BIGINT))) AS j FROM g3)), "
        f"f5 AS (SELECT *, {across} AS wc FROM f4), "
        "f6 AS (SELECT *, unnest(generate_series(CAST(least(3, greatest(0, floor(t0 / 50e0 + 2))) AS BIGINT), CAST(least(3, greatest(0, floor(t1 / 50e0 + 2))) AS BIGINT))) AS k FROM f5 WHERE wc > 0), "
        "dd AS (SELECT event_id, CASE WHEN up THEN j + i * 8 ELSE i + j * 8 END + k * 64 AS vox, wc / (s1 - s0) * step * (least((k - 1) * 50e0, t1) - greatest((k - 2) * 50e0, t0)) / (t1 - t0) AS w FROM f6 WHERE (k - 1) * 50e0 > t0 AND (k - 2) * 50e0 < t1)"
    )


FACED = "faced AS (SELECT lm.event_id, tof_ps, randoms, " + ", ".join(f"{d}.{c} AS {c}{k}" for k, d in (("1", "a"), ("2", "b")) for c in ("x", "y", "z", "nx", "ny", "nz")) + " FROM lm JOIN det a ON a.det_id = d1 JOIN det b ON b.det_id = d2)"
ACROSS_TABLE = views.sql_values("across", "kernel, i, v", [(k, i - 1, v) for k, taps in enumerate(ACROSS.kernels) for i, v in enumerate(taps)], "INTEGER, INTEGER, DOUBLE")
_DD = {"trans": 12.0, "axial": 9.0}
_TOF = (500.0, 3.0)


def _faced(spark, sf):
    """Events with the ends and normals of both crystals (a scanner's detectors: a dimension table of fixed size)."""
    d = geo.det_lut(spark)
    a, b = (F.broadcast(d.select(F.col("det_id").alias(f"d{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "z", "nx", "ny", "nz")])) for k in "12")
    return views.lm(spark, sf).join(a, "d1").join(b, "d2")


@query("SELECT event_id, round(sum(w * value), 3) + 0e0 AS value FROM dd JOIN voxels USING (vox) GROUP BY event_id", LM, DET, FACED, sql_footprint("faced"), VOX)
def dd_forward(spark, sf):
    m = footprint.distance_driven(_faced(spark, sf), **_DD, keep=("event_id",))
    return project.forward(m, views.voxels(spark, sf), "event_id").select("event_id", r("value", 3).alias("value"))


@query("SELECT vox, round(sum(w * randoms), 3) + 0e0 AS value FROM dd JOIN faced USING (event_id) WHERE randoms <> 0 GROUP BY vox", LM, DET, FACED, sql_footprint("faced"))
def dd_back(spark, sf):
    return footprint.back_lors(_faced(spark, sf).withColumnRenamed("randoms", "value"), **_DD).select("vox", r("value", 3).alias("value"))


@query("SELECT event_id, round(sum(w * value), 6) + 0e0 AS value FROM dd JOIN voxels USING (vox) GROUP BY event_id", LM, DET, FACED, ACROSS_TABLE, sql_footprint("faced", _TOF, taps=True), VOX)
def dd_tof_psf_forward(spark, sf):
    """Time of flight and the kernel of each line's distance inside the footprint."""
    m = footprint.distance_driven(_faced(spark, sf), **_DD, keep=("event_id",), tof=_TOF, psf=ACROSS)
    return project.forward(m, views.voxels(spark, sf), "event_id").select("event_id", r("value", 6).alias("value"))


@query("SELECT vox, round(sum(w * randoms), 5) + 0e0 AS value FROM dd JOIN faced USING (event_id) WHERE randoms <> 0 GROUP BY vox", LM, DET, FACED, ACROSS_TABLE, sql_footprint("faced", _TOF, taps=True, flipped=True))
def dd_tof_psf_back(spark, sf):
    """The adjoint: the kernels reversed."""
    return footprint.back_lors(_faced(spark, sf).withColumnRenamed("randoms", "value"), **_DD, tof=_TOF, psf=ACROSS).select("vox", r("value", 5).alias("value"))
