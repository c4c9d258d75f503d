"""Named queries over written files, iterations, rays and joint fits, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tomoframe.functions import geometry as geo
from tomoframe.operators import aggregate, kinetic, project, recon, scatter, temporal
from tomoframe.plans.slate import BINNED_HIST, CELL_KEY, DET, DH, EM, FACTORS, HIST, INTERVALS, LM, LOR, RM, SENS, SH, SIDDON, SQL, TAC, TURN, VOX, _ang, _dd_lors, _pla, _sql_siddon, cell_values, em_data, em_lines, lors, matrix, query, r
from tomoframe.plans.volumes import POSES, SQL_POSES
from tomoframe.sources import formats, views

# --- files

SCT = views.sql_amounts("sct_q", CELL_KEY, 46080) + ", sct AS (SELECT id // 9216 AS tof, id // 1536 % 6 AS p1, id // 96 % 16 AS a1, id // 16 % 6 AS p2, id % 16 AS a2, 1e0 + q % 13 AS value FROM sct_q)"


def _written(spark, sf):
    """The list-mode rows as record files in the shared folder."""
    path = recon.shared_path(spark, "listmode")
    formats.write_listmode(views.lm(spark, sf), path, tof=True, randoms=True)
    return path


@query("SELECT ts_ms, d1, d2, CAST(CAST(tof_ps AS FLOAT) AS DOUBLE) AS tof_ps, CAST(CAST(randoms AS FLOAT) AS DOUBLE) AS randoms FROM lm", LM)
def listmode_file_scan(spark, sf):
    """Written by many tasks, read in byte ranges."""
    return formats.read_listmode(spark, _written(spark, sf), tof=True, randoms=True, detectors=1152, split=1 << 16).select("ts_ms", "d1", "d2", "tof_ps", "randoms")


@query("SELECT ts_ms, d1, d2 FROM lm WHERE ts_ms >= 432000000 AND ts_ms < 864000000", LM)
def listmode_file_bounded(spark, sf):
    """Of files in order of time, only the ranges of that time are read."""
    e = formats.read_listmode(spark, _written(spark, sf), tof=True, randoms=True, start=432000000, stop=864000000, ordered=True)
    return e.select("ts_ms", "d1", "d2")


@query("SELECT least(d1, d2) AS d1, greatest(d1, d2) AS d2, sum(value) AS value FROM hist GROUP BY ALL", HIST)
def sparse_histogram_file(spark, sf):
    path = recon.shared_path(spark, "histogram")
    formats.write_sparse_histogram(views.hist(spark, sf), path)
    return formats.read_sparse_histogram(spark, path, 1152).select("d1", "d2", "value")


@query("SELECT tof, p1, a1, p2, a2, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM sct", SCT)
def scatter_space_file(spark, sf):
    """A five-dimensional array file, written by many tasks in place and read back in byte ranges."""
    path = recon.shared_path(spark, "scatter")
    formats.write_scatter_space(cell_values(spark, sf, 5), path.removeprefix("file://"), (5, 6, 16, 6, 16))
    return formats.open_table(spark, path.removeprefix("file://"), "scatter", split=1 << 14)


@query("SELECT bin, CAST(CAST(coalesce(value, 0) AS FLOAT) AS DOUBLE) AS value FROM (SELECT id AS bin FROM range(481536) AS r(id)) LEFT JOIN dh USING (bin)", HIST, RM, BINNED_HIST, DH)
def histogram_file(spark, sf):
    """A dense histogram file: all bins come back, those without counts as 0."""
    dense = aggregate.dense_histogram(geo.pair_to_bin(views.hist(spark, sf), geo.ring_map(spark)), F.col("value"))
    path = recon.shared_path(spark, "dense").removeprefix("file://")
    formats.write_histogram(dense, path, (132, 48, 76))
    return formats.read_histogram(spark, path, (132, 48, 76), split=1 << 18)


# --- iterations


def _sql_subset(n: int, k: int, subsets: int) -> str:
    """Image x{n + 1} from x{n} by the rows of subset k."""
    own = f"event_id % {subsets} = {k}"
    return (
        f"pr{n} AS (SELECT event_id, sum(w * x) AS p FROM sm JOIN x{n} USING (vox) WHERE {own} GROUP BY event_id), "
        f"ra{n} AS (SELECT event_id, CASE WHEN abs(q) > 1e-35 THEN 1e0 / q * sens * atten ELSE 0e0 END AS ratio FROM (SELECT event_id, sens, atten, coalesce(p, 0e0) * sens * atten + randoms + scatter AS q FROM fac LEFT JOIN pr{n} USING (event_id) WHERE {own})), "
        f"up{n} AS (SELECT vox, sum(w * ratio) AS u FROM sm JOIN ra{n} USING (event_id) WHERE ratio <> 0 GROUP BY vox), "
        f"x{n + 1} AS (SELECT vox, CASE WHEN s / {subsets} > 0 THEN x * coalesce(u, 0e0) / (s / {subsets}) ELSE x END AS x, s FROM x{n} LEFT JOIN up{n} USING (vox))"
    )


_BASE = (LM, DET, LOR, SIDDON, HIST, SH, FACTORS)
#: Two iterations of two subsets, unrolled.
SQL["osem_subsets"] = f"WITH {', '.join((*_BASE, EM, *(_sql_subset(n, n % 2, 2) for n in range(4))))} SELECT vox, round(x, 5) + 0e0 AS value FROM x4"

_START = "x0 AS (SELECT vox, CASE WHEN s > 0 THEN 0.125e0 ELSE 0e0 END AS x, s FROM se)"


@query(
    "SELECT vox, round(x, 5) + 0e0 AS value FROM x3",
    *_BASE, VOX, SENS, EM.replace(_START, "x0 AS (SELECT vox, CASE WHEN sens.sens > 0 THEN value ELSE 0e0 END AS x, s FROM se JOIN voxels USING (vox) JOIN sens USING (vox))"), *(_sql_subset(n, n, 3) for n in range(3)),
)
def osem_from_image(spark, sf):
    """One iteration of three subsets from a given image under a mask."""
    lines = recon.cut(em_lines(spark, sf), "lines")
    mask = views.sens(spark, sf).withColumnRenamed("sens", "value")
    return recon.osem_lines(lines, recon.sensitivity_of(lines), 1, 3, given=views.voxels(spark, sf), mask=mask).select("vox", r("value", 5).alias("value"))


_TIMED_SM = _sql_siddon("ml", "rid", (500.0, 3.0))
_U3 = [f"(CASE WHEN ray = 0 THEN 0e0 ELSE nr * {s!r}::DOUBLE - floor(nr * {s!r}::DOUBLE) - 0.5e0 END)" for s in project.RAY_STEPS]
_ENDS3 = ", ".join(
    f"x{k} + ny{k} * ({_U3[j]} * {side} * 3e0 / sqrt(nx{k} * nx{k} + ny{k} * ny{k})) + nx{k} * {_U3[m]} * 8e0 AS x{k}, y{k} - nx{k} * ({_U3[j]} * {side} * 3e0 / sqrt(nx{k} * nx{k} + ny{k} * ny{k})) + ny{k} * {_U3[m]} * 8e0 AS y{k}, z{k} + {_U3[i]} * 5e0 + nz{k} * {_U3[m]} * 8e0 AS z{k}"
    for k, side, (i, j, m) in (("1", 1, (0, 1, 4)), ("2", -1, (2, 3, 5)))
)


@query(
    "SELECT vox, round(x, 5) + 0e0 AS value FROM x2",
    LM, DET, SQL_POSES, INTERVALS,
    "ln AS (SELECT event_id, ts_ms, tof_ps, (event_id * 2 + ray) % 1000003 AS nr, ray, event_id * 2 + ray AS rid, a.x AS x1, a.y AS y1, a.z AS z1, a.nx AS nx1, a.ny AS ny1, a.nz AS nz1, b.x AS x2, b.y AS y2, b.z AS z2, b.nx AS nx2, b.ny AS ny2, b.nz AS nz2 FROM lm JOIN det a ON a.det_id = d1 JOIN det b ON b.det_id = d2, range(2) AS rays(ray))",
    f"rl AS (SELECT rid, ts_ms, tof_ps, {_ENDS3} FROM ln)",
    "ml AS (SELECT rid, tof_ps, " + ", ".join(f"coalesce(r{i}0 * x{k} + r{i}1 * y{k} + r{i}2 * z{k} + t{a}, {a}{k}) AS {a}{k}" for k in "12" for i, a in enumerate("xyz")) + " FROM rl LEFT JOIN mi ON ts_ms >= t_start AND (t_next IS NULL OR ts_ms < t_next))",
    _TIMED_SM.replace("sm AS (", "s8 AS ("), "sm AS (SELECT rid // 2 AS event_id, vox, w / 2 AS w FROM s8)",
    HIST, SH, FACTORS, EM, _sql_subset(0, 0, 2), _sql_subset(1, 1, 2),
)
def osem_motion_tof(spark, sf):
    """One iteration of two subsets over lines that are moved, weighted by time of flight and averaged over two rays."""
    d = em_data(spark, sf)
    faced = _dd_lors(spark, sf).drop("randoms").join(d.select("event_id", "value", "sens", "atten", "randoms", "scatter", "invivo"), "event_id")
    poses = spark.createDataFrame(POSES, "frame int, t_start long, " + ", ".join(f"{c} double" for c in temporal.RIGID))
    lines = recon.cut(recon.em_lines(faced, tof=(500.0, 3.0), motion=poses, rays=2, crystal=(5.0, 3.0, 8.0)), "lines")
    return recon.osem_lines(lines, recon.sensitivity_of(lines), 1, 2).select("vox", r("value", 5).alias("value"))


@query(
    "SELECT round(sum(w * value * randoms), 3) AS forward, round(sum(w * randoms * value), 3) AS back FROM sm JOIN voxels USING (vox) JOIN lm USING (event_id)", LM, DET, LOR, SIDDON, VOX,
)
def adjoint_sums(spark, sf):
    """<A x, y> and <x, At y>."""
    e, x = lors(spark, sf), views.voxels(spark, sf)
    p = project.forward(matrix(spark, sf), x, "event_id").withColumnRenamed("value", "p")
    a = p.join(e.select("event_id", "randoms"), "event_id").agg(r(F.sum(F.col("p") * F.col("randoms")), 3).alias("forward"))
    u = project.back_lors(e.withColumnRenamed("randoms", "value")).withColumnRenamed("value", "u")
    return a.crossJoin(u.join(x, "vox").agg(r(F.sum(F.col("u") * F.col("value")), 3).alias("back")))  # one row each


# --- corrections

_FOUND = "(CASE WHEN b = 0 THEN 0e0 ELSE coalesce({t}.value, {d}) END)"


@query(
    "SELECT event_id, kind, round(sens, 6) + 0e0 AS sens, round(atten, 6) + 0e0 AS atten, round(invivo, 6) + 0e0 AS invivo, round(rand, 6) + 0e0 AS randoms, round(scatter, 6) + 0e0 AS scatter FROM ("
    f"SELECT event_id, 'parts' AS kind, {_FOUND.format(t='sn', d='1e0')} AS sens, {_FOUND.format(t='hw', d='1e0')} * {_FOUND.format(t='iv', d='1e0')} AS atten, {_FOUND.format(t='iv', d='1e0')} AS invivo, {_FOUND.format(t='sc', d='0e0')} * 2e0 AS rand, {_FOUND.format(t='sc', d='0e0')} AS scatter FROM zz "
    "LEFT JOIN sn ON sn.d1 = a AND sn.d2 = b LEFT JOIN att hw ON hw.d1 = a AND hw.d2 = b LEFT JOIN iv ON iv.d1 = a AND iv.d2 = b LEFT JOIN sc ON sc.d1 = a AND sc.d2 = b "
    f"UNION ALL SELECT event_id, 'total', 1e0, {_FOUND.format(t='att', d='1e0')}, 1e0, randoms, 0e0 FROM zz LEFT JOIN att ON att.d1 = a AND att.d2 = b)",
    LM, HIST, SH, FACTORS, "zz AS (SELECT * FROM z)", "iv AS (SELECT d1, d2, exp(-0.1e0 * value / 2e1) AS value FROM sh WHERE d2 % 3 = 1)",
)
def correction_precompute(spark, sf):
    """All factors of every event, from the parts of attenuation and from the total."""
    h = aggregate.sparse_histogram(views.hist(spark, sf), F.col("value"))
    fall = lambda where, by: h.where(where).select("d1", "d2", project.attenuation(F.col("value") / F.lit(by)).alias("value"))
    sens = h.where("d1 % 2 = 0").select("d1", "d2", (F.lit(0.5e0) + F.col("value") / F.lit(1e2)).alias("value"))
    scattered = h.select("d1", "d2", (F.col("value") / F.lit(1e3)).alias("value"))
    parts = recon.precompute(views.lm(spark, sf), sens, hardware=fall("d1 % 3 = 0", 1e1), in_vivo=fall("d2 % 3 = 1", 2e1), randoms=scattered.withColumn("value", F.col("value") * 2), scatter=scattered)
    whole = recon.precompute(views.lm(spark, sf), total=fall("d1 % 3 = 0", 1e1))
    both = [e.select("event_id", F.lit(kind).alias("kind"), *[r(c, 6).alias(c) for c in ("sens", "atten", "invivo", "randoms", "scatter")]) for e, kind in ((parts, "parts"), (whole, "total"))]
    return both[0].unionByName(both[1])


# --- rays

_U = [f"(CASE WHEN ray = 0 THEN 0e0 ELSE nr * {s!r}::DOUBLE - floor(nr * {s!r}::DOUBLE) - 0.5e0 END)" for s in project.RAY_STEPS]
_RAY_ENDS = ", ".join(
    f"x{k} + ny{k} * ({_U[j]} * {side} * 3e0 / sqrt(nx{k} * nx{k} + ny{k} * ny{k})) + nx{k} * {_U[m]} * 8e0 AS x{k}, y{k} - nx{k} * ({_U[j]} * {side} * 3e0 / sqrt(nx{k} * nx{k} + ny{k} * ny{k})) + ny{k} * {_U[m]} * 8e0 AS y{k}, z{k} + {_U[i]} * 5e0 + nz{k} * {_U[m]} * 8e0 AS z{k}"
    for k, side, (i, j, m) in (("1", 1, (0, 1, 4)), ("2", -1, (2, 3, 5)))
)


@query(
    "SELECT event_id, round(sum(w * value) / 3, 3) + 0e0 AS value FROM (SELECT rid // 3 AS event_id, vox, w FROM sm) JOIN voxels USING (vox) GROUP BY event_id",
    LM, DET, VOX,
    "ln AS (SELECT event_id, (event_id * 3 + ray) % 1000003 AS nr, ray, event_id * 3 + ray AS rid, a.x AS x1, a.y AS y1, a.z AS z1, a.nx AS nx1, a.ny AS ny1, a.nz AS nz1, b.x AS x2, b.y AS y2, b.z AS z2, b.nx AS nx2, b.ny AS ny2, b.nz AS nz2 FROM lm JOIN det a ON a.det_id = d1 JOIN det b ON b.det_id = d2, range(3) AS rays(ray))",
    f"rl AS (SELECT rid, {_RAY_ENDS} FROM ln)", _sql_siddon("rl", "rid"),
)
def crystal_rays_forward(spark, sf):
    """Forward projection averaged over three rays between the crystals, within their depth too."""
    rays = project.crystal_rays(_dd_lors(spark, sf), 3, 5.0, 3.0, 8.0, key="event_id")
    return project.forward(project.siddon(rays, keep=("event_id",)), views.voxels(spark, sf), "event_id").select("event_id", r(F.col("value") / 3, 3).alias("value"))


# --- time of flight in scatter space

TIMED = scatter.Space(tofs=5, max_tof=400.0)
_TOF = "(greatest(40e0, least(360e0, tof_ps)) / 80e0 - 0.5e0)"
_FRAC = "(CASE WHEN {d} = 1 THEN {c} - floor({c}) ELSE 1 - ({c} - floor({c})) END)"


def _timed(spark, sf):
    return lors(spark, sf).withColumn("tof_ps", F.abs("tof_ps"))


@query(
    "SELECT event_id, CAST(trunc(round(" + _TOF + ")) AS BIGINT) AS tof FROM (SELECT event_id, abs(tof_ps) AS tof_ps FROM lm)", LM,
)
def scs_tof_bin(spark, sf):
    return scatter.cells(_timed(spark, sf), TIMED).select("event_id", "tof")


@query(
    f"SELECT event_id, round(sum({_FRAC.format(d='dt', c='tf')} * {_FRAC.format(d='dp', c='pl1')} * {_FRAC.format(d='da', c='an1')} * {_FRAC.format(d='dq', c='pl2')} * {_FRAC.format(d='db', c='an2')} * coalesce(value, 0e0)), 4) + 0e0 AS value FROM "
    "(SELECT *, least(floor(tf) + dt, 4) AS tof, least(floor(pl1) + dp, 5) AS p1, (floor(an1) + da + 16) % 16 AS a1, least(floor(pl2) + dq, 5) AS p2, (floor(an2) + db + 16) % 16 AS a2 FROM "
    f"(SELECT event_id, {_TOF.replace('tof_ps', 'abs(tof_ps)')} AS tf, {_pla.format(k=1)} AS pl1, {_ang.format(k=1)} / {TURN} - 0.5e0 AS an1, {_pla.format(k=2)} AS pl2, {_ang.format(k=2)} / {TURN} - 0.5e0 AS an2 FROM lor), "
    "range(2) t(dt), range(2) a(dp), range(2) b(da), range(2) c(dq), range(2) d(db)) LEFT JOIN sct USING (tof, p1, a1, p2, a2) GROUP BY event_id",
    LM, DET, LOR, SCT,
)
def scs_tof_interp(spark, sf):
    """Linear in time of flight, planes and angles: 32 corners."""
    v = cell_values(spark, sf, 5)
    return scatter.interpolate(_timed(spark, sf), v, TIMED).select("event_id", r("value").alias("value"))


# --- joint fits

TRUST, ALPHA, PRIOR = (0.5, 1.0, 2.0, 0.25, 1.5, 0.75), 3.0, (0.4, 0.1, 0.9, 0.3, 0.12, 1.1)
_W = [[1.0 + t % 3 for t in range(64)], [0.5 + t % 4 for t in range(64)]]


def _joint(k: int) -> tuple[float, float, list[list[float]], list[float]]:
    """Basis k: both kappas, the columns a0, b0, a1, b1, the inverse."""
    kappa = (0.05 * (k + 1), 0.04 * (k + 2))
    cols = [[1.0 / (1 + ((t + k * 3) % 7)) for t in range(64)], [0.5 + ((t * (k + 2)) % 11) / 1e1 for t in range(64)], [1.0 / (1 + ((t * 2 + k) % 5)) for t in range(64)], [0.25 + ((t * (k + 3)) % 13) / 1e1 for t in range(64)]]
    a = np.array(cols).reshape(2, 2, 64)
    return *kappa, cols, kinetic.joint_inverse(a, np.array(_W), kappa, ALPHA, np.array(TRUST)).ravel().tolist()


_JOINT = [_joint(k) for k in range(5)]
_ARR = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
JOINT_BASES = "jb AS (" + " UNION ALL ".join(f"SELECT {k} AS k, {j[0]!r}::DOUBLE AS kappa0, {j[1]!r}::DOUBLE AS kappa1, {', '.join(f'{_ARR(c)} AS {n}' for c, n in zip(j[2], ('a0', 'b0', 'a1', 'b1'), strict=True))}, {_ARR(j[3])} AS inverse, {_ARR(_W[0])} AS w0, {_ARR(_W[1])} AS w1" for k, j in enumerate(_JOINT)) + ")"
_SUM = "list_sum(list_transform(range(1, 65), lambda i: {}))"
_Y = ", ".join(
    f"{_SUM.format(f'{c}{s}[i] * w{s}[i] * tac{s}[i]')} + "
    + (f"{ALPHA * TRUST[3 * s]!r} * ({PRIOR[3 * s]!r}::DOUBLE + 1) / kappa{s} + {ALPHA * TRUST[3 * s + 1]!r} * {PRIOR[3 * s + 1]!r}::DOUBLE" if c == "a" else f"{ALPHA * TRUST[3 * s + 2]!r} * {PRIOR[3 * s + 2]!r}::DOUBLE")
    + f" AS y{2 * s + 'ab'.index(c)}"
    for s in (0, 1)
    for c in "ab"
)
_THETA = ", ".join(" + ".join(f"inverse[{4 * i + j + 1}] * y{j}" for j in range(4)) + f" AS t{i}" for i in range(4))
_COST = " + ".join(_SUM.format(f"w{s}[i] * pow(tac{s}[i] - (a{s}[i] * t{2 * s} + b{s}[i] * t{2 * s + 1}), 2)") for s in (0, 1))
_PENALTY = " + ".join(f"{ALPHA * TRUST[i]!r} * pow({PRIOR[i]!r}::DOUBLE - {c}, 2)" for i, c in enumerate(kinetic.JOINT))


@query(
    "SELECT pix, k, round(bp_b, 4) + 0e0 AS bp_b, round(k2_b, 5) + 0e0 AS k2_b, round(r1_b, 5) + 0e0 AS r1_b, round(k2_d, 5) + 0e0 AS k2_d, round(r1_d, 5) + 0e0 AS r1_d, round(ro * bp_b - bp_b, 4) + 0e0 AS spread, round(cost, 5) + 0e0 AS cost FROM ("
    f"SELECT *, 1 - bp_d / (CASE WHEN abs(bp_b) < 1e-8 THEN CASE WHEN bp_b >= 0 THEN 1e-8 ELSE -1e-8 END ELSE bp_b END) AS ro, row_number() OVER (PARTITION BY pix ORDER BY cost, k) AS rn FROM (SELECT *, 0.5e0 * ({_COST} + {_PENALTY}) AS cost FROM "
    f"(SELECT *, t0 / kappa0 - 1 AS bp_b, t0 AS k2_b, t1 AS r1_b, t2 / kappa1 - 1 AS bp_d, t2 AS k2_d, t3 AS r1_d FROM (SELECT *, {_THETA} FROM (SELECT *, {_Y} FROM tj, jb))))) WHERE rn = 1",
    TAC, "tj AS (SELECT pix, tac AS tac0, list_reverse(tac) AS tac1 FROM tac)", JOINT_BASES,
)
def srtm_joint_fit(spark, sf):
    """Two scans of every pixel fitted together, drawn to a prior."""
    bases = spark.createDataFrame([(k, j[0], j[1], *j[2], j[3]) for k, j in enumerate(_JOINT)], "k int, kappa0 double, kappa1 double, a0 array<double>, b0 array<double>, a1 array<double>, b1 array<double>, inverse array<double>")
    tacs = views.tac(spark, sf).select("pix", F.col("tac").alias("tac0"), F.reverse("tac").alias("tac1"), F.array(*map(F.lit, PRIOR)).alias("prior"))
    e = kinetic.srtm_joint(tacs, bases, tuple(F.array(*map(F.lit, w)) for w in _W), ALPHA, TRUST)
    spread = F.col("ro") * F.col("bp_b") - F.col("bp_b")
    return e.select("pix", "k", *[r(c, p).alias(c) for c, p in (("bp_b", 4), ("k2_b", 5), ("r1_b", 5), ("k2_d", 5), ("r1_d", 5), ("cost", 5))], r(spread).alias("spread"))
