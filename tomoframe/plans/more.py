"""Named queries with their SQL: enumeration of projections, vendor files, motion parameters, solids, convolution."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tomoframe.functions import geometry as geo
from tomoframe.operators import convert, convolve, enumerate, poses, projectors, recon, solids
from tomoframe.plans.extra import GATE, _gate
from tomoframe.plans.slate import DET, LM, LOR, VOX, VOX2, _sql_siddon, lors, query, r
from tomoframe.plans.volumes import FACED, _faced, sql_footprint
from tomoframe.sources import vendor, views

# --- enumeration

#: The scanner of det: two layers of 12 x 48 crystals.
RINGS = enumerate.Rings(axial=12, radial=48, most=2, coverage=0.45, spare=1)
_L, _H, _W = *RINGS.fan, RINGS.width


def _sql_basis(name: str, within: bool, angle: bool) -> str:
    rows = f"SELECT b1, lo + f + b1 AS b2 FROM (SELECT unnest(range({_H})) AS b1, {_L} AS lo), range({_W}) AS fs(f) WHERE lo + f + b1 < 48" if within else f"SELECT b1, (lo + f + b1) % 48 AS b2, f FROM (SELECT unnest(range(48)) AS b1, {_L} AS lo), range({_W}) AS fs(f)"
    turn = "round(acos(CASE WHEN p.y - q.y < 0 THEN -(p.x - q.x) ELSE p.x - q.x END / sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6)"
    order = f"{turn}, b1, b2" if angle else "b1, b2" if within else "b1, f"
    return f"{name} AS (SELECT b1, b2, row_number() OVER (ORDER BY {order}) - 1 AS place FROM ({rows}) JOIN det p ON p.det_id = b1 JOIN det q ON q.det_id = b2)"


def _sql_legal(angle: bool) -> str:
    """leg: proj_id, d1, d2; the projections numbered one after the other."""
    parts = [
        "SELECT 0 AS diff, axial, 0 AS part, place, axial * 48 + b1 AS d1, axial * 48 + b2 AS d2 FROM bw, ax",
        "SELECT 0, axial, 1, place, axial * 48 + b1, axial * 48 + b2 + 576 FROM bo, ax",
        "SELECT 0, axial, 2, place, axial * 48 + b1 + 576, axial * 48 + b2 + 576 FROM bw, ax",
        "SELECT diff, axial, 0, place, axial * 48 + b1, (axial + diff) * 48 + b2 FROM bo, dx",
        "SELECT diff, axial, 1, place, axial * 48 + b1, (axial + diff) * 48 + b2 + 576 FROM bo, dx",
        "SELECT diff, axial, 2, place, (axial + diff) * 48 + b2, axial * 48 + b1 + 576 FROM bo, dx",
        "SELECT diff, axial, 3, place, axial * 48 + b1 + 576, (axial + diff) * 48 + b2 + 576 FROM bo, dx",
    ]
    return (
        f"{_sql_basis('bw', True, angle)}, {_sql_basis('bo', False, angle)}, ax AS (SELECT id AS axial FROM range(12) AS r(id)), dx AS (SELECT axial, diff FROM ax, range(1, {RINGS.most + 1}) AS d(diff) WHERE axial + diff < 12), "
        f"leg AS (SELECT row_number() OVER (ORDER BY diff, axial, part, place) - 1 AS proj_id, d1, d2 FROM ({' UNION ALL '.join(parts)}))"
    )


_USED = "used AS (SELECT least(d1, d2) AS d1, greatest(d1, d2) AS d2, count(*) AS n FROM lm GROUP BY ALL)"


def _places(spark):
    return geo.det_lut(spark).where("det_id < 48").select(F.col("det_id").alias("radial"), "x", "y")


@query("SELECT proj_id, d1, d2, coalesce(n, 0) AS n FROM leg LEFT JOIN used USING (d1, d2)", LM, DET, _sql_legal(False), _USED)
def legal_projections(spark, sf):
    """Every legal projection with its events."""
    used = views.lm(spark, sf).groupBy(F.least("d1", "d2").alias("d1"), F.greatest("d1", "d2").alias("d2")).agg(F.count("*").alias("n"))
    return enumerate.legal_projections(spark, RINGS).join(used, ["d1", "d2"], "left").select("proj_id", "d1", "d2", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT proj_id, d1, d2, n FROM leg JOIN used USING (d1, d2)", LM, DET, _sql_legal(True), _USED)
def projections_by_angle(spark, sf):
    """The projections that events have, numbered in the order of their angle within each block."""
    used = views.lm(spark, sf).groupBy(F.least("d1", "d2").alias("d1"), F.greatest("d1", "d2").alias("d2")).agg(F.count("*").alias("n"))
    return enumerate.legal_projections(spark, RINGS, _places(spark)).join(used, ["d1", "d2"]).select("proj_id", "d1", "d2", "n")


@query("SELECT event_id, coalesce(proj_id, -1) AS proj_id FROM lm LEFT JOIN leg ON leg.d1 = least(lm.d1, lm.d2) AND leg.d2 = greatest(lm.d1, lm.d2)", LM, DET, _sql_legal(False))
def event_projection_numbers(spark, sf):
    """The number of each event's pair, without the table of all projections."""
    return enumerate.projection_numbers(views.lm(spark, sf), RINGS).select("event_id", "proj_id")


@query("SELECT proj_id, CAST(count(*) AS DOUBLE) AS value FROM lm JOIN leg ON leg.d1 = least(lm.d1, lm.d2) AND leg.d2 = greatest(lm.d1, lm.d2) GROUP BY proj_id", LM, DET, _sql_legal(True))
def projection_histogram(spark, sf):
    """Events counted by projection; those outside the field of view are left out."""
    e = enumerate.projection_numbers(views.lm(spark, sf), RINGS, _places(spark)).where("proj_id <> -1")
    return e.groupBy("proj_id").agg(F.count("*").cast("double").alias("value"))


# --- vendor files

_LEVEL_VALUES = {"Camera": "{e} % 2", "Ring": "{e} % 56", "Bloc": "{e} % 18", "Mod": "{e} % 4", "Det": "{e} * 7 % 32", "subDet": "({e} + 1) % 2"}


def _coincidences(spark, sf):
    """Simulated coincidences from the events: one in three has photons of two sources."""
    cols = {f"{n}{k}": F.expr(v.format(e=e)) for k, e in (("0", "event_id"), ("1", "user_id")) for n, v in _LEVEL_VALUES.items()}
    i = F.col("event_id")
    place = {"X": (i % 200 - 100) * F.lit(1e0), "Y": (i % 190 - 95) * F.lit(1e0), "Z": (i % 170 - 85) * F.lit(1e0)}
    cols |= {f"{c}0": v for c, v in place.items()} | {f"{c}1": v + F.when(i % 3 == 0, 1.0).otherwise(0.0) for c, v in place.items()}
    cols |= {"t0": i / F.lit(8e0), "t1": i / F.lit(8e0) + (F.col("user_id") % 5) / F.lit(4e0)}
    return views.table(spark, sf, "events").select("event_id", *[v.alias(c) for c, v in cols.items()])


def _folder(spark, name):
    return recon.shared_path(spark, name).removeprefix("file://")


@query("SELECT least(g1, g2) AS d1, greatest(g1, g2) AS d2, count(*) AS n FROM gd GROUP BY ALL", GATE)
def simulation_file_detectors(spark, sf):
    """Coincidences written as binary records, read in byte ranges, their hierarchical ids made flat."""
    g = _gate(spark, sf).select("event_id")
    path = _folder(spark, "simulation")
    e, u = F.col("event_id"), F.col("user_id")
    rows = views.table(spark, sf, "events").join(g, "event_id").select(
        (e / F.lit(8e0)).alias("t0"), (u / F.lit(8e0)).alias("t1"),
        *[v.cast("int").alias(f"{n}{k}") for k, x, l in (("0", e, u % 2), ("1", u, e % 2)) for n, v in (("Camera", F.lit(0)), ("Ring", x % 56), ("Bloc", x % 18), ("Mod", x % 4), ("Det", x * (7 if k == "0" else 5) % 32), ("subDet", l))],
    )
    vendor.write_simulation(rows, path)
    got = vendor.read_simulation(spark, path, split=1 << 14)
    flat = [convert.flat_id(F.col(f"subDet{k}"), *convert.crystal_index(*(F.col(f"{n}{k}") for n in ("Ring", "Bloc", "Mod", "Det")))) for k in "01"]
    low, high = convert.sorted_pair(*flat)
    return got.groupBy(low.alias("d1"), high.alias("d2")).agg(F.count("*").alias("n"))


@query(
    "SELECT t0, t1, " + ", ".join(f"CAST({v.format(e=e)} AS BIGINT) AS {n}{k}" for k, e in (("0", "event_id"), ("1", "user_id")) for n, v in _LEVEL_VALUES.items()) + ", (event_id % 200 - 100) * 1e0 AS X0, (event_id % 190 - 95) * 1e0 AS Y0, (event_id % 170 - 85) * 1e0 AS Z0 FROM "
    "(SELECT *, event_id / 8e0 AS t0, event_id / 8e0 + (user_id % 5) / 4e0 AS t1 FROM events)",
)
def simulation_text_file(spark, sf):
    """All 46 columns written as text and picked out again."""
    path = _folder(spark, "text")
    vendor.simulation_text(_coincidences(spark, sf), 46).write.text(path)
    return vendor.read_simulation_text(spark, path, 46)


@query(
    "SELECT CAST(t AS INTEGER) AS t, CAST(i + j * 10 + k * 80 AS BIGINT) AS vox, CAST(count(*) AS DOUBLE) AS value FROM (SELECT CASE WHEN time < 40 THEN 0 ELSE 1 END AS t, least(floor((x + 100) / 20e0), 9) AS i, least(floor((y + 80) / 20e0), 7) AS j, least(floor((z + 90) / 30e0), 5) AS k FROM "
    "(SELECT event_id, event_id / 8e0 + (user_id % 5) / 8e0 AS time, event_id % 200 - 100 AS x, event_id % 190 - 95 AS y, event_id % 170 - 85 AS z FROM events) WHERE event_id % 3 <> 0 AND time < 90 AND y BETWEEN -80 AND 80) GROUP BY ALL",
)
def simulation_source_image(spark, sf):
    """True coincidences by the place of their source, in two stretches of time."""
    path = _folder(spark, "sources")
    vendor.write_simulation(_coincidences(spark, sf), path, "sources")
    return vendor.source_image(vendor.read_simulation(spark, path, "sources"), (10, 8, 6), (200.0, 160.0, 180.0), [0.0, 40.0, 90.0])


@query("SELECT ts_ms, d1, d2, CAST(CAST(tof_ps AS FLOAT) AS DOUBLE) AS tof_ps FROM lm", LM)
def headed_listmode_file(spark, sf):
    """A list-mode file with a text header, written and read."""
    path = _folder(spark, "headed") + "/scan.cdh"
    e = views.lm(spark, sf).withColumn("atten", F.lit(0.5))
    vendor.write_headed_listmode(e, path, tof=True, attenuation=True)
    return vendor.read_headed_listmode(spark, path, split=1 << 14).select("ts_ms", "d1", "d2", "tof_ps")


# --- motion

_POSE = "k * 2.5e0 AS degrees, 1e0 AS ax, k % 3 * 1e0 AS ay, -2e0 AS az, (k % 7 - 3) * 0.5e0 AS px, (k % 5 - 2) * 0.75e0 AS py, (k % 3 - 1) * 1.25e0 AS pz"
POSITIONS = f"pos AS (SELECT CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS frame, b * 21600 AS t_start, (b + 1) * 21600 AS t_stop, {_POSE} FROM (SELECT ts_ms // 21600000 AS b, min(event_id) % 64 AS k FROM lm GROUP BY ALL))"


def _positions(spark, sf):
    """A position for each quarter of a day that has events."""
    from pyspark.sql import Window

    e = views.lm(spark, sf).groupBy(F.floor(F.col("ts_ms") / 21600000).alias("b")).agg((F.min("event_id") % 64).alias("k"))
    frame = F.row_number().over(Window.orderBy("b")) - 1  # one row a quarter
    cols = [c.strip().rsplit(" AS ", 1) for c in _POSE.replace("1e0 AS ax", "1D AS ax").replace("e0", "D").split(", ")]
    return e.select(frame.alias("frame"), (F.col("b") * 21600).alias("t_start"), ((F.col("b") + 1) * 21600).alias("t_stop"), *[F.expr(v).alias(n) for v, n in cols])


@query(
    # a turn by quaternions written out: the reference's inverse first on the left
    "SELECT frame, t_start, round((pow(0.5, t_start / 6586.2e0) - pow(0.5, t_stop / 6586.2e0)) / (SELECT sum(pow(0.5, t_start / 6586.2e0) - pow(0.5, t_stop / 6586.2e0)) FROM pos), 9) + 0e0 AS weight, "
    "round(w, 6) + 0e0 AS qw, round(x, 6) + 0e0 AS qx, round(y, 6) + 0e0 AS qy, round(z, 6) + 0e0 AS qz, "
    "round(px - ((1 - 2 * (y * y + z * z)) * ox + 2 * (x * y - w * z) * oy + 2 * (x * z + w * y) * oz), 5) + 0e0 AS tx, round(py - (2 * (x * y + w * z) * ox + (1 - 2 * (x * x + z * z)) * oy + 2 * (y * z - w * x) * oz), 5) + 0e0 AS ty, round(pz - (2 * (x * z - w * y) * ox + 2 * (y * z + w * x) * oy + (1 - 2 * (x * x + y * y)) * oz), 5) + 0e0 AS tz "
    "FROM (SELECT q.*, r.px AS ox, r.py AS oy, r.pz AS oz, r.q0 * q.q0 + r.q1 * q.q1 + r.q2 * q.q2 + r.q3 * q.q3 AS w, r.q0 * q.q1 - r.q1 * q.q0 - r.q2 * q.q3 + r.q3 * q.q2 AS x, r.q0 * q.q2 + r.q1 * q.q3 - r.q2 * q.q0 - r.q3 * q.q1 AS y, r.q0 * q.q3 - r.q1 * q.q2 + r.q2 * q.q1 - r.q3 * q.q0 AS z FROM qs q, (SELECT * FROM qs WHERE frame = 5) r)",
    LM, POSITIONS, "qs AS (SELECT *, cos(radians(degrees) / 2) AS q0, ax / l * sin(radians(degrees) / 2) AS q1, ay / l * sin(radians(degrees) / 2) AS q2, az / l * sin(radians(degrees) / 2) AS q3 FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS l FROM pos))",
)
def motion_parameters(spark, sf):
    """Moves relative to the sixth position, weighted by the decays of a source of 110 minutes."""
    e = poses.motion_parameters(_positions(spark, sf), 5, 6586.2)
    return e.select("frame", "t_start", r("weight", 9).alias("weight"), *[r(c, 6).alias(c) for c in ("qw", "qx", "qy", "qz")], *[r(c, 5).alias(c) for c in ("tx", "ty", "tz")])


# --- solids

SOLID = solids.Cylinder(90.0, 150.0, (4.0, -3.0, 2.0))
PLANE = solids.Plane(((0.0, 0.0, 10.0), (50.0, 0.0, 20.0), (0.0, 40.0, 5.0)))
_LINES = ["x1 + {s} * ny1 * 6e0 AS xa, y1 - {s} * nx1 * 6e0 AS ya, z1 AS za, x2 - {s} * ny2 * 6e0 AS xb, y2 + {s} * nx2 * 6e0 AS yb, z2 AS zb", "x1 AS xa, y1 AS ya, z1 + {s} * 4.5e0 AS za, x2 AS xb, y2 AS yb, z2 + {s} * 4.5e0 AS zb"]
TUBES = (
    "tl AS (" + " UNION ALL ".join(f"SELECT event_id, {t.format(s=s)} FROM faced" for t in _LINES for s in ("1", "-1")) + ")",
    "tq AS (SELECT *, pow(xb - xa, 2) + pow(yb - ya, 2) AS a, 2 * ((xb - xa) * (xa - 4) + (yb - ya) * (ya + 3)) AS b, pow(xa - 4, 2) + pow(ya + 3, 2) - 8100e0 AS c FROM tl)",
    "tt AS (SELECT *, CASE WHEN a > 0 AND b * b - 4 * a * c >= 0 THEN (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END AS t1, CASE WHEN a > 0 AND b * b - 4 * a * c >= 0 THEN (-b + sqrt(b * b - 4 * a * c)) / (2 * a) END AS t2 FROM tq)",
    "tc AS (SELECT *, coalesce(abs(za + t1 * (zb - za) - 2) <= 75 AND abs(za + t2 * (zb - za) - 2) <= 75, false) AS met FROM tt)",
)


@query(
    "SELECT event_id, bool_and(met) AS whole, " + ", ".join(f"round(sum({c}a + (CASE WHEN met THEN {t} ELSE {k - 1}e0 END) * ({c}b - {c}a)) / 4, 4) + 0e0 AS c{c}{k}" for k, t in ((1, "t1"), (2, "t2")) for c in "xyz") + " FROM tc GROUP BY event_id",
    LM, DET, FACED, *TUBES,
)
def tube_clip(spark, sf):
    """Tubes between crystals cut at a cylinder."""
    e = solids.tube_clip(_faced(spark, sf), SOLID, 12.0, 9.0)
    return e.select("event_id", "whole", *[r(f"c{c}{k}").alias(f"c{c}{k}") for k in "12" for c in "xyz"])


@query(
    "SELECT event_id, round(CASE WHEN abs(b - a) >= 1e-7 THEN a / (a - b) END, 6) + 0e0 AS t FROM (SELECT event_id, (-400e0 * x1 + 250e0 * y1 + 2000e0 * (z1 - 10)) AS a, (-400e0 * x2 + 250e0 * y2 + 2000e0 * (z2 - 10)) AS b FROM lor)",
    LM, DET, "lor AS (SELECT lm.event_id, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2 FROM lm JOIN det a ON a.det_id = d1 JOIN det b ON b.det_id = d2)",
)
def plane_crossing(spark, sf):
    """Where each line meets a plane, null for parallel ones."""
    p, q = (tuple(F.col(f"{a}{k}") for a in "xyz") for k in "12")
    return lors(spark, sf).select("event_id", r(PLANE.crossing(p, q), 6).alias("t"))


# --- convolution

KERNEL = np.array([(z * 9 + y * 3 + x) % 7 - 1.5 + 0.25 * x for z in range(3) for y in range(3) for x in range(3)]).reshape(3, 3, 3)
_TAPS = "taps AS (SELECT * FROM (VALUES " + ", ".join(f"({z}, {y}, {x}, {KERNEL[z, y, x]!r}::DOUBLE)" for z in range(3) for y in range(3) for x in range(3)).replace("np.float64(", "").replace(")::DOUBLE", "::DOUBLE") + ") AS v(kz, ky, kx, w))"
_XYZ = "im AS (SELECT t, vox % 8 AS x, vox // 8 % 8 AS y, vox // 64 AS z, value FROM voxels)"


@query(
    "SELECT o.t, o.x + o.y * 8 + o.z * 64 AS vox, round(sum(w * i.value), 5) + 0e0 AS value FROM im o, taps JOIN im i ON i.t = o.t AND i.x = o.x + kx AND i.y = o.y + ky AND i.z = o.z + kz WHERE o.x < 6 AND o.y < 6 AND o.z < 2 GROUP BY ALL",
    VOX2, _XYZ, _TAPS,
)
def convolve_inside(spark, sf):
    """Only where the whole kernel lies within the image; blocks of 3 x 5 x 2 voxels."""
    e = convolve.convolve(views.voxels(spark, sf, nt=2), KERNEL, block=(3, 5, 2))
    return e.select("t", "vox", r("value", 5).alias("value"))


_MIRROR = "(CASE WHEN {p} < 0 THEN -1 - ({p}) WHEN {p} >= {n} THEN {m} - ({p}) ELSE {p} END)"


@query(
    "SELECT o.t, o.x + o.y * 8 + o.z * 64 AS vox, round(sum(w * i.value), 5) + 0e0 AS value FROM im o, taps JOIN im i ON i.t = o.t AND i.x = "
    + _MIRROR.format(p="o.x + kx - 1", n=8, m=15) + " AND i.y = " + _MIRROR.format(p="o.y + ky - 1", n=8, m=15) + " AND i.z = " + _MIRROR.format(p="o.z + kz - 1", n=4, m=7) + " GROUP BY ALL",
    VOX2, _XYZ, _TAPS,
)
def convolve_mirrored(spark, sf):
    e = convolve.convolve(views.voxels(spark, sf, nt=2), KERNEL, border="mirror", block=(4, 3, 3))
    return e.select("t", "vox", r("value", 5).alias("value"))


# --- projectors by name


@query(
    "SELECT name, event_id, round(sum(w * value), 3) + 0e0 AS value FROM (SELECT 'dd' AS name, event_id, vox, w FROM dd UNION ALL SELECT 'siddon', event_id, vox, w FROM sm) JOIN voxels USING (vox) GROUP BY ALL",
    LM, DET, LOR, FACED, sql_footprint("faced"), _sql_siddon("lor", "event_id"), VOX,
)
def projectors_by_name(spark, sf):
    """The same lines and image through either projector."""
    x, out = views.voxels(spark, sf), None
    for name in ("dd", "siddon"):
        e = projectors.Projector(name, crystal=(9.0, 12.0, 0.0)).forward(_faced(spark, sf), x, "event_id")
        e = e.select(F.lit(name).alias("name"), "event_id", r("value", 3).alias("value"))
        out = e if out is None else out.unionByName(e)
    return out
