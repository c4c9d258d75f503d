"""Enumeration, vendor files, motion parameters, solids and convolution against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.operators import convolve, enumerate, poses, solids
from tomoframe.sources import vendor
from tomoframe.sources.views import Grid


def listed(s):
    """All legal projections in order, by loops."""
    low, high = s.fan
    fan = range(low, high + 1)
    within = [(a, a + f) for a in range(high) for f in fan if a + f < s.radial]
    between = [(a, (a + f) % s.radial) for a in range(s.radial) for f in fan]
    at = lambda layer, axial, radial: (layer * s.axial + axial) * s.radial + radial
    out = []
    for d, a in itertools.product(range(s.most + 1), range(s.axial)):
        if a + d >= s.axial:
            continue
        if d == 0:
            for l1, l2, basis in ((0, 0, within), (0, 1, between), (1, 1, within)):
                out += [(at(l1, a, x), at(l2, a, y)) for x, y in basis]
        else:
            out += [(at(0, a, x), at(0, a + d, y)) for x, y in between] + [(at(0, a, x), at(1, a + d, y)) for x, y in between]
            out += [(at(0, a + d, y), at(1, a, x)) for x, y in between] + [(at(1, a, x), at(1, a + d, y)) for x, y in between]
    return out


@pytest.mark.parametrize("s", [enumerate.Rings(3, 12, 1, 0.5), enumerate.Rings(4, 10, 3, 0.3, 2), enumerate.Rings(2, 8, 0, 0.6), enumerate.Rings(3, 14, 2, 0.9)])
def test_legal_projections_against_loops(spark, s):
    want = listed(s)
    got = {r.proj_id: (r.d1, r.d2) for r in enumerate.legal_projections(spark, s).collect()}
    assert len(want) == s.projections and got == dict(zip(range(len(want)), want, strict=True))
    assert len(set(want)) == len(want)
    pairs = [(i, j) for i in range(2 * s.layer) for j in range(i, 2 * s.layer)]
    number = {p: k for k, p in zip(range(len(want)), want, strict=True)}
    rows = spark.createDataFrame([(j, i) if (i + j) % 2 else (i, j) for i, j in pairs], "d1 long, d2 long")
    for r in enumerate.projection_numbers(rows, s).collect():
        assert r.proj_id == number.get((min(r.d1, r.d2), max(r.d1, r.d2)), -1)


def test_order_of_the_angle(spark):
    s = enumerate.Rings(1, 12, 0, 0.5)
    places = spark.createDataFrame([(k, math.cos(2 * math.pi * k / 12), math.sin(2 * math.pi * k / 12)) for k in range(12)], "radial long, x double, y double")
    rows = sorted(enumerate.radial_basis(spark, s, True, places).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(s.same))

    def beta(a, b):
        dx, dy = math.cos(2 * math.pi * a / 12) - math.cos(2 * math.pi * b / 12), math.sin(2 * math.pi * a / 12) - math.sin(2 * math.pi * b / 12)
        return round(math.acos((-dx if dy < 0 else dx) / math.hypot(dx, dy)), 4)

    turned = [beta(r.b1, r.b2) for r in rows]
    assert turned == sorted(turned)


@pytest.mark.parametrize("kind", list(vendor.KINDS))
def test_simulated_coincidences_go_round(spark, tmp_path, kind):
    dtype = vendor.simulation_dtype(kind)
    assert dtype.itemsize == {"times": 64, "sources": 112, "interactions": 160}[kind]
    i = F.col("id")
    rows = spark.range(0, 300, 1, 3).select(*[((i * (k + 3)) % 97).cast("double" if dtype[n].kind == "f" else "int").alias(n) for k, n in zip(range(99), dtype.names)])
    vendor.write_simulation(rows, str(tmp_path / "s"), kind)
    got = vendor.read_simulation(spark, str(tmp_path / "s"), kind, split=2000).select(*dtype.names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "bad").write_bytes(b"123")
    with pytest.raises(Exception, match="no multiple"):
        vendor.read_simulation(spark, str(tmp_path / "bad"), kind).count()


def test_text_columns(spark, tmp_path):
    for n in (14, 20, 46):
        (tmp_path / f"{n}.txt").write_text("".join("  ".join(str(100 * k + c) for c in range(n)) + "\n" for k in range(3)) + "\n")
        r = vendor.read_simulation_text(spark, str(tmp_path / f"{n}.txt"), n).orderBy("t0").first()
        at = vendor.TEXT_COLUMNS[n]
        assert (r.t0, r.t1) == at["time"] and tuple(r[f"{c}1"] for c in at["names"]) == at["levels"][1]
        assert at["source"] is None or (r.X0, r.Y0, r.Z0) == at["source"]
    with pytest.raises(ValueError):
        vendor.read_simulation_text(spark, str(tmp_path / "14.txt"), 15)
    with pytest.raises(Exception, match="not 20 numbers"):
        vendor.read_simulation_text(spark, str(tmp_path / "14.txt"), 20).collect()


@pytest.mark.parametrize(("tof", "atten"), list(itertools.product([False, True], repeat=2)))
def test_headed_listmode(spark, tmp_path, tof, atten):
    rows = spark.range(50).selectExpr("id AS ts_ms", "id * 3 AS d1", "id + 7 AS d2", "id / 8D AS tof_ps", "0.25D AS atten")
    path = str(tmp_path / "scan.cdh")
    vendor.write_headed_listmode(rows, path, tof, atten)
    got = vendor.read_headed_listmode(spark, path)
    cols = ["ts_ms", "d1", "d2"] + ["tof_ps"] * tof + ["atten"] * atten
    assert set(got.columns) == {"record_id", *cols} and sorted(got.select(cols).collect()) == sorted(rows.select(cols).collect())
    head = (tmp_path / "scan.cdh").read_text()
    for bad, said in ((head.replace("list-mode", "histogram"), "not list-mode"), (head.replace("events: 50", "events: 51"), "51 events")):
        (tmp_path / "scan.cdh").write_text(bad)
        with pytest.raises(ValueError, match=said):
            vendor.read_headed_listmode(spark, path)


def matrix(degrees, axis):
    u = np.array(axis) / np.linalg.norm(axis)
    k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    a = np.radians(degrees)
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def test_motion_parameters_against_matrices(spark):
    r = np.random.default_rng(2)
    rows = [(i, 10 * i, 10 * (i + 1) + i, *map(float, r.uniform(-170, 170, 1)), *map(float, r.normal(size=3)), *map(float, r.normal(size=3) * 5)) for i in range(6)]
    e = spark.createDataFrame(rows, "frame int, t_start long, t_stop long, degrees double, ax double, ay double, az double, px double, py double, pz double")
    ref = matrix(rows[2][3], rows[2][4:7]), np.array(rows[2][7:])
    got = {x.frame: x for x in poses.motion_parameters(e, 2).collect()}
    for row in rows:
        x = got[row[0]]
        w, *v = x.qw, x.qx, x.qy, x.qz
        turn = matrix(np.degrees(2 * np.arctan2(np.linalg.norm(v), w)), v if np.linalg.norm(v) else [1, 0, 0])
        assert np.allclose(turn, ref[0].T @ matrix(row[3], row[4:7]))
        assert np.allclose([x.tx, x.ty, x.tz], np.array(row[7:]) - turn @ ref[1])
    assert sum(x.weight for x in got.values()) == pytest.approx(1) and got[3].weight == pytest.approx(13 / sum(t[2] - t[1] for t in rows))
    decay = {x.frame: x.weight for x in poses.motion_parameters(e, 0, 20.0).collect()}
    part = [0.5 ** (t[1] / 20) - 0.5 ** (t[2] / 20) for t in rows]
    assert all(decay[i] == pytest.approx(p / sum(part)) for i, p in zip(range(6), part, strict=True))
    with pytest.raises(ValueError):
        poses.motion_parameters(e, 9)


def test_solids(spark):
    c = solids.Cylinder(5.0, 8.0, (1.0, 0.0, 0.0))
    at = lambda p, q, finite=True: tuple(spark.range(1).select(*[t.alias(f"t{k}") for k, t in zip("01", c.crossings(tuple(map(F.lit, p)), tuple(map(F.lit, q)), finite), strict=True)]).first())
    assert at((-9.0, 0.0, 0.0), (11.0, 0.0, 0.0)) == (0.25, 0.75)
    assert at((-9.0, 6.0, 0.0), (11.0, 6.0, 0.0)) == (None, None) and at((1.0, 0.0, -9.0), (1.0, 0.0, 9.0)) == (None, None)
    assert at((-9.0, 0.0, -10.0), (11.0, 0.0, 10.0)) == (None, None) and at((-9.0, 0.0, -10.0), (11.0, 0.0, 10.0), False) == (0.25, 0.75)
    p = solids.Plane(((0.0, 0.0, 2.0), (1.0, 0.0, 2.0), (0.0, 1.0, 2.0)))
    row = spark.range(1).select(p.crossing((F.lit(0.0), F.lit(0.0), F.lit(0.0)), (F.lit(1.0), F.lit(1.0), F.lit(8.0))), p.crossing((F.lit(0.0), F.lit(0.0), F.lit(1.0)), (F.lit(1.0), F.lit(1.0), F.lit(1.0))), p.holds((F.lit(5.0), F.lit(3.0), F.lit(2.0))), p.holds((F.lit(5.0), F.lit(3.0), F.lit(2.5))), solids.plane_distance(p, (F.lit(0.0), F.lit(0.0), F.lit(5.0)))).first()
    assert tuple(row) == (0.25, None, True, False, 3.0)
    with pytest.raises(ValueError):
        solids.Plane(((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0)))


@pytest.mark.parametrize(("border", "block"), [("inside", (64, 64, 64)), ("inside", (2, 3, 2)), ("mirror", (3, 2, 2)), ("circular", (4, 4, 1))])
def test_convolution_against_numpy(spark, border, block):
    g = Grid(nx=7, ny=5, nz=4)
    r = np.random.default_rng(5)
    a, kernel = r.normal(size=(2, 4, 5, 7)), r.normal(size=(3, 2, 3))
    rows = [(t, x + y * 7 + z * 35, float(a[t, z, y, x])) for t, z, y, x in np.ndindex(*a.shape)]
    got = np.full(a.shape, np.nan)
    for t, vox, v in convolve.convolve(spark.createDataFrame(rows, "t int, vox long, value double").repartition(3), kernel, g, border, block).collect():
        assert np.isnan(got[t, vox // 35, vox // 7 % 5, vox % 7])
        got[t, vox // 35, vox // 7 % 5, vox % 7] = v
    want = np.full(a.shape, np.nan)
    for t in (0, 1):
        wide = a[t] if border == "inside" else np.pad(a[t], [(k // 2, k - 1 - k // 2) for k in kernel.shape], mode={"mirror": "symmetric", "circular": "wrap"}[border])
        windows = np.lib.stride_tricks.sliding_window_view(wide, kernel.shape)
        out = (windows * kernel).sum((-1, -2, -3))
        want[t][tuple(slice(n) for n in out.shape)] = out
    assert np.allclose(got, want, equal_nan=True)
    with pytest.raises(ValueError):
        convolve.convolve(spark.createDataFrame(rows, "t int, vox long, value double"), np.zeros((1, 1, 99)), g, "mirror")


def test_projectors_by_name_are_adjoint_and_say_what_they_need(spark):
    from tomoframe.operators.projectors import Projector
    from tomoframe.plans import volumes

    e = volumes._faced(spark, "/root/testdata/sf0.001").where("event_id < 300").withColumnRenamed("randoms", "value")
    x = spark.range(256).selectExpr("id AS vox", "1D + id % 7 AS value")
    for p in (Projector(), Projector("siddon", tof=(500.0, 3.0)), Projector("siddon", rays=3, crystal=(5.0, 3.0, 8.0)), Projector("dd", tof=(500.0, 3.0), crystal=(9.0, 12.0, 0.0))):
        a = p.forward(e, x, "event_id").withColumnRenamed("value", "p").join(e, "event_id").agg(F.sum(F.col("p") * F.col("value"))).first()[0]
        b = p.back(e, "event_id").withColumnRenamed("value", "u").join(x, "vox").agg(F.sum(F.col("u") * F.col("value"))).first()[0]
        assert a > 0 and a == pytest.approx(b)
    with pytest.raises(ValueError, match="nx1"):
        Projector("dd").forward(e.drop("nx1"), x, "event_id")
    for bad in ({"name": "none"}, {"name": "siddon", "psf": volumes.ACROSS}, {"name": "dd", "rays": 2}):
        with pytest.raises(ValueError):
            Projector(**bad)


def test_scanner_files():
    import json

    from tomoframe.functions import geometry as geo

    raw = {"VERSION": 3.1, "scannerName": "s", "axialFOV": 200, "crystalSize_z": 1, "crystalSize_trans": 2, "crystalDepth": 10, "scannerRadius": 150, "detsPerRing": 48, "num_rings": 12, "numDOI": 2, "max_ring_diff": 8, "minAngDiff": 6, "fwhm": 80.5}
    f = geo.scanner_file(json.dumps(raw))
    assert (f.name, f.scanner.rings, f.scanner.dets_per_block, f.scanner.crystal_size_trans, f.fwhm, f.mask) == ("s", 12, 1, 2.0, 80.5, None)
    assert geo.Scanner.from_json(json.dumps(raw | {"dets_per_block": 4, "detCoord": "d.lut"})).dets_per_block == 4
    for k in set(raw) - {"fwhm"}:
        with pytest.raises(ValueError, match="missing"):
            geo.scanner_file(json.dumps({n: v for n, v in raw.items() if n != k}))
    for bad, said in ((json.dumps(raw | {"VERSION": 3.3}), "newer"), ("{", "no JSON")):
        with pytest.raises(ValueError, match=said):
            geo.scanner_file(bad)
