import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.operators import image, psf, scatter, sss, temporal
from tomoframe.sources import views


def test_gaussian_box_is_normalised_and_reaches_one_voxel_at_least():
    taps = psf.gaussian_box((20.0, 30.0, 40.0), (3.0, 3.0, 3.0))
    assert abs(sum(t[3] for t in taps) - 1) < 1e-12
    assert [max(t[i] for t in taps) for i in range(3)] == [1, 2, 1]
    mixed = psf.gaussian_box((20.0, 30.0, 40.0), (3.0, 3.0, 3.0), other=(21.0, 20.0, 10.0), share=0.0)
    assert [t[3] for t in mixed] == pytest.approx([t[3] for t in taps])
    with pytest.raises(ValueError):
        psf.gaussian_box((0.0, 1.0, 1.0), (3.0, 3.0, 3.0))


def test_variant_psf_file():
    v = psf.read_variant_psf("60,0,0\n60,60,60\n3,3,3\n20,20,40\n30,30,50,\n")
    assert v.counts == (2, 1, 1) and v.kernels[1] == psf.gaussian_box((30.0, 30.0, 50.0), (3.0, 3.0, 3.0))
    two = psf.read_variant_psf("0,0,0\n60,60,60\n3,3,3\n20,20,40,30,30,50,0.25\n")
    assert two.kernels[0] == psf.gaussian_box((20.0, 20.0, 40.0), (3.0, 3.0, 3.0), other=(30.0, 30.0, 50.0), share=0.25)
    for bad in ("60,0,0\n60,60,60\n3,3,3\n", "60,0,0\n60,60,60\n3,3,3\n20,20\n", "60,0,0\n60,60,60\n3,3,3\n20,20,40\n"):
        with pytest.raises(ValueError):
            psf.read_variant_psf(bad)


def test_variant_psf_keeps_a_constant_and_has_its_adjoint(spark):
    v = psf.read_variant_psf("60,60,60\n60,60,60\n3,3,3\n" + "\n".join(f"{20 + k},{25 + k},{40 + 2 * k}" for k in range(8)))
    flat = views.voxels(spark, "/root/testdata/sf0.001").withColumn("value", F.lit(2.0))
    assert [round(r.value, 9) for r in psf.variant(flat, v).collect()] == [2.0] * views.GRID.voxels
    x, y = views.voxels(spark, "/root/testdata/sf0.001"), views.sens(spark, "/root/testdata/sf0.001").selectExpr("0 AS t", "vox", "sens AS value")
    dot = lambda a, b: a.join(b.withColumnRenamed("value", "o"), ["t", "vox"]).agg(F.sum(F.col("value") * F.col("o"))).first()[0]
    assert dot(psf.variant(x, v), y) == pytest.approx(dot(x, psf.variant(y, v, adjoint=True)))


def test_projection_psf_file_and_weights(spark):
    p = psf.read_projection_psf("30,2,3,0.5,1,0.25,0.75,1.5,0.5")
    assert p.kernels == ([0.5, 1.0, 0.25], [0.75, 1.5, 0.5]) and p.half_width == 4.0
    w = lambda a, b, flip=False: spark.range(1).select(p.weight(F.lit(0), F.lit(a), F.lit(b), flip)).first()[0]
    assert w(-4.0, 4.0) == pytest.approx(2 * 1.75) and w(4.5, 9.0) == 0 and w(1.0, 1.0) == 0
    assert w(-4.0, 0.0) == pytest.approx(w(0.0, 4.0, True))
    with pytest.raises(ValueError):
        psf.read_projection_psf("30,2,2,0.5,1")


def test_rigid_motion_is_the_turn_about_z_where_it_is_one(spark):
    e = spark.createDataFrame([(5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (-1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "ts_ms long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    turn = spark.createDataFrame([(0, 0, 0.6, 0.8, 1.0, -2.0, 0.5)], "frame int, t_start long, c double, s double, tx double, ty double, tz double")
    whole = turn.selectExpr("frame", "t_start", "c r00", "-s r01", "0D r02", "tx", "s r10", "c r11", "0D r12", "ty", "0D r20", "0D r21", "1D r22", "tz")
    cols = ["ts_ms", *(f"{a}{k}" for k in "12" for a in "xyz")]
    a = temporal.move(temporal.motion_asof(e, turn)).select(cols).collect()
    b = temporal.move_rigid(temporal.motion_asof(e, whole, temporal.RIGID)).select(cols).collect()
    assert sorted(a) == sorted(b) and temporal.move_rigid(temporal.motion_asof(e, whole.where("false"), temporal.RIGID)).select(cols).collect() == e.collect()


def test_resampling_onto_its_own_grid_changes_nothing(spark):
    v = views.voxels(spark, "/root/testdata/sf0.001")
    out = {r.vox: r.value for r in image.resample(v, v.select("vox"), views.GRID).collect()}
    assert all(out[r.vox] == pytest.approx(r.value) for r in v.collect())


def test_single_scatter_against_loops(spark):
    """Every cell of a small space by plain loops over the points, with finely stepped line integrals."""
    s, g = scatter.Space(planes=2, angles=4), views.Grid(nx=4, ny=4, nz=2, vx=40.0, vy=40.0, vz=60.0, ox=0.0, oy=0.0, oz=0.0, fov=150.0)
    d = sss.Detection([0.08 * (511.0 / (k + 1)) ** 1.5 for k in range(1000)])
    mu = spark.range(32).selectExpr("0 AS t", "id AS vox", "(id % 5) * 0.03D AS value")
    lam = spark.range(32).selectExpr("0 AS t", "id AS vox", "1D + id % 3 AS value")
    points = sss.sample_points(spark, mu, d, 0.1, g)
    pts = points.collect()
    assert 10 < len(pts) <= 125 and all(p.density > sss.LEAST_MU for p in pts)
    m, e = (np.array([r.value for r in t.orderBy("vox").collect()]).reshape(2, 4, 4) for t in (mu, lam))

    def line(img, a, b):
        n = 20_000
        q = a + (b - a) * ((np.arange(n) + 0.5) / n)[:, None]
        i = [np.floor(q[:, k] / v + c / 2).astype(int) for k, v, c in ((0, 40, 4), (1, 40, 4), (2, 60, 2))]
        ok = (i[0] >= 0) & (i[0] < 4) & (i[1] >= 0) & (i[1] < 4) & (i[2] >= 0) & (i[2] < 2)
        return img[i[2][ok], i[1][ok], i[0][ok]].sum() * np.linalg.norm(b - a) / n

    ends = [np.array([200 * math.cos((a + 0.5) * math.pi / 2), 200 * math.sin((a + 0.5) * math.pi / 2), (p + 0.5) * 100 - 100]) for p in range(2) for a in range(4)]

    def exit_(o, way, radius):
        a, b, c = way[:2] @ way[:2], o[:2] @ way[:2], o[:2] @ o[:2] - radius**2
        return (-b + math.sqrt(b * b - a * c)) / a

    depth = lambda o, to: (exit_(o, to - o, 220) - exit_(o, to - o, 200)) * np.linalg.norm(to - o)
    eff = lambda energy: math.erfc((400 - energy) / (math.sqrt(2) * d.sigma))
    stop = lambda path, energy: 1 - math.exp(-path * d.crystal[int(energy) - 1])
    scale = lambda energy: spark.range(1).select(scatter.mu_scaling(F.lit(energy))).first()[0]
    got = {((r.p1 * 4 + r.a1), (r.p2 * 4 + r.a2)): r.value for r in sss.simulate(points, mu, lam, d, s, g).collect()}
    assert len(got) == 64 and all(got[i, i] == 0 for i in range(8)) and all(got[i, j] == got[j, i] for i, j in got)
    for i, j in ((0, 1), (0, 2), (1, 7), (3, 5)):
        total = 0.0
        for p in pts:
            q = np.array([p.sx, p.sy, p.sz])
            u, v = q - ends[i], ends[j] - q
            r1, r2 = np.linalg.norm(u), np.linalg.norm(v)
            cos = (u @ v) / r1 / r2
            energy = 511 / (2 - cos)
            if energy <= 400:
                continue
            t1, t2, l1, l2 = line(m, ends[i], q) / 10, line(m, ends[j], q) / 10, line(e, ends[i], q), line(e, ends[j], q)
            f, q1, q2 = scale(energy), depth(q, ends[i]), depth(q, ends[j])
            first = l1 * math.exp(-t1 - t2 * f) * eff(511) * stop(q1, 511) * eff(energy) * stop(q2, energy)
            second = l2 * math.exp(-t1 * f - t2) * eff(511) * stop(q2, 511) * eff(energy) * stop(q1, energy)
            k = 1 / (2 - cos)
            kn = k * k * (k + 2 - cos - (1 - cos * cos))
            facing = abs(ends[i][:2] @ u[:2]) / 200 / r1 * abs(ends[j][:2] @ v[:2]) / 200 / r2
            total += p.density * kn * (first + second) * facing / (r1 * r1 * r2 * r2 * 4 * math.pi)
        w, mid = ends[j] - ends[i], (ends[i] + ends[j]) / 2
        n = np.linalg.norm(w)
        own = eff(511) ** 2 * stop(depth(mid, ends[i]), 511) * stop(depth(mid, ends[j]), 511) * abs(ends[i][:2] @ w[:2]) / 200 / n * abs(ends[j][:2] @ w[:2]) / 200 / n / (n * n * 4 * math.pi)
        assert got[i, j] == pytest.approx(total / own, rel=2e-3)
