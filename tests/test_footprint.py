"""The distance-driven projector against plain loops, and against its own adjoint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.operators import footprint, project, psf
from tomoframe.sources.views import Grid

G = Grid(nx=6, ny=5, nz=4, vx=20.0, vy=24.0, vz=30.0, ox=1.5, oy=-2.0, oz=3.0, fov=1e6)
COLS = ["bin", *footprint.ENDS, *footprint.NORMALS, "tof_ps", "value"]
SYMMETRIC = psf.ProjectionPsf(25.0, 3.0, ([0.25, 1.0, 0.25], [0.5, 1.0, 0.5]))
LOPSIDED = psf.ProjectionPsf(25.0, 3.0, ([0.5, 1.0, 0.25], [0.0, 1.0, 0.75]))


def lines(n=40, tilted=False):
    r = np.random.default_rng(9)
    out = []
    for i in range(n):
        a = r.uniform(0, 2 * np.pi)
        b = a + np.pi + r.uniform(-0.4, 0.4)
        ends = [(150 * np.cos(t), 150 * np.sin(t), r.uniform(-55, 55)) for t in (a, b)]
        normals = [np.array([np.cos(t), np.sin(t), r.uniform(-0.4, 0.4) * tilted]) for t in (a, b)]
        out.append((i, *map(float, ends[0]), *map(float, ends[1]), *map(float, normals[0]), *map(float, normals[1]), float(r.uniform(-300, 300)), float(r.uniform(0, 2))))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "bin long, " + ", ".join(f"{c} double" for c in COLS[1:]))


def loops(row, trans, axial, tof=None, kernels=None, flipped=False):
    """Weights of one line by voxel, with vectors and a loop for each slice, pixel and plane."""
    v = dict(zip(COLS, row, strict=True))
    off = np.array([G.ox, G.oy, G.oz])
    p, q = (np.array([v[f"{a}{k}"] for a in "xyz"]) - off for k in "12")
    n = [np.array([v[f"n{a}{k}"] for a in "xyz"]) for k in "12"]
    size, count = np.array([G.vx, G.vy, G.vz]), (G.nx, G.ny, G.nz)
    d = q - p
    length = np.linalg.norm(d)
    main = 1 if abs(d[1]) > abs(d[0]) else 0
    cross = 1 - main
    lo, hi = 0.0, 1.0
    for a in range(3):
        half = (count[a] - 1) * size[a] / 2
        if d[a] == 0:
            if abs(p[a]) > half:
                return {}
        else:
            t = sorted([(-half - p[a]) / d[a], (half - p[a]) / d[a]])
            lo, hi = max(lo, t[0]), min(hi, t[1])
    at = v["tof_ps"] * project.C_MM_PS / 2
    if tof:
        sigma = project.tof_sigma(tof[0])
        lo, hi = max(lo, 0.5 + (at - tof[1] * sigma) / length), min(hi, 0.5 + (at + tof[1] * sigma) / length)
    if lo > hi:
        return {}
    kernel = None
    if kernels:
        away = abs(p[0] * d[1] - p[1] * d[0]) / np.hypot(d[0], d[1])
        kernel = kernels.kernels[min(int(away // kernels.step), len(kernels.kernels) - 1)]
        kernel = kernel[::-1] if flipped else kernel
    side = [np.cross(m, [0, 0, 1]) / np.linalg.norm(np.cross(m, [0, 0, 1])) for m in n]
    rise = [np.cross(m, s) / np.linalg.norm(np.cross(m, s)) for m, s in zip(n, side, strict=True)]
    ends = sorted(np.floor((p[main] + t * d[main]) / size[main] + count[main] / 2) for t in (lo, hi))
    out = {}
    for i in range(int(max(0, ends[0])), int(min(count[main] - 1, ends[1])) + 1):
        x = (i + 0.5 - count[main] / 2) * size[main]

        def meet(a, b, along, x=x):
            return a[along] + (x - a[main]) / (b[main] - a[main]) * (b[along] - a[along])

        c = sorted(meet(p + s * trans / 2 * side[0], q - s * trans / 2 * side[1], cross) for s in (-1, 1))
        z = sorted(meet(p + s * axial / 2 * rise[0], q + s * axial / 2 * rise[1], 2) for s in (-1, 1))
        step = size[main] * length / abs(d[main])
        if tof:
            step *= np.exp(-((((x - p[main]) / d[main] - 0.5) * length - at) ** 2) / (2 * sigma**2)) / (np.sqrt(2 * np.pi) * sigma)
        for j in range(count[cross]):
            left = (j - count[cross] / 2) * size[cross]
            if kernel is None:
                w = min(left + size[cross], c[1]) - max(left, c[0])
            else:  # fine trapezoids of the piecewise linear kernel
                a, b = left - c[1], left + size[cross] - c[0]
                half = (len(kernel) + 1) // 2
                u = np.linspace(max(a, -half * kernels.spacing), min(b, half * kernels.spacing), 20001) if b > -half * kernels.spacing and a < half * kernels.spacing else np.zeros(2)
                f = np.interp(u, (np.arange(len(kernel) + 2) - half) * kernels.spacing, [0, *kernel, 0])
                w = float(np.trapezoid(f, u))
            for k in range(count[2]):
                low = (k - count[2] / 2) * size[2]
                h = min(low + size[2], z[1]) - max(low, z[0])
                if w > 1e-9 and h > 0:
                    vox = (j + i * G.nx if main == 1 else i + j * G.nx) + k * G.nx * G.ny
                    out[vox] = out.get(vox, 0.0) + w / (c[1] - c[0]) * h / (z[1] - z[0]) * step
    return out


@pytest.mark.parametrize(("tof", "kernels", "tilted"), [(None, None, False), (None, None, True), ((400.0, 3.0), None, False), ((400.0, 0.0), None, False), (None, LOPSIDED, False), ((400.0, 2.0), LOPSIDED, True)])
def test_weights_against_loops(spark, tof, kernels, tilted):
    rows = lines(tilted=tilted)
    for flipped in (False, True)[: 1 + bool(kernels)]:
        got = footprint.distance_driven(table(spark, rows), G, 8.0, 11.0, tof=tof, psf=kernels, adjoint=flipped)
        by = {}
        for r in got.groupBy("bin", "vox").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect():
            assert r.n == 1
            by.setdefault(r.bin, {})[r.vox] = r.w
        for row in rows:
            want = loops(row, 8.0, 11.0, (tof[0], tof[1] or 1e9) if tof else None, kernels, flipped)
            have = by.get(row[0], {})
            assert all(abs(have.get(k, 0.0) - want.get(k, 0.0)) <= 1e-6 + 2e-4 * abs(want.get(k, 0.0)) for k in have | want), row[0]
    assert len(by) > 25


@pytest.mark.parametrize(("tof", "kernels"), [(None, None), ((400.0, 3.0), SYMMETRIC)])
def test_forward_and_back_are_adjoint(spark, tof, kernels):
    e = table(spark, lines(60))
    x = spark.range(G.voxels).selectExpr("id AS vox", "1D + id * 37 % 11 AS value")
    forward = project.forward(footprint.distance_driven(e, G, 8.0, 11.0, ("bin",), tof, kernels), x).withColumnRenamed("value", "p")
    a = forward.join(e, "bin").agg(F.sum(F.col("p") * F.col("value"))).first()[0]
    back = footprint.back_lors(e, G, 8.0, 11.0, tof, kernels).withColumnRenamed("value", "u")
    b = back.join(x, "vox").agg(F.sum(F.col("u") * F.col("value"))).first()[0]
    assert a > 0 and a == pytest.approx(b, rel=1e-12)


def test_lines_without_slices_have_no_rows(spark):
    rows = [(1, 5.0, 5.0, -90.0, 5.0, 5.0, 90.0, 1.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0), (2, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (3, 300.0, -300.0, 0.0, 300.0, 300.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    assert footprint.distance_driven(table(spark, rows), G, 8.0, 11.0).count() == 0
    assert footprint.distance_driven(table(spark, rows).where("false"), G, 8.0, 11.0).count() == 0
