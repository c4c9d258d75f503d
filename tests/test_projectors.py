import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.operators import footprint, kernels, project, recon, temporal
from tomoframe.plans import slate
from tomoframe.sources.views import GRID, Grid, voxels

SF = "/root/testdata/sf0.001"


def chord(p1, p2, g):
    """Length of the segment inside box and cylinder, by fine sampling."""
    t = (np.arange(200_000) + 0.5) / 200_000
    p = np.array(p1)[None] + t[:, None] * (np.array(p2) - np.array(p1))[None] - np.array([g.ox, g.oy, g.oz])
    half = np.array([g.nx * g.vx, g.ny * g.vy, g.nz * g.vz]) / 2
    ok = (np.abs(p) < half).all(1) & (p[:, 0] ** 2 + p[:, 1] ** 2 < g.fov**2)
    return ok.mean() * np.linalg.norm(np.array(p2) - np.array(p1))


def test_siddon_weights_sum_to_the_chord(spark):
    r = np.random.default_rng(4)
    lines = [(i, *map(float, r.uniform(-220, 220, 6))) for i in range(30)] + [(98, -200.0, 3.0, 1.0, 200.0, 3.0, 1.0), (99, 0.5, 0.5, -150.0, 0.5, 0.5, 150.0), (97, 300.0, 300.0, 0.0, 300.0, -300.0, 0.0)]
    df = spark.createDataFrame(lines, "bin long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    got = {x.bin: x.s for x in project.siddon(df).groupBy("bin").agg({"w": "sum"}).withColumnRenamed("sum(w)", "s").collect()}
    for line in lines:
        assert abs(got.get(line[0], 0.0) - chord(line[1:4], line[4:7], GRID)) < 0.05, line


def test_distance_driven_is_near_siddon_for_central_lines(spark):
    g = Grid(nx=8, ny=8, nz=4, ox=0.0, oy=0.0, oz=0.0, fov=1e6)
    cols = "bin long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, nx1 double, ny1 double, nz1 double, nx2 double, ny2 double, nz2 double"
    a = np.deg2rad(20)
    line = (1, 200 * float(np.cos(a)), 200 * float(np.sin(a)), 5.0, -200 * float(np.cos(a)), -200 * float(np.sin(a)), 5.0, float(np.cos(a)), float(np.sin(a)), 0.0, -float(np.cos(a)), -float(np.sin(a)), 0.0)
    df = spark.createDataFrame([line], cols)
    dd = footprint.distance_driven(df, g, 1.0, 1.0).agg({"w": "sum"}).first()[0]
    sd = project.siddon(df, g).agg({"w": "sum"}).first()[0]
    assert abs(dd - sd) / sd < 0.05


def test_osem_equals_numpy(spark):
    m = slate.matrix(spark, SF).collect()
    data = {r.event_id: r for r in slate.em_data(spark, SF).collect()}
    ids = sorted(data)
    at = {e: i for i, e in enumerate(ids)}
    a = np.zeros((len(ids), GRID.voxels))
    for r in m:
        a[at[r.event_id], r.vox] += r.w
    get = lambda c: np.array([data[e][c] for e in ids])
    sens, atten, rnd, sc = get("sens"), get("atten"), get("randoms"), get("scatter")
    f = sens * atten
    s = a.T @ f
    x = np.where(s > 0, 0.125, 0.0)
    for _ in range(2):
        for k in range(2):
            sub = np.array([e % 2 == k for e in ids])
            q = (a[sub] @ x) * f[sub] + rnd[sub] + sc[sub]
            ratio = np.where(np.abs(q) > 1e-35, 1 / np.where(q == 0, 1, q), 0) * f[sub]
            u = a[sub].T @ ratio
            x = np.where(s / 2 > 0, x * u / np.where(s > 0, s / 2, 1), x)
    got = {r.vox: r.value for r in slate.osem_subsets(spark, SF).collect()}
    assert got and all(abs(v - x[k]) <= 1e-4 + 1e-4 * abs(x[k]) for k, v in got.items())


@pytest.mark.parametrize(("update", "subsets"), [("w", 2), ("h", 1), ("dual", 2)])
def test_low_rank_em_equals_numpy(spark, update, subsets):
    g = np.random.default_rng(3)
    bins, voxels, frames, rank, times = 24, 7, 3, 2, 3
    a = np.where(g.random((bins, voxels)) < 0.5, np.round(g.random((bins, voxels)), 2), 0)
    y, f, rnd = np.round(g.random(bins) * 9, 1), np.round(0.5 + g.random(bins), 2), np.round(g.random(bins), 2)
    frame = g.integers(0, frames, bins)
    frame[:2] = -1  # rows of no frame take no part
    w, h = 0.5 + g.random((rank, voxels)), 0.5 + g.random((rank, frames))
    s = a.T @ f
    s[0] = 0  # no sensitivity: the voxel stays
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(bins) for j in range(voxels) if a[i, j]], "bin long, vox long, w double")
    d = spark.createDataFrame([(i, float(y[i]), float(f[i]), 1.0, float(rnd[i]), 0.0, 1.0) for i in range(bins)], "bin long, value double, sens double, atten double, randoms double, scatter double, invivo double")
    dw = spark.createDataFrame([(l, j, float(w[l, j])) for l in range(rank) for j in range(voxels)], "rank int, vox long, value double")
    dh = spark.createDataFrame([(l, t, float(h[l, t])) for l in range(rank) for t in range(frames)], "rank int, frame int, h double")
    df = spark.createDataFrame([(i, int(t)) for i, t in enumerate(frame) if t >= 0], "bin long, frame int")
    ds = spark.createDataFrame([(j, float(s[j])) for j in range(1, voxels)], "vox long, sens double")
    got_w, got_h = recon.low_rank_em(m, d, dw, dh, df, ds, times, subsets, update)
    for it in range(times):
        for k in range(subsets):
            uw, uh = np.zeros_like(w), np.zeros_like(h)
            for i in range(bins):
                if i % subsets == k and frame[i] >= 0:
                    q = a[i] @ (w.T @ h[:, frame[i]]) * f[i] + rnd[i]
                    ratio = y[i] / q * f[i]
                    uw += ratio * np.outer(h[:, frame[i]], a[i])
                    uh[:, frame[i]] += ratio * (w @ a[i])
            sub = s / subsets
            new_w = np.where(sub > 0, w * uw / h.sum(1)[:, None] / np.where(sub > 0, sub, 1), w)
            if update == "h" or (update == "dual" and it):
                h = h * uh / (w @ sub)[:, None]
            if update != "h":
                w = new_w
    assert all(abs(r.value - w[r["rank"], r.vox]) < 1e-9 * max(1, w.max()) for r in got_w.collect()) and got_w.count() == w.size
    assert all(abs(r.h - h[r["rank"], r.frame]) < 1e-9 * max(1, h.max()) for r in got_h.collect()) and got_h.count() == h.size


def test_full_kernel_equals_brute_force(spark):
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=60), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "vox long, value double")
    want = {(i, j) for i in range(60) for j in sorted(range(60), key=lambda j: (abs(v[i] - v[j]), j))[:4]}
    for block in (5, 7, 4096):
        assert {(x.i, x.j) for x in kernels.nearest_by_value(df, 4, 0.1, block).collect()} == want
    plan = kernels.nearest_by_value(df, 4, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    with pytest.raises(ValueError):
        kernels.nearest_by_value(df, 7, 0.1, 7)


def test_window_neighbours_beside_absent_voxels(spark, tmp_path):
    """The last slice of the image lacks most of its voxels: patches there are shorter, as in the SQL."""
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 237) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = duck.execute(slate.SQL["kernel_knn"]).fetchall()
    got = slate.kernel_knn(spark, str(tmp_path)).select("i", "j", "k").collect()
    assert sorted((r.i, r.j, round(r.k, 6)) for r in got) == sorted((i, j, round(k, 6)) for i, j, k in want)


def test_bootstrap_split_is_a_partition(spark):
    e = spark.range(1000).withColumnRenamed("id", "event_id")
    parts = recon.bootstrap_split(e, 4, 1).groupBy("part").count().collect()
    assert sum(p["count"] for p in parts) == 1000 and len(parts) == 4 and min(p["count"] for p in parts) > 150


def test_voxels_view(spark):
    assert voxels(spark, SF, nt=2).count() == 2 * GRID.voxels


@pytest.mark.parametrize("ranges", [2, 8, 32])
def test_asof_join_with_most_rows_after_the_last_start(spark, ranges):
    """Nine in ten rows follow the last start; results are those of a search, and no range of time has more than a few shares of the rows."""
    r = np.random.default_rng(8)
    ts = [*map(int, r.integers(-50, 1000, 200)), *map(int, r.integers(1000, 10**9, 1800)), None]
    starts = sorted({*map(int, r.integers(0, 40, 15)), 500, 999})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "id long, ts_ms long").repartition(4)
    motion = spark.createDataFrame([(k, t, 1.0 * k) for k, t in enumerate(starts)], "frame int, t_start long, c double")
    got = {x.id: (x.motion_frame, x.c) for x in temporal.motion_asof(rows, motion, ("c",), ranges, 0.5).collect()}
    for i, t in enumerate(ts):
        k = -1 if t is None else int(np.searchsorted(starts, t, "right")) - 1
        assert got[i] == (k, None if k < 0 else float(k))
    bounds = temporal._range_bounds(rows, motion, ranges, 0.5)
    share = np.bincount(np.searchsorted(bounds, [t for t in ts if t is not None], "right"))
    assert share.max() <= 3 * len(ts) / ranges + 60
    assert temporal.motion_asof(rows, motion.where("false"), ("c",)).where("motion_frame = -1 AND c IS NULL").count() == len(ts)
    assert temporal.motion_asof(rows.where("false"), motion, ("c",)).count() == 0


@pytest.mark.parametrize("slab", [1 << 23, 50, 7])
def test_a_step_on_lines_equals_the_one_on_a_matrix(spark, slab):
    d, lines = slate.em_data(spark, SF), recon.cut(slate.em_lines(spark, SF), "lines")
    image = recon.cut(voxels(spark, SF), "image")
    m = slate.matrix(spark, SF)
    want = {r.vox: r.value for r in recon.ratio_step(m, image, d, "event_id").collect()}
    step = recon.em_step(lines, image, slab=slab)
    got = {r.vox: r.value for r in step.collect()}
    assert got.keys() == want.keys() and all(v == pytest.approx(want[k], rel=1e-9) for k, v in got.items())
    if slab > 256:
        plan = step._jdf.queryExecution().executedPlan().toString()
        joins = [w for w in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin") if w in plan]
        assert not joins, plan


def test_rays_are_gathered_by_line(spark):
    e = slate._dd_lors(spark, SF).drop("randoms").join(slate.em_data(spark, SF).select("event_id", "value", "sens", "atten", "randoms", "scatter", "invivo"), "event_id")
    lines = recon.em_lines(e, rays=3, crystal=(5.0, 3.0, 8.0))
    assert lines.count() == lines.select("event_id").distinct().count() > 100
    got = {(r.event_id, r.vox): r.w for r in lines.select("event_id", F.explode("segments").alias("s")).groupBy("event_id", "s.vox").agg(F.sum("s.w").alias("w")).collect()}
    rays = project.siddon(project.crystal_rays(e, 3, 5.0, 3.0, 8.0, key="event_id"), keep=("event_id",))
    want = {(r.event_id, r.vox): r.w / 3 for r in rays.groupBy("event_id", "vox").agg(F.sum("w").alias("w")).collect()}
    assert got.keys() == want.keys() and all(v == pytest.approx(want[k]) for k, v in got.items())
