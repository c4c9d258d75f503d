import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.functions import scalars
from tomoframe.operators import algebra, recon, select, temporal
from tomoframe.sources import formats


def test_erfc_is_near_the_library(spark):
    rows = spark.range(-400, 401).select((F.col("id") / 100.0).alias("x")).select("x", scalars.erfc(F.col("x")).alias("v")).collect()
    assert all(abs(r.v - math.erfc(r.x)) <= 1.3e-7 * math.erfc(r.x) + 1e-300 for r in rows)


def test_kernel_integral_against_fine_sums(spark):
    taps, step = [0.5, 1.0, 2.0, 0.25, 0.125], 1.5
    grid = np.linspace(-6, 6, 480_001)
    f = np.interp(grid, [(i - 2) * step for i in range(-1, 6)], [0, *taps, 0], 0, 0)
    r = random.Random(3)
    pairs = [(r.uniform(-6, 6), r.uniform(-6, 6)) for _ in range(40)] + [(-20.0, 20.0), (1.0, 1.0)]
    got = [x.v for x in spark.createDataFrame(pairs, "a double, b double").coalesce(1).select(scalars.kernel_integral(taps, step, F.col("a"), F.col("b")).alias("v")).collect()]
    for (a, b), v in zip(pairs, got, strict=True):
        inside = (grid >= a) & (grid <= b)
        assert abs(v - (f[inside].sum() * (grid[1] - grid[0]) if a < b else 0)) < 1e-3


def test_gaussian_kernel():
    k = scalars.gaussian_kernel(2.0, 1.0)
    assert len(k) == 10 and abs(sum(k) - 1) < 1e-12 and max(k) == k[5]
    assert scalars.gaussian_kernel_fwhm(2.0 * scalars.SIGMA_TO_FWHM, 1.0, 5) == pytest.approx(scalars.gaussian_kernel(2.0, 1.0, 5))


def test_many_frames_meet_rows_by_bucket(spark):
    bounds = sorted(random.Random(1).sample(range(0, 100_000), 41))
    frames = spark.createDataFrame([(i, bounds[i], bounds[i + 1] - (i % 3 == 0)) for i in range(40)], "frame int, t_start long, t_stop long")
    rows = spark.range(-50, 100_050, 37).select(F.col("id").alias("ts_ms"))
    few = temporal.assign_frames(rows, frames).collect()
    many = temporal.assign_frames(rows, frames, most=5).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and len(few) == rows.count()


def test_arrays_come_back_whole(spark):
    a = np.arange(24.0).reshape(2, 3, 4) % 5
    got = formats.array_table(spark, a, dense=True).collect()
    b = np.full((2, 3, 4), -1.0)
    for r in got:
        b[r.i0, r.i1, r.i2] = r.value
    assert len(got) == 24 and (a == b).all()


def test_ranges_of_text(spark):
    got = spark.range(1).select(select.parse_ranges(F.lit(" 3-5,9, 12-12 ,")).alias("r")).first().r
    assert [tuple(x) for x in got] == [(3, 5), (9, 9), (12, 12)]


def test_point_update_multiplies(spark):
    image = spark.createDataFrame([(v, 2.0) for v in range(256)], "vox long, value double")
    points = spark.createDataFrame([(0.5, 0.5, 0.5, 3.0), (0.6, 0.6, 0.6, 2.0), (1e9, 0.0, 0.0, 7.0)], "x double, y double, z double, amount double")
    got = {r.vox: r.value for r in algebra.update_points(image, points, multiply=True).collect()}
    assert sorted(got.values()) == [2.0] * 255 + [12.0]


def test_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Frame:
        class sparkSession:
            conf = Conf()

            class sparkContext:
                master = "yarn"

                @staticmethod
                def getConf():
                    return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        recon.cut(Frame(), "x")
