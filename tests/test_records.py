"""The data source of fixed-length records: splits, bounds, round trips."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.sources import formats, records


@pytest.mark.parametrize(("doi", "tof", "randoms"), list(itertools.product([False, True], repeat=3)))
def test_round_trip_of_all_layouts(spark, tmp_path, doi, tof, randoms):
    i = F.col("id")
    rows = spark.range(0, 997, 1, 6).select((i * 7 % 997).alias("ts_ms"), (i % 1152).alias("d1"), (i % 256).alias("doi1"), (i * 5 % 1152).alias("d2"), (i * 3 % 256).alias("doi2"), (i / 8).alias("tof_ps"), (i / 4).alias("randoms"))
    dtype = formats.record_dtype(doi, tof, randoms)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task
    for _ in range(2):
        formats.write_listmode(rows, str(tmp_path / "out"), doi, tof, randoms, overwrite=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out").iterdir())
    whole = np.concatenate([np.frombuffer(f.read_bytes(), dtype) for f in files])
    assert len(files) > 1 and len(whole) == 997 and (np.diff(whole["ts_ms"].astype(int)) >= 0).all()
    got = formats.read_listmode(spark, str(tmp_path / "out"), doi, tof, randoms, detectors=1152)
    assert sorted(map(tuple, got.select(*dtype.names).collect())) == sorted(map(tuple, rows.select(*dtype.names).collect()))


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    dtype = formats.record_dtype()
    a = np.zeros(10_000, dtype)
    a["ts_ms"], a["d1"], a["d2"] = np.arange(10_000) // 2, np.arange(10_000) % 99, 7
    (tmp_path / "a.lm").write_bytes(a.tobytes())
    path = str(tmp_path / "a.lm")
    df = formats.read_listmode(spark, path, split=12 * 1000)
    assert df.rdd.getNumPartitions() == 10
    got = df.orderBy("record_id").collect()
    assert [r.record_id for r in got] == list(range(10_000)) and [r.d1 for r in got] == a["d1"].tolist()
    plain = formats.read_listmode(spark, path, start=1500, stop=1600)
    quick = formats.read_listmode(spark, path, start=1500, stop=1600, ordered=True, split=12 * 50)
    assert quick.rdd.getNumPartitions() == 4 and sorted(plain.collect()) == sorted(quick.collect()) and quick.count() == 200
    assert formats.read_listmode(spark, path, start=9000, stop=9999, ordered=True).count() == 0
    (tmp_path / "none.lm").write_bytes(b"")
    assert formats.read_listmode(spark, str(tmp_path / "none.lm")).count() == 0
    with pytest.raises(Exception, match="nothing"):
        formats.read_listmode(spark, str(tmp_path / "nothing.lm")).count()


def test_sparse_histogram_files(spark, tmp_path):
    rows = [(1, 2, 0.5), (3, 4, 2.0), (2, 1, 1.5)]
    formats.write_sparse_histogram(spark.createDataFrame(rows, "d1 long, d2 long, value double").repartition(2), str(tmp_path / "h"))
    assert {(r.d1, r.d2, r.value) for r in formats.open_table(spark, str(tmp_path / "h"), "sh").collect()} == {(1, 2, 2.0), (3, 4, 2.0)}
    assert formats.read_histogram_records(spark, f"file:{tmp_path}/h").count() == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit(1).alias("d1"), F.when(F.col("id") < 99, F.lit(2)).alias("d2"), F.expr("IF(id = 99, raise_error('stop'), 1)").alias("ts_ms"))
    with pytest.raises(Exception, match="stop"):
        records.write(rows, str(tmp_path / "w"), formats.record_dtype())
    assert not [f for f in (tmp_path / "w").rglob("*") if f.is_file()]


def test_joint_fit_finds_the_parameters_of_its_own_curves(spark):
    from tomoframe.operators import kinetic

    rng = np.random.default_rng(4)
    bases = []
    for k in range(4):
        a = rng.uniform(0.1, 1.0, (2, 2, 12))
        w, kappa = np.ones((2, 12)), (0.11 * (k + 1), 0.2 * (k + 1))
        bases.append((k, *kappa, *a.reshape(4, 12).tolist(), kinetic.joint_inverse(a, w, kappa).ravel().tolist()))
    t = (0.3, 0.8, 0.5, 1.1)
    _, kappa0, kappa1, a0, b0, a1, b1, _ = bases[2]
    tac = [[t[0] * x + t[1] * y for x, y in zip(a0, b0)], [t[2] * x + t[3] * y for x, y in zip(a1, b1)]]
    df = spark.createDataFrame([(7, *tac)], "pix long, tac0 array<double>, tac1 array<double>")
    table = spark.createDataFrame(bases, "k int, kappa0 double, kappa1 double, a0 array<double>, b0 array<double>, a1 array<double>, b1 array<double>, inverse array<double>")
    one = F.array(*[F.lit(1.0)] * 12)
    got = kinetic.srtm_joint(df, table, (one, one)).first()
    assert got.k == 2 and got.cost < 1e-18
    bp = (t[0] / kappa0 - 1, t[2] / kappa1 - 1)
    assert (got.bp_b, got.k2_b, got.r1_b, got.ro, got.k2_d, got.r1_d) == pytest.approx((bp[0], t[0], t[1], 1 - bp[1] / bp[0], t[2], t[3]))
