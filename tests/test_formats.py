import numpy as np
import pytest

from tomoframe.sources import formats
from tomoframe.streaming.frames import frame_histogram


def test_listmode_round_trip_bounds_and_errors(spark, tmp_path):
    dt = formats.record_dtype(doi=True, tof=True, randoms=True)
    a = np.zeros(1000, dt)
    a["ts_ms"], a["d1"], a["d2"] = np.arange(1000) * 10, np.arange(1000) % 1152, (np.arange(1000) * 7) % 1152
    a["doi1"], a["tof_ps"], a["randoms"] = np.arange(1000) % 256, np.arange(1000) / 8, 0.25
    for k in range(2):
        (tmp_path / f"p{k}.lm").write_bytes(a[k * 500 : (k + 1) * 500].tobytes())
    df = formats.open_table(spark, str(tmp_path / "*.lm"), "lm-doi", tof=True, randoms=True, detectors=1152)
    got = sorted((r.ts_ms, r.d1, r.doi1, r.d2, r.tof_ps) for r in df.collect())
    assert got == sorted((int(x["ts_ms"]), int(x["d1"]), int(x["doi1"]), int(x["d2"]), float(x["tof_ps"])) for x in a)
    some = formats.read_listmode(spark, str(tmp_path / "*.lm"), doi=True, tof=True, randoms=True, start=100, stop=200)
    assert sorted(r.ts_ms for r in some.collect()) == list(range(100, 200, 10))
    with pytest.raises(Exception, match="detector id"):
        formats.open_table(spark, str(tmp_path / "*.lm"), "LM-DOI", tof=True, randoms=True, detectors=100).count()
    (tmp_path / "bad.lmx").write_bytes(b"123")
    with pytest.raises(Exception, match="no multiple"):
        formats.read_listmode(spark, str(tmp_path / "bad.lmx")).count()
    with pytest.raises(ValueError):
        formats.open_table(spark, "x", "none")
    out = tmp_path / "w.lm"
    plain = formats.record_dtype()
    assert formats.write_records(df.select("ts_ms", "d1", "d2"), str(out), plain, "ts_ms") == 1000
    assert (np.frombuffer(out.read_bytes(), plain)["d2"] == a["d2"]).all()


def test_sparse_histogram_adds_up(spark, tmp_path):
    a = np.array([(1, 2, 0.5), (2, 1, 1.5), (3, 4, 2.0)], [("d1", "<u4"), ("d2", "<u4"), ("value", "<f4")])
    (tmp_path / "h.sh").write_bytes(a.tobytes())
    assert {(r.d1, r.d2, r.value) for r in formats.open_table(spark, str(tmp_path / "h.sh"), "sh").collect()} == {(1, 2, 2.0), (3, 4, 2.0)}


def test_arrays_and_images(spark):
    a = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    data = formats.rawd_bytes(a)
    assert (formats.read_rawd(data, (2, 0, 4)) == a).all()
    for bad in (data[:-1], b"\0" * 20):
        with pytest.raises(ValueError):
            formats.read_rawd(bad)
    with pytest.raises(ValueError):
        formats.read_rawd(data, (9, 3, 4))
    assert formats.array_table(spark, a).count() == 24 and formats.array_table(spark, a, dense=False).count() == 23
    grid = {"vx": 2.0, "vy": 3.0, "vz": 4.0, "off_x": 0.5, "off_y": -1.0, "off_z": 2.0}
    img = np.random.default_rng(0).normal(size=(2, 3, 4, 5)).astype("<f4")
    back, g = formats.read_nifti(formats.nifti_bytes(img, grid))
    assert np.allclose(back, img) and all(abs(g[k] - v) < 1e-5 for k, v in grid.items())


def test_small_text_formats(spark, tmp_path):
    (tmp_path / "m.csv").write_text("5,1,0,0,1,0,1,0,2,0,0,1,3,0.1\nbroken,line\n1,1,0,0,0,0,1,0,0,0,0,1,0,0\n")
    rows = formats.read_motion(spark, str(tmp_path / "m.csv")).orderBy("frame").collect()
    assert [(r.frame, r.t_start, r.tz) for r in rows] == [(0, 1, 0.0), (1, 5, 3.0)]
    assert formats.motion_lines([(1, 0.5)]) == "1,0.500000000\n"
    assert formats.read_frames(spark, "0 10\n30 60").count() == 3
    with pytest.raises(ValueError):
        formats.read_frames(spark, "0 10 10")
    assert formats.read_numbers("1,2\n3\n").tolist() == [[1, 2], [3, 0]]
    k = formats.read_psf("0.2,0.6,0.2\n1\n0.5,0,0.5\n3,1,3")
    assert k[0] == [0.2, 0.6, 0.2] and k[1] == [1.0]
    p = formats.image_params('{"nx": 4, "ny": 2, "nz": 1, "vx": 2, "vy": 2, "length_z": 5, "off_x": 1}')
    assert p["length_x"] == 8 and p["vz"] == 5 and p["off_y"] == 0
    (tmp_path / "l.log").write_text("1 2 3 4 5 6\nBEGIN\n1.5 2 3 0 1 0\nno\n2 2 3 -1 1e-3 0\n")
    assert formats.read_lut_log(spark, str(tmp_path / "l.log"), "BEGIN").count() == 2
    det = formats.read_detectors(spark, np.arange(12, dtype="<f4").tobytes(), 2)
    assert formats.detector_bytes(det) == np.arange(12, dtype="<f4").tobytes()
    assert formats.read_mask(spark, b"\0\1\2").where("enabled").count() == 2
    r = formats.hierarchical_id(spark.createDataFrame([(1, 2, 3)], "layer long, axial long, radial long"), 4, 10).first()
    assert r.det == 63


def test_streaming_histogram_equals_batch(spark, tmp_path):
    from tomoframe.sources import views

    e = views.lm(spark, "/root/testdata/sf0.001", 48)
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = frame_histogram(s, views.frames(spark)).writeStream.outputMode("complete").format("memory").queryName("fh").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("fh").collect()}
    assert got == {tuple(r) for r in frame_histogram(e, views.frames(spark)).collect()}
