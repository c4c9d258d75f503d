import json

"""Round trips of the writers added beside the readers."""

import numpy as np
import pytest

from tomoframe.functions import geometry as geo
from tomoframe.sources import formats, views


def test_dense_histogram_file(spark, tmp_path):
    dims = (4, 3, 5)
    rows = [(k, float(k % 4)) for k in range(0, 60, 2)]
    path = tmp_path / "a.his"
    path.write_bytes(formats.histogram_bytes(spark.createDataFrame(rows, "bin long, value double"), dims))
    got = {r.bin: r.value for r in formats.open_table(spark, str(path), "h", dims=dims).collect()}
    assert got == dict.fromkeys(range(60), 0.0) | dict(rows)


def test_detector_tables(spark):
    det = geo.det_lut(spark)
    a = formats.detector_array(det)
    assert a.shape == (1152, 6) and np.allclose(a[7], [[r.x, r.y, r.z, r.nx, r.ny, r.nz] for r in det.where("det_id = 7").collect()][0], atol=1e-4)
    mask = spark.range(50).selectExpr("id AS det_id", "id % 3 <> 0 AS enabled").repartition(4)
    assert sorted(map(tuple, formats.read_mask(spark, formats.mask_bytes(mask)).collect())) == sorted(map(tuple, mask.collect()))


def test_texts(spark):
    frames = views.frames(spark)
    back = formats.read_frames(spark, formats.frames_text(frames))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frames.collect()))
    with pytest.raises(ValueError):
        formats.frames_text(frames.where("frame <> 2"))
    kernels = ([0.25, 0.5, 0.25], [1.0], [0.1, 0.2, 0.4, 0.2, 0.1])
    assert formats.read_psf(formats.psf_text(kernels)) == kernels
    grid = formats.image_params('{"nx": 4, "ny": 5, "nz": 6, "vx": 1.5, "vy": 2, "length_z": 12, "off_x": 3}')
    assert formats.image_params(formats.image_params_json(grid)) == grid


def test_basis_and_bound_rows(spark):
    basis = views.hbasis(spark, "/root/testdata/sf0.001")
    a = formats.read_rawd(formats.basis_bytes(basis))
    assert a.shape == (3, 6) and all(abs(a[r["rank"], r["frame"]] - r["h"]) < 1e-6 for r in basis.collect())
    assert json.loads(formats.basis_json("h.raw", [(0, 5), (5, 9)])) == {"file": "h.raw", "frames": 2, "start_ms": [0, 5], "stop_ms": [5, 9]}
    rows = {"ts_ms": np.array([5, 6]), "d1": np.array([1, 2]), "d2": np.array([3, 9]), "tof_ps": np.array([0.5, -1.0])}
    got = formats.bind_listmode(spark, rows, 10).orderBy("record_id").collect()
    assert [(r.record_id, r.ts_ms, r.d2, r.tof_ps) for r in got] == [(0, 5, 3, 0.5), (1, 6, 9, -1.0)]
    with pytest.raises(ValueError):
        formats.bind_listmode(spark, rows, 9)
    with pytest.raises(ValueError):
        formats.bind_listmode(spark, {"d1": rows["d1"]})
