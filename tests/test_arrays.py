"""The data source of array files: byte ranges, sinks by many tasks, errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomoframe.sources import arrays, formats


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    a = np.arange(5 * 7 * 11, dtype="<f4").reshape(5, 7, 11) / 4
    (tmp_path / "a.raw").write_bytes(formats.rawd_bytes(a))
    df = arrays.read_array(spark, str(tmp_path / "a.raw"), (5, 0, 11), split=4 * 50)
    assert df.rdd.getNumPartitions() == 8
    got = {(r.i0, r.i1, r.i2): r.value for r in df.collect()}
    assert len(got) == a.size and all(got[k] == v for k, v in np.ndenumerate(a))
    assert formats.open_table(spark, str(tmp_path / "a.raw"), "image").where("t = 0").count() == a.size


def test_a_file_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id % 10 AS z", "id div 10 % 10 AS y", "id div 100 AS x", "id / 8D AS value").where("value <> 3").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    arrays.write_array(rows, str(tmp_path / "sub" / "b.raw"), (10, 10, 12), ("z", "y", "x"), per=64)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    a = formats.read_rawd((tmp_path / "sub" / "b.raw").read_bytes(), (10, 10, 12))
    want = np.zeros((10, 10, 12))
    for i in range(1000):
        if i != 24:
            want[i % 10, i // 10 % 10, i // 100] = i / 8
    assert (a == want.astype("<f4")).all() and [p.name for p in (tmp_path / "sub").iterdir()] == ["b.raw"]


def test_errors_leave_nothing(spark, tmp_path):
    for rows, said in (([(0, 5, 1.0)], "outside"), ([(0, 1, 1.0), (0, 1, 2.0)], "twice"), ([(-1, 1, 1.0)], "outside")):
        with pytest.raises(Exception, match=said):
            arrays.write_array(spark.createDataFrame(rows, "a long, b long, value double"), str(tmp_path / "c.raw"), (2, 3), ("a", "b"))
    assert not list(tmp_path.iterdir())
    arrays.write_array(spark.createDataFrame([], "a long, b long, value double"), str(tmp_path / "e.raw"), (2, 3), ("a", "b"))
    assert (formats.read_rawd((tmp_path / "e.raw").read_bytes()) == 0).all()
    with pytest.raises(ValueError, match="dimensions"):
        arrays.read_array(spark, str(tmp_path / "e.raw"), (2, 4))
    (tmp_path / "bad.raw").write_bytes(b"12345678")
    with pytest.raises(ValueError, match="no array"):
        arrays.read_array(spark, str(tmp_path / "bad.raw"))
    (tmp_path / "e.raw").write_bytes(formats.rawd_bytes(np.zeros((2, 3)))[:-4])
    with pytest.raises(Exception, match="does not fit"):
        arrays.read_array(spark, str(tmp_path / "e.raw")).count()


def test_histograms_images_and_scatter_spaces_go_round(spark, tmp_path):
    hist = spark.createDataFrame([(5, 1.5), (59, 2.0), (0, 0.25)], "bin long, value double")
    formats.write_histogram(hist, str(tmp_path / "h"), (3, 4, 5))
    back = formats.open_table(spark, str(tmp_path / "h"), "H")
    assert back.count() == 60 and sorted(back.where("value <> 0").collect()) == sorted(hist.collect())
    image = spark.range(48).select((F.col("id") / 24).cast("int").alias("t"), (F.col("id") % 24).alias("vox"), (F.col("id") + 0.5).alias("value"))
    formats.write_image_cells(image, str(tmp_path / "i"), (2, 2, 3, 4))
    assert sorted(formats.open_table(spark, str(tmp_path / "i"), "IMAGE").collect()) == sorted(image.collect())
    cells = spark.createDataFrame([(0, 1, 2, 0, 3, 1.25), (1, 0, 0, 1, 1, 7.0)], "tof long, p1 long, a1 long, p2 long, a2 long, value double")
    formats.write_scatter_space(cells, str(tmp_path / "s"), (2, 2, 4, 2, 4))
    assert sorted(formats.open_table(spark, str(tmp_path / "s"), "scatter").where("value <> 0").collect()) == sorted(cells.collect())
