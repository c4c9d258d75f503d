"""Readers and writers of the reference's file formats, behind one registry.

Fixed-length records are read and written by the data source in `records`;
whole-file headers are parsed once on the driver.  Writers go through a single
file only where the format is one stream.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.operators.aggregate import sparse_histogram
from tomoframe.sources import arrays, records

#: First number of an array file; record of a sparse histogram (fixed values).
RAWD_MAGIC = arrays.MAGIC
PAIR_VALUE = np.dtype([("d1", "<u4"), ("d2", "<u4"), ("value", "<f4")])


def record_dtype(doi: bool = False, tof: bool = False, randoms: bool = False) -> np.dtype:
    """Little-endian list-mode record: time, detectors (each with its depth code), time of flight, randoms."""
    fields = [("ts_ms", "<u4"), ("d1", "<u4")] + [("doi1", "u1")] * doi + [("d2", "<u4")] + [("doi2", "u1")] * doi
    return np.dtype(fields + [("tof_ps", "<f4")] * tof + [("randoms", "<f4")] * randoms)


def read_listmode(
    spark: SparkSession, path: str, doi: bool = False, tof: bool = False, randoms: bool = False, detectors: int | None = None, start: int | None = None, stop: int | None = None, ordered: bool = False, split: int = records.SPLIT
) -> DataFrame:
    """List-mode records; with start and stop only start <= ts_ms < stop, whose ids alone are checked.

    Files that are each in order of time (ordered) are read from the first to
    the last record of that time only.
    """
    return records.read(spark, path, record_dtype(doi, tof, randoms), detectors=detectors, start=start, stop=stop, ordered=ordered, split=split)


def write_listmode(rows: DataFrame, path: str, doi: bool = False, tof: bool = False, randoms: bool = False, overwrite: bool = False) -> None:
    """List-mode files of a folder, written by many tasks; by name they are in order of time."""
    records.write(rows, path, record_dtype(doi, tof, randoms), "ts_ms", overwrite)


def read_sparse_histogram(spark: SparkSession, path: str, detectors: int | None = None) -> DataFrame:
    """(d1, d2, value) by canonical pair; repeated records add up."""
    raw = records.read(spark, path, PAIR_VALUE, detectors=detectors)
    return sparse_histogram(raw, F.col("value"), keep_zeros=True)


def write_sparse_histogram(hist: DataFrame, path: str, overwrite: bool = False) -> None:
    """Sparse histogram files of a folder, of (d1, d2, value), written by many tasks."""
    records.write(hist, path, PAIR_VALUE, overwrite=overwrite)


def read_histogram_records(spark: SparkSession, path: str) -> DataFrame:
    """Listed pairs of a sparse histogram file, record by record, not added up: (record_id, d1, d2, value)."""
    return records.read(spark, path, PAIR_VALUE).drop("file")


def write_records(rows: DataFrame, path: str, dtype: np.dtype, order: str) -> int:
    """Writes rows in order as one local file, partition by partition through the driver; returns their number.

    write_listmode and write_sparse_histogram write a folder by many tasks.
    """
    n = 0
    with open(path, "wb") as f:
        for r in rows.orderBy(order).select(*dtype.names).toLocalIterator(prefetchPartitions=True):
            f.write(np.array([tuple(r)], dtype).tobytes())
            n += 1
    return n


def read_rawd(data: bytes, dims: tuple[int, ...] | None = None, dtype: str = "<f4") -> np.ndarray:
    """Array file: magic, number of dimensions, dimensions, payload; dims are checked, 0 matches any."""
    magic, nd = struct.unpack_from("<ii", data)
    if magic != RAWD_MAGIC:
        raise ValueError("no array file")
    shape = struct.unpack_from(f"<{nd}q", data, 8)
    if dims is not None and (len(dims) != nd or any(d not in (0, s) for d, s in zip(dims, shape, strict=True))):
        raise ValueError(f"dimensions {shape}, not {dims}")
    body = data[8 + 8 * nd :]
    if len(body) != int(np.prod(shape)) * np.dtype(dtype).itemsize:
        raise ValueError("the payload's size does not fit the dimensions")
    return np.frombuffer(body, dtype).reshape(shape)


def rawd_bytes(a: np.ndarray) -> bytes:
    return struct.pack("<ii", RAWD_MAGIC, a.ndim) + struct.pack(f"<{a.ndim}q", *a.shape) + np.ascontiguousarray(a, "<f4").tobytes()


def array_table(spark: SparkSession, a: np.ndarray, dense: bool = True) -> DataFrame:
    """(i0, .., value) of all cells of an array in memory, or without dense of those that are not zero."""
    at = np.indices(a.shape).reshape(a.ndim, -1) if dense else np.nonzero(a)
    cols = {f"i{k}": pa.array(x.astype(np.int64)) for k, x in enumerate(at)} | {"value": pa.array(a[tuple(at)].astype(np.float64))}
    return spark.createDataFrame(pa.table(cols))


def read_detectors(spark: SparkSession, data: bytes, expected: int | None = None) -> DataFrame:
    """(det_id, x, y, z, nx, ny, nz) from six little-endian floats a detector."""
    a = np.frombuffer(data, "<f4").reshape(-1, 6).astype(np.float64)
    if expected is not None and len(a) != expected:
        raise ValueError(f"{len(a)} detectors, not {expected}")
    return spark.createDataFrame(pa.table({"det_id": pa.array(np.arange(len(a)))} | {n: pa.array(a[:, i]) for i, n in enumerate(("x", "y", "z", "nx", "ny", "nz"))}))


def detector_bytes(det: DataFrame) -> bytes:
    return np.array([tuple(r) for r in det.orderBy("det_id").select("x", "y", "z", "nx", "ny", "nz").collect()], "<f4").tobytes()  # a scanner's detectors


def read_mask(spark: SparkSession, data: bytes) -> DataFrame:
    a = np.frombuffer(data, "u1") != 0
    return spark.createDataFrame(pa.table({"det_id": pa.array(np.arange(len(a))), "enabled": pa.array(a)}))


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """Motion rows: time, 3 x 4 transform, error; malformed lines are skipped, frame is the place in time."""
    from pyspark.sql import Window

    names = "t_start r00 r01 r02 tx r10 r11 r12 ty r20 r21 r22 tz err".split()
    rows = spark.read.csv(path, schema=", ".join(f"{n} {'long' if n == 't_start' else 'double'}" for n in names), mode="DROPMALFORMED").na.drop()
    return rows.select((F.row_number().over(Window.orderBy("t_start")) - 1).alias("frame"), *names)  # a short table


def motion_lines(rows: list[tuple]) -> str:
    return "".join(f"{int(r[0])}," + ",".join(f"{x:.9f}" for x in r[1:]) + "\n" for r in rows)


def read_frames(spark: SparkSession, text: str) -> DataFrame:
    """Frames from boundaries in ms between white space; they must rise strictly."""
    bounds = [int(x) for x in text.split()]
    if any(b <= a for a, b in zip(bounds, bounds[1:], strict=False)):
        raise ValueError("frame boundaries do not rise")
    return spark.createDataFrame([(i, bounds[i], bounds[i + 1]) for i in range(len(bounds) - 1)], "frame int, t_start long, t_stop long")


def read_numbers(text: str, sep: str = ",") -> np.ndarray:
    """Ragged numeric lines, filled with zeros to the widest."""
    rows = [[float(x) for x in line.split(sep) if x.strip()] for line in text.splitlines() if line.strip()]
    width = max(map(len, rows), default=0)
    return np.array([r + [0.0] * (width - len(r)) for r in rows]).reshape(len(rows), width)


def read_psf(text: str) -> tuple[list[float], list[float], list[float]]:
    """Three kernels and, in the fourth line, their odd sizes."""
    a = read_numbers(text)
    sizes = [int(x) for x in a[3][:3]]
    if any(n % 2 == 0 for n in sizes):
        raise ValueError("kernel sizes must be odd")
    return tuple(list(a[i][:n]) for i, n in enumerate(sizes))


def image_params(text: str) -> dict[str, float]:
    """Grid from JSON: sizes, voxel sizes or lengths (one gives the other), offsets 0 where absent."""
    raw = json.loads(text)
    out = {k: int(raw[k]) for k in ("nx", "ny", "nz")} | {"nt": int(raw.get("nt", 1))}
    for a in "xyz":
        out[f"v{a}"] = float(raw[f"v{a}"]) if f"v{a}" in raw else float(raw[f"length_{a}"]) / out[f"n{a}"]
        out[f"length_{a}"] = out[f"v{a}"] * out[f"n{a}"]
        out[f"off_{a}"] = float(raw.get(f"off_{a}", 0.0))
    return out


#: NIfTI data types by code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def read_nifti(data: bytes) -> tuple[np.ndarray, dict[str, float]]:
    """(array t, z, y, x, grid) of a single-file NIfTI-1 image, with slope and intercept applied; rotations are rejected."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        data = gzip.decompress(data)
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    dim = struct.unpack_from(f"{order}8h", data, 40)
    kind = struct.unpack_from(f"{order}h", data, 70)[0]
    if kind not in NIFTI_TYPES:
        raise ValueError(f"data type {kind}")
    pix = struct.unpack_from(f"{order}8f", data, 76)
    at, slope, inter = struct.unpack_from(f"{order}3f", data, 108)
    rows = [struct.unpack_from(f"{order}4f", data, 280 + 16 * k) for k in range(3)]
    coded = struct.unpack_from(f"{order}h", data, 254)[0]
    if coded and any(abs(rows[i][j]) > 1e-6 for i in range(3) for j in range(3) if i != j):
        raise ValueError("the image is rotated")
    n = [max(1, d) for d in dim[1:5]]
    a = np.frombuffer(data, order + NIFTI_TYPES[kind], int(np.prod(n)), int(at)).reshape(n[::-1]).astype(np.float64)
    a = a * (slope or 1.0) + (inter if slope else 0.0)
    grid = dict(zip(("nx", "ny", "nz", "nt"), n, strict=True)) | {f"v{c}": pix[i + 1] for i, c in enumerate("xyz")}
    for i, c in enumerate("xyz"):
        origin = rows[i][3] * (-1 if c in "xy" else 1) if coded else -(n[i] - 1) / 2 * pix[i + 1]
        grid[f"off_{c}"] = origin + (n[i] - 1) / 2 * pix[i + 1]
    return a, grid


def nifti_bytes(a: np.ndarray, grid: dict[str, float]) -> bytes:
    """Single-file NIfTI-1 image of float32 with -x, -y in its transform."""
    t, z, y, x = a.shape
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 4, x, y, z, t, 1, 1, 1)
    struct.pack_into("<2h", h, 70, 16, 32)
    struct.pack_into("<8f", h, 76, 1, grid["vx"], grid["vy"], grid["vz"], 1, 0, 0, 0)
    struct.pack_into("<3f", h, 108, 352, 1, 0)
    struct.pack_into("<2h", h, 252, 0, 1)
    for i, (c, n) in enumerate(zip("xyz", (x, y, z), strict=True)):
        row = [0.0] * 4
        row[i] = -grid[f"v{c}"] if c in "xy" else grid[f"v{c}"]
        row[3] = (grid[f"off_{c}"] - (n - 1) / 2 * grid[f"v{c}"]) * (-1 if c in "xy" else 1)
        struct.pack_into("<4f", h, 280 + 16 * i, *row)
    h[344:348] = b"n+1\0"
    return bytes(h) + np.ascontiguousarray(a, "<f4").tobytes()


def read_lut_log(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """Detector rows from a text log: lines after the marker that hold at least six numbers."""
    number = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("ls"))
    lines = lines.select(F.posexplode("ls").alias("n", "line"), F.array_position(F.transform("ls", lambda x: x.contains(marker)), True).alias("from"))
    found = lines.where("n >= from AND from > 0").select("n", F.regexp_extract_all("line", F.lit(f"({number})"), F.lit(1)).alias("v")).where("size(v) >= 6")
    return found.select("n", *[F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))])


def hierarchical_id(rows: DataFrame, per_axial: int, per_radial: int, layer: str = "layer", axial: str = "axial", radial: str = "radial") -> DataFrame:
    """Adds det: layer * axial cells * radial cells + axial * radial cells + radial."""
    return rows.withColumn("det", F.col(layer) * (per_axial * per_radial) + F.col(axial) * per_radial + F.col(radial))


def bind_listmode(spark: SparkSession, arrays: dict[str, np.ndarray], detectors: int | None = None) -> DataFrame:
    """List-mode rows from columns in memory (ts_ms, d1, d2, and any of doi1, doi2, tof_ps, randoms), with record_id."""
    sizes = {len(v) for v in arrays.values()}
    if len(sizes) != 1 or not {"ts_ms", "d1", "d2"} <= set(arrays):
        raise ValueError("ts_ms, d1 and d2 are needed, all of one length")
    if detectors is not None and sizes != {0} and max(arrays["d1"].max(), arrays["d2"].max()) >= detectors:
        raise ValueError(f"detector id of {detectors} or more")
    cols = {"record_id": pa.array(np.arange(sizes.pop()))}
    cols |= {k: pa.array(np.asarray(v).astype(np.float64 if k in ("tof_ps", "randoms") else np.int64)) for k, v in arrays.items()}
    return spark.createDataFrame(pa.table(cols))


def read_histogram(spark: SparkSession, path: str, dims: tuple[int, int, int] | None = None, split: int = records.SPLIT) -> DataFrame:
    """(bin, value) of all bins of a dense histogram file: an array (z_bin, phi, r), read in byte ranges by many tasks."""
    fs, files = records.list_files(path)
    shape = arrays.read_shape(fs, files[0].path, dims or (0, 0, 0))
    e = arrays.read_array(spark, path, shape, split=split)
    return e.select(arrays.flat(("i0", "i1", "i2"), shape).alias("bin"), "value")


def write_histogram(hist: DataFrame, path: str, dims: tuple[int, int, int]) -> None:
    """Dense histogram file of (bin, value), written by many tasks; absent bins are 0."""
    plane = dims[1] * dims[2]
    cells = hist.select(F.floor(F.col("bin") / plane).alias("i0"), F.floor(F.col("bin") % plane / dims[2]).alias("i1"), (F.col("bin") % dims[2]).alias("i2"), "value")
    arrays.write_array(cells, path, dims, ("i0", "i1", "i2"))


#: Dimensions of a scatter space file, slowest first.
CELL = ("tof", "p1", "a1", "p2", "a2")


def read_scatter_space(spark: SparkSession, path: str, split: int = records.SPLIT) -> DataFrame:
    """(tof, p1, a1, p2, a2, value) of all cells of a scatter space."""
    e = arrays.read_array(spark, path, (0,) * len(CELL), split=split)
    return e.select(*[F.col(f"i{k}").alias(c) for k, c in enumerate(CELL)], "value")


def write_scatter_space(cells: DataFrame, path: str, shape: tuple[int, int, int, int, int]) -> None:
    arrays.write_array(cells, path, shape, CELL)


def read_image_cells(spark: SparkSession, path: str, split: int = records.SPLIT) -> DataFrame:
    """(t, vox, value) of an image in an array file (z, y, x) or (t, z, y, x)."""
    fs, files = records.list_files(path)
    shape = arrays.read_shape(fs, files[0].path)
    if len(shape) not in (3, 4):
        raise ValueError(f"an image has 3 or 4 dimensions, not {len(shape)}")
    e = arrays.read_array(spark, path, shape, split=split)
    own = [f"i{k}" for k in range(len(shape))]
    return e.select((F.col("i0").cast("int") if len(shape) == 4 else F.lit(0)).alias("t"), arrays.flat(own[-3:], shape[-3:]).alias("vox"), "value")


def write_image_cells(image: DataFrame, path: str, shape: tuple[int, int, int, int]) -> None:
    """Array file (t, z, y, x) of (t, vox, value)."""
    _, _, ny, nx = shape
    v = F.col("vox")
    cells = image.select("t", F.floor(v / (nx * ny)).alias("z"), (F.floor(v / nx) % ny).alias("y"), (v % nx).alias("x"), "value")
    arrays.write_array(cells, path, shape, ("t", "z", "y", "x"))


def histogram_bytes(hist: DataFrame, dims: tuple[int, int, int]) -> bytes:
    """Dense histogram file of (bin, value); a scanner's bins fit the driver, absent ones are 0."""
    got = hist.select("bin", F.col("value").cast("double").alias("value")).toArrow()
    a = np.zeros(int(np.prod(dims)), "<f4")
    a[got.column("bin").to_numpy()] = got.column("value").to_numpy()
    return rawd_bytes(a.reshape(dims))


def detector_array(det: DataFrame) -> np.ndarray:
    """Detectors as an array with the columns x, y, z, nx, ny, nz."""
    return np.frombuffer(detector_bytes(det), "<f4").reshape(-1, 6)


def mask_bytes(mask: DataFrame) -> bytes:
    """One byte a detector in order of det_id, 1 where it is enabled."""
    return bytes(int(r["enabled"]) for r in mask.orderBy("det_id").select("enabled").collect())  # a scanner's detectors


def frames_text(frames: DataFrame) -> str:
    """Boundaries of frames that follow each other, one a line."""
    rows = [tuple(r) for r in frames.orderBy("t_start").select("t_start", "t_stop").collect()]  # a short table
    if any(a[1] != b[0] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError("frames do not follow each other")
    return "".join(f"{x}\n" for x in [r[0] for r in rows] + [rows[-1][1]] * bool(rows))


def psf_text(kernels: tuple[list[float], list[float], list[float]]) -> str:
    return "".join(",".join(map(repr, k)) + "\n" for k in kernels) + ",".join(str(len(k)) for k in kernels) + "\n"


def image_params_json(params: dict[str, float]) -> str:
    return json.dumps(params, indent=1)


def basis_json(file: str, frames: list[tuple[int, int]]) -> str:
    """What stands beside a basis file: its name, the number of frames and their bounds in ms."""
    return json.dumps({"file": file, "frames": len(frames), "start_ms": [a for a, _ in frames], "stop_ms": [b for _, b in frames]}, indent=1)


def basis_bytes(basis: DataFrame) -> bytes:
    """Array file (rank, frame) of (rank, frame, h)."""
    rows = basis.select("rank", "frame", "h").collect()  # ranks times frames
    a = np.zeros((1 + max(r["rank"] for r in rows), 1 + max(r["frame"] for r in rows)))
    for r in rows:
        a[r["rank"], r["frame"]] = r["h"]
    return rawd_bytes(a)


#: Readers by format name, whatever its case; add to it to plug in a format.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"LM": read_listmode, "LM-DOI": lambda spark, path, **k: read_listmode(spark, path, doi=True, **k), "SH": read_sparse_histogram, "H": read_histogram, "SCATTER": read_scatter_space, "IMAGE": read_image_cells}


def open_table(spark: SparkSession, path: str, kind: str, **options: object) -> DataFrame:
    by_name = {re.sub(r"\s", "", k).upper(): v for k, v in REGISTRY.items()}
    if kind.upper() not in by_name:
        raise ValueError(f"unknown format {kind}")
    return by_name[kind.upper()](spark, path, **options)
