"""Event files of other programs: simulated coincidences in binary and text records, and list-mode files with a text header."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.sources import records

#: Fields of each of the two photons of a simulated coincidence, in their order.
LEVELS = ("Camera", "Ring", "Bloc", "Mod", "Det", "subDet")
KINDS = {"times": (False, False), "sources": (True, False), "interactions": (True, True)}
#: By the number of columns of a text file, where time, detector and source are, for both photons.
TEXT_COLUMNS = {
    14: {"time": (0, 7), "levels": ((2, 3), (9, 10)), "names": ("Ring", "Bloc"), "source": None},
    20: {"time": (3, 13), "levels": ((5, 6), (15, 16)), "names": ("Ring", "Bloc"), "source": (0, 1, 2)},
    46: {"time": (6, 29), "levels": (tuple(range(11, 17)), tuple(range(34, 40))), "names": LEVELS, "source": (3, 4, 5)},
}


def simulation_dtype(kind: str) -> np.dtype:
    """Little-endian record of a coincidence: source place, time, interaction place and detector of either photon."""
    source, interaction = KINDS[kind]
    fields = []
    for k in "01":
        fields += [(f"{c}{k}", "<f8") for c in "XYZ"] * source + [(f"t{k}", "<f8")] + [(f"P{k}_{c}", "<f8") for c in "XYZ"] * interaction
        fields += [(f"{n}{k}", "<i4") for n in LEVELS]
    return np.dtype(fields)


def read_simulation(spark: SparkSession, path: str, kind: str = "times", split: int = records.SPLIT) -> DataFrame:
    """(file, record_id, fields) of binary coincidences, in byte ranges by many tasks."""
    return records.read(spark, path, simulation_dtype(kind), split=split)


def write_simulation(rows: DataFrame, path: str, kind: str = "times", overwrite: bool = False) -> None:
    records.write(rows, path, simulation_dtype(kind), "t0", overwrite)


def read_simulation_text(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(t0, t1, detector levels of either photon, and X0, Y0, Z0 where the file has them) from lines of so many numbers.

    A file of 14 or 20 columns gives Ring and Bloc alone.  A line of another
    number of columns is an error.
    """
    if columns not in TEXT_COLUMNS:
        raise ValueError(f"{columns} columns: known are {sorted(TEXT_COLUMNS)}")
    at = TEXT_COLUMNS[columns]
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    good = F.when(F.size(parts) == columns, parts).otherwise(F.raise_error(F.concat(F.lit(f"not {columns} numbers: "), F.col("value"))).cast("array<string>"))
    e = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(good.alias("v"))
    get = lambda i: F.get("v", F.lit(i)).cast("double")
    out = [get(i).alias(f"t{k}") for k, i in enumerate(at["time"])]
    out += [get(i).cast("long").alias(f"{n}{k}") for k in (0, 1) for n, i in zip(at["names"], at["levels"][k], strict=True)]
    out += [get(i).alias(f"{c}0") for c, i in zip("XYZ", at["source"] or (), strict=False)]
    return e.select(out)


def simulation_text(rows: DataFrame, columns: int) -> DataFrame:
    """One column of text lines of so many numbers, from rows as read_simulation_text gives them; other places are 0."""
    at = TEXT_COLUMNS[columns]
    cells: list[Column] = [F.lit("0")] * columns
    for k in (0, 1):
        cells[at["time"][k]] = F.col(f"t{k}").cast("string")
        for n, i in zip(at["names"], at["levels"][k], strict=True):
            cells[i] = F.col(f"{n}{k}").cast("string")
    for c, i in zip("XYZ", at["source"] or (), strict=False):
        cells[i] = F.col(f"{c}0").cast("string")
    return rows.select(F.concat_ws(" ", *cells).alias("value"))


def true_coincidences(rows: DataFrame) -> DataFrame:
    """(time, X, Y, Z) of coincidences whose photons have one source; time is the mean of both arrivals."""
    same = (F.col("X0") == F.col("X1")) & (F.col("Y0") == F.col("Y1")) & (F.col("Z0") == F.col("Z1"))
    return rows.where(same).select(((F.col("t0") + F.col("t1")) / 2).alias("time"), *[F.col(f"{c}0").alias(c) for c in "XYZ"])


def source_image(rows: DataFrame, count: tuple[int, int, int], size: tuple[float, float, float], bounds: list[float] | None = None) -> DataFrame:
    """(t, vox, value): true coincidences counted by voxel of a centred image, x fastest; with bounds of time one image a stretch.

    A place on the upper border counts for the last voxel, one outside for none.
    """
    e = true_coincidences(rows)
    place, ok = F.lit(0).cast("long"), F.lit(True)
    for c, n, length in reversed(list(zip("XYZ", count, size, strict=True))):
        u = (F.col(c) + F.lit(length / 2)) / F.lit(length / n)
        ok = ok & (F.col(c) >= -length / 2) & (F.col(c) <= length / 2)
        place = place * n + F.least(F.floor(u), F.lit(n - 1))
    t = F.lit(0)
    if bounds is not None:
        t = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col("time"))) - 1
        ok = ok & (F.col("time") >= bounds[0]) & (F.col("time") < bounds[-1])
    return e.where(ok).groupBy(t.cast("int").alias("t"), place.alias("vox")).agg(F.count("*").cast("double").alias("value"))


def parse_header(text: str) -> dict[str, str]:
    """Values by name of lines `name: value`."""
    pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line)
    return {k.strip(): v.strip() for k, v in pairs}


def listmode_dtype(tof: bool, attenuation: bool) -> np.dtype:
    """Record of a list-mode file with a header: time, attenuation factor and time of flight where it has them, crystals."""
    return np.dtype([("ts_ms", "<u4")] + [("atten", "<f4")] * attenuation + [("tof_ps", "<f4")] * tof + [("d1", "<u4"), ("d2", "<u4")])


def read_headed_listmode(spark: SparkSession, path: str, split: int = records.SPLIT) -> DataFrame:
    """(record_id, ts_ms, d1, d2, and tof_ps and atten where the file has them) of the data file that the header at path names.

    The data file stands beside the header.  Another data mode, or another
    number of events than the header's, is an error.
    """
    fs, inner = records.open_fs(path)
    with fs.open_input_file(inner) as f:
        head = parse_header(f.read().decode())
    if head.get("Data mode") != "list-mode":
        raise ValueError(f"data mode {head.get('Data mode')}, not list-mode")
    flag = lambda name: bool(int(head.get(name, "0")))
    dtype = listmode_dtype(flag("TOF information flag"), flag("Attenuation correction flag"))
    data = path.rsplit("/", 1)[0] + "/" + head["Data filename"] if "/" in path else head["Data filename"]
    size = sum(f.size for f in records.list_files(data)[1])
    if size != int(head["Number of events"]) * dtype.itemsize:
        raise ValueError(f"{size} bytes are not {head['Number of events']} events of {dtype.itemsize}")
    return records.read(spark, data, dtype, split=split).drop("file")


def write_headed_listmode(rows: DataFrame, path: str, tof: bool = False, attenuation: bool = False) -> None:
    """A header at path and beside it a folder of data files, written by many tasks in order of time."""
    dtype = listmode_dtype(tof, attenuation)
    data = path.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".data"
    records.write(rows, path.rsplit("/", 1)[0] + "/" + data, dtype, "ts_ms")
    size = sum(f.size for f in records.list_files(path.rsplit("/", 1)[0] + "/" + data)[1])
    fs, inner = records.open_fs(path)
    with fs.open_output_stream(inner) as f:
        f.write(f"Data filename: {data}\nNumber of events: {size // dtype.itemsize}\nData mode: list-mode\nTOF information flag: {int(tof)}\nAttenuation correction flag: {int(attenuation)}\n".encode())
