"""Array files (magic, number of dimensions, dimensions, float payload) as a Spark data source.

The header is read once, on the driver; the payload is cut into byte ranges
that tasks read by themselves, and a value's place becomes its indices.  The
sink fills one file: cells are exchanged by the range of the file that they
belong to, and each task writes its own ranges, in place, into a file that has
its full size and its header from the start.  That file stands aside until all
tasks are done, and a task that runs again writes the same bytes again.
"""

from __future__ import annotations

import math
import os
import posixpath
import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tomoframe.functions.cluster import ship
from tomoframe.sources.records import SPLIT, Range, list_files, open_fs

NAME = "nd_array"
#: Fixed value: first number of an array file.
MAGIC = 732174000
#: Values of one batch that is read, and of one range that is written.
BATCH, WRITTEN = 1 << 18, 1 << 22


def header(shape: Sequence[int]) -> bytes:
    return struct.pack("<ii", MAGIC, len(shape)) + struct.pack(f"<{len(shape)}q", *shape)


def read_shape(fs: pafs.FileSystem, path: str, dims: Sequence[int] | None = None) -> tuple[int, ...]:
    """The dimensions in a file's header; dims are checked, 0 matches any."""
    with fs.open_input_file(path) as f:
        head = f.read(8)
        if len(head) < 8 or struct.unpack("<i", head[:4])[0] != MAGIC:
            raise ValueError(f"{path}: no array file")
        nd = struct.unpack("<i", head[4:])[0]
        rest = f.read(8 * nd)
        if not 0 < nd < 64 or len(rest) < 8 * nd:
            raise ValueError(f"{path}: {nd} dimensions")
        shape = struct.unpack(f"<{nd}q", rest)
    if dims is not None and (len(dims) != nd or any(d not in (0, s) for d, s in zip(dims, shape, strict=True))):
        raise ValueError(f"{path}: dimensions {shape}, not {tuple(dims)}")
    return shape


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.dtype = options["path"], np.dtype(options.get("dtype", "<f4"))
        self.shape = _numbers(options["shape"])
        self.per = max(1, int(options.get("split") or SPLIT) // self.dtype.itemsize)

    def partitions(self) -> list[Range]:
        fs, files = list_files(self.path)
        n = math.prod(self.shape)
        for f in files:
            if read_shape(fs, f.path) != self.shape:
                raise ValueError(f"{f.path}: other dimensions than the first file's {self.shape}")
            if f.size != len(header(self.shape)) + n * self.dtype.itemsize:
                raise ValueError(f"{f.path}: the payload's size does not fit the dimensions")
        return [Range(f.path, at, min(self.per, n - at)) for f in files for at in range(0, n, self.per)] or [Range(files[0].path, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        names = ["file", *(f"i{k}" for k in range(len(self.shape))), "value"]
        with fs.open_input_file(part.file) as f:
            for at in range(part.first, part.first + part.count, BATCH):
                n = min(BATCH, part.first + part.count - at)
                data = np.frombuffer(f.read_at(n * self.dtype.itemsize, len(header(self.shape)) + at * self.dtype.itemsize), self.dtype)
                places = np.unravel_index(np.arange(at, at + n), self.shape)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.file, pa.string()), n), *(pa.array(p.astype(np.int64)) for p in places), pa.array(data.astype(np.float64))], names)


class ArrayWriter(DataSourceArrowWriter):
    """Rows (range, place, value) in that order within a task, into the file at `path`, which has its full size already."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.shape, self.per = options["path"], _numbers(options["shape"]), int(options["per"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        total = math.prod(self.shape)
        now, held = None, []

        def put() -> None:
            """Writes the range `now`: zeros but for the cells held."""
            first = now * self.per
            out = np.zeros(min(self.per, total - first), "<f4")
            places = np.concatenate([p for p, _ in held]) - first
            if len(np.unique(places)) < len(places):
                raise ValueError("a cell is given twice")
            out[places] = np.concatenate([v for _, v in held])
            f.seek(len(header(self.shape)) + 4 * first)
            f.write(out.tobytes())

        with open(self.path, "r+b") as f:
            for batch in batches:
                ranges, places, values = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                edges = np.flatnonzero(np.diff(ranges)) + 1
                for a, b in zip(np.append(0, edges), np.append(edges, len(ranges)), strict=True):
                    if a == b:
                        continue
                    if now is not None and ranges[a] != now:
                        put()
                        held = []
                    now = int(ranges[a])
                    held.append((places[a:b].copy(), values[a:b].copy()))
            if held:
                put()
        return WriterCommitMessage()


class ArraySource(DataSource):
    """Options: path, shape (numbers between commas), split, dtype."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        places = [StructField(f"i{k}", LongType()) for k in range(len(_numbers(self.options["shape"])))]
        return StructType([StructField("file", StringType()), *places, StructField("value", DoubleType())])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(dict(self.options))


def _numbers(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(","))


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArraySource)


def read_array(spark: SparkSession, path: str, dims: Sequence[int] | None = None, dtype: str = "<f4", split: int = SPLIT) -> DataFrame:
    """(file, i0, .., value): all cells of one array file, or of several of the same dimensions; dims are checked, 0 matches any."""
    _register(spark)
    fs, files = list_files(path)
    shape = read_shape(fs, files[0].path, dims)
    return spark.read.format(NAME).options(shape=",".join(map(str, shape)), dtype=dtype, split=str(split)).load(path)


def flat(columns: Sequence[str], shape: Sequence[int]):  # noqa: ANN201
    """Place of a cell in the payload, null where an index is outside."""
    place, inside = F.lit(0).cast("long"), F.lit(True)
    for c, n in zip(columns, shape, strict=True):
        place, inside = place * n + F.col(c).cast("long"), inside & (F.col(c) >= 0) & (F.col(c) < n)
    return F.when(inside, place)


def write_array(cells: DataFrame, path: str, shape: Sequence[int], columns: Sequence[str], value: str = "value", per: int = WRITTEN) -> None:
    """One array file of cells (columns, value), by many tasks in ranges of `per` cells; cells that are not given are 0.

    path is on a file system that driver and workers mount.  A cell outside
    the shape or given twice is an error, and a write that fails leaves
    nothing.
    """
    _register(cells.sparkSession)
    _, inner = open_fs(path)
    if not isinstance(open_fs(path)[0], pafs.LocalFileSystem):
        raise ValueError(f"{path}: tasks write into one file, so it has to be on a mounted file system")
    os.makedirs(posixpath.dirname(inner) or ".", exist_ok=True)
    aside = f"{inner}.{uuid.uuid4().hex[:8]}.tmp"
    with open(aside, "wb") as f:
        f.write(header(shape))
        f.truncate(len(header(shape)) + 4 * math.prod(shape))
    place = F.coalesce(flat(columns, shape), F.raise_error(F.lit(f"a cell outside the dimensions {tuple(shape)}")).cast("long"))
    rows = cells.select(place.alias("place"), F.col(value).cast("double").alias("value"))
    rows = rows.select(F.floor(F.col("place") / per).alias("range"), "place", "value").repartition("range").sortWithinPartitions("range", "place")
    try:
        rows.write.format(NAME).mode("append").options(shape=",".join(map(str, shape)), per=str(per)).save(aside)
        os.replace(aside, inner)
    except BaseException:
        os.unlink(aside)
        raise
