"""Files of fixed-length binary records as a Spark data source: read in byte ranges by many tasks, written by many tasks.

A record's layout is a numpy dtype.  A file is cut at record boundaries, so its
size is bounded by nothing and a task reads `split` bytes at most.  Paths are
those that pyarrow's file systems open.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tomoframe.functions.cluster import ship

NAME = "fixed_records"
#: Bytes that a task reads at most, and records of one Arrow batch.
SPLIT, BATCH = 64 << 20, 1 << 18
_GLOB = "*?["


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and the path in it; a path without a scheme is a local one."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def list_files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The files of a path, a folder or a pattern, in order of their names; names that begin with _ or . are left out."""
    fs, inner = open_fs(path)
    if any(c in inner for c in _GLOB):
        parts = inner.split("/")
        head = next(i for i, p in enumerate(parts) if any(c in p for c in _GLOB))
        found = fs.get_file_info(pafs.FileSelector("/".join(parts[:head]) or "/", recursive=True, allow_not_found=True))
        files = [f for f in found if f.type == pafs.FileType.File and len(f.path.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, f.path.split("/"), parts))]
    else:
        info = fs.get_file_info(inner)
        files = [info] if info.type == pafs.FileType.File else []
        if info.type == pafs.FileType.Directory:
            files = [f for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File]
        files = [f for f in files if f.path == inner or f.base_name[0] not in "_."]
    if not files:
        raise FileNotFoundError(path)
    return fs, sorted(files, key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    file: str
    first: int
    count: int

    def __init__(self, file: str, first: int, count: int) -> None:
        super().__init__(None)
        self.file, self.first, self.count = file, first, count


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    records: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.dtype = _dtype(options["layout"])
        number = lambda k: int(options[k]) if options.get(k) else None
        self.start, self.stop, self.detectors = number("start"), number("stop"), number("detectors")
        self.per = max(1, (number("split") or SPLIT) // self.dtype.itemsize)
        self.ordered = options.get("ordered") == "true"

    def partitions(self) -> list[Range]:
        fs, files = list_files(self.path)
        out = []
        for f in files:
            n, rest = divmod(f.size, self.dtype.itemsize)
            if rest:
                raise ValueError(f"{f.path}: {f.size} bytes are no multiple of {self.dtype.itemsize}")
            low, high = (self._place(fs, f.path, n, t) for t in (self.start, self.stop)) if self.ordered and self.start is not None else (0, n)
            out += [Range(f.path, at, min(self.per, high - at)) for at in range(low, high, self.per)]
        return out or [Range(files[0].path, 0, 0)]

    def _place(self, fs: pafs.FileSystem, path: str, n: int, time: int) -> int:
        """First record of a file in order of time that is not before a time."""
        with fs.open_input_file(path) as f:
            low, high = 0, n
            while low < high:
                mid = (low + high) // 2
                early = np.frombuffer(f.read_at(self.dtype.itemsize, mid * self.dtype.itemsize), self.dtype)["ts_ms"][0] < time
                low, high = (mid + 1, high) if early else (low, mid)
        return low

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        names = ["file", "record_id", *self.dtype.names]
        with fs.open_input_file(part.file) as f:
            for at in range(part.first, part.first + part.count, BATCH):
                n = min(BATCH, part.first + part.count - at)
                rec = np.frombuffer(f.read_at(n * self.dtype.itemsize, at * self.dtype.itemsize), self.dtype)
                ids = np.arange(at, at + n)
                if self.start is not None:
                    ok = (rec["ts_ms"] >= self.start) & (rec["ts_ms"] < self.stop)
                    rec, ids = rec[ok], ids[ok]
                if self.detectors is not None and len(rec) and max(rec["d1"].max(), rec["d2"].max()) >= self.detectors:
                    raise ValueError(f"{part.file}: detector id of {self.detectors} or more")
                cols = [pa.array(rec[c].astype(np.float64 if self.dtype[c].kind == "f" else np.int64)) for c in self.dtype.names]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.file, pa.string()), len(rec)), pa.array(ids, pa.int64()), *cols], names)


class RecordWriter(DataSourceArrowWriter):
    """Each task writes one file aside; those of the tasks that count are moved in place once all are done."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.dtype, self.overwrite = options["path"].rstrip("/"), _dtype(options["layout"]), overwrite
        self.aside = f"_{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, inner = open_fs(self.path)
        task = TaskContext.get()
        name = f"{inner}/{self.aside}/{task.partitionId():06d}-{task.taskAttemptId()}"
        fs.create_dir(posixpath.dirname(name), recursive=True)
        n = 0
        with fs.open_output_stream(name) as f:
            for batch in batches:
                out = np.empty(batch.num_rows, self.dtype)
                for c in self.dtype.names:
                    out[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                f.write(out.tobytes())
                n += len(out)
        return Written(task.partitionId(), name, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner = open_fs(self.path)
        fs.create_dir(inner, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(inner)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for m in sorted((m for m in messages if m and m.records), key=lambda m: m.partition):
            fs.move(m.file, f"{inner}/part-{m.partition:06d}-{self.aside[1:9]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, inner = open_fs(self.path)
        if fs.get_file_info(f"{inner}/{self.aside}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inner}/{self.aside}")


class RecordSource(DataSource):
    """Options: path, layout, split; for list-mode also start and stop (with ordered, only that part of a file is read) and detectors."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        dtype = _dtype(self.options["layout"])
        cols = [StructField(n, DoubleType() if dtype[n].kind == "f" else LongType()) for n in dtype.names]
        return StructType([StructField("file", StringType()), StructField("record_id", LongType()), *cols])

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def _layout(dtype: np.dtype) -> str:
    return json.dumps(dtype.descr)


def _dtype(layout: str) -> np.dtype:
    return np.dtype([tuple(x) for x in json.loads(layout)])


def read(spark: SparkSession, path: str, dtype: np.dtype, **options: object) -> DataFrame:
    """(file, record_id, fields): record_id is the place in the file."""
    _register(spark)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format(NAME).options(layout=_layout(dtype), **given).load(path)


def write(rows: DataFrame, path: str, dtype: np.dtype, order: str | None = None, overwrite: bool = False) -> None:
    """Writes rows into a folder, one file a task; with order the files, by name, are the rows in that order."""
    _register(rows.sparkSession)
    kinds = {n: "double" if dtype[n].kind == "f" else "long" for n in dtype.names}
    rows = (rows.orderBy(order) if order else rows).selectExpr(*[f"CAST({n} AS {k}) AS {n}" for n, k in kinds.items()])
    rows.write.format(NAME).mode("overwrite" if overwrite else "append").options(layout=_layout(dtype)).save(path)


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RecordSource)
