"""Arrow-batch helpers: texts in bounded slices, and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoframe.functions.cluster import ship

#: Bytes of text that a slice holds at most (one longer text makes a slice of its own).
SLICE_BYTES = 4 << 20

SPACES = (32, 9, 10, 11, 12, 13)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in the given column hold about `limit` bytes at most."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string, null as empty): all that a text operator reads."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Applies make()(texts) to slices of texts; it returns the columns of schema after doc_id, one value a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, 1):
                cols = work(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[x if isinstance(x, pa.Array) else pa.array(x) for x in cols.values()]], ["doc_id", *cols])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {schema}")


_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def _splitmix(seed: int, n: int) -> np.ndarray:
    out = []
    for k in range(n):
        z = (seed + (k + 1) * _STEP) & _MASK
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    The sum of table[byte] * P^position over a word, shifted to position 0:
    a polynomial hash over random byte values, from one prefix sum.
    """

    def __init__(self, seed: int = 1) -> None:
        self.table = _splitmix(seed, 256) | np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.power = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 16, 2 * len(self.power))
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(n, _STEP, np.uint64))
                self.inverse = np.cumprod(np.full(n, pow(_STEP, -1, 1 << 64), np.uint64))

    def __call__(self, texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, number of words of each text)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        if lower:
            joined = joined.translate(LOWER)
        data = np.frombuffer(joined, np.uint8)
        self._grow(len(data))
        word = np.empty(len(data) + 1, np.int8)
        word[0] = 0
        np.logical_not(self.space[data], out=word[1:].view(bool))
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(data) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.table[data] * self.power[: len(data)], out=sums[1:])
            hashes = mix((sums[end] - sums[start]) * self.inverse[start])
        bounds = np.cumsum([len(b) + 1 for b in raw])
        return hashes, np.diff(np.searchsorted(start, bounds), prepend=0)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text (null as empty) make()(texts) marks true: a filter without a join."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(np.asarray(work([t or "" for t in part.column(at).to_pylist()]), bool)))

    return docs.mapInArrow(run, docs.schema)
