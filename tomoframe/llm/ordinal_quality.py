"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector shared by all
grades and ordered thresholds.  x holds the shares of hashed words, the
presence of hashed words (a few telling words count as much in a long text as
in a short one), and the shares of pairs of neighbouring character classes.
The fit uses a bounded sample of labelled documents; scoring gathers one
weight per word and one per different word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions.cluster import ship
from tomoframe.llm import arrow_text, shared

WORD_BITS, PRESENCE_BITS = 14, 16
#: Value of the presence of a word, against shares that sum to 1.
PRESENCE = 0.3
#: Bound of the training sample: labelled documents of each grade.
MAX_DOCS = 2000
GRADES = 3
#: Selection: least probability of the best grade but one or better.
SELECT_GRADE, SELECT_PROBABILITY = 1, 0.5

_KINDS = 12


def _kinds() -> np.ndarray:
    out = np.full(256, 9, np.int64)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[32, 9, 13, 11, 12]], out[10] = 3, 4
    out[[ord(c) for c in ".,;:"]], out[[ord(c) for c in "!?"]], out[[ord(c) for c in "#*$%&|<>"]] = 5, 6, 7
    out[[ord(c) for c in "'\"()-"]] = 8
    out[0x80:0xC0], out[0xC0:] = 10, 11
    return out


class Features:
    """Word buckets, buckets of different words and class-pair counts of texts."""

    pairs = 1 << WORD_BITS
    present = pairs + _KINDS * _KINDS
    size = present + (1 << PRESENCE_BITS)

    def __init__(self) -> None:
        self.words = arrow_text.WordHasher(seed=3)
        self.kind = _kinds()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of every word, words of each text, pair shares with one row a text, (text, presence bucket) pairs)."""
        hashes, counts = self.words(texts)
        pairs = np.zeros((len(texts), _KINDS * _KINDS))
        for i, t in enumerate(texts):
            k = self.kind[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)]
            if len(k) > 1:
                pairs[i] = np.bincount(k[:-1] * _KINDS + k[1:], minlength=_KINDS * _KINDS) / (len(k) - 1)
        owner = np.repeat(np.arange(len(texts)), counts) << PRESENCE_BITS
        different = np.unique(owner + (hashes >> np.uint64(64 - PRESENCE_BITS)).astype(np.int64))
        return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), counts, pairs, different >> PRESENCE_BITS, different & ((1 << PRESENCE_BITS) - 1)

    def linear(self, texts: list[str], weight: np.ndarray) -> np.ndarray:
        buckets, counts, pairs, owner, different = self(texts)
        present = np.bincount(owner, weight[self.present + different], len(texts)) * PRESENCE
        sums = np.concatenate(([0.0], np.cumsum(weight[buckets])))
        ends = np.cumsum(counts)
        return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1) + np.sqrt(pairs) @ weight[self.pairs : self.present] + present


@dataclass
class OrdinalModel:
    weight: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[str], features: Features) -> np.ndarray:
        """P(grade >= k) for k from 1, one row a text; falls with k."""
        z = features.linear(texts, self.weight)[:, None] - self.thresholds[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the label columns: 0 low quality, 1 good but toxic, 2 good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, grades: int = GRADES, max_docs: int = MAX_DOCS, rounds: int = 300, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most max_docs rated documents of each grade, none held out; the driver gets their hashed features.

    ratings has (doc_id, grade).  Without any usable rating the weights are 0
    and the thresholds 0, 1, ..
    """
    from tomoframe.llm.toxicity import held_out

    ship(docs.sparkSession)
    usable = ratings.where(~held_out()).groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = None
    for g in range(grades):
        part = usable.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select(F.col(id_col).alias("doc_id"), shared.text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            for doc, grade, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                buckets, counts, pairs, _, different = make([text])
                at, n = np.unique(buckets, return_counts=True)
                some = np.flatnonzero(pairs[0])
                i = np.concatenate([at, some + Features.pairs, different + Features.present])
                v = np.concatenate([n / max(1, int(counts[0])), np.sqrt(pairs[0][some]), np.full(len(different), PRESENCE)])
                yield pa.RecordBatch.from_pydict({"doc": pa.array([doc], pa.int64()), "grade": pa.array([grade], pa.int32()), "i": pa.array([i.astype(np.int32)], pa.list_(pa.int32())), "v": pa.array([v.astype(np.float32)], pa.list_(pa.float32()))})

    got = sample.select(F.col("doc_id").cast("long").alias("doc"), "grade", "text").mapInArrow(rows, "doc long, grade int, i array<int>, v array<float>").orderBy("doc", "grade").toArrow()
    y = got.column("grade").to_numpy().astype(np.int64)
    sizes = np.array([len(x) for x in got.column("i")], np.int64)
    col = np.concatenate([np.asarray(x.values) for x in got.column("i")]) if len(y) else np.empty(0, np.int64)
    val = np.concatenate([np.asarray(x.values) for x in got.column("v")]).astype(np.float64) if len(y) else np.empty(0)
    row = np.repeat(np.arange(len(y)), sizes)
    return fit(row, col, val, y, grades, Features.size, rounds)


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, grades: int, size: int, rounds: int = 300, ridge: float = 1e-3) -> OrdinalModel:
    """Adam on the cumulative-link loss; gaps between thresholds stay positive as exponentials."""
    n = len(y)
    w, first, gaps = np.zeros(size), 0.0, np.zeros(grades - 2)
    if not n:
        return OrdinalModel(w, np.arange(grades - 1, dtype=float))
    share = np.bincount(y, minlength=grades)
    each = (n / grades / np.maximum(share, 1))[y]  # all grades weigh the same
    above = (y[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    m, v = np.zeros(size + grades - 1), np.zeros(size + grades - 1)
    for t in range(1, rounds + 1):
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        z = np.bincount(row, val * w[col], n)[:, None] - cuts[None, :]
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - above) * each[:, None] / n
        gw = np.bincount(col, val * err.sum(1)[row], size) + ridge * w
        later = -err.sum(0)
        tail = np.cumsum(later[::-1])[::-1]
        grad = np.concatenate([gw, [tail[0]], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, first, gaps = w - step[:size], first - step[size], gaps - step[size + 1 :]
    return OrdinalModel(w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def grade_documents(docs: DataFrame, model: OrdinalModel, select_grade: int = SELECT_GRADE, probability: float = SELECT_PROBABILITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, expected_grade, tail_1 .. tail_k, selected.

    Null and empty texts have no features and get the grade of the thresholds
    alone; very long texts are read whole.  Repeated rows are graded one by
    one, equal texts alike, an empty table gives an empty result, other
    columns are ignored.
    """
    from tomoframe.llm.toxicity import held_out

    k = len(model.thresholds)

    def make():  # noqa: ANN202
        features = Features()

        def work(texts: list[str]) -> dict:
            tails = model.tails(texts, features)
            cols = {"expected_grade": pa.array(tails.sum(1))} | {f"tail_{i + 1}": pa.array(tails[:, i]) for i in range(k)}
            return cols | {"selected": pa.array(tails[:, select_grade - 1] >= probability)}

        return work

    schema = "expected_grade double, " + ", ".join(f"tail_{i + 1} double" for i in range(k)) + ", selected boolean"
    out = arrow_text.map_texts(docs, make, schema, id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), *out.columns[1:])


def op3_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    return grade_documents(docs, train(docs, rated(shared.read(spark, sf_dir, "labels"))))
