"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by their subsequences of three letters or digits, each
weighted by a decay for its span, so gaps and inserted characters cost little:
a run of other characters, however long, is one place of the span.  The kernel
of a word and a landmark is raised to a power, which keeps near matches and
drops chance ones; a sentence counts by its strongest words.  Landmarks are the words that tell toxic training documents best, and
the commonest words.  A linear support vector machine is trained on the
Nyström features of labelled sentences: those of a toxic document that hold
evidence are its examples, the strongest of clean documents the counter
examples.  Landmarks with one inserted letter are further examples, as much as
their evidence counts.  A document's score is that of the strongest word of
its sentences, through a fitted sigmoid.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions.cluster import ship
from tomoframe.llm import arrow_text, shared

#: Letters among which a subsequence of three lies (all subsequences of words that are no longer; beyond it a weight would
#: be under a ninth of the greatest), decay for each place of the span, power of the kernel.
SPAN, DECAY, POWER = 12, 0.8, 2
#: Bounds of the training sample: labelled documents of each class, and examples kept of each.
MAX_DOCS, MAX_SENTENCES = 3000, 4
LANDMARKS, COMMON_LANDMARKS = 160, 32
#: Evidence that a landmark needs: log-likelihood ratio, and toxic documents for each clean one that holds the word.
MIN_RATIO, MIN_ODDS = 5.0, 1.0
#: Kernel value to a telling landmark that a toxic document's sentence must reach to be an example.
MIN_EVIDENCE = 0.3
THRESHOLD = 0.7
#: A document's strongest words that its score looks at: one insult makes a text toxic.
TOP = 1
#: Letter of no landmark, put between a telling landmark's letters to make virtual examples.
STRANGE = "\U00010400"

#: Subsequences that are looked at in one pass, and most cells of a table by code.
PART, TABLE = 1 << 19, 1 << 24
_STEPS = np.array(list(itertools.combinations(range(1, SPAN), 2))).T
#: Weights by span: SPAN letters and a gap of other characters after each.
_DECAYS = DECAY ** np.arange(2 * SPAN + 1)
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_LETTERS = re.compile(r"(?:(?<=\s)|^)\S(?:\s\S(?=\s|$)){2,}")


def sentences(text: str) -> list[list[str]]:
    """Lower-cased words by sentence; letters set apart by spaces are joined to a word."""
    out = []
    for s in _SENTENCE.split(text.lower()):
        words = s.split()
        if sum(len(w) == 1 for w in words) > 2:
            words = _LETTERS.sub(lambda m: m[0].replace(" ", ""), " ".join(words)).split()
        if words:
            out.append(words)
    return out


@functools.lru_cache(64)
def _whole(n: int) -> np.ndarray:
    """Index triples of the subsequences of n letters, within SPAN letters each."""
    start = np.arange(n - 2)[:, None]
    x, y, z = np.broadcast_arrays(start, start + _STEPS[0], start + _STEPS[1])
    ok = z < n
    return np.array([x[ok], y[ok], z[ok]])


def _triples(n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, index triples) that together are all of a word of n letters; a long word comes in runs of first letters."""
    run = PART // _STEPS.shape[1]
    if n <= run:
        yield 0, _whole(n)
        return
    for at in range(0, n - 2, run):
        part = _whole(min(n - at, run + SPAN - 1))
        yield at, part[:, part[0] < run]


class SubsequenceKernel:
    """Kernels of words to landmarks, from a table of the landmarks' weighted subsequences."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        chars = sorted({c for w in landmarks for c in w if c.isalnum()})
        self.base = len(chars) + 1
        self.code = {ord(c): i + 1 for i, c in enumerate(chars)}
        cells: dict[tuple[int, int], float] = {}
        for k, w in enumerate(landmarks):
            for codes, weights, _ in self._subsequences([w]):
                for c, x in zip(codes.tolist(), weights.tolist(), strict=True):
                    if c >= 0:
                        cells[c, k] = cells.get((c, k), 0.0) + x
        norm = np.zeros(len(landmarks))
        for (_, k), x in cells.items():
            norm[k] += x * x
        norm = np.sqrt(np.where(norm > 0, norm, 1))
        # by subsequence: the landmarks that have it, each with its share; a subsequence is in few of them
        order = sorted(cells)
        self.holder = np.array([k for _, k in order], np.int64)
        self.share = np.array([cells[c, k] / norm[k] for c, k in order])
        kinds, first, many = np.unique(np.array([c for c, _ in order], np.int64), return_index=True, return_counts=True)
        self.kinds = kinds
        self.row = None
        if self.base**3 <= TABLE:  # a table by code; an alphabet too large for one is searched
            self.row = np.full(self.base**3, -1, np.int32)
            self.row[kinds] = np.arange(len(kinds))
        self.first, self.many = first, many

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each subsequence that a landmark has, -1 for the others."""
        if self.row is not None:
            return self.row[codes]
        at = np.minimum(np.searchsorted(self.kinds, codes), max(0, len(self.kinds) - 1))
        return np.where(self.kinds[at] == codes, at, -1) if len(self.kinds) else np.full(len(codes), -1)

    def _subsequences(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Codes (-1: a character of no landmark), weights and word numbers of all subsequences, in parts of bounded size."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        letter = np.array([chr(p).isalnum() for p in kinds], bool)[inverse]
        code = np.array([self.code.get(int(p), 0) for p in kinds], np.int64)[inverse]
        word = np.repeat(np.arange(len(words)), lengths)
        # a run of other characters is one place: it makes a gap, however long, and no subsequences
        place = np.cumsum(letter | np.diff(letter, prepend=True))
        code, word, place = code[letter], word[letter], place[letter]
        many = np.bincount(word, minlength=len(words))
        first = np.cumsum(many) - many
        for n in np.unique(many[many > 2]).tolist():
            own = np.flatnonzero(many == n)
            for at, triples in _triples(n):
                step = max(1, PART // triples.shape[1])
                for k in range(0, len(own), step):
                    start = first[own[k : k + step], None] + at
                    x, y, z = (start + t for t in triples)
                    a, b, c = code[x], code[y], code[z]
                    codes = np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, -1)
                    weights = _DECAYS[place[z] - place[x] + 1]
                    yield codes.ravel(), weights.ravel(), np.repeat(own[k : k + step], triples.shape[1])

    def __call__(self, words: list[str]) -> np.ndarray:
        """Kernel values, one row a word: 0 to about 1, raised to POWER."""
        out = np.zeros((len(words), len(self.landmarks)))
        square = np.zeros(len(words))
        for codes, weights, owner in self._subsequences(words):
            square += np.bincount(owner, weights**2, len(words))
            hit = np.flatnonzero(codes >= 0)
            row = self._rows(codes[hit])
            hit, row = hit[row >= 0], row[row >= 0]
            many = self.many[row]
            each = np.repeat(np.arange(len(hit)), many)
            at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.first[row][each]
            cell = owner[hit][each] * out.shape[1] + self.holder[at]
            if len(cell):
                out += np.bincount(cell, weights[hit][each] * self.share[at], out.size).reshape(out.shape)
        out = out / np.sqrt(np.where(square > 0, square, 1))[:, None]
        return np.minimum(out, 1) ** POWER


@dataclass
class ToxicityModel:
    """Landmarks, one weight for each, the bias, and the sigmoid's slopes for the TOP strongest words and its shift."""

    landmarks: list[str]
    weight: np.ndarray
    bias: float
    slope: np.ndarray = field(default_factory=lambda: np.eye(1, TOP)[0])
    shift: float = 0.0
    _cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_cache", "_kernel")} | {"_cache": {}}

    def _words(self, words: set[str]) -> None:
        if not hasattr(self, "_kernel"):
            self._kernel = SubsequenceKernel(self.landmarks)
        if len(self._cache) > 400_000:
            self._cache.clear()
        new = [w for w in words if w not in self._cache]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self._cache.update(zip(part, (self._kernel(part) @ self.weight).tolist(), strict=True))

    def decisions(self, texts: list[str]) -> np.ndarray:
        """Margins, within -1 and 1, of each text's TOP strongest words; the bias where there is none."""
        cut = [list(itertools.chain.from_iterable(sentences(t))) for t in texts]
        out = np.full((len(texts), TOP), self.bias)
        words = list(itertools.chain.from_iterable(cut))
        if not words:
            return np.clip(out, -1, 1)
        self._words(set(words))
        per = np.fromiter(map(self._cache.__getitem__, words), np.float64, len(words)) + self.bias
        at = 0
        for i, doc in enumerate(cut):
            own = per[at : at + len(doc)]
            if len(own) > TOP:
                own = np.partition(own, len(own) - TOP)[-TOP:]
            out[i, : len(own)] = np.sort(own)[::-1]
            at += len(doc)
        return np.clip(out, -1, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.clip(self.decisions(texts) @ self.slope + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled documents that training may use."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, toxic, text) of at most max_docs labelled documents of each class, none of them held out."""
    usable = usable_labels(labels)
    picked = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])  # at most 2 * max_docs rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def _clean_word(w: str) -> str:
    return w.strip(".,;:!?'\"()[]{}<>-_*#$%&|")


def _landmarks(sample: DataFrame, n: int, common: int) -> tuple[dict[str, float], list[str]]:
    """Words with the signed likelihood ratio of their document counts in the two classes, and the commonest words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted({x for s in sentences(text) for w in s if len(x := _clean_word(w)) >= 3})  # shorter ones have no subsequence of three
                yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "toxic": pa.array([int(toxic)] * len(found), pa.int32())})

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0) or 1, sizes.get(0, 0) or 1
    counts = sample.select("toxic", "text").mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rate = (F.col("a") + F.col("b")) / float(n1 + n0)
    g2 = F.col("a") * F.log((F.col("a") + 0.5) / (rate * n1 + 0.5)) + F.col("b") * F.log((F.col("b") + 0.5) / (rate * n0 + 0.5))
    counts = counts.withColumn("g2", F.when(F.col("a") * n0 > F.col("b") * n1, g2).otherwise(-g2))
    counts = shared.stage_table(counts, "words")
    best = {r["word"]: r["g2"] for r in counts.where((F.col("a") > 1) & (F.col("g2") >= MIN_RATIO) & (F.col("a") >= MIN_ODDS * F.col("b"))).orderBy(F.desc("g2"), "word").limit(n).collect()}
    often = [r["word"] for r in counts.orderBy(F.desc(F.col("a") + F.col("b")), "word").limit(common).collect()]
    return best, [w for w in often if w not in best]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss machine, by dual coordinate ascent."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    square = (x1**2).sum(1)
    alpha, w = np.zeros(len(x)), np.zeros(x1.shape[1])
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (w @ x1[i])) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x1[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def _sigmoid_fit(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and shift of the logistic curve of y over the columns of f, by projected gradient steps."""
    w, b = np.full(f.shape[1], 0.5), 0.0
    total = weight.sum()
    for _ in range(4000):
        p = 1 / (1 + np.exp(-np.clip(f @ w + b, -30, 30)))
        e = weight * (p - y) / total
        w = np.maximum(0.0, w - 1.0 * (f.T @ e + 1e-4 * w))
        b -= 1.0 * (e.sum() + 1e-5 * b)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, landmarks: int = LANDMARKS, common: int = COMMON_LANDMARKS) -> ToxicityModel:
    """Fits on the bounded training sample; the driver gets MAX_SENTENCES feature rows a document.

    Without a toxic and a clean training document the model scores all texts 0.
    """
    ship(docs.sparkSession)
    sample = shared.stage_table(training_sample(docs, labels, max_docs), "labelled")
    have = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    all_of = {r["toxic"]: r["n"] for r in usable_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(have) != {0, 1}:
        return ToxicityModel([], np.zeros(0), -40.0)
    ratio, often = _landmarks(sample, landmarks, common)
    best = list(ratio)
    if not best:
        return ToxicityModel([], np.zeros(0), -40.0)
    marks = best + often
    m, told = len(marks), len(best)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = SubsequenceKernel(marks)
        for batch in batches:
            for toxic, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cut = sentences(text) or [[]]
                words = sorted({w for s in cut for w in s})
                at = {w: i for i, w in enumerate(words)}
                values = kernel(words)
                peak = values[:, :told].max(1) if words else np.zeros(len(words))
                # the sentences' strongest words, each an example of its sentence
                top = heapq.nlargest(MAX_SENTENCES, (at[w] for s in cut for w in s), key=peak.__getitem__)
                rows = [values[i] for i in top] or [np.zeros(m, np.float32)]
                yield pa.RecordBatch.from_pydict({"doc": pa.array([doc] * len(rows), pa.int64()), "toxic": pa.array([int(toxic)] * len(rows), pa.int32()), "x": pa.array([r.astype(np.float32) for r in rows], pa.list_(pa.float32()))})

    got = sample.select("toxic", F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(features, "doc long, toxic int, x array<float>").orderBy("doc", "toxic").toArrow()
    doc, y = got.column("doc").to_numpy(), got.column("toxic").to_numpy()
    raw = got.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(y), m)  # no Python object a number
    del got
    # Nyström: features whose inner products are the kernel projected on the landmarks
    kernel = SubsequenceKernel(marks)
    k = kernel(marks)
    values, vectors = np.linalg.eigh((k + k.T) / 2 + 1e-3 * np.eye(m))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = raw @ root
    bag = np.unique(doc, return_inverse=True)[1]
    score = raw[:, :told].max(1)
    use = np.flatnonzero((y == 0) | (score >= MIN_EVIDENCE))
    # a sampled document stands for its share of its class
    stands = np.array([all_of[k] / have[k] for k in (0, 1)])
    cost = 10.0 * (stands / stands[1])[y[use]]
    cost[y[use] == 1] /= np.bincount(bag[use])[bag[use]][y[use] == 1]
    # virtual examples: each telling landmark with one inserted letter, far less for landmarks by chance
    virtual = kernel([w[:p] + STRANGE + w[p:] for w in best for p in range(1, len(w))]) @ root
    share = 10.0 * np.concatenate([np.full(len(w) - 1, (ratio[w] / max(ratio.values())) ** 2) for w in best])
    w, b = _svm(np.vstack([x[use], virtual]), np.concatenate([np.where(y[use] == 1, 1.0, -1.0), np.ones(len(virtual))]), np.concatenate([cost, share]))
    score = x @ w + b
    strongest = np.full((bag.max() + 1, TOP), b)
    truth = np.zeros(bag.max() + 1)
    truth[bag] = y
    order = np.lexsort((-score, bag))
    place = np.arange(len(order)) - np.searchsorted(bag[order], bag[order])
    head = order[place < TOP]
    strongest[bag[head], place[place < TOP]] = score[head]
    strongest = np.clip(strongest, -1, 1)
    slope, shift = _sigmoid_fit(strongest, truth, stands[truth.astype(int)])
    return ToxicityModel(marks, root @ w, b, slope, shift)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words.  Repeated rows
    are scored one by one, an empty table gives an empty result, other columns
    are ignored.
    """

    def make():  # noqa: ANN202
        def work(texts: list[str]) -> dict:
            s = model.scores(texts)
            return {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

        return work

    out = arrow_text.map_texts(docs, make, "score double, predicted int", id_col, text_col)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_subsequence_kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, shared.read(spark, sf_dir, "labels")))
