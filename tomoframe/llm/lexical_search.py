"""Ranked lexical search over a clustered index whose order comes from recursive graph bisection.

1. One pass over the texts leaves each document's length and its counts of the
   terms that are asked for.  Counts over all documents give the weights.
2. Recursive graph bisection: the documents of a bounded sample are split in
   halves again and again; documents change sides while that lowers the
   logarithmic gap cost of the terms' lists.  Each node of the tree keeps, for
   each term, what one more document costs more on the left than on the right,
   and every document of the table goes down the tree by the sum over its terms.
3. All documents are sorted by leaf (a range exchange) and cut into shards of
   at most SHARD_DOCS neighbours in that order.  A shard's bound for an item is
   the sum of the greatest part that each term has in one of its documents.
4. Items visit shards by falling bound, in waves, until no shard is left whose
   bound reaches the lowest of the item's best scores so far.  Shards with an
   equal bound are still visited, since ties go by doc_id, which the index keeps.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomoframe.llm import arrow_text, shared

#: Documents of the sample that the bisection is fitted on, depth of its tree, and documents of a shard at most.
SAMPLE_DOCS, DEPTH, SHARD_DOCS = 4096, 6, 2048
#: Items and different terms of one block of items, and (item, shard) pairs of one wave, at most; more make more blocks and waves.
BLOCK_ITEMS, BLOCK_TERMS, WAVE_PAIRS = 4096, 200_000, 400_000

#: Letters and digits of ASCII (in lower case) and all bytes of other characters; the rest are blanks.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def postings(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its length in terms, and counts of the given ones by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow_text.slices(batch, 1):
                ids, sizes, numbers, counts = [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = terms_of(text)
                    if words:
                        found = sorted((terms[w], k) for w, k in Counter(words).items() if w in terms)
                        ids.append(i)
                        sizes.append(len(words))
                        numbers.append([t for t, _ in found])
                        counts.append([k for _, k in found])
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(numbers, ints), pa.array(counts, ints)], ["doc_id", "n", "terms", "tfs"])

    return arrow_text.id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


# --- recursive graph bisection


def _cost(degree: np.ndarray, docs: int) -> np.ndarray:
    """Bits of the gaps of lists of the given lengths among so many documents."""
    degree = np.maximum(degree, 0)
    return degree * np.log2((docs + 1) / (degree + 1))


class Bisection:
    """The tree: weights[node] has for each term what a document with it costs more on the left than on the right."""

    def __init__(self, documents: list[np.ndarray], terms: int, depth: int = DEPTH, rounds: int = 20) -> None:
        depth = max(1, min(depth, int(math.log2(max(2, (16 << 20) // max(1, terms))))))
        self.depth, self.weights = depth, np.zeros(((1 << depth) - 1, max(1, terms)), np.float32)
        self.rounds = rounds
        self._size = np.array([len(d) for d in documents], np.int64)
        self._start = np.cumsum(self._size) - self._size
        self._flat = np.concatenate([*documents, np.empty(0, np.int64)]).astype(np.int64)
        self._split(np.arange(len(documents)), 0, 0)
        del self._flat, self._size, self._start

    def _terms(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms of docs one after the other, the place of each one's document in docs)."""
        size = self._size[docs]
        owner = np.repeat(np.arange(len(docs)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self._start[docs], size)
        return self._flat[at], owner

    def _split(self, docs: np.ndarray, node: int, level: int) -> None:
        if level == self.depth or len(docs) < 4:
            return
        terms, owner = self._terms(docs)
        width, half = self.weights.shape[1], len(docs) // 2
        right = np.arange(len(docs)) >= half
        for k in range(self.rounds + 1):
            there = right[owner]
            l, r = np.bincount(terms[~there], minlength=width), np.bincount(terms[there], minlength=width)
            n_l, n_r = half, len(docs) - half
            if k == self.rounds:
                break
            to_right = _cost(l, n_l) + _cost(r, n_r) - _cost(l - 1, n_l) - _cost(r + 1, n_r)
            to_left = _cost(l, n_l) + _cost(r, n_r) - _cost(l + 1, n_l) - _cost(r - 1, n_r)
            gain = np.bincount(owner, np.where(there, to_left[terms], to_right[terms]), len(docs))
            a, b = np.flatnonzero(~right), np.flatnonzero(right)
            a, b = a[np.argsort(-gain[a], kind="stable")][: len(b)], b[np.argsort(-gain[b], kind="stable")]
            swap = gain[a] + gain[b[: len(a)]] > 1e-9
            if not swap.any():
                break
            right[a[swap]], right[b[: len(a)][swap]] = True, False
        self.weights[node] = (_cost(l + 1, n_l) - _cost(l, n_l)) - (_cost(r + 1, n_r) - _cost(r, n_r))
        self._split(docs[~right], 2 * node + 1, level + 1)
        self._split(docs[right], 2 * node + 2, level + 1)

    def leaves(self, sizes: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The leaf of each of many documents, given their numbers of terms and all terms one after the other."""
        node = np.zeros(len(sizes), np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for _ in range(self.depth):
            more = np.bincount(owner, self.weights[node[owner], terms], len(sizes))
            node = 2 * node + 1 + (more > 0)
        return node - (1 << self.depth) + 1


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, all values one after the other) of a list column without nulls."""
    ends = column.offsets.to_numpy()
    return np.diff(ends), column.values.to_numpy()[ends[0] : ends[-1]]


def clustered(posted: DataFrame, tree: Bisection, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(shard, doc_id, n, terms, tfs), in the order of the tree's leaves; shards are neighbours in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.leaves(*_lists(batch.column("terms"))), pa.int32()))

    placed = posted.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>, leaf int")
    # equal documents share a leaf, so the hash spreads what is hot in it over several ranges
    ordered = placed.repartitionByRange("leaf", F.xxhash64("doc_id", "n")).sortWithinPartitions("leaf", F.xxhash64("doc_id", "n"))
    place = F.monotonically_increasing_id()  # partition << 33 | row
    shard = F.shiftright(place, 33) * F.lit(1 << 33) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / shard_docs)
    return shared.stage_table(ordered.select(shard.cast("long").alias("shard"), "doc_id", "n", "terms", "tfs"), "clustered")


# --- search


class Scorer:
    """Scores documents of shards for the items that visit them."""

    def __init__(self, weights: np.ndarray, items: list[list[tuple[int, int]]], visits: dict[int, list[int]], floor: dict[int, int], k: int) -> None:
        self.weights, self.items, self.visits, self.floor, self.k = weights, items, visits, floor, k

    def shard(self, ids: pa.Array, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, items: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, scores): the best k of these documents for each item, those below the item's floor left out."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        part = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m[owner]))
        order = np.argsort(terms, kind="stable")
        owner, part = owner[order], part[order]
        have, first = np.unique(terms[order], return_index=True)
        last = np.append(first[1:], len(order))
        span = {int(t): (a, b) for t, a, b in zip(have, first, last, strict=True)}
        keys = np.array([np.iinfo(np.int64).max if x is None else x for x in ids.to_pylist()], np.int64)
        for item in items:
            score = np.zeros(len(sizes), np.int64)
            for t, times in self.items[item]:
                if t in span:
                    a, b = span[t]
                    score[owner[a:b]] += times * part[a:b]
            at = np.flatnonzero(score >= max(1, self.floor.get(item, 1)))
            if len(at) > self.k:
                least = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
                at = at[score[at] >= least]
                at = at[np.lexsort((keys[at], -score[at]))][: self.k]
            if len(at):
                yield item, at, score[at]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for a, b in zip(cut := np.flatnonzero(np.diff(shards, prepend=-1)), np.append(cut[1:], len(shards)), strict=True):
                part = batch.slice(a, b - a)
                asking = self.visits.get(int(shards[a]))
                if not asking:
                    continue
                sizes, terms = _lists(part.column("terms"))
                tfs = _lists(part.column("tfs"))[1].astype(np.int64)
                out = list(self.shard(part.column("doc_id"), part.column("m").to_numpy(), sizes, terms, tfs, asking))
                if out:
                    at = pa.array(np.concatenate([x for _, x, _ in out]))
                    item = np.repeat([i for i, _, _ in out], [len(x) for _, x, _ in out])
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), part.column("doc_id").take(at), pa.array(np.concatenate([s for _, _, s in out]))], ["item", "doc_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, items: list[Counter], k: int, id_col: str, text_col: str, shard_docs: int) -> DataFrame | None:
    """(item, rank, doc_id, score) of one block of items, numbered by place; None if there is nothing to find."""
    number = {t: j for j, t in enumerate(sorted(set().union(*items)))}
    asked = [sorted((number[t], c) for t, c in item.items()) for item in items]
    posted = shared.stage_table(postings(docs, number, id_col, text_col), "postings")
    n_docs, n_terms = posted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(number), np.int64)  # of the block's terms, BLOCK_TERMS at most
    for t, df in posted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    sample = posted.orderBy(F.xxhash64("doc_id", "n")).limit(SAMPLE_DOCS).select("terms").toArrow().column(0)
    tree = Bisection([np.asarray(x) for x in sample.to_pylist()], len(number))
    m = 75 + F.expr(f"(25 * n * {n_docs}L) DIV {n_terms}L")
    index = clustered(posted, tree, shard_docs).withColumn("m", m)

    spent = spark.createDataFrame([(t, i, int(weights[t]) * c) for i, a in enumerate(asked) for t, c in a] or [(-1, -1, 0)], "term int, item int, spent long")
    part = index.select("shard", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("shard", F.col("p.terms").alias("term"), F.expr("(1000000000L * p.tfs) DIV (1000L * p.tfs + 12 * m)").alias("part"))
    most = part.groupBy("shard", "term").agg(F.max("part").alias("part"))
    # the items' terms: at most BLOCK_ITEMS texts
    bound = most.join(F.broadcast(spent), "term").groupBy("item", "shard").agg(F.sum(F.col("part") * F.col("spent")).alias("bound"))
    bounds = shared.stage_table(bound.where("bound > 0"), "bounds")

    best = spark.createDataFrame([], "item int, doc_id long, score long, rank int")
    state = {i: (1, (1 << 63) - 1, -1) for i in range(len(items))}  # lowest useful score, bound and shard visited last
    width = 2
    while True:
        known = spark.createDataFrame([(i, *s) for i, s in state.items()], "item int, least long, last_bound long, last_shard long")
        left = bounds.join(F.broadcast(known), "item").where("bound >= least AND (bound < last_bound OR (bound = last_bound AND shard > last_shard))")
        w = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
        wave = left.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= min(width, max(1, WAVE_PAIRS // len(items))))
        pairs = wave.select("item", "shard", "bound", "turn").collect()  # WAVE_PAIRS at most
        if not pairs:
            return best
        visits: dict[int, list[int]] = defaultdict(list)
        for p in sorted(pairs, key=lambda p: (p.item, p.turn)):
            visits[p.shard].append(p.item)
            state[p.item] = (state[p.item][0], p.bound, p.shard)
        floor = {i: s[0] for i, s in state.items()}
        reading = index.where(F.col("shard").isin(list(visits))) if len(visits) <= 1000 else index
        found = reading.select("shard", "doc_id", "m", "terms", "tfs").mapInArrow(Scorer(weights, asked, dict(visits), floor, k), "item int, doc_id long, score long")
        best = shared.stage_table(_best(best.drop("rank").unionByName(found), k), "best")
        for r in best.where(F.col("rank") == k).select("item", "score").collect():
            state[r["item"]] = (r["score"], *state[r["item"]][1:])
        width *= 4


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score.

    Equal scores go by doc_id, a null one last; rows that repeat a doc_id are
    documents of their own, each with a rank.  Null, empty and termless texts
    are no documents and ask for nothing; an item that nothing scores for has
    no rows, and so have empty tables.  Items with the same id are separate
    searches.  Very long texts are read whole.  Other columns are ignored.
    Items are taken in blocks of at most BLOCK_ITEMS and about BLOCK_TERMS
    different terms; each block is searched among all documents.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def add(block: list[tuple], out: DataFrame) -> DataFrame:
        best = _search_block(spark, docs, [c for _, c in block], k, id_col, text_col, shard_docs) if block else None
        if best is None:
            return out
        named = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(block)], "item int, item_id long")
        return out.unionByName(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))

    block, terms = [], set()
    for item_id, text in items.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")).toLocalIterator():
        counts = Counter(terms_of(text or ""))
        if counts:
            block.append((item_id, counts))
            terms |= counts.keys()
        if len(block) == BLOCK_ITEMS or len(terms) >= BLOCK_TERMS:
            out, block, terms = add(block, out), [], set()
    return add(block, out)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "benchmark"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
doc AS (SELECT r, doc_id, len(ws)::BIGINT AS n, ws FROM d WHERE len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM doc),
item AS (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS ws FROM benchmark),
asked AS (SELECT i, item_id, t, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(ws) AS t FROM item) GROUP BY ALL),
wanted AS (SELECT DISTINCT t FROM asked),
posted AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM doc) SEMI JOIN wanted USING (t) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM posted GROUP BY t), total),
part AS (
  SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))) AS part
  FROM posted JOIN doc USING (r) JOIN weight USING (t), total
),
scored AS (SELECT i, item_id, r, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN part USING (t) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scored WHERE score > 0)
SELECT item_id, k::INTEGER AS rank, doc_id, score FROM ranked WHERE k <= 20
"""
