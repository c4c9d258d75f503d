"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

Counts of single tokens and of pairs of neighbours are taken over all training
documents, quantised to levels on a logarithmic scale, and put in a Bloom
filter: an n-gram of level q is entered q times, once with each of the numbers
1 to q.  The filter is asked for 1, 2, ... until the answer is no, which gives
the level (never too low, too high with a small chance that falls with each
level), and a pair's probability is smoothed with that of its second token:

    P(w | h) = (c(h, w) + STRENGTH * P(w)) / (c(h) + STRENGTH),    P(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

with the counts that the levels stand for.  The filter is made of segments,
each with the n-grams of one range of hashes, so that segments are built where
the exchange has brought the n-grams together.  It goes to the workers by
broadcast, in groups of segments of at most `filter_bytes`; one more pass over
the documents for each further group looks up what its segments hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.llm import arrow_text, shared

#: Growth of a level's lower bound, bits and hashes of an entry, weight of the smoothing, bytes of text that a segment stands for.
BASE, BITS, HASHES, STRENGTH, SEGMENT_TEXT = 1.5, 14, 5, 256.0, 2 << 20
#: Bytes of filter in one broadcast, tokens with exact counts in one broadcast: at most.
FILTER_BYTES, COMMON_TOKENS = 256 << 20, 1 << 20

#: An n-gram's row on its way to its segment: 57 bits of its hash, 1 for a single token, 6 for its count less one.
_COUNT, _SINGLE = np.uint64(63), np.uint64(64)
_NAME = ~np.uint64(127)
#: Names of the tokens that start and end a text, which no word has but by chance.
START, END = np.uint64(0x5D1C0A7E9B3F2480), np.uint64(0xC2B2AE3D27D4EB00)


def levels(base: float = BASE, top: int = 1 << 40) -> np.ndarray:
    """Least count of each level, from level 1 on."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out, np.int64)


LEAST = levels()
#: The count that a level stands for: the middle of its counts; 0 for level 0.
MIDDLE = np.append([0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right")


class Tokens:
    """Names of the tokens of many texts: words in lower case, then one end a text."""

    def __init__(self) -> None:
        self.hasher = arrow_text.WordHasher()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(names of all tokens in order, number of tokens of each text)."""
        words, sizes = self.hasher(texts)
        words = words & _NAME
        ends = np.cumsum(sizes + 1) - 1
        out = np.empty(len(words) + len(texts), np.uint64)
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[is_word], out[ends] = words, END
        return out, sizes + 1

    @staticmethod
    def pairs(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the token before each, START before the first of a text; names of the pairs of both)."""
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(sizes) - sizes] = START
        with np.errstate(over="ignore"):
            return before, arrow_text.mix(before * np.uint64(0x9E3779B97F4A7C15) + (tokens >> np.uint64(7))) & _NAME


def _packed(names: np.ndarray, flag: np.uint64) -> np.ndarray:
    """Rows of the n-grams named, each with its count; counts above 64 take several rows."""
    kinds, counts = np.unique(names, return_counts=True)
    counts = counts.astype(np.int64)
    rows = [kinds | flag | np.minimum(counts - 1, 63).astype(np.uint64)]
    rest = counts - 64
    while len(kinds := kinds[rest > 0]):
        rest = rest[rest > 0]
        rows.append(kinds | flag | np.minimum(rest - 1, 63).astype(np.uint64))
        rest = rest - 64
    return np.concatenate(rows).view(np.int64)


def _unpacked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names with the flag of single tokens, counts) of sorted rows, one for each n-gram."""
    names = rows.view(np.uint64) & ~_COUNT
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[first], np.add.reduceat((rows.view(np.uint64) & _COUNT).astype(np.int64) + 1, first)


#: Tokens whose n-grams are added up together before they leave a task.
GATHERED = 1 << 21


def ngram_rows(docs: DataFrame) -> DataFrame:
    """(ngram): the packed counts of docs (doc_id, text), added up over some slices of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            for part, flag in zip(held, (_SINGLE, np.uint64(0)), strict=True):
                rows = _packed(np.concatenate(part), flag)
                part.clear()
                for at in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[at : at + (1 << 16)])], ["ngram"])

        have = 0
        for batch in batches:
            for part in arrow_text.slices(batch, 1):
                names, sizes = tokens(part.column(1).to_pylist())
                held[0].extend((names, np.full(len(sizes), START)))
                held[1].append(tokens.pairs(names, sizes)[1])
                have += len(names)
                if have >= GATHERED:
                    yield from out()
                    have = 0
        if have:
            yield from out()

    return docs.mapInArrow(run, "ngram long")


# --- the filter


_LOW = np.uint64(0xFFFFFFFF)


def probes(names: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the places of n-grams entered with a level."""
    with np.errstate(over="ignore"):
        a = arrow_text.mix(names + np.uint64((level * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF))
    return a & _LOW, (a >> np.uint64(32)) | np.uint64(1)


def place(start: np.ndarray, step: np.ndarray, k: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The k-th place, in segments of so many bits."""
    return (((start + np.uint64(k) * step) & _LOW) * bits) >> np.uint64(32)


def segment(names: np.ndarray, counts: np.ndarray, bits: int = BITS, hashes: int = HASHES) -> bytes:
    """The Bloom filter of the given n-grams, each entered once for every level up to its own."""
    level = level_of(counts)
    size = max(64, -(-int(level.sum()) * bits // 8) * 8)
    out = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        start, step = probes(names[level >= q], q)
        for k in range(hashes):
            out[place(start, step, k, np.uint64(size))] = True
    return np.packbits(out, bitorder="little").tobytes()


class Filter:
    """Some segments of the filter; levels of n-grams by membership probes."""

    def __init__(self, parts: Iterable[tuple[int, bytes]], shift: int, hashes: int = HASHES) -> None:
        """parts: (number, bits) of each segment, taken one after the other into one buffer."""
        self.data, numbers, sizes = bytearray(), [], []
        for number, bits in parts:
            self.data += bits
            numbers.append(number)
            sizes.append(len(bits))
        order, size = np.argsort(np.array(numbers, np.int64)), np.array(sizes, np.int64)
        self.numbers, self.shift, self.hashes = np.array(numbers, np.int64)[order], shift, hashes
        self.bits, self.start = (size * 8).astype(np.uint64)[order], (np.cumsum(size) - size)[order]

    def levels(self, names: np.ndarray) -> np.ndarray:
        """The level of each n-gram (with its flag), 0 where the filter has none or lacks the segment."""
        out = np.zeros(len(names), np.uint8)
        if not len(self.numbers):
            return out
        data = np.frombuffer(self.data, np.uint8)
        number = segment_number(names, self.shift)
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        left = np.flatnonzero(self.numbers[at] == number)
        names, bits, base = names[left], self.bits[at[left]], self.start[at[left]]
        for q in range(1, len(LEAST)):
            start, step = probes(names, q)
            yes = np.arange(len(names))
            for k in range(self.hashes):
                bit = place(start, step, k, bits).astype(np.int64)
                hit = np.flatnonzero(data[base[yes] + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1)
                if len(hit) < len(yes):
                    yes, start, step, bits = yes[hit], start[hit], step[hit], bits[hit]
            left, names, base = left[yes], names[yes], base[yes]
            if not len(left):
                break
            out[left] = q
        return out


def segment_number(names: np.ndarray, shift: int) -> np.ndarray:
    return (names >> np.uint64(shift)).astype(np.int64)


class Model:
    """The written segments (number, bits, tokens, counts), totals, and what is broadcast of them."""

    def __init__(self, spark: SparkSession, segments: DataFrame, shift: int, filter_bytes: int, common_tokens: int) -> None:
        self.spark, self.segments, self.shift = spark, segments, shift
        self.known = segments.select(F.explode(F.arrays_zip("tokens", "counts")).alias("t")).select(F.col("t.tokens").alias("token"), F.col("t.counts").alias("c"))
        end = int(END.view(np.int64))
        own = self.known.where(F.col("token") != int(START.view(np.int64)))
        n, v, texts = own.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("token") == end, F.col("c")))).first()
        self.tokens, self.kinds, self.texts = int(n or 0), int(v or 0), int(texts or 0)
        # exact counts of the most frequent tokens: those with at least so many uses that no more than common_tokens have them
        size = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.expr("shiftleft(1L, CAST(floor(log2(c)) AS INT))"))
        uses = sorted(own.groupBy(size.alias("c")).count().collect(), reverse=True)  # some 4100 rows at most
        self.least, have = 1 << 62, 0
        for c, k in uses:
            if have + k > common_tokens:
                break
            self.least, have = c, have + k
        own = own.where(F.col("c") >= self.least)
        common = own.toArrow() if have else pa.table({"token": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        names = common.column("token").to_numpy().view(np.uint64)
        order = np.argsort(names)
        self.common = (names[order], common.column("c").to_numpy()[order])
        total, parts = segments.agg(F.sum(F.length("bits")), F.count("*")).first()
        self.groups = max(1, min(parts, -(-(total or 0) // filter_bytes)))

    def rare(self) -> DataFrame:
        return self.known.where((F.col("c") < self.least) & (F.col("token") != int(START.view(np.int64))))

    def filter(self, group: int) -> Filter:
        """One group of segments, brought to the driver: filter_bytes of them, give or take the segments' spread."""
        part = self.segments.where(F.pmod("number", F.lit(self.groups)) == group).select("number", "bits")
        return Filter(((r.number, r.bits) for r in part.toLocalIterator()), self.shift)


def train(docs: DataFrame, filter_bytes: int = FILTER_BYTES, common_tokens: int = COMMON_TOKENS, segment_text: int = SEGMENT_TEXT) -> Model:
    """The model of all texts of docs (doc_id, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = 64 - max(1, min(40, int(np.ceil(np.log2(size / segment_text))) if size > segment_text else 1))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one partition in order: a segment is complete where the next one begins."""
        kept: list[np.ndarray] = []
        now = None

        def done() -> pa.RecordBatch:
            names, counts = _unpacked(np.concatenate(kept))
            single = names & _SINGLE != 0
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in ((names[single] & _NAME).view(np.int64), counts[single])]
            return pa.RecordBatch.from_arrays([pa.array([int(now)], pa.int64()), pa.array([segment(names, counts)], pa.binary()), *lists], ["number", "bits", "tokens", "counts"])

        for batch in batches:
            rows = batch.column(0).to_numpy()
            number = segment_number(rows.view(np.uint64), shift)
            edges = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip(np.append(0, edges), np.append(edges, len(rows)), strict=True):
                if a == b:
                    continue
                if now is not None and number[a] != now:
                    yield done()
                    kept = []
                now = number[a]
                kept.append(rows[a:b].copy())
        if kept:
            yield done()

    # all rows of a segment in one partition, sorted: its number is the upper part of the row
    dealt = ngram_rows(docs).repartition(F.shiftrightunsigned("ngram", shift)).sortWithinPartitions("ngram")
    segments = dealt.mapInArrow(build, "number long, bits binary, tokens array<long>, counts array<long>")
    return Model(spark, shared.stage_table(segments, "segments"), shift, filter_bytes, common_tokens)


# --- scores


def token_logs(level: np.ndarray, before: np.ndarray, pair: np.ndarray, n: int, v: int, strength: float) -> np.ndarray:
    """log10 P(w | h) from the levels of w, h and the pair."""
    single = (MIDDLE[level] + 0.5) / (n + 0.5 * (v + 1))
    history = MIDDLE[before]
    return np.log10((np.minimum(MIDDLE[pair], history) + strength * single) / (history + strength))


def score(docs: DataFrame, model: Model, strength: float = STRENGTH) -> DataFrame:
    """(row, doc_id, n_tokens, known, common, score, rare, uses): row numbers rows; known and common are the sums over frequent
    tokens of their number and of log10(c + 1/2); rare and uses are the other tokens with their numbers of uses."""
    spark = docs.sparkSession
    n, v = model.tokens, model.kinds
    common = spark.sparkContext.broadcast(model.common)  # COMMON_TOKENS at most
    last = model.groups - 1
    for group in range(model.groups):
        bloom = spark.sparkContext.broadcast(model.filter(group))

        def levels_of(batches: Iterator[pa.RecordBatch], bloom=bloom, group=group) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            """Adds what this group's segments know: three levels a token."""
            tokens, part_filter = Tokens(), bloom.value
            exact = common.value if group == last else None
            for batch in batches:
                for part in arrow_text.slices(batch, 1):
                    names, sizes = tokens(part.column(1).to_pylist())
                    _, pairs = tokens.pairs(names, sizes)
                    ends = np.cumsum(sizes)
                    kinds, which = np.unique(np.append(names, START), return_inverse=True)
                    single = part_filter.levels(kinds | _SINGLE)[which]
                    before = np.append(single[-1:], single[:-2])  # START's, then that of the token before
                    before[ends - sizes] = single[-1]
                    found = np.stack([single[:-1], before, part_filter.levels(pairs)], 1)
                    if group:
                        found = np.maximum(found, np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, 3))
                    if group < last:
                        data = [found[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], ["doc_id", "text", "levels"])
                    else:
                        yield finish(part.column(0), names, sizes, found, exact)

        def finish(ids: pa.Array, names: np.ndarray, sizes: np.ndarray, found: np.ndarray, exact: tuple) -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(sizes)), sizes)
            logs = token_logs(found[:, 0], found[:, 1], found[:, 2], n, v, strength)
            have, counts = exact
            at = np.minimum(np.searchsorted(have, names), max(0, len(have) - 1))
            known = have[at] == names if len(have) else np.zeros(len(names), bool)
            c = counts[at] if len(have) else np.zeros(len(names))
            sums = [np.bincount(owner, w, len(sizes)) for w in (known, np.where(known, np.log10(c + 0.5), 0.0), logs)]
            uses: list[list] = [[], []]
            ends, rare = np.cumsum(sizes), ~known
            for a, b in zip(ends - sizes, ends, strict=True):
                kinds, k = np.unique(names[a:b][rare[a:b]], return_counts=True)
                uses[0].append(kinds.view(np.int64))
                uses[1].append(k)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(uses[0], pa.list_(pa.int64())), pa.array(uses[1], pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "known", "common", "score", "rare", "uses"],
            )

        schema = "doc_id long, n_tokens long, known long, common double, score double, rare array<long>, uses array<long>" if group == last else "doc_id long, text string, levels binary"
        docs = docs.mapInArrow(levels_of, schema)
        if group < last:
            docs = shared.stage_table(docs, "levels")
    return shared.stage_table(docs.withColumn("row", F.monotonically_increasing_id()), "scored")


def score_texts(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    strength: float = STRENGTH,
    filter_bytes: int = FILTER_BYTES,
    common_tokens: int = COMMON_TOKENS,
    segment_text: int = SEGMENT_TEXT,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training is a condition on the column doc_id; the model is learnt from the
    rows for which it is true (a null one is false), and held_out is its
    opposite.  base_score and n_known come from exact counts of tokens, those
    of frequent ones by a broadcast of bounded size, those of the others by a
    join; score is the filter's log10 probability of the text.  Null and empty
    texts have the end alone.  Very long texts are read whole.  Repeated rows
    count and are scored one by one; without any training rows nothing is
    known, N and V are 0.  An empty table gives an empty result; other columns
    are ignored.  Tokens are compared by 57-bit hashes.
    """
    texts = arrow_text.id_and_text(docs, id_col, text_col)
    held = ~F.coalesce(training, F.lit(False))
    model = train(texts.where(~held), filter_bytes, common_tokens, segment_text)
    scored = score(texts, model, strength)
    n, v = model.tokens, model.kinds
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "uses")).alias("r")).select("row", F.col("r.rare").alias("token"), F.col("r.uses").alias("k"))
    found = rare.join(model.rare(), "token", "left")
    c = F.coalesce("c", F.lit(0))
    extra = found.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("__known"), F.sum(F.col("k") * F.log10(c + F.lit(0.5))).alias("__logs"))
    whole = scored.drop("rare", "uses").join(extra, "row", "left")
    return whole.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("common") + F.coalesce("__logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"),
        "score",
    )


def op13_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return score_texts(shared.read(spark, sf_dir, "documents"), crc % 5 != 1)


def held_out(doc_id: int) -> bool:
    """The query's rule, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 1
