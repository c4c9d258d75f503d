"""Periodic runs of words by Lyndon arrays, after Ellert and Fischer (linear time over ordered alphabets).

A run is a stretch with smallest period q that no neighbour extends.  Under
one of the two orders of the alphabet (and of the end of text) some word i of
its first period starts the longest Lyndon word of length q, that is, the next
smaller suffix of i starts at i + q.  So both orders' next smaller suffixes,
with the number of words that each pair of suffixes has in common, give every
run once; the left end takes less than one period of comparisons more.

Suffixes are compared word by word and never twice over the same stretch:
what was matched furthest to the right is remembered with its shift, pairs in
it take their extension from the pair one shift before, and a chain of previous
smaller suffixes passes its extension on.  There are no suffix arrays, trees or
fingerprints; words become numbers by sorting them.

Before that, texts are cut to the stretches in which runs can lie at all: in a
run of e periods every pair of neighbouring words is found e - 1 times or more.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tomoframe.llm import arrow_text, shared

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
)
LEAST_WORDS, LEAST_PERIODS = 6, 4


def next_smaller(x: list[int], reverse: bool = False) -> tuple[list[int], list[int]]:
    """For each i the start of the next smaller suffix (len(x): none) and the symbols that the two have in common.

    reverse: under the opposite order, in which the end of text is the
    largest symbol and not the smallest.
    """
    n = len(x)
    after, shared_after = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n
    left = far = shift = 0  # x[k] == x[k - shift] for left <= k < far
    for j in range(1, n):
        i, m = j - 1, 0
        while True:
            if left <= i and j < far:  # the same pair, one shift before
                a, b = i - shift, j - shift
                known = shared_after[a] if after[a] == b else shared_before[b] if before[b] == a else 0
                m = max(m, min(known, far - j))
            while j + m < n and x[i + m] == x[j + m]:
                m += 1
            if j + m > far:
                left, far, shift = j, j + m, j - i
            if (j + m == n or x[j + m] < x[i + m]) == reverse:
                if j + m < n or reverse:
                    before[j], shared_before[j] = i, m
                    break
            after[i], shared_after[i] = j, m
            # the previous smaller suffix p of i: p < i, and j < i, so what p shares with i tells what it shares with j
            p = before[i]
            while p >= 0 and shared_before[i] > m:
                after[p], shared_after[p] = j, m
                i, p = p, before[p]
            if p < 0:
                break
            if shared_before[i] < m:
                before[j], shared_before[j] = p, shared_before[i]
                break
            i = p
    return after, shared_after


def runs(x: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` symbols and `periods` (2 or more) periods, by start, then period."""
    found = []
    for reverse in (False, True):
        after, common = next_smaller(x, reverse)
        for i, e in enumerate(common):
            j = after[i]
            p = j - i
            if e <= (periods - 2) * p:
                continue
            if i >= p and after[i - p] == i and common[i - p] >= p:
                continue  # a later period of a run whose first is known
            k = 0
            while k < i and x[i - k - 1] == x[j - k - 1]:
                k += 1
            if p + k + e >= max(least, periods * p):
                found.append((i - k, p + k + e, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, group: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch numbers) of the symbols in stretches that can hold a run; a stretch lies in one group.

    Drops pairs of neighbours that a group has fewer than periods - 1 times,
    and stretches of too few symbols, until nothing changes.
    """
    at = np.arange(len(ids))
    while len(at):
        inside = np.empty(len(at), bool)
        inside[-1] = False
        inside[:-1] = (group[1:] == group[:-1]) & (at[1:] == at[:-1] + 1)
        x = ids[at]
        pair = x[:-1] * (int(x.max()) + 1) + x[1:]
        if (int(pair.max(initial=0)) + 1) * (int(group[-1]) + 1) >= 1 << 62:
            pair = np.unique(pair, return_inverse=True)[1]
        key = group[:-1] * (int(pair.max(initial=0)) + 1) + pair
        ordered = np.sort(key[inside[:-1]])
        far = periods - 2
        often = np.unique(ordered[far:][ordered[far:] == ordered[: len(ordered) - far]]) if len(ordered) > far else ordered[:0]
        live = np.zeros(len(at) + 1, bool)  # live[i]: the pair (i, i + 1) can be in a run
        live[:-2] = inside[:-1] & np.isin(key, often)
        edge = np.diff(live.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start + 1 >= least
        start, size = start[long], (end - start + 1)[long]
        number = np.repeat(np.arange(len(start)), size)
        keep = at[np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]
        done = len(keep) == len(at) and len(start) == group[-1] + 1
        at, group = keep, number
        if done:
            break
    return at, group


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the period that the query's contract writes into every tenth document (a null doc_id: none)."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _digests(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = None
    for s, length, p in found:  # by start, then period: the first of equals stays
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    if found:
        gone = np.zeros(len(words), bool)
        for s, length, p in found:
            gone[s + p : s + length] = True
        words = [words[k] for k in np.flatnonzero(~gone)]
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *named, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def of_texts(texts: list[list[bytes]], least: int, periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    sizes = np.array([len(w) for w in texts])
    flat = pa.array([w for words in texts for w in words], pa.large_binary())
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(flat):
        return out
    ids = pc.rank(flat, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    at, number = stretches(ids, np.repeat(np.arange(len(texts)), sizes), least, periods)
    begin = np.cumsum(sizes) - sizes
    cut = np.flatnonzero(np.diff(number)) + 1
    for part in np.split(at, cut) if len(at) else []:
        doc = int(np.searchsorted(begin, part[0], "right")) - 1  # of texts without words the last is taken, which has it
        offset = int(part[0] - begin[doc])
        out[doc] += [(offset + s, length, p) for s, length, p in runs(ids[part].tolist(), least, periods)]
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, the number of runs, the run of greatest length/period, digests of all runs and of the text without repeats.

    A run has at least `least` words and `periods` (2 or more) periods.  Of runs
    of equal length/period the one that starts first, then the shorter period,
    is named.  Without runs (null, empty and short texts) the run's columns are
    null, the digests those of no lines and of all words.  Very long texts are
    read whole, in time linear in their words; one text is one task's work.
    Repeated rows are taken one by one, an empty table gives an empty result,
    other columns are ignored.  prepare(doc_id, words) may change the words
    first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = SCHEMA.replace(",", "").split()[::2]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            for part in arrow_text.slices(batch, 1):
                keys = part.column(0).to_pylist()
                texts = [t.encode("utf-8", "surrogatepass").split() for t in part.column(1).to_pylist()]
                if prepare:
                    texts = [prepare(i, w) for i, w in zip(keys, texts, strict=True)]
                rows = [(i, *_digests(w, found)) for i, w, found in zip(keys, texts, of_texts(texts, least, periods), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return arrow_text.id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(shared.read(spark, sf_dir, "documents"), prepare=planted)
