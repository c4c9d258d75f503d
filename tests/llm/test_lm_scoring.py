import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, edge_rows
from tomoframe.llm import lm_scoring as lm


def train():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def level_middle(c):
    return lm.MIDDLE[int(lm.level_of(np.array([c]))[0])]


def brute(rows):
    """Rows of exact counts, with the score of quantised but certain counts."""
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    single, pair = Counter(), Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            w = tokens(t)
            single.update(w)
            pair.update(zip(["<", *w[:-1]], w, strict=True))
    n, v = sum(single.values()), len(single)
    single["<"] = single[None]
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        w = tokens(t)
        base = sum(math.log10((single[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for a, b in zip(["<", *w[:-1]], w, strict=True):
            p = (level_middle(single[b]) + 0.5) / (n + 0.5 * (v + 1))
            c = level_middle(single[a])
            score += math.log10((min(level_middle(pair[a, b]), c) + lm.STRENGTH * p) / (c + lm.STRENGTH))
        out.append((i, h, len(w), sum(single[x] > 0 for x in w), n, base, score))
    return out


def compare(got, rows, slack=0.025):
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    got = sorted(map(tuple, got), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want, strict=True))
    # false positives of the filter move single tokens only
    assert all(abs(g[6] - w[6]) <= slack * max(100, abs(w[6])) for g, w in zip(got, want, strict=True))


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize(("filter_bytes", "common", "segment"), [(1 << 28, 1 << 20, 1 << 21), (30_000, 50, 20_000), (60_000, 0, 5_000)])
def test_edge_rows_against_brute_force(spark, edge_docs, filter_bytes, common, segment):
    """The last two: some groups of segments, few or no tokens in the broadcast."""
    got = lm.score_texts(edge_docs, train(), filter_bytes=filter_bytes, common_tokens=common, segment_text=segment)
    assert got.columns == COLUMNS
    compare(got.collect(), edge_rows())


def test_documents_against_brute_force(spark, small):
    got = lm.op13_log_frequency_bloom(spark, SF)
    compare(got.collect(), [tuple(r) for r in small.select("doc_id", "text").collect()])


def test_empty_tables_and_no_training(spark, no_docs, small):
    assert lm.score_texts(no_docs, train()).count() == 0
    rows = lm.score_texts(small.limit(5), F.lit(False)).collect()
    assert len(rows) == 5 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9 for r in rows)


def test_levels_and_packed_counts():
    assert lm.LEAST[0] == 1 and (np.diff(lm.LEAST) > 0).all()
    c = np.arange(1, 5000)
    q = lm.level_of(c)
    assert (lm.LEAST[q - 1] <= c).all() and (c < lm.LEAST[q]).all() and (np.abs(lm.MIDDLE[q] / c - 1) < 0.34).all()
    r = np.random.default_rng(1)
    names = r.integers(0, 1 << 62, 300, dtype=np.uint64) & lm._NAME
    many = np.repeat(names, r.integers(1, 400, 300))
    r.shuffle(many)
    rows = np.sort(np.concatenate([lm._packed(many[:9000], lm._SINGLE), lm._packed(many[9000:], lm._SINGLE)]))
    got, counts = lm._unpacked(rows)
    want = Counter((many | lm._SINGLE).tolist())
    assert dict(zip(got.tolist(), counts.tolist(), strict=True)) == want


def test_filter_has_no_false_negatives_and_few_false_positives():
    r = np.random.default_rng(2)
    names = np.unique(r.integers(0, 1 << 63, 60_000, dtype=np.uint64) & lm._NAME)
    inside, outside = names[::2], names[1::2]
    counts = np.minimum(r.zipf(1.7, len(inside)), 1 << 30)
    shift, parts = 60, []
    for k in np.unique(lm.segment_number(inside, shift)):
        own = lm.segment_number(inside, shift) == k
        parts.append((int(k), lm.segment(inside[own], counts[own])))
    r.shuffle(parts)
    bloom = lm.Filter(parts, shift)
    got = bloom.levels(inside)
    assert (got >= lm.level_of(counts)).all() and (got > lm.level_of(counts)).mean() < 0.02
    assert (bloom.levels(outside) > 0).mean() < 0.005
    assert sum(len(p) for _, p in parts) * 8 < (lm.BITS + 0.2) * lm.level_of(counts).sum() + 64 * len(parts)


def test_model_beats_single_tokens_on_held_out_text(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    follow = r.integers(0, 200, (200, 3))

    def text():
        at, out = int(r.integers(200)), []
        for _ in range(150):
            out.append(words[at])
            at = int(follow[at, r.integers(3)])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    rows = [x for x in lm.score_texts(docs, train()).collect() if x.held_out]
    assert rows and all(x.score > 0.6 * x.base_score for x in rows)
