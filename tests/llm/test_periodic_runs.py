import hashlib
import random
import re
import zlib

import pytest

from tests.llm.conftest import SF, edge_rows
from tomoframe.llm import periodic_runs as pr


def brute_runs(x, least, periods):
    """Every run, from the stretches on which symbols p apart agree, the smallest period of each."""
    n, out = len(x), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            length = j + p - i
            if length >= 2 * p and not any(s <= i and i + length <= s + size and p % q == 0 for s, size, q in out.values()):
                out[(i, p)] = (i, length, p)
            i = j + 1
    return sorted((r for r in out.values() if r[1] >= max(least, periods * r[2])), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts():
    r = random.Random(1)
    yield from ([], [1], [1, 1], [3] * 40, fibonacci(120), [0, 1] * 30, [1, 0, 0] * 20, list(range(30)) * 3)
    for _ in range(250):
        n, k = r.randint(1, 60), r.randint(1, 3)
        yield [r.randrange(k) for _ in range(n)]
    for _ in range(100):
        x = []
        while len(x) < 80:
            part = [r.randrange(3) for _ in range(r.randint(1, 6))]
            x += part * r.randint(1, 6)
        yield x


@pytest.mark.parametrize(("least", "periods"), [(2, 2), (3, 3), (6, 4)])
def test_runs_against_brute_force(least, periods):
    for x in texts():
        assert pr.runs(x, least, periods) == brute_runs(x, least, periods), x


def test_next_smaller_suffixes():
    for x in texts():
        n = len(x)
        for reverse in (False, True):
            key = lambda i: [-c for c in x[i:]] + [1] if reverse else [*x[i:], -1]  # noqa: B023, E731
            after, common = pr.next_smaller(x, reverse)
            for i in range(n):
                j = next((j for j in range(i + 1, n) if key(j) < key(i)), n)
                assert after[i] == j
                if j < n:
                    m = 0
                    while j + m < n and x[i + m] == x[j + m]:
                        m += 1
                    assert common[i] == m


class Counted(int):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("make", [lambda n: [1] * n, fibonacci, lambda n: [0, 1] * (n // 2), lambda n: ([0] * 40 + [1]) * (n // 41), lambda n: [random.Random(7).randrange(2) for _ in range(n)], lambda n: (fibonacci(300) * (n // 300))[:n], lambda n: [1] * (n // 2) + [0] + [1] * (n // 2)])
def test_comparisons_grow_in_proportion(make):
    for reverse in (False, True):
        x = [Counted(c) for c in make(8000)]
        Counted.seen = 0
        pr.next_smaller(x, reverse)
        assert Counted.seen <= 6 * len(x)


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 6, 4)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *named, sha("".join(f"{s},{size},{p}\n" for s, size, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len((r.text or "").split()) < 700]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, pr.periodic_runs(docs, prepare=pr.planted).collect()), key=repr)
    want = sorted((brute_row(*r) for r in rows), key=repr)
    assert got == want and sum(r[1] for r in got) > 5


def test_edge_rows(spark, edge_docs, no_docs):
    short = lambda t: len((t or "").split()) < 3000
    rows = [r for r in edge_rows() if short(r[1])]
    got = sorted(map(tuple, pr.periodic_runs(edge_docs.where("coalesce(length(text), 0) < 25000"), prepare=pr.planted).collect()), key=repr)
    assert got == sorted((brute_row(*r) for r in rows if len(r[1] or "") < 25000), key=repr)
    assert pr.periodic_runs(edge_docs).count() == len(edge_rows())
    assert pr.periodic_runs(no_docs).count() == 0


def test_one_long_text_of_one_word(spark):
    row = pr.periodic_runs(spark.createDataFrame([(1, "la " * 200_000)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 200_000, 1)
