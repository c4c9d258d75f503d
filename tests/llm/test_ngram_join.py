import os
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import edge_rows, invented
from tomoframe.llm import ngram_join, shared


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def brute(rows, percent=80):
    sets = defaultdict(set)
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(i, shingles(t)) for i, t in rows]
    for i, _ in items:
        parent.setdefault(i, i)
    for a in range(len(items)):
        for b in range(a):
            (i, s), (j, t) = items[a], items[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in items}


def result(df, **k):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, **k).collect()}


def test_edge_rows(edge_docs):
    rows = [(i, t) for i, t in edge_rows() if i is not None]
    got = {x for x in result(edge_docs) if x[0] is not None}
    assert got == brute(rows)
    assert edge_docs.count() == ngram_join.near_duplicates(edge_docs).count()


def test_empty(no_docs):
    assert result(no_docs) == set()


def test_against_brute_force_on_documents(small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    assert result(small) == brute(rows)


def mutated(seed):
    """Families at many distances, passages that unlike documents share, one large near-copy group."""
    r = random.Random(seed)
    passage = invented(900 + seed, 60)
    rows, k = [], 0
    for f in range(12):
        words = invented(seed * 100 + f, r.choice((12, 40, 150))).split()
        for _ in range(r.randint(1, 6)):
            w = list(words)
            for _ in range(r.choice((0, 1, 2, 3, 5))):
                w[r.randrange(len(w))] = r.choice(["changed", "words", "here"])
            rows.append((k, " ".join(w)))
            k += 1
    for f in range(25):  # mostly the passage, with a part of their own around the threshold
        rows.append((k, invented(seed * 1000 + f, r.choice((3, 8, 12, 15, 20, 40))) + "\n" + passage))
        k += 1
    big = invented(7777 + seed, 200).split()
    for f in range(60):
        w = list(big)
        w[f * 3] = f"own{f}"
        rows.append((k, " ".join(w)))
        k += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families_passages_and_hot_group(spark, seed, monkeypatch):
    rows = mutated(seed)
    monkeypatch.setattr(ngram_join, "GROUP_MEMBERS", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(df) == brute(rows)


def test_matrix_alone_finds_all_links(spark, monkeypatch):
    """Without pivots the matrix must find every component by itself."""
    rows = mutated(3)
    monkeypatch.setattr(ngram_join, "_pivot_links", lambda sets, percent: sets.selectExpr("rep AS src", "rep AS dst", "true AS linked").where("false"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df) == brute(rows)


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_any_share_of_first_tokens_gives_the_same_links(spark, share):
    rows = mutated(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df, first_share=share) == brute(rows)


def test_first_tokens_hold_the_bound():
    """A linked set has at least `need` of its first tokens among the other's first tokens."""
    r = np.random.default_rng(5)
    for n in (1, 2, 4, 5, 9, 40, 300):
        for _ in range(40):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = a.copy()
            change = int(r.integers(0, n // 5 + 1))
            b[r.choice(len(b), change, replace=False)] += np.uint64(1)
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                (x, y), need = ngram_join._first_tokens([a, b], 80, 0.4)
                assert len(np.intersect1d(x, y)) >= max(need)


def test_hot_tokens_are_told_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_HOT", 3)
    monkeypatch.setattr(ngram_join, "HOT_TOKENS", 1_000_000)
    rows = mutated(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == brute(rows)


def test_rows_without_id_link(spark):
    base = invented(31, 90)
    near = base.replace(base.split()[20], "changed", 1)
    bare = invented(32, 90)
    rows = [(7, base), (None, near), (None, bare), (None, bare.replace(bare.split()[20], "changed", 1)), (9, invented(33, 50))]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 7), (7, 7), (9, 9)]


def test_word_hash_depends_on_words_only():
    from tomoframe.llm.arrow_text import WordHasher

    h = WordHasher()
    a, n = h(["one two  three", "", "\x0bthree\ttwo"])
    assert list(n) == [3, 0, 2] and a[2] == a[3] and a[1] == a[4] and len(set(a.tolist())) == 3


def _shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_sweep_lets_shuffle_files_of_stored_stages_go(spark):
    """The files of a stage whose result is written are gone soon after the sweep, not when a heap fills."""
    old = _shuffle_files(spark)
    shared.stage_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    new = _shuffle_files(spark) - old
    assert new
    until = time.time() + 20
    while new & _shuffle_files(spark) and time.time() < until:
        spark.range(8).collect()  # threads keep hold of the last job until the next one
        shared.sweep(spark)
        time.sleep(0.2)
    assert not new & _shuffle_files(spark)


def test_shuffle_files_go_with_the_step_that_wrote_them(spark, edge_docs, monkeypatch):
    """Without any sweep of the heap, no shuffle file outlives the step that wrote it, and the session keeps its setting."""
    monkeypatch.setattr(shared, "sweep", lambda s: None)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, before = _shuffle_files(spark), spark.conf.get(key)
    left, stage = [], shared.stage_table

    def stored(df, name):
        out = stage(df, name)
        left.append(len(_shuffle_files(spark) - old))
        return out

    monkeypatch.setattr(shared, "stage_table", stored)
    ngram_join.near_duplicates(edge_docs)
    assert len(left) > 8
    assert not any(left)
    assert spark.conf.get(key) == before
