import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import SF, edge_rows
from tomoframe.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    have = [(i, Counter(w), len(w)) for i, w in ((i, words(t)) for i, t in docs) if w]
    n, total = len(have), sum(x[2] for x in have)
    df = Counter(t for _, c, _ in have for t in c)
    out = []
    for item_id, text in items:
        asked = words(text)
        scored = []
        for i, c, size in have:
            m = 75 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def got(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("shard_docs", [1, 7, 2048])
def test_edge_rows_against_brute_force(spark, edge_docs, shard_docs):
    items = [(1, edge_rows()[0][1][:200]), (2, "the of and and THE"), (3, None), (4, "nothingsuch"), (5, "  .. "), (1, "idiot \U0001f600 你好 ünï"), (6, "one two one")]
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, doc_id string, score string")
    assert got(ls.search(edge_docs, asked, shard_docs=shard_docs)) == brute(edge_rows(), items)


def test_many_ties_and_small_k(spark):
    docs = [(i, f"common w{i % 3} " + "common " * (i % 4)) for i in range(200, 0, -1)] + [(None, "common w1")]
    items = [(1, "common w1"), (2, "w0"), (3, "w2 w2")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 5, 300):
        assert got(ls.search(d, q, k=k, shard_docs=8)) == brute(docs, items, k)


def test_blocks_of_items_give_the_same(spark, small, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([tuple(r) for r in small.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got(ls.search(small, items)) == want
    monkeypatch.setattr(ls, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(ls, "WAVE_PAIRS", 9)
    assert got(ls.search(small, items, shard_docs=60)) == want


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got(ls.op12_lexical_search(spark, SF)) == Counter(con.execute(ls.SQL).fetchall())


def test_empty_tables(spark, small, no_docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ls.search(no_docs, items).count() == 0
    assert ls.search(small, items.where("false")).count() == 0


def test_bisection_gathers_documents_that_share_terms():
    r = np.random.default_rng(3)
    topics = np.arange(8).repeat(40)
    r.shuffle(topics)
    docs = [np.unique(np.concatenate([t * 50 + r.integers(0, 50, 20), 400 + r.integers(0, 100, 10)])) for t in topics]
    tree = ls.Bisection(docs, 500, depth=3)
    leaf = tree.leaves(np.array([len(d) for d in docs]), np.concatenate(docs))
    together = sum(max(Counter(topics[leaf == x].tolist()).values()) for x in set(leaf.tolist()))
    assert together > 0.8 * len(docs)
    cost = lambda where: sum(ls._cost(np.bincount(np.concatenate([docs[i] for i in np.flatnonzero(where == x)]), minlength=500), int((where == x).sum())).sum() for x in set(where.tolist()))
    assert cost(leaf) < 0.8 * cost(r.permutation(leaf))
