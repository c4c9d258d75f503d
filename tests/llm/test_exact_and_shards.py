import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import edge_rows
from tomoframe.llm import exact_dedup, licenses, sharding


def test_exact_dedup_against_brute_force(edge_docs):
    got = exact_dedup.exact_dedup(edge_docs, min_chars=16, max_chars=64).collect()
    groups = defaultdict(list)
    for i, t in edge_rows():
        groups[t or ""].append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(edge_rows())
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_chunks_join_to_the_text(spark, edge_docs):
    out = edge_docs.select("text", exact_dedup.content_chunks(edge_docs["text"], 16, 64).alias("c")).where("text is not null").collect()
    assert all("".join(r.c) == r.text for r in out)
    assert all(len(c) <= 64 for r in out for c in r.c)


def test_a_shared_passage_gives_shared_chunks(spark):
    from pyspark.sql import functions as F

    tail = "Common sentence that is long. " * 40
    df = spark.createDataFrame([("Start one is here. " + tail,), ("Another longer start is over there. " + tail,)], "text string")
    a, b = [set(r.c) for r in df.select(exact_dedup.content_chunks(F.col("text"), 16, 64).alias("c")).collect()]
    assert len(a & b) >= 1


def test_clashing_chunk_names_are_widened(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = exact_dedup.recipes

    def weak(*a, **k):
        return real(*a, **k).withColumn("names", F.transform("names", lambda _: F.lit(1).cast("long")))

    monkeypatch.setattr(exact_dedup, "recipes", weak)
    df = spark.createDataFrame([(1, "a. b"), (2, "a. c"), (3, "a. b")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df, min_chars=1, max_chars=2).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def test_groups_come_from_the_recipe_alone(spark, monkeypatch):
    """Without the digest of the text, and with hot groups, the groups are the same."""
    from pyspark.sql import functions as F

    real = exact_dedup.recipes
    monkeypatch.setattr(exact_dedup, "recipes", lambda *a, **k: real(*a, **k).withColumn("text_sha256", F.lit("none")))
    rows = [(i, f"copy number one. {'x' * 40}. end") for i in range(1500)] + [(5000 + i, f"text {i % 40}. {'y' * (i % 7)}.\nend") for i in range(200)] + [(9000, None), (9001, "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=4, max_chars=16).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(rows)


def test_empty_tables(no_docs, spark):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert sharding.balanced_shards(no_docs).count() == 0
    assert licenses.scan_licenses(no_docs, licenses.known_licenses(spark)).count() == 0


def test_shards_hold_the_law(edge_docs):
    got = sharding.balanced_shards(edge_docs, shards=4).collect()
    rows = edge_rows()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(4)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_propagation_cuts_fewer_links_than_hashing(spark):
    from pyspark.sql import functions as F

    lines = [[f"family {f} line number {k} of the shared text" for k in range(6)] for f in range(40)]
    rows = [(f * 10 + j, "\n".join(lines[f][j % 3 : j % 3 + 3] + [f"own line {f} {j} that nobody shares at all"])) for f in range(40) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = sharding.balanced_shards(docs, shards=8)
    mine = sharding.cut_weight(docs, placed).first()
    hashed = docs.select("doc_id", F.pmod(F.hash("doc_id"), F.lit(8)).alias("shard"))
    other = sharding.cut_weight(docs, hashed).first()
    assert mine.links == other.links and mine.cut < 0.35 * other.cut


def test_propagation_improves_on_the_start_order(spark):
    import random

    r = random.Random(8)
    topic = lambda f: "\n".join(f"topic {f} has the line number {k} in common" for k in r.sample(range(12), 4))
    texts = [topic(f) + f"\n{j}" for f in range(12) for j in range(20)] + [f"text {j} that shares no line with any other" for j in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    cuts = []
    for rounds in (0, sharding.ROUNDS):
        placed = sharding.balanced_shards(docs, shards=8, rounds=rounds)
        counts = [x["count"] for x in placed.groupBy("shard").count().collect()]
        assert sum(counts) == len(texts) and len(counts) == 8 and max(counts) - min(counts) <= 1
        cuts.append(sharding.cut_weight(docs, placed).first().cut)
    assert cuts[1] < 0.85 * cuts[0], cuts


def test_unlinked_nodes_trade_places_with_one_way_wishes(spark):
    linked = [(f"a{k}", 1, True, 0) for k in range(30)] + [(f"b{k}", 1, True, 1) for k in range(20)]
    label = spark.createDataFrame(linked + [(f"c{k}", 1, False, 0) for k in range(20)], "node string, w long, linked boolean, label int")
    edges = label.where("linked").selectExpr("node", "w", "1L AS line")
    got = Counter((r.node[0], r.label) for r in sharding._propagate(edges, label, 2, 1).collect())
    assert got == {("a", 0): 30, ("b", 0): 20, ("c", 1): 20}


def plain_round(edges, label, unit, shards):
    """One round of propagation in plain Python: (node, label) after it, from rows of edges and labels and each node's unit number."""
    at = {r.node: r for r in label}
    held, lines = defaultdict(lambda: [0] * shards), defaultdict(list)
    for e in edges:
        held[e.line][at[e.node].label] += e.w
        lines[e.node].append(e.line)
    wish = {}
    for node, own in lines.items():
        votes = [sum(held[x][s] * sharding.VOTE // sum(held[x]) for x in own) for s in range(shards)]
        to, here = votes.index(max(votes)), at[node].label
        gain = votes[to] - votes[here]
        if gain > 0 and to != here:
            wish[node] = (here, to, min(math.floor(math.log2(1 + gain / sharding.VOTE) * 4), sharding.GAIN_BUCKETS - 1))
    flow, total, free = Counter(), Counter(), Counter()
    for node, (here, to, bucket) in wish.items():
        flow[here, to, bucket] += at[node].w
        total[here, to] += at[node].w
    for r in label:
        if not r.linked:
            free[r.label] += r.w
    over = {k: max(0, n - total[k[::-1]]) for k, n in total.items()}
    part = {to: min(1.0, free[to] / sum(n for k, n in over.items() if k[1] == to)) if sum(n for k, n in over.items() if k[1] == to) else 0.0 for to in range(shards)}
    trade = {k: n * part[k[1]] for k, n in over.items()}
    moved = {}
    for node, (here, to, bucket) in wish.items():
        before = sum(n for (a, b, c), n in flow.items() if (a, b) == (here, to) and c > bucket)
        share = (total[to, here] + trade[here, to] - before) / flow[here, to, bucket]
        if unit[node] < max(0.0, min(1.0, share)):
            moved[node] = to
    for r in label:
        if not r.linked:
            until = 0.0
            for here in range(shards):
                if trade.get((here, r.label), 0) > 0:
                    width = trade[here, r.label] / free[r.label]
                    until += width
                    if until - width <= unit[r.node] < until:
                        moved[r.node] = here
                        break
    return {r.node: moved.get(r.node, r.label) for r in label}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_round_against_plain_python(spark, seed):
    r = random.Random(seed)
    label = spark.createDataFrame([(f"n{k}", r.randint(1, 3), k < 120, r.randrange(4)) for k in range(200)], "node string, w long, linked boolean, label int")
    weight = {x.node: x.w for x in label.collect()}
    pairs = {(f"n{k}", r.randrange(30)) for k in range(120) for _ in range(3)}
    edges = spark.createDataFrame([(n, weight[n], x) for n, x in sorted(pairs)], "node string, w long, line long")
    unit = {x.node: x.u for x in label.selectExpr("node", "pmod(xxhash64(node, 1), 1000003) / 1000003D AS u").collect()}
    want = plain_round(edges.collect(), label.collect(), unit, 4)
    got = {x.node: x.label for x in sharding._propagate(edges, label, 4, 1).collect()}
    assert got == want and any(got[x.node] != x.label for x in label.collect())


def test_license_variants_share_a_digest(spark):
    from tomoframe.llm.license_texts import TEXTS

    text = TEXTS["MIT"]
    variants = [text, "Copyright (c) 2020 Jane Roe\n\n" + text.upper(), text.replace("sublicense", "sub-license").replace(",", ";"), "(c) 1999 X\nAll rights reserved.\n" + text.replace("\n", "  \n")]
    rows = [(i, t) for i, t in enumerate(variants)] + [(9, text + " and more"), (10, None)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).where("unit = 'text'").collect()
    assert {r.doc_id: r.license_id for r in got} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 9: None, 10: None}


def test_two_ids_on_one_digest_give_one_row(spark):
    from pyspark.sql import functions as F

    known = licenses.known_licenses(spark)
    twice = known.unionByName(known.where("license_id = 'MIT'").withColumn("license_id", F.lit("AAA")))
    from tomoframe.llm.license_texts import TEXTS

    got = licenses.scan_licenses(spark.createDataFrame([(1, TEXTS["MIT"])], "doc_id long, text string"), twice).collect()
    assert [(r.doc_id, r.unit, r.license_id) for r in got] == [(1, "text", "AAA")]


def test_identifier_lines_of_every_known_license(spark):
    from tomoframe.llm.license_texts import DIGESTS, NOTICES, TEXTS

    ids = sorted({*TEXTS, *DIGESTS, *NOTICES})
    text = "\n".join(f"// SPDX-License-Identifier: {x}" for x in ids)
    got = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), licenses.known_licenses(spark)).where("unit = 'line'")
    assert [r.license_id for r in got.orderBy("line_no").collect()] == ids


def test_license_notice_lines(edge_docs, spark):
    got = licenses.scan_licenses(edge_docs, licenses.known_licenses(spark))
    assert got.where("unit = 'text'").count() == len(edge_rows())
    assert {(r.doc_id, r.license_id) for r in got.where("license_id is not null").collect()} == {(18, "CC-BY-NC-4.0")}


def test_stage_tables_are_released(spark):
    from tomoframe.llm import shared

    shared.release(spark)
    kept = shared.stage_table(spark.range(3), "a")
    assert kept.count() == 3 and shared.release(spark) == 1 and shared.release(spark) == 0


def test_cluster_needs_a_shared_folder():
    import pytest

    from tomoframe.llm import shared

    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Fake())
