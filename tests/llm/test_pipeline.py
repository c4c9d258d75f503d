import itertools
import math
import re
from collections import Counter

import corpus_pipeline
from tests.llm.conftest import SF, invented
from tests.llm.test_ngram_join import brute
from tests.llm.test_text_operators import reference_packing_holds
from tomoframe.llm import quality_rules, shared, toxicity


def test_stages_in_turn(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        from tomoframe.llm import shared

        docs = shared.stage_table(out, f"test{k}")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.select("doc_id").distinct().count() == counts[-1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_edge_rows(spark, edge_docs):
    import corpus_pipeline

    docs = edge_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == edge_docs.columns
    texts = [r.text for r in docs.collect()]
    assert len(texts) == len(set(texts)) and len(texts) >= 20


def plain_quality(text):
    """The rules of the first stage in plain Python, from the fixed references."""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    often = Counter(windows)
    repeats = len({i + d for i, w in enumerate(windows) if often[w] > 1 for d in range(5)})
    if n < 10 or 100 * repeats > 20 * n:
        return False

    def distance(p, q):
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max((half(p, q) + half(q, p)) / 2, 0))

    def kind(c):
        if c in "\x20\t\n\x0b\x0c\r":
            return 3
        if c in quality_rules.PUNCT:
            return 4
        if ord(c) > 127:
            return 6
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 5

    if len(text) >= quality_rules.MIN_CHARS:
        held = Counter(map(kind, text))
        share = [held[k] / len(text) for k in range(7)]
        if min(distance(share, ref) for ref in quality_rules.CLASS_REFERENCE.values()) > quality_rules.MAX_CLASS_DISTANCE:
            return False
    if n < quality_rules.MIN_WORDS:
        return True
    low = Counter("".join(c.lower() if c.isascii() else c for c in w) for w in words)
    nearest, fewer = 1.0, True
    for ref in quality_rules.WORD_REFERENCE.values():
        seen = [low[w] for w in ref]
        rest = 1 - sum(ref.values()) / 1000
        nearest = min(nearest, distance([k / n for k in seen] + [1 - sum(seen) / n], [v / 1000 for v in ref.values()] + [rest]))
        fewer = fewer and n - sum(seen) > n * rest
    more = any(sum(low[w] for w in ref) / n > quality_rules.STUFFED * sum(ref.values()) / 1000 for ref in quality_rules.WORD_REFERENCE.values())
    return not (nearest > quality_rules.MAX_WORD_DISTANCE and more) and not (nearest > quality_rules.MAX_LACK_DISTANCE and fewer)


def plain_subsequences(word):
    """Weight of each subsequence of three letters of a word: a run of other characters is one place."""
    letters, place, before = [], 0, True
    for c in word:
        if c.isalnum() or before:
            place += 1
        before = c.isalnum()
        if c.isalnum():
            letters.append((c, place))
    out = Counter()
    for a, b, c in itertools.combinations(range(len(letters)), 3):
        if c - a < toxicity.SPAN:
            out[letters[a][0] + letters[b][0] + letters[c][0]] += toxicity.DECAY ** (letters[c][1] - letters[a][1] + 1)
    return out, letters


def plain_score(text, model, kept):
    """Score of a text under a trained model: every word against every landmark, subsequence by subsequence."""
    best = None
    for w in {w for s in toxicity.sentences(text) for w in s}:
        if w not in kept:
            own, letters = plain_subsequences(w)
            # a word's own length counts each occurrence of a subsequence by itself
            square = sum(toxicity.DECAY ** (2 * (letters[c][1] - letters[a][1] + 1)) for a, _, c in itertools.combinations(range(len(letters)), 3) if c - a < toxicity.SPAN)
            total = 0.0
            for k, mark in enumerate(model.landmarks):
                other = kept.setdefault("\0" + mark, plain_subsequences(mark)[0])
                size = math.sqrt(sum(v * v for v in other.values())) or 1.0
                value = sum(x * other[s] for s, x in own.items() if s in other) / size / (math.sqrt(square) or 1.0)
                total += min(value, 1.0) ** toxicity.POWER * model.weight[k]
            kept[w] = total + model.bias
        best = kept[w] if best is None else max(best, kept[w])
    z = min(1.0, max(-1.0, model.bias if best is None else best)) * model.slope[0] + model.shift
    return 1 / (1 + math.exp(-z))


def test_run_against_plain_python(spark, tmp_path):
    """Every row of run() on planted cases: junk, insults, exact copies, near copies and clean texts, stage by stage."""
    import corpus_pipeline

    rows = [(i, invented(1000 + i, 90)) for i in range(160)]
    insults = ["idiot", "moron", "imbecile", "st.u.pid", "idioot", "stupid"]
    rows += [(200 + i, invented(2000 + i, 70) + f" you are such a {insults[i % 6]} and always were. " + invented(3000 + i, 20)) for i in range(90)]
    rows += [(400 + i, rows[i][1]) for i in range(12)] + [(430 + i, rows[0][1]) for i in range(9)]
    rows += [(450 + i, rows[20 + i % 3][1].replace(rows[20 + i % 3][1].split()[40 + i], f"changed{i}", 1)) for i in range(15)]
    rows += [(500, "too short"), (501, None), (502, ""), (503, "the same words here again " * 40), (504, "|| ## $$ %% && ** <> " * 30), (506, " ".join(["at", "from", "or", "an", "are", "this", "with", "by"][(k * k + k // 3) % 8] for k in range(300))), (505, "zzqx " + " ".join(f"qwv{i}xk" for i in range(80)))]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(200 <= i < 290)) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    left = [(i, t or "") for i, t in rows if plain_quality(t or "")]
    assert {i for i, _ in rows} - {i for i, _ in left} >= {500, 501, 502, 503, 504, 505} and {i for i, _ in left} >= set(range(160))
    model = toxicity.train(docs.where(docs.doc_id.isin([i for i, _ in left])), labels)
    words = {}
    scores = {i: plain_score(t, model, words) for i, t in left}
    assert max(abs(a - scores[i]) for (i, t), a in zip(left, model.scores([t for _, t in left]), strict=True)) < 1e-9
    left = [(i, t) for i, t in left if scores[i] < toxicity.THRESHOLD]
    assert {i for i, _ in left} >= set(range(160)) and sum(200 <= i < 290 for i, _ in left) < 20
    last = {t: max(i for i, u in left if u == t) for _, t in left}
    left = [(i, t) for i, t in left if last[t] == i]
    component = {i: c for i, _, c in brute(left)}
    left = [(i, t) for i, t in left if component[i] == i]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left}
    lengths = reference_packing_holds(left, got, 2048)
    assert sum(n < 2048 for n in lengths) <= 1


def test_run_on_empty_tables(spark, tmp_path, no_docs):
    import corpus_pipeline

    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_sweeps_after_every_stored_stage(spark, monkeypatch):
    """The driver's heap and the shuffle files of a stage do not wait for those of the next ones."""
    swept = []
    monkeypatch.setattr(shared, "sweep", lambda s: swept.append(s))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("same", lambda spark, docs, sf_dir: docs)] * 3)
    assert corpus_pipeline.run(spark, SF).count() == shared.read(spark, SF, "documents").count()
    assert len(swept) == 2
