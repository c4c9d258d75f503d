import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SF, edge_rows, invented
from tomoframe.llm import html_blocks, html_extract, html_training, ordinal_quality, packing, pieces, quality_rules, toxicity


def brute_repeats(words):
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    return len({i + d for v in seen.values() if len(v) > 1 for i in v for d in range(5)})


def test_quality_base_signals(edge_docs):
    import re

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge_quality(edge_docs).collect())
    want = Counter()
    for i, t in edge_rows():
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = brute_repeats(words)
        want[(i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(words) < 10 or 100 * rep > 20 * len(words))] += 1
    assert got == want


def test_repeated_words_with_a_huge_vocabulary():
    r = np.random.default_rng(2)
    ids = np.concatenate([np.arange(30_000), np.arange(100, 140), r.permutation(30_000)])
    words = list(map(str, ids))
    assert quality_rules.repeated_words(ids, 30_000) == brute_repeats(words)


def test_quality_verdict_separates_junk(spark, no_docs):
    clean = invented(5, 300)
    rows = [(1, clean), (2, clean.upper()), (3, clean.replace(" ", "$$$ ")), (4, "the of and to"), (5, None)]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert quality_rules.judge_quality(no_docs).count() == 0


def test_quality_rejects_text_without_common_words():
    r = np.random.default_rng(4)
    names = [f"{a}{b}{c}" for a in ("ther", "lin", "mor", "sta") for b in ("eda", "oni", "ure") for c in ("tion", "ble", "ning", "ral")]
    salad = " ".join(r.choice(names) + (". " if i % 12 == 11 else "") for i in range(300))
    words = [w for w, k in quality_rules.WORD_REFERENCE["en"].items() for _ in range(k)]
    prose = " ".join(r.choice(words if i % 3 == 0 else names) for i in range(300))
    judge = quality_rules.Judge(quality_rules.MIN_CHARS, quality_rules.MIN_WORDS, quality_rules.MAX_CLASS_DISTANCE, quality_rules.MAX_WORD_DISTANCE)
    bad, good, stuffed = judge.one(salad), judge.one(prose), judge.one(invented(5, 300))
    assert not bad[5] and bad[7] <= quality_rules.MAX_CLASS_DISTANCE and bad[8] <= quality_rules.MAX_WORD_DISTANCE
    assert not bad[6] and good[6] and stuffed[6]
    assert judge.one(" ".join(salad.split()[:40]))[6]  # too short for the word test


def test_each_word_rule_rejects_what_the_other_keeps():
    r = np.random.default_rng(6)
    names = [f"{a}{b}{c}" for a in ("ther", "lin", "mor", "sta") for b in ("eda", "oni", "ure") for c in ("tion", "ble", "ning", "ral")]
    lacking = " ".join(r.choice(names, 300))
    stuffed = " ".join(r.choice(["at", "from", "or", "an", "are", "this"], 300))
    far, lack = quality_rules.MAX_WORD_DISTANCE, quality_rules.MAX_LACK_DISTANCE
    judge = lambda a, b: quality_rules.Judge(quality_rules.MIN_CHARS, quality_rules.MIN_WORDS, 1.0, a, b)
    assert not judge(1.0, lack).one(lacking)[6] and judge(far, None).one(lacking)[6]
    assert judge(1.0, lack).one(stuffed)[6] and not judge(far, None).one(stuffed)[6]


def test_quality_against_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge_quality(docs).join(labels, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.1


def reference_packing_holds(rows, got, window):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    by_doc = defaultdict(list)
    for r in got:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    want = Counter()
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        want[(i, len(ids))] += len(ids)
        at = 0
        data = np.array(ids, "<u4").tobytes()
        for p in sorted((p for p in by_doc[(i, len(ids))]), key=lambda p: (p.start, p.sequence_id)):
            if p.start == at and zlib.crc32(data[4 * at : 4 * (at + p.length)]) == p.ids_crc32:
                at += p.length
        assert at == len(ids), (i, at, len(ids))
    assert Counter({k: sum(p.length for p in v) for k, v in by_doc.items()}) == want
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append(r)
    for v in seq.values():
        at = 0
        for p in sorted(v, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
    return [sum(p.length for p in v) for v in seq.values()]


def test_packing_edge_rows(edge_docs, no_docs):
    got = packing.pack(edge_docs, packing.tokenizer_path()).collect()
    lengths = reference_packing_holds(edge_rows(), got, 2048)
    assert sum(n < 2048 for n in lengths) <= 1
    assert packing.pack(no_docs, packing.tokenizer_path()).count() == 0


def test_packing_documents(small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    lengths = reference_packing_holds(rows, packing.pack(small.repartition(5), packing.tokenizer_path()).collect(), 2048)
    assert sum(n < 2048 for n in lengths) <= 1


def test_byte_encoder_equals_the_library():
    enc = packing.ByteEncoder(packing.tokenizer_path())
    odd = ["a  b\n\n c", "don't I'll we've", "x²³½ ١٢٣  y", "tab\t\tz  ", "\x1cq", "naïve Straße ŀ", "<|endoftext|>x", "", " ", "12,345.6  7", "ªº µ", "¡hola! «x»"]
    for t in odd + [x or "" for _, x in edge_rows()]:
        want = np.array(enc.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc(t) == want, t[:40]


def test_pieces_equal_the_library(edge_docs, no_docs, small):
    import sentencepiece

    path = packing.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (edge_docs, small):
        rows = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = sp.encode(r.text or "")
            rows[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += 1
        got = Counter(tuple(r) for r in pieces.encode_pieces(df, path, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
        assert got == rows
    plain = pieces.encode_pieces(edge_docs.where("doc_id = 1"), path).first()
    assert plain.ids == sp.encode(edge_rows()[0][1]) and plain.decoded == edge_rows()[0][1]
    assert pieces.encode_pieces(no_docs, path).count() == 0


def test_agenda_on_odd_strings():
    v = pieces.Vocabulary(packing.tokenizer_path("piece_bpe_32k.model"))
    e = pieces.Encoder(packing.tokenizer_path("piece_bpe_32k.model"))
    odd = ["a", " ", "   ", "\n", "\n\n  x\t y", "▁▁a ▁", "aaaaaaaaaaaaaaaaaaaaa", "ﬁ ｘ 　 \x00 ‍", "🙂🙃 中文 العربية", "x y", "<s>", "<0x0A>"]
    assert [[int(i) for i in x[1].split(",")] for x in e.batch(odd)] == v.library.encode(odd)
    assert [x[2] for x in e.batch(odd)] == [v.library.decode(x) for x in v.library.encode(odd)]


def test_toxicity_tolerates_gaps_and_inserted_characters():
    k = toxicity.SubsequenceKernel(["idiot", "moron", "thousand"])
    v = k(["idiot", "id-iot", "i.d.i.o.t", "idxiot", "table", "thoughts", ""])
    assert v[0, 0] > 0.99 and v[1, 0] > 5 * v[4, 0] + 0.1 and v[3, 0] > 0.15
    assert v[2, 0] > v[4, 0] and v[4, 0] < 0.01 and (v[6] == 0).all()
    assert toxicity.sentences("you i d i o t now")[0] == ["you", "idiot", "now"]


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score_toxicity(labelled, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = [r.predicted for r in got if r.toxic == 1]
    false = [r.predicted for r in got if r.toxic == 0]
    # about one toxic label in seven of this table is on a text without any insult
    assert np.mean(hit) > 0.7 and np.mean(false) < 0.02, (np.mean(hit), np.mean(false))


def test_toxicity_kernel_outlives_gaps():
    k = toxicity.SubsequenceKernel(["idiot", "scum"])
    assert (k(["i.d.i.o.t", "i**d**i**o**t", "i-----diot"])[:, 0] > 0.8).all() and k(["s.c.u.m"])[0, 1] > 0.8
    assert k(["idxiot"])[0, 0] > 0.4
    long = "id" * 50_000
    assert np.isfinite(k([long, "x." * 30_000, "idiot"])).all() and k([long, "idiot"])[1, 0] > 0.99
    # a long word in runs has the same subsequences as in one
    got = np.hstack([at + part for at, part in toxicity._triples(20_000)])
    assert len({tuple(x) for x in got.T[::97]}) == len(got.T[::97]) and got.shape == toxicity._whole(20_000).shape


def test_toxicity_kernel_has_no_bound_on_alphabet_or_length():
    wide = [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k) for k in range(200)] + ["idiot", "x" * 3 + "abcdefghijklmnopqrstuvwxyz" * 2]
    k = toxicity.SubsequenceKernel(wide)
    assert k.row is None
    assert np.allclose(np.diag(k(wide)), 1) and k([wide[199], "idiot"])[0, 199] > 0.99 and k(["i.d.i.o.t"])[0, 200] > 0.8


def test_toxicity_finds_a_single_disguised_insult(spark):
    d = "/root/testdata/sf0.1"
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    text = invented(5, 60)
    insults = ["idiot", "i.d.i.o.t", "s.t.u.p.i.d", "m.o.r.o.n", "i**d**i**o**t", "sc*um", "mor-on", "idxiot", "stuxpid", "worthxless"]
    got = dict(zip(insults, model.scores([f"{text} {w} {text}" for w in insults]) >= toxicity.THRESHOLD, strict=True))
    assert all(got.values()), got
    assert model.scores([text])[0] < toxicity.THRESHOLD


def test_toxicity_edges(spark, edge_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(edge_docs, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.doc_id: r.held_out for r in got}[7] == (zlib.crc32(b"7") % 3 == 1)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    none = toxicity.train(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.score_toxicity(edge_docs, none).collect()} == {0}


def test_ordinal_thresholds_and_ranking(spark, edge_docs, no_docs):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = ordinal_quality.train(docs, ordinal_quality.rated(labels))
    assert (np.diff(model.thresholds) > 0).all()
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = ordinal_quality.grade_documents(labelled, model).join(ordinal_quality.rated(labels), "doc_id").where("held_out").collect()
    means = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in range(3)]
    assert means[0] < means[2] and means[0] < means[1]
    assert means[1] < means[2], means
    for k in (1, 2):  # the order at each threshold
        tail = np.array([r[f"tail_{k}"] for r in got])
        above = np.array([r.grade >= k for r in got])
        place = np.argsort(np.argsort(tail)) + 1
        n = above.sum()
        assert (place[above].sum() - n * (n + 1) / 2) / (n * (len(got) - n)) >= 0.8
    right = np.mean([r.selected == (r.grade > 0) for r in got])
    assert right > 0.9, right
    edge = ordinal_quality.grade_documents(edge_docs, model).collect()
    assert len(edge) == len(edge_rows()) and all(r.tail_1 >= r.tail_2 for r in edge)
    assert ordinal_quality.grade_documents(no_docs, model).count() == 0
    none = ordinal_quality.train(docs, ordinal_quality.rated(labels.where("false")))
    assert {r.tail_1 for r in ordinal_quality.grade_documents(edge_docs, none).collect()} == {0.5}


def test_html_blocks():
    got = html_blocks.blocks("<div class='aB c'>x <b>y</b>&amp;z<p>one<br>two<p>three</div>tail<!-- no --><script>var a='<p>';</script><a href=x>link</a> t &am")
    assert [b.text for b in got] == ["x y&z", "one two", "three", "tail link t &am"]
    assert got[0].path == ("div", ".a", ".b", ".c") and abs(got[3].linked - 4 / 15) < 1e-9
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<<<>") != [] and html_blocks.blocks("<p") == []


def test_block_vectors_read_whole_blocks():
    head = " ".join(f"word{i}" for i in range(60))
    a, b = html_extract.vectors(html_blocks.blocks(f"<p>{head} {'tail ' * 40}</p><p>{head} {'rest ' * 40}</p>"))
    words = slice(html_extract.PATH_SIZE, html_extract.PATH_SIZE + html_extract.WORD_SIZE)
    assert not np.allclose(a[words], b[words]) and a[words].sum() == pytest.approx(100 / 101)


@pytest.fixture(scope="module")
def net():
    return html_extract.train()


def test_block_labeller_on_unseen_pages(net):
    pages = [html_training.page(55_000_000 + k) for k in range(150)]
    got = html_extract.extract(net, [p[0] for p in pages])
    same = np.mean([g == "\n".join(" ".join(k.split()) for k in keep) for g, (_, keep) in zip(got, pages, strict=True)])
    assert same > 0.85, same


@pytest.mark.parametrize("layout", ["table", "section"])
def test_block_labeller_on_whole_layout_families(net, layout):
    pages = [html_training.page(66_000_000 + k, layout) for k in range(100)]
    got = html_extract.extract(net, [p[0] for p in pages])
    same = np.mean([g == "\n".join(" ".join(k.split()) for k in keep) for g, (_, keep) in zip(got, pages, strict=True)])
    assert same > 0.75, same


def test_block_labeller_on_written_pages(net):
    prose = "This is the first paragraph of a story, with some length to it. It goes on for another sentence."
    bare = f"<html><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><section><h2>A heading of the story</h2><p>{prose}</p><dl><dt>Term</dt><dd>What the term means here.</dd></dl></section><footer><p>All rights reserved.</p></footer></body></html>"
    table = f"<html><body><table><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr></table><table><tr><td><h1>A title of the page</h1><p>{prose}</p><p>{prose}</p></td></tr></table></body></html>"
    got = html_extract.extract(net, [bare, table])
    assert got[0] == f"A heading of the story\n{prose}\nTerm\nWhat the term means here."
    assert got[1] == f"A title of the page\n{prose}\n{prose}"


def test_block_labeller_gradients():
    r = np.random.default_rng(3)
    net = html_extract.BlockLabeller.fresh(1)
    for f in ("wx", "wh", "b", "out"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    x, mask = r.standard_normal((4, 2, html_extract.INPUT)), np.ones((4, 2, 1))
    mask[3, 1] = 0
    y = (r.random((4, 2)) > 0.5).astype(float)
    _, grads = net.gradients(x, mask, y)
    for p, g in zip((net.wx, net.wh, net.b, net.out), grads, strict=True):
        at = tuple(r.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-4
        up = net.gradients(x, mask, y)[0]
        p[at] = old - 1e-4
        down = net.gradients(x, mask, y)[0]
        p[at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-3


def test_extract_pages(spark, net):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_extract.extract_pages(pages, net).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    import html as h
    import re

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert by[r.page_id] == "\n".join(x for x in want if x)
    odd = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "", "x"), (2, None, "<p>" * 3000, "x"), (None, "v", "plain", "x"), (3, "w", "<article><p>" + "long text here. " * 20_000 + "</p></article>", "x")], "page_id long, url string, html string, text string")
    out = html_extract.extract_pages(odd, net).collect()
    assert len(out) == 5 and {r.text for r in out if r.page_id == 1} == {""}
    assert html_extract.extract_pages(odd.where("false"), net).count() == 0
