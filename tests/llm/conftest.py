import random

import pytest

#: Column names that clash with names the operators use inside.
CLASHING = ("row", "label", "node", "pos", "__t", "ids", "n", "shard", "component", "score", "digest", "route")


def invented(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4)))
        w = r.choice(["the", "of", "and", "to", "in", w, w, w])
        out.append(w + (". " if i % 11 == 10 else " ") + ("\n" if i % 40 == 39 else ""))
    return "".join(out).strip()


def edge_rows() -> list[tuple]:
    base = invented(1, 120)
    near = base.replace(base.split()[30], "changed", 1)
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, "one two"),
        (9, invented(2, 30_000)), (10, "é" * 50 + " ünï — ñ 你好 \U0001f600 ▁x"), (11, "a\x0bb\x0cc\rd\x85e\xa0f"), (12, "x" * 20_000),
        (13, base.upper()), (14, "the same line\n" * 50), (15, "|| $$ ## && ** %% <> " * 30), (16, "you idiot idiot. " + invented(3, 60)),
        (2, base), (None, invented(4, 40)), (17, "<|endoftext|> and <s> </s> <unk>"), (18, "Licensed under CC BY-NC 4.0."), (19, "\n\n\n"),
    ]
    return rows + [(100 + k, invented(50 + k, 80)) for k in range(20)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*r, "en", "src", None, *["z"] * len(CLASHING)) for r in edge_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


SF = "/root/testdata/sf0.001"
