"""A training corpus from `documents`: quality, toxicity, exact and near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.llm import arrow_text, exact_dedup, ngram_join, packing, quality_rules, shared, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""

    def make():  # noqa: ANN202
        judge = quality_rules.Judge(quality_rules.MIN_CHARS, quality_rules.MIN_WORDS, quality_rules.MAX_CLASS_DISTANCE, quality_rules.MAX_WORD_DISTANCE)
        return lambda texts: judge(texts)["kept"].to_numpy(zero_copy_only=False)

    return arrow_text.filter_texts(docs, make)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject."""
    model = toxicity.train(docs, shared.read(spark, sf_dir, "labels"))
    return arrow_text.filter_texts(docs, lambda: lambda texts: model.scores(texts) < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    decided = shared.stage_table(exact_dedup.exact_dedup(docs), "decided")
    gone = decided.where("NOT kept AND NOT doc_id <=> keep_id").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(shared.text_or_empty().cast("binary"), 256)
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (sha == gone["__sha"]), "left_anti")
    if not decided.where("NOT kept AND doc_id <=> keep_id").isEmpty():  # the same doc_id and text twice
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, the document that names it (the smallest doc_id)."""
    found = ngram_join.near_duplicates(docs)
    gone = shared.stage_table(found.where("doc_id <> component_id").select("doc_id"), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", apart),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.stage_table(docs, f"stage{k}")
            shared.sweep(spark)
    return docs


#: A trained model decides in the second stage, which SQL cannot express.
ORACLE_SQL = None
