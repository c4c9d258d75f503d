"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so: a chunk ends at the first full
stop or line feed that follows at least `min_chars` characters, or after
`max_chars` if none comes.  Each chunk is named by a 64-bit hash; the chunk
dictionary verifies the names by the SHA-256 of all chunks that share one, and
where different chunks share a name it numbers them.  Texts are equal when
their ordered lists of verified identifiers are: that list alone makes the
groups.  A long text is read once and only its recipe is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomoframe.llm import shared

#: Groups of copies that may be met by broadcast.
HOT_GROUPS = 256


def content_chunks(text: Column, min_chars: int = 512, max_chars: int = 4096) -> Column:
    """Array of chunks whose concatenation is the text; [] for the empty text."""
    rule = f"(?s).{{{min_chars},{max_chars - 1}}}?[.\\n]|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def recipes(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 512, max_chars: int = 4096) -> DataFrame:
    """(doc_id, row, text_sha256, names, proofs): one row per input row."""
    text = shared.text_or_empty(text_col)
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256"),
        content_chunks(F.col("__text"), min_chars, max_chars).alias("__chunks"),
    )
    return cut.select(
        "doc_id",
        "row",
        "text_sha256",
        F.transform("__chunks", lambda c: F.xxhash64(c)).alias("names"),
        F.transform("__chunks", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("proofs"),
    )


def chunk_dictionary(recipe: DataFrame) -> DataFrame:
    """(name, uses, verified): verified is false where two different chunks share the name."""
    chunks = recipe.select(F.explode(F.arrays_zip("names", "proofs")).alias("c")).select("c.names", "c.proofs")
    proof = chunks.groupBy(F.col("names").alias("name")).agg(F.count("*").alias("uses"), F.min("proofs").alias("lo"), F.max("proofs").alias("hi"))
    return proof.select("name", "uses", (F.col("lo") == F.col("hi")).alias("verified"))


def identifiers(recipe: DataFrame) -> DataFrame:
    """recipe with ids: the ordered list of verified chunk identifiers, in place of names and proofs.

    A name that stands for one chunk is its identifier; else the name with the
    chunk's number among those of that name, by their proofs.
    """
    clashing = chunk_dictionary(recipe).where("NOT verified").select("name")
    if clashing.isEmpty():
        return recipe.withColumn("ids", F.col("names")).drop("names", "proofs")
    chunks = recipe.select("row", F.posexplode(F.arrays_zip("names", "proofs")).alias("at", "c")).select("row", "at", F.col("c.names").alias("name"), F.col("c.proofs").alias("proof"))
    own = chunks.join(clashing, "name", "left_semi").select("name", "proof").distinct()
    numbered = own.select("name", "proof", F.row_number().over(Window.partitionBy("name").orderBy("proof")).alias("number"))
    told = chunks.join(numbered, ["name", "proof"], "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "name", F.coalesce("number", F.lit(0)).alias("number")))).alias("list"))
    lists = told.select("row", F.transform("list", lambda x: F.struct(x["name"].alias("name"), x["number"].alias("number"))).alias("ids"))
    empty = F.array().cast("array<struct<name:bigint,number:int>>")
    return recipe.join(lists, "row", "left").withColumn("ids", F.coalesce("ids", empty)).drop("names", "proofs")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 512, max_chars: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept (a null doc_id
    sorts first); where that doc_id itself repeats, exactly one of its rows
    is kept, whichever was read last.  Null texts count as empty; all empty
    texts form one group.  Very long texts are cut and compared whole.  An
    empty table gives an empty result; other columns are ignored.  text_sha256
    is for the reader; it takes no part in the comparison.
    """
    recipe = shared.stage_table(recipes(docs, id_col, text_col, min_chars, max_chars), "recipes")
    named = identifiers(recipe)
    groups = named.groupBy("ids").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    groups = shared.stage_table(groups, "groups")
    # groups of at least 1 / HOT_GROUPS of all rows, so HOT_GROUPS at most, meet their rows by broadcast
    hot = F.col("group_size") > max(1000, recipe.count() // HOT_GROUPS)
    often = F.broadcast(groups.where(hot))
    rest = named.join(often.select("ids"), "ids", "left_anti").join(groups.where(~hot), "ids")
    out = named.join(often, "ids").select(rest.columns).unionByName(rest)
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
