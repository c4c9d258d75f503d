"""Licence scan by canonical digests (DataFrame functions only).

A text is normalised (case, copyright lines, punctuation, equivalent
spellings, white space), hashed as a whole, and hash-joined to the digests of
known licence texts and notices.  A second unit is each line that mentions a
licence, so that a notice inside another text is found too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.llm import shared
from tomoframe.llm.license_texts import DIGESTS, NOTICES, TEXTS

#: Lines that name a right holder or reserve rights, in lower case.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©)?[ \t]*(?:[0-9]{4}|<year>|\[year\]|by )[^\n]*|all rights reserved[. ]*)$"
#: Everything but letters and digits.
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Spellings that count as the same, applied in this order to the words.
SPELLINGS = (
    ("licenc", "licens"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("sub licens", "sublicens"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    (" v3 ", " version 3 "),
    (" v2 ", " version 2 "),
)
#: Lines that can hold a notice.
MENTIONS = ("licens", "licenc", "spdx")


def canonical(text: Column) -> Column:
    """The normal form of a text: words of letters and digits between single spaces, with one at either end."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, " "), F.lit(" "))
    for was, now in SPELLINGS:
        out = F.replace(out, F.lit(was), F.lit(now))
    return F.concat(F.lit(" "), F.trim(out), F.lit(" "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the built-in texts, digests and notices: some dozens of rows."""
    rows = [(k, v) for k, v in TEXTS.items()] + [(k, x) for k, v in NOTICES.items() for x in v]
    made = spark.createDataFrame(rows, "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    return made.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license_id string, digest string")).distinct()


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, unit, line_no, digest, license_id).

    Every input row gives one row of unit 'text' (line_no -1), its license_id
    null where the whole text is no known licence, and one row of unit 'line'
    for each matched line.  known has (license_id, digest); where two ids
    share a digest, the first in order is returned.  Null texts count as
    empty, very long ones are hashed whole.  Repeated rows are scanned one by
    one, an empty table gives an empty result, other columns are ignored.
    """
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    text = shared.text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("__t"))
    whole = base.select("doc_id", F.lit("text").alias("unit"), F.lit(-1).alias("line_no"), digest(F.col("__t")).alias("digest"))
    whole = whole.join(known, "digest", "left")
    lower = F.lower("__t")
    some = lower.contains(MENTIONS[0]) | lower.contains(MENTIONS[1]) | lower.contains(MENTIONS[2])
    lines = base.where(some).select("doc_id", F.posexplode(F.split("__t", "\n")).alias("line_no", "__line"))
    low = F.lower("__line")
    lines = lines.where(low.contains(MENTIONS[0]) | low.contains(MENTIONS[1]) | low.contains(MENTIONS[2]))
    lines = lines.select("doc_id", F.lit("line").alias("unit"), "line_no", digest(F.col("__line")).alias("digest")).join(known, "digest")
    cols = ["doc_id", "unit", "line_no", "digest", "license_id"]
    return whole.select(cols).unionByName(lines.select(cols))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(shared.read(spark, sf_dir, "documents"), known_licenses(spark))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"' ' || regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g') || ' '"
    for was, now in SPELLINGS:
        out = f"replace({out}, {_quoted(was)}, {_quoted(now)})"
    return f"' ' || trim({out}, ' ') || ' '"


_ROWS = ", ".join(f"({_quoted(k)}, {_quoted(x)})" for k, x in [*TEXTS.items(), *((k, x) for k, v in NOTICES.items() for x in v)])
_KNOWN = ", ".join(f"({_quoted(k)}, {_quoted(x)})" for k, x in DIGESTS.items())
_SOME = " OR ".join(f"contains(lower(%s), '{m}')" for m in MENTIONS)
SQL = f"""
WITH known AS (
  SELECT min(license_id) AS license_id, digest FROM (
    SELECT license_id, sha256({_sql_canonical("text")}) AS digest FROM (VALUES {_ROWS}) AS k(license_id, text)
    UNION ALL SELECT * FROM (VALUES {_KNOWN}) AS d(license_id, digest)
  ) GROUP BY digest
), base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, string_split(t, chr(10)) AS ls FROM base),
lines AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS line FROM cut)
SELECT doc_id, 'text' AS unit, -1 AS line_no, w.digest, license_id
FROM (SELECT doc_id, sha256({_sql_canonical("t")}) AS digest FROM base) w LEFT JOIN known k ON w.digest = k.digest
UNION ALL
SELECT doc_id, 'line', line_no, l.digest, license_id
FROM (SELECT doc_id, line_no, sha256({_sql_canonical("line")}) AS digest FROM lines WHERE {_SOME.replace("%s", "line")}) l
JOIN known k ON l.digest = k.digest
"""
