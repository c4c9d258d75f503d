"""Quality rules: Jensen-Shannon distance of a text's histograms to language references.

Two histograms are compared with each language's reference: the share of
characters in seven classes, and the share of each common word among all
words (the rest in one bin).  A text is judged by the nearest language, since
the stated language can be missing or wrong.  A histogram counts only from a
minimum length on, as short texts scatter.  Two rules judge the words: a text
is stuffed if its distance is above `max_word` and some language's common words
are more than STUFFED times as frequent as in its reference, and it lacks them
if its distance is above `max_lack` and every language's are rarer than in its
reference.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tomoframe.llm import arrow_text, shared

CLASSES = ("lower", "upper", "digit", "space", "punct", "symbol", "other")
PUNCT = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"

#: Share of each class in running prose, by language, in the order of CLASSES.
CLASS_REFERENCE = {
    "en": (0.795, 0.020, 0.005, 0.160, 0.018, 0.001, 0.001),
    "de": (0.775, 0.040, 0.005, 0.140, 0.018, 0.001, 0.021),
    "fr": (0.745, 0.018, 0.005, 0.160, 0.020, 0.001, 0.051),
    "es": (0.765, 0.018, 0.005, 0.160, 0.018, 0.001, 0.033),
}
#: Common words and their uses in 1000 words, by language.
WORD_REFERENCE = {
    "en": {"the": 62, "of": 31, "and": 29, "to": 26, "a": 23, "in": 21, "that": 11, "is": 10, "it": 10, "was": 10, "for": 9, "on": 7, "with": 7, "as": 7, "be": 6, "by": 6, "at": 5, "this": 5, "are": 5, "from": 4, "or": 4, "an": 4},
    "de": {"die": 35, "der": 35, "und": 30, "in": 20, "den": 12, "von": 11, "zu": 11, "das": 11, "mit": 9, "ist": 9, "sich": 8, "des": 8, "auf": 7, "für": 7, "im": 7, "dem": 7, "nicht": 7, "ein": 7, "eine": 7, "als": 6, "auch": 5, "es": 5, "an": 5},
    "fr": {"de": 55, "la": 30, "le": 28, "et": 25, "les": 24, "des": 20, "en": 17, "un": 14, "du": 13, "une": 12, "que": 11, "est": 10, "qui": 9, "dans": 9, "pour": 8, "par": 8, "au": 7, "sur": 6, "pas": 5, "avec": 4},
    "es": {"de": 60, "la": 37, "que": 30, "el": 28, "en": 27, "y": 26, "a": 20, "los": 17, "se": 13, "del": 12, "las": 11, "un": 11, "por": 10, "con": 9, "no": 9, "una": 8, "su": 8, "para": 7, "es": 7, "al": 6, "lo": 5, "como": 4},
}

MIN_CHARS, MIN_WORDS = 200, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.40
#: Share of common words, over that of the reference, from which a distant text is stuffed.
STUFFED = 2.5
#: Word distance above which a text with too few common words lacks them: nine tenths of the least distance (0.387, de)
#: that a text without any common word has.
MAX_LACK_DISTANCE = 0.35


def _class_of_byte() -> np.ndarray:
    """Class of each ASCII byte; 6 for the first byte of a longer character, 7 for the others of it."""
    out = np.full(256, 5, np.int64)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[list(arrow_text.SPACES)] = 3
    out[[ord(c) for c in PUNCT]] = 4
    out[0x80:0xC0], out[0xC0:] = 7, 6
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of p and each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def repeated_words(ids: np.ndarray, kinds: int, width: int = 5) -> int:
    """Words that lie in a window of `width` words found twice or more; ids are word numbers below kinds."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, size = ids[:n].copy(), kinds
    for k in range(1, width):
        if size * kinds >= 1 << 62:  # renumber the window heads so far: exact, whatever the vocabulary
            heads, key = np.unique(key, return_inverse=True)
            size = len(heads)
        key = key * kinds + ids[k : k + n]
        size *= kinds
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    mark = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


class Judge:
    """Signals and verdict of texts."""

    def __init__(self, min_chars: int, min_words: int, max_class: float, max_word: float, max_lack: float | None = MAX_LACK_DISTANCE) -> None:
        self.limits = (min_chars, min_words, max_class, max_word)
        self.max_lack = np.inf if max_lack is None else max_lack
        self.kind = _class_of_byte()
        self.vocabulary: dict[bytes, list[tuple[int, int]]] = {}
        self.width = max(map(len, WORD_REFERENCE.values())) + 1
        words = np.zeros((len(WORD_REFERENCE), self.width))
        for i, ref in enumerate(WORD_REFERENCE.values()):
            for j, (w, per) in enumerate(ref.items()):
                self.vocabulary.setdefault(w.encode(), []).append((i, j))
                words[i, j] = per / 1000
            words[i, -1] = 1 - sum(ref.values()) / 1000
        self.words = words
        self.classes = np.array(list(CLASS_REFERENCE.values()))

    def one(self, text: str) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        chars = np.bincount(self.kind, by_byte, 8)[:7]
        n_chars = int(chars.sum())
        n_symbols = int(by_byte[[ord(c) for c in SYMBOLS]].sum())
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        repeats = repeated_words(ids, max(1, len(number)))
        used = np.bincount(ids, minlength=len(number)) if n else ids
        seen = np.zeros_like(self.words)
        known = self.vocabulary
        for w, i in number.items():
            if (at := known.get(w.lower())) is not None:
                for a in at:
                    seen[a] += used[i]
        class_js = float(js_distance(chars / max(n_chars, 1), self.classes).min()) if n_chars else 0.0
        word_js, lacks, stuffed = 0.0, False, False
        if n:
            seen[:, -1] = n - seen.sum(1)
            word_js = float(js_distance(seen / n, self.words).min())
            lacks = word_js > self.max_lack and bool((seen[:, -1] > n * self.words[:, -1]).all())
            stuffed = word_js > self.limits[3] and bool((n - seen[:, -1] > STUFFED * n * (1 - self.words[:, -1])).any())
        failed = n < 10 or 100 * repeats > 20 * n
        min_chars, min_words, max_class, _ = self.limits
        kept = not failed and (n_chars < min_chars or class_js <= max_class) and (n < min_words or not (stuffed or lacks))
        return n, n_chars - int(chars[3]), n_symbols, len(lines) - len(set(lines)), repeats, failed, kept, class_js, word_js

    def __call__(self, texts: list[str]) -> dict:
        import pyarrow as pa

        cols = list(zip(*map(self.one, texts), strict=True))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_js", "word_js")
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        return {k: pa.array(v, t) for k, v, t in zip(names, cols, kinds, strict=True)}


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    max_class: float = MAX_CLASS_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    max_lack: float | None = MAX_LACK_DISTANCE,
) -> DataFrame:
    """One row per input row: doc_id, the base signals, base_failed, kept, class_js, word_js.

    Null and empty texts have no words: base_failed, distances 0.  Very long
    texts are read whole.  Repeated rows are judged one by one, and rows are
    not compared, so there are no ties; an empty table gives an empty result,
    other columns are ignored.  Without max_lack, texts that lack common words
    pass.
    """
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_js double, word_js double"
    return arrow_text.map_texts(docs, lambda: Judge(min_chars, min_words, max_class, max_word, max_lack), schema, id_col, text_col)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = judge_quality(shared.read(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_js", "word_js")})


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    in_class = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^\x20\x09-\x0D]", "punct": r"[^.,;:!?'" + '"' + r"()\-]", "other": r"[\x00-\x7F]"}
    counts = ", ".join(f"length(regexp_replace(t, {q(v)}, '', 'g')) AS c_{k}" for k, v in in_class.items())
    classes = ", ".join(f"({q(lang)}, {q(c)}, {v!r}::DOUBLE)" for lang, ref in CLASS_REFERENCE.items() for c, v in zip(CLASSES, ref, strict=True))
    words = ", ".join(f"({q(lang)}, {q(w)}, {v / 1000!r}::DOUBLE)" for lang, ref in WORD_REFERENCE.items() for w, v in ref.items())
    rest = ", ".join(f"({q(lang)}, '', {1 - sum(ref.values()) / 1000!r}::DOUBLE)" for lang, ref in WORD_REFERENCE.items())
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    js = "sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0))"
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
chars AS (SELECT r, length(t) AS n, {counts} FROM base),
all_chars AS (SELECT *, n - c_lower - c_upper - c_digit - c_space - c_punct - c_other AS c_symbol FROM chars),
long_chars AS (UNPIVOT (SELECT r, n, {", ".join(f"c_{c}::BIGINT AS {c}" for c in CLASSES)} FROM all_chars) ON {", ".join(CLASSES)} INTO NAME class VALUE k),
class_ref(lang, class, q) AS (VALUES {classes}),
class_lang AS (SELECT r, lang, {js} AS d FROM (SELECT r, lang, k / n AS p, q FROM long_chars JOIN class_ref USING (class) WHERE n > 0) GROUP BY r, lang),
class_js AS (SELECT r, min(d) AS class_js FROM class_lang GROUP BY r),
split AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM base),
sized AS (SELECT r, ws, len(ws) AS n FROM split),
word AS (SELECT r, n, unnest(ws) AS w, unnest(range(n)) AS i FROM sized),
word_ref(lang, w, q) AS (VALUES {words}),
rest_ref(lang, w, q) AS (VALUES {rest}),
used AS (SELECT r, translate(w, '{upper}', '{upper.lower()}') AS w, count(*) AS k FROM word GROUP BY ALL),
cell AS (SELECT s.r, s.n, f.lang, f.q, coalesce(u.k, 0) AS k FROM sized s CROSS JOIN word_ref f LEFT JOIN used u ON u.r = s.r AND u.w = f.w WHERE s.n > 0),
cells AS (SELECT r, n, lang, q, k FROM cell UNION ALL SELECT c.r, c.n, c.lang, f.q, c.n - sum(c.k) FROM cell c JOIN rest_ref f USING (lang) GROUP BY c.r, c.n, c.lang, f.q),
word_lang AS (SELECT r, lang, {js} AS d FROM (SELECT r, lang, k / n AS p, q FROM cells) GROUP BY r, lang),
word_js AS (SELECT r, min(d) AS word_js FROM word_lang GROUP BY r),
rest_cell AS (SELECT c.r, c.lang, c.n, c.n - sum(c.k) AS rest, f.q FROM cell c JOIN rest_ref f USING (lang) GROUP BY c.r, c.lang, c.n, f.q),
share AS (SELECT r, bool_and(rest > n * q) AS below, bool_or(n - rest > {STUFFED!r} * n * (1 - q)) AS above FROM rest_cell GROUP BY r),
win AS (SELECT r, i, list_aggregate(ws[i + 1 : i + 5], 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(n - 4)) AS i FROM sized WHERE n >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1),
rep AS (SELECT r, count(DISTINCT i + d) AS k FROM twice CROSS JOIN range(5) AS s(d) GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM base),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS k FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
flat AS (
  SELECT doc_id, s.n::BIGINT AS n_words, (a.n - a.c_space)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.k, 0)::BIGINT AS n_dup_lines, coalesce(rep.k, 0)::BIGINT AS n_repeat_words, a.n AS n_chars,
         coalesce(class_js, 0) AS class_js, coalesce(word_js, 0) AS word_js, coalesce(below, false) AS below, coalesce(above, false) AS above
  FROM base JOIN sized s USING (r) JOIN all_chars a USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
  LEFT JOIN class_js USING (r) LEFT JOIN word_js USING (r) LEFT JOIN share USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (n_chars < {MIN_CHARS} OR class_js <= {MAX_CLASS_DISTANCE})
         AND (n_words < {MIN_WORDS} OR NOT (word_js > {MAX_WORD_DISTANCE} AND above OR word_js > {MAX_LACK_DISTANCE} AND below)) AS kept,
       round(class_js, 6) AS class_js, round(word_js, 6) AS word_js
FROM flat
"""


SQL = _sql()
