"""Near-duplicate components by a token-group matrix over word-shingle sets.

Documents are sets of hashed shingles; two link when their Jaccard
similarity reaches the threshold.  Documents are partitioned into groups of
similar ones, each group stores the union of its members' tokens, a query's
overlap with that union bounds its similarity to every member, and only
groups whose bound reaches the threshold are opened.  The matrix is applied
three times, ever finer, and every step is exact:

1. Each document against the union of all documents with another set, by the
   first tokens of each set in hash order.  The union is never built: tokens
   are grouped, and those that several sets have are told to the documents.
   Rows and bytes grow with the tokens alone.  Few documents reach the bound;
   copies of a set stand behind one representative.
2. Representatives that share a minimum hash are compared with one pivot.
   The components of these links are the groups; each representative is then
   bounded by the union of all other groups in the same way, by all tokens.
3. What is left is joined to the (token, group) matrix by its rarest tokens;
   a group is a part of a large component, or of documents that are akin.
   Each query is bounded by the union of each group it finds, and compared
   with the members of the groups that qualify.

Results are one row per document with its component, so a large group of
copies or near copies costs rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomoframe.llm import arrow_text, shared

WIDTH, PERCENT = 5, 80
#: Minimum hashes of a representative, by which it finds pivots.
PIVOT_KEYS = 3
#: Similarity to a pivot from which documents are akin, and so members of one group of the matrix.
KIN_PERCENT = 40
#: About so many members and tokens has a part of a group of the matrix, and so many queries meet it at once.
GROUP_MEMBERS, GROUP_TOKENS, QUERIES = 512, 1 << 18, 1024
#: Share of the hash space whose tokens step 1 compares; any share from 0 to 1 gives the same links.
FIRST_SHARE = 0.4
#: A token is hot with more rows than LEAST_HOT and than this part of all rows.
HOT_TOKENS, LEAST_HOT = 100_000, 4096

class Shingler:
    """Sets of 64-bit shingle hashes of texts, sorted."""

    def __init__(self, width: int = WIDTH) -> None:
        self.words = arrow_text.WordHasher(seed=11)
        self.width = width
        self.factor = arrow_text._splitmix(29, 2 * width) | np.uint64(1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        hashes, counts = self.words(texts)
        w, at, out = self.width, 0, []
        with np.errstate(over="ignore"):
            n = max(0, len(hashes) - w + 1)
            full = np.zeros(n, np.uint64)
            for j in range(w):
                full += hashes[j : j + n] * self.factor[j]
            full = arrow_text.mix(full)
            for k in counts:
                if k >= w:
                    out.append(np.unique(full[at : at + k - w + 1]))
                elif k:  # the whole sequence as one, apart from full shingles by its length
                    part = (hashes[at : at + k] * self.factor[:k]).sum(dtype=np.uint64) + self.factor[w + k]
                    out.append(arrow_text.mix(part.reshape(1)))
                else:
                    out.append(np.empty(0, np.uint64))
                at += k
        return out


def fingerprints(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a token set."""
    with np.errstate(over="ignore"):
        a = arrow_text.mix(np.array([tokens.sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64))
        b = arrow_text.mix(np.array([np.bitwise_xor.reduce(arrow_text.mix(tokens + np.uint64(77)), initial=np.uint64(0))], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _first_tokens(sets: list[np.ndarray], percent: int, share: float) -> tuple[list[np.ndarray], np.ndarray]:
    """For each set, its first tokens in hash order and how many of them a link needs in other sets.

    The first tokens are those below `share` of the hash space, and at least
    so many that two sets that link have one in common.  A linked set lacks at
    most n - least tokens, so of the tokens below the share it has all but these.
    """
    limit = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))
    first, need = [], []
    for s in sets:
        n = len(s)
        spare = n - (percent * n + 99) // 100
        below = int(np.searchsorted(s, limit, "right"))
        first.append(s[: max(below, min(n, spare + 1))])
        need.append(max(1, below - spare))
    return first, np.array(need, np.int64)


def _shingled(texts: DataFrame, width: int, percent: int, share: float) -> DataFrame:
    """(doc_id, n, label, extra, need, first): label and extra are fingerprints of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for part in arrow_text.slices(batch, 1):
                sets = shingle(part.column(1).to_pylist())
                prints = [fingerprints(s) for s in sets]
                first, need = _first_tokens(sets, percent, share)
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(need), _lists(first)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "label", "extra", "need", "first"])

    return texts.mapInArrow(run, "doc_id long, n long, label long, extra long, need long, first array<long>")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))


def _elsewhere(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(*keys, elsewhere): how many tokens of each of rows (*keys, label, tokens) another label has too.

    A token's labels meet as their minimum and maximum, combined before the
    shuffle.  Rows of a token with more than 1 / HOT_TOKENS of all rows would
    meet in one task when they are told, so they are told by broadcast: there
    are fewer than HOT_TOKENS such tokens, at any size of input.
    """
    total = rows.agg(F.sum(F.size("tokens")).cast("long")).first()[0] or 0
    most = max(LEAST_HOT, total // HOT_TOKENS)
    each = rows.select(*[c for c in rows.columns if c != "tokens"], F.explode("tokens").alias("token"))
    met = each.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    met = shared.stage_table(met.select("token", "c"), name)
    shared.sweep(rows.sparkSession)  # the tokens are exchanged once more below
    told = _split_hot(each.select(*keys, "token"), met, "token", most)
    return told.groupBy(*keys).agg(F.count("*").alias("elsewhere"))


def _token_sets(docs: DataFrame, width: int) -> DataFrame:
    """(rep, n, tokens, keys, label, extra): keys are minimum hashes under PIVOT_KEYS orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for part in arrow_text.slices(batch, 1):
                sets = shingle(part.column(1).to_pylist())
                keys = [[int(arrow_text.mix(s + np.uint64(k)).min().view(np.int64)) for k in range(PIVOT_KEYS)] if len(s) else [] for s in sets]
                prints = [fingerprints(s) for s in sets]
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), pa.array(keys, pa.list_(pa.int64())), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "n", "tokens", "keys", "label", "extra"])

    return docs.mapInArrow(run, "rep long, n long, tokens array<long>, keys array<long>, label long, extra long")


def _linked(percent: int, both: Column, na: Column, nb: Column) -> Column:
    """Condition that token sets of sizes na and nb with `both` tokens in common link."""
    return 100 * both >= percent * (na + nb - both)


def _pivot_links(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst, linked) of representatives and the pivots of their minimum hashes that are at least akin."""
    keyed = sets.select("rep", F.posexplode("keys").alias("k", "key"))
    pivots = keyed.groupBy("k", "key").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    pairs = keyed.join(pivots, ["k", "key"]).where("rep <> pivot").select("rep", "pivot").distinct()
    a = sets.select("rep", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("rep").alias("pivot"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    kin = min(KIN_PERCENT, percent)
    sized = pairs.join(a, "rep").join(b, "pivot").where(100 * F.least("na", "nb") >= kin * F.greatest("na", "nb"))
    both = sized.select("rep", "pivot", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("both"))
    akin = both.where(_linked(kin, F.col("both"), F.col("na"), F.col("nb")))
    return akin.select(F.col("rep").alias("src"), F.col("pivot").alias("dst"), _linked(percent, F.col("both"), F.col("na"), F.col("nb")).alias("linked"))


def _split_hot(rows: DataFrame, told: DataFrame, key: str, most: int) -> DataFrame:
    """rows joined with told (key, c, ...; one row a key, c the number of its rows); rows of keys with c over `most` by broadcast."""
    often = F.broadcast(told.where(F.col("c") > most))
    rest = told.where(F.col("c") <= most)
    cold = rows.join(often.select(key), key, "left_anti").join(rest, key)
    return rows.join(often, key).select(cold.columns).unionByName(cold)


def _parted(rows: DataFrame, keys: Sequence[str], most: int, tokens: int, name: str) -> DataFrame:
    """rows (*keys, rep, n, ...) with `parts`, so many that each holds about `most` rows and `tokens` tokens, and a row's part `name`."""
    size = rows.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / tokens), F.lit(1)).alias("parts"))
    return rows.join(size, list(keys)).withColumn(name, F.pmod(F.xxhash64("rep"), F.col("parts")))


def _open_groups(percent: int):  # noqa: ANN202
    """Compares queries with the members of one group whose tokens they may share enough; gives links between labels."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        sets = _arrays(members.column("tokens"))
        sizes = np.array([len(s) for s in sets], np.int64)
        labels = members.column("label").to_numpy()
        held = np.concatenate([*sets, np.empty(0, np.uint64)])
        order = np.argsort(held, kind="stable")
        owner = np.repeat(np.arange(len(sets)), sizes)[order]
        union, first = np.unique(held[order], return_index=True)
        ends = np.append(first[1:], len(held))
        pairs: set[tuple[int, int]] = set()
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for tokens, own in zip(_arrays(queries.column("tokens")), queries.column("label").to_pylist(), strict=True):
            at = np.minimum(np.searchsorted(union, tokens), max(0, len(union) - 1))
            at = at[union[at] == tokens] if len(union) else at[:0]
            if 100 * len(at) < percent * len(tokens):  # the bound by the group's union
                continue
            low, n = first[at], ends[at] - first[at]
            where = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[where], minlength=len(sets))
            hit = (100 * both >= percent * (len(tokens) + sizes - both)) & (labels != own)
            for other in np.unique(labels[hit]).tolist():
                x, y = top(own), top(other)
                if x != y:  # links that join what is joined already add nothing
                    parent[max(x, y)] = min(x, y)
                    pairs.add((max(own, other), min(own, other)))
        src, dst = zip(*sorted(pairs), strict=True) if pairs else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for x in column]


def _matrix_links(left: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) between labels among rows (rep, n, elsewhere, tokens, label, key), by the token-group matrix.

    Groups are large labels, and elsewhere documents of one `key`, which are
    akin; both in parts of bounded size.  A query finds groups with members no
    larger than itself: their first tokens in the order (rows that hold the
    token, token) are indexed up to n - ceil(2t / (1 + t) n) + 1, the query's
    are looked up to n - ceil(t n) + 1, which loses no link of similarity t.
    Tokens that the same groups have in the index are joined as one.
    """
    big = left.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") >= GROUP_MEMBERS).select("label", F.col("label").alias("whole"))
    members = left.join(big, "label", "left").withColumn("g", F.xxhash64(F.col("whole").isNull(), F.coalesce("whole", "key")))
    members = shared.stage_table(_parted(members, ["g"], GROUP_MEMBERS, GROUP_TOKENS, "part").drop("parts"), "members")
    rows = members.select("rep", "n", "elsewhere", "label", "whole", "g", "part", F.explode("tokens").alias("token"))
    spread = rows.groupBy("token").agg(F.count("*").alias("c"), (F.min("label") != F.max("label")).alias("common"))
    total = members.agg(F.sum("n")).first()[0] or 0
    ranked = _split_hot(rows, spread, "token", max(LEAST_HOT, total // HOT_TOKENS))
    ranked = ranked.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("common", "c", "token"))).where("common")
    least = F.floor((percent * F.col("n") + 99) / 100)
    least_even = F.ceil(2 * percent * F.col("n") / (100 + percent))
    ranked = ranked.where(F.col("i") <= F.col("n") - least + 1).withColumn("indexed", F.col("i") <= F.col("n") - least_even + 1)
    ranked = shared.stage_table(ranked.select("rep", "n", "elsewhere", "label", "whole", "g", "part", "token", "indexed"), "ranked")
    shared.sweep(left.sparkSession)
    # a member can be the smaller one of a link only if enough of its tokens are elsewhere for one of its own size
    smaller = F.col("indexed") & ((100 + percent) * F.col("elsewhere") >= 2 * percent * F.col("n"))
    index = ranked.where(smaller).groupBy("token", "g", "part").agg(F.first("whole").alias("whole"), F.min("n").alias("small"), F.max("n").alias("large"))
    mark = F.xxhash64("g", "part")
    # the groups of a token as one number: their count and the sums of two hashes
    sign = index.groupBy("token").agg(F.xxhash64(F.count("*"), F.sum(mark.cast("decimal(38,0)")), F.sum(F.xxhash64(mark, F.lit(1)).cast("decimal(38,0)"))).alias("sign"))
    index = index.join(sign, "token").groupBy("sign", "g", "part").agg(F.first("whole").alias("whole"), F.min("small").alias("small"), F.max("large").alias("large"))
    probe = ranked.join(sign, "token").select("rep", F.col("n").alias("nq"), F.col("elsewhere").alias("eq"), F.col("label").alias("lq"), "sign").distinct()
    fits = (~F.col("whole").eqNullSafe(F.col("lq"))) & (F.col("small") <= F.col("nq")) & (100 * F.col("large") >= percent * F.col("nq")) & ((100 + percent) * F.col("eq") >= percent * (F.col("nq") + F.col("small")))
    found = shared.stage_table(probe.join(index, "sign").where(fits).select("rep", "g", "part").distinct(), "found")
    query = found.join(left.select("rep", "n", "tokens", "label"), "rep")
    query = _parted(query, ["g", "part"], QUERIES, GROUP_TOKENS, "turn")
    turns = query.select("g", "part", F.col("turn").alias("for")).distinct()
    held = members.join(turns, ["g", "part"]).select("g", "part", "for", "label", "tokens")
    opened = query.select("g", "part", "turn", "label", "tokens").groupBy("g", "part", "turn").cogroup(held.groupBy("g", "part", "for"))
    return opened.applyInArrow(_open_groups(percent), "src long, dst long").distinct()


def _unnamed(label: str = "label", extra: str = "extra") -> Column:
    """The vertex of a class whose rows have no doc_id: above 2^62, so any real id names the component."""
    return F.xxhash64(label, extra).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))


def _stars(links: DataFrame, name: str) -> DataFrame:
    """(rep, component) of links (src, dst) with src > dst, where the dst are few.

    Each src stands with its least dst; components are sought among the dst
    alone, so a large group costs one row a member, once.
    """
    own = shared.stage_table(links.groupBy("src").agg(F.min("dst").alias("m")), f"{name}-own")
    hubs = links.select(F.col("dst").alias("node")).distinct()
    more = links.join(own, "src").where("dst <> m").select("m", "dst").distinct()
    chain = own.join(hubs, own["src"] == hubs["node"], "left_semi").select("src", "m")
    edges = more.select(F.col("m").alias("src"), "dst").unionByName(chain.select("src", F.col("m").alias("dst")))
    whole = shared.connected_components(edges, name)
    placed = own.unionByName(hubs.join(own, hubs["node"] == own["src"], "left_anti").select(F.col("node").alias("src"), F.col("node").alias("m")))
    return placed.join(whole, placed["m"] == whole["node"], "left").select(F.col("src").alias("rep"), F.coalesce("component", "m").alias("component"))


def _components(texts: DataFrame, width: int, percent: int, first_share: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored: the rows with their sets' fingerprints, the classes of equal sets, and the components by pivots and by the matrix."""
    seen = shared.stage_table(_shingled(texts, width, percent, first_share), "shingled")
    some = seen.where("n > 0")
    told = _elsewhere(some.select("doc_id", "extra", "need", "label", F.col("first").alias("tokens")), ["doc_id", "label", "extra", "need"], "met")
    near = told.where("elsewhere >= need").select("label", "extra").distinct().withColumn("near", F.lit(True))
    classes = some.groupBy("label", "extra").agg(F.min("doc_id").alias("rep")).join(near, ["label", "extra"], "left")
    classes = shared.stage_table(classes.select("label", "extra", F.coalesce("rep", _unnamed()).alias("rep"), F.coalesce("near", F.lit(False)).alias("near")), "classes")
    shared.sweep(texts.sparkSession)
    reps = classes.where("near")
    sets = _token_sets(texts.where("doc_id IS NOT NULL").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), width)
    # rows without an id are found by their sets; where all rows have one, this scans statistics only
    bare = _token_sets(texts.where("doc_id IS NULL"), width).withColumn("rep", _unnamed()).dropDuplicates(["rep"]).join(reps.select("rep"), "rep", "left_semi")
    sets = shared.stage_table(sets.unionByName(bare.select(sets.columns)).drop("label", "extra"), "sets")
    shared.sweep(texts.sparkSession)
    pairs = shared.stage_table(_pivot_links(sets, percent), "pivots")
    shared.sweep(texts.sparkSession)
    label = shared.stage_table(_stars(pairs.where("linked").select("src", "dst"), "links"), "stars")
    kin = _stars(pairs.select("src", "dst"), "akin").withColumnRenamed("component", "key")
    grouped = sets.join(label, "rep", "left").join(kin, "rep", "left").select("rep", "n", "tokens", F.coalesce("key", "rep").alias("key"), F.coalesce("component", "rep").alias("label"))
    grouped = shared.stage_table(grouped, "grouped")
    cross = _elsewhere(grouped, ["rep", "n"], "crossed")
    left = cross.where(100 * F.col("elsewhere") >= percent * F.col("n")).select("rep", "elsewhere")
    left = shared.stage_table(grouped.join(left, "rep"), "left")
    shared.sweep(texts.sparkSession)
    more = shared.stage_table(_matrix_links(left, percent), "matrix")
    whole = shared.connected_components(more, "whole").select(F.col("node").alias("whole"), F.col("component").alias("least"))
    shared.sweep(texts.sparkSession)
    return seen, classes, label, whole


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, first_share: float = FIRST_SHARE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are linked with nothing.  Rows
    that share a doc_id are one vertex.  Rows of a null doc_id link by their
    texts as all others do; component_id is null only where no linked row has
    a doc_id.  Very long texts are read whole.  Ties and repeated rows change
    nothing.  An empty table gives an empty result; other columns are ignored.
    """
    with shared.tidied(docs.sparkSession):
        seen, classes, label, whole = _components(arrow_text.id_and_text(docs, id_col, text_col), width, percent, first_share)
    named = classes.join(label, "rep", "left").select("label", "extra", F.coalesce("component", "rep").alias("own"))
    named = named.join(whole, named["own"] == whole["whole"], "left").select("label", "extra", F.coalesce("least", "own").alias("component"))
    out = seen.select("doc_id", "n", "label", "extra").join(named, ["label", "extra"], "left")
    component = F.when(F.col("component") < F.lit(1 << 62), F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce(component, "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "documents"))
