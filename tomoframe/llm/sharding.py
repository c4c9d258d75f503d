"""Balanced label propagation over linked documents (DataFrame functions only).

Rows of equal text form one node.  Nodes are linked through the lines they
share; a shared line's links are kept as the line's shard histogram, so no
pairs of documents are built.  Each round every node finds the shard that
holds most of its neighbours (a line counts by 1 / its number of users), and
for each pair of shards equal weights move both ways, the best gains first:
that keeps the sizes even.  Where more nodes wish to move one way than back,
nodes without links, which lose nothing, trade places with them.  Rounds end
when few nodes move.  Last, rows are laid in order of shard, with the unlinked
ones at both edges, and cut into runs whose counts differ by one at most,
which moves only the rows at the edges of shards that had drifted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomoframe.llm import shared

GAIN_BUCKETS = 20
#: A line whose users are all in one shard counts so much for it.
VOTE = 1 << 20
#: Most rounds, and the share of all rows that a round must move for another one to follow.
ROUNDS, LEAST_MOVED = 8, 0.001


def _nodes(docs: DataFrame, id_col: str, text_col: str, min_line: int) -> DataFrame:
    text = shared.text_or_empty(text_col)
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(x) >= min_line)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("__t")).select(
        "doc_id",
        (F.octet_length("__t") + 1).cast("long").alias("size"),
        F.crc32(F.col("__t").cast("binary")).alias("text_crc32"),
        F.md5(F.col("__t").cast("binary")).alias("node"),
        F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("lines"),
    )


def _propagate(edges: DataFrame, label: DataFrame, shards: int, k: int) -> DataFrame:
    """One round: (node, w, label) with moved labels."""
    at = edges.join(label.select("node", "label"), "node")
    held = [F.sum(F.when(F.col("label") == s, F.col("w")).otherwise(0)).alias(f"h{s}") for s in range(shards)]
    lines = at.groupBy("line").agg(F.sum("w").alias("users"), *held)
    seen = edges.join(lines, "line")
    # whole numbers, so that sums do not depend on their order
    votes = seen.groupBy("node").agg(*[F.sum(F.floor(F.col(f"h{s}") * VOTE / F.col("users"))).alias(f"h{s}") for s in range(shards)])
    score = F.array(*[F.col(f"h{s}") for s in range(shards)])
    wish = (
        votes.join(label.select("node", "w", "label"), "node")
        .withColumn("score", score)
        .withColumn("best", F.array_max("score"))
        .withColumn("to", (F.array_position("score", F.col("best")) - 1).cast("int"))
        .withColumn("gain", F.col("best") - F.element_at("score", F.col("label") + 1))
        .where((F.col("gain") > 0) & (F.col("to") != F.col("label")))
        .select("node", "w", F.col("label").alias("src"), "to", F.least(F.floor(F.log2(1 + F.col("gain") / VOTE) * 4), F.lit(GAIN_BUCKETS - 1)).alias("bucket"))
    )
    wish = shared.stage_table(wish, f"wish{k}")
    # quotas: at most shards * shards * GAIN_BUCKETS rows, whatever the input
    flow = wish.groupBy("src", "to", "bucket").agg(F.sum("w").alias("want"))
    down = Window.partitionBy("src", "to").orderBy(F.desc("bucket"))
    total = shared.stage_table(flow.groupBy("src", "to").agg(F.sum("want").alias("want")), f"total{k}")
    # the weight that wishes to come without one that wishes to go back, and the unlinked weight there to trade for it
    wished = total.select(F.col("src").alias("to"), F.col("to").alias("src"), F.col("want").alias("back"))
    pair = total.join(wished, ["src", "to"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    pair = pair.withColumn("over", F.greatest(F.lit(0), F.col("want") - F.col("back")))
    free = label.where("NOT linked").groupBy(F.col("label").alias("to")).agg(F.sum("w").alias("free"))
    into = Window.partitionBy("to")
    pair = pair.join(free, "to", "left").withColumn("part", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("free"), F.sum("over").over(into)), F.lit(0.0))))
    pair = shared.stage_table(pair.select("src", "to", "back", "free", (F.col("over") * F.col("part")).alias("trade")), f"pair{k}")
    quota = flow.withColumn("before", F.sum("want").over(down) - F.col("want")).join(pair, ["src", "to"])
    quota = quota.select("src", "to", "bucket", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("back") + F.col("trade") - F.col("before")) / F.col("want"))).alias("share"))
    unit = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    moves = wish.join(F.broadcast(quota), ["src", "to", "bucket"]).where(unit < F.col("share")).select("node", "to")
    # each trading shard's unlinked nodes go to the shards that they make room for, in shares of the unit interval
    until = F.sum(F.col("trade") / F.col("free")).over(into.orderBy("src"))
    room = pair.where("trade > 0").select(F.col("to").alias("label"), F.col("src").alias("to"), until.alias("until"), (F.col("trade") / F.col("free")).alias("width"))
    room = room.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("until", "width", "to"))).alias("room"))  # shards rows, of shards items
    given = label.where("NOT linked").join(F.broadcast(room), "label")
    given = given.withColumn("pick", F.filter("room", lambda x: (unit < x["until"]) & (unit >= x["until"] - x["width"]))).where(F.size("pick") > 0)
    moves = moves.unionByName(given.select("node", F.col("pick")[0]["to"].alias("to")))
    moved = label.join(moves, "node", "left")
    return shared.stage_table(moved.select("node", "w", "linked", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")), f"label{k}")


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = ROUNDS, min_line: int = 24) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law 'rows', shard, slot, grown_shard (null).

    Shard counts differ by one at most.  Copies of a text lie side by side, so
    a group is in one shard unless it crosses a cut.  Null texts count as
    empty.  Repeated rows are placed one by one; an empty table gives an empty
    result; other columns are ignored.
    """
    base = shared.stage_table(_nodes(docs, id_col, text_col, min_line), "nodes")
    nodes = base.groupBy("node").agg(F.count("*").alias("w"), F.first("lines").alias("lines"))
    links = nodes.select("node", "w", F.explode("lines").alias("line"))
    common = links.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    edges = shared.stage_table(links.join(common, "line"), "links")
    # a balanced start: nodes in order of their least shared line, cut by weight
    least = edges.groupBy("node").agg(F.min("line").alias("least"))
    keyed = base.groupBy("node").agg(F.count("*").alias("w")).join(least, "node", "left")
    keyed = keyed.select("node", "w", F.col("least").isNotNull().alias("linked"), F.coalesce("least", F.xxhash64("node")).alias("key"))
    placed = shared.global_positions(keyed, ["key", "node"], "start", "w")
    n = base.count()
    start = F.least(F.floor(F.col("pos") * shards / F.lit(max(n, 1))), F.lit(shards - 1)).cast("int")
    label = shared.stage_table(placed.select("node", "w", "linked", start.alias("label")), "label0")
    for k in range(1, rounds + 1):
        label = _propagate(edges, label, shards, k)
        if label.where("moved AND linked").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0] <= LEAST_MOVED * n:
            break
    # unlinked rows stand first or last in their shard, where the cut into runs may move them
    edge = F.when(F.col("linked"), 0).otherwise(F.when(F.col("node") < "8", -1).otherwise(1)).alias("edge")
    rows = base.select("doc_id", "size", "text_crc32", "node").join(label.select("node", "label", edge), "node")
    laid = shared.global_positions(rows, ["label", "edge", "node", "doc_id"], "laid")
    low, extra = divmod(n, shards)
    head = extra * (low + 1)
    shard = F.when(F.col("pos") < head, F.floor(F.col("pos") / (low + 1))).otherwise(extra + F.floor((F.col("pos") - head) / max(low, 1)))
    begin = F.col("shard") * low + F.least(F.col("shard"), F.lit(extra))
    laid = laid.withColumn("shard", shard.cast("int"))
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("pos") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_weight(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line: int = 24) -> DataFrame:
    """One row (links, cut): line uses, and those outside their line's fullest shard; for reports and tests."""
    lines = _nodes(docs, id_col, text_col, min_line).select("doc_id", F.explode("lines").alias("line"))
    held = lines.join(placed.select("doc_id", "shard"), "doc_id").groupBy("line", "shard").agg(F.count("*").alias("n"))
    per = held.groupBy("line").agg(F.sum("n").alias("users"), F.max("n").alias("top")).where("users > 1")
    return per.agg(F.sum("users").alias("links"), F.sum(F.col("users") - F.col("top")).alias("cut"))


def op2_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(shared.read(spark, sf_dir, "documents"))
