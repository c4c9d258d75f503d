"""Helpers that several training-data operators use."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where the session names no shared folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints"

#: Folders that stage_table wrote in this process and nobody released yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session.

    Unset, a local session gets a folder of its own; on a cluster, where each
    machine would write to its own disk, that is an error.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = LOCAL_DIR
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    Each call writes a folder of its own; the files stay until `release` or
    until the folder is cleaned, as the returned frame reads them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of stages whose results are stored.

    They go when the driver's JVM collects the plans that wrote them, which an
    idle heap puts off until the files of many stages lie on disk together.
    Those of the last job may stay until a sweep after the next one.
    """
    gc.collect()  # plans that only unreachable Python objects hold
    spark._jvm.System.gc()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of each write or action when it ends; no sweep has to find them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> int:
    """Deletes the stage tables written so far; call it once the results that read them are stored.  Returns their number."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def global_positions(df: DataFrame, keys: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """Adds `pos`, each row's 0-based place in the total order by keys (with weight: the weight before it).

    A range shuffle sorts the rows, the place within a partition comes from
    the partition's own numbering (or a window over one partition's rows),
    and the offsets of partitions are summed from one row a partition.  No
    task sees more than one range; ties in all keys take any order.
    """
    from pyspark.sql import Window

    ranged = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    placed = stage_table(ranged.withColumn("__mid", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("__pid", F.shiftright("__mid", 33))
    step = F.lit(1) if weight is None else F.col(weight)
    per = placed.groupBy("__pid").agg(F.sum(step).cast("long").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition: bounded by the number of partitions, not by the data
    offsets = per.select("__pid", before.alias("__off"))
    out = placed.join(F.broadcast(offsets), "__pid")
    if weight is None:
        pos = F.col("__off") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        inner = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
        pos = F.col("__off") + F.coalesce(F.sum(weight).over(inner), F.lit(0))
    return out.withColumn("pos", pos.cast("long")).drop("__mid", "__pid", "__off")


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (src, dst); component is the smallest reachable node.

    Alternates the large-star and small-star steps on written tables until
    the edge set stops changing.  Both steps group by a node but only through
    min() and joins, so a hub's neighbours are never gathered in one task.
    """
    und = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct()
    cur = stage_table(und, f"{name}-cc0")
    seen = None
    for k in range(1, max_rounds + 1):
        # large star: link every larger neighbour of a node to the node's smallest neighbour
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: link the node and its smaller neighbours to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        small = small.unionByName(low.select(F.col("a").alias("x"), "m"))
        cur = stage_table(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), f"{name}-cc{k}")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    mins = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mins.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
