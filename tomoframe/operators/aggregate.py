"""Histograms and other aggregates over pairs, bins and detectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"d1": F.least("d1", "d2"), "d2": F.greatest("d1", "d2")})


def sparse_histogram(rows: DataFrame, value: Column | None = None, keep_zeros: bool = False) -> DataFrame:
    """(d1, d2, value) by canonical pair; zero inputs are skipped unless kept."""
    e = rows.select("d1", "d2", (F.lit(1.0) if value is None else value).alias("value"))
    if not keep_zeros:
        e = e.where("value <> 0")
    return canonical(e).groupBy("d1", "d2").agg(F.sum("value").alias("value"))


def dense_histogram(binned: DataFrame, value: Column | None = None) -> DataFrame:
    """(bin, value) of rows with a bin: positive values, two different detectors."""
    e = binned.where("d1 <> d2").select("bin", (F.lit(1.0) if value is None else value).alias("value")).where("value > 0")
    return e.groupBy("bin").agg(F.sum("value").alias("value"))


def detector_usage(rows: DataFrame, value: Column | None = None) -> DataFrame:
    """(det_id, value): each row counts for both its detectors."""
    e = rows.select(F.explode(F.array("d1", "d2")).alias("det_id"), (F.lit(1.0) if value is None else value).alias("value"))
    return e.groupBy("det_id").agg(F.sum("value").alias("value"))


def cumulate(tables: list[DataFrame]) -> DataFrame:
    return sparse_histogram(reduce(DataFrame.unionByName, tables), F.col("value"))


def to_listmode(hist: DataFrame, events: int) -> DataFrame:
    """(d1, d2, copy): each pair round(value / total * events) times."""
    total = hist.agg(F.sum("value").alias("__total"))
    n = F.round(F.col("value") / F.col("__total") * events).cast("long")
    e = hist.crossJoin(F.broadcast(total)).withColumn("__n", n).where("__n > 0")  # one row of total
    return e.select("d1", "d2", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("copy"))


def compare(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows on both sides, and how many differ in each column."""
    a = left.select(key, *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = right.select(key, *[F.col(c).alias(f"__b_{c}") for c in columns])
    diff = [F.sum(F.when(F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), 0).otherwise(1)).alias(f"diff_{c}") for c in columns]
    return a.join(b, key).agg(F.count("*").alias("rows"), *diff)


def exclusive_prefix(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds start: the sum of value before the row within its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(value).over(w), F.lit(0)))


def exclusive_prefix_all(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds start: the sum of value before the row, in the total order of all rows.

    A range shuffle on the order, one total a range, and a running sum within
    each range: no task sees more than one range.  The sorted rows are written
    once, so that both passes see the same ranges.
    """
    from tomoframe.operators.recon import cut

    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__m", F.monotonically_increasing_id()), "prefix").withColumn("__p", F.shiftright("__m", 33))
    per = placed.groupBy("__p").agg(F.sum(value).alias("__n"))
    kind, totals, offsets = dict(per.dtypes)["__n"], sorted((r["__p"], r["__n"]) for r in per.collect()), []  # one row a range
    zero = next((type(n)() for _, n in totals if n is not None), 0.0 if kind == "double" else 0)
    before = zero
    for p, n in totals:
        offsets.append((p, before))
        before += zero if n is None else n
    offsets = rows.sparkSession.createDataFrame(offsets, f"__p long, __off {kind}")
    inner = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(offsets), "__p").withColumn("start", F.col("__off") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return out.drop("__m", "__p", "__off")


def compare_whole(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows of either side, rows of one side only, and how many of the common rows differ in each column."""
    a = left.select(F.col(key).alias("__k"), F.lit(True).alias("__in_a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = right.select(F.col(key).alias("__k"), F.lit(True).alias("__in_b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    ina, inb = F.col("__in_a").isNotNull(), F.col("__in_b").isNotNull()
    diff = [count(ina & inb & ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))).alias(f"diff_{c}") for c in columns]
    return a.join(b, "__k", "full").agg(count(ina).alias("left_rows"), count(inb).alias("right_rows"), count(ina & ~inb).alias("left_only"), count(inb & ~ina).alias("right_only"), *diff)


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """(lo, hi) integer ranges merged where they overlap or touch (gaps and islands), within each group column `g`."""
    w = Window.partitionBy("g").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    e = ranges.withColumn("__top", F.max("hi").over(w))
    e = e.withColumn("__new", F.when(F.col("__top").isNull() | (F.col("lo") > F.col("__top") + 1), 1).otherwise(0))
    e = e.withColumn("__k", F.sum("__new").over(Window.partitionBy("g").orderBy("lo", "hi")))
    return e.groupBy("g", "__k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__k")
