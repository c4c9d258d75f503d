"""Iterative reconstruction: corrections, sensitivity, expectation maximisation, low rank."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.operators import image as img
from tomoframe.operators import lookup, project, temporal
from tomoframe.sources.views import GRID, Grid

#: Start value of a voxel, floor of an estimate.
START, FLOOR = 0.125, 1e-35


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df in the shared folder and reads it back, to cut an iteration's lineage; by: one folder for each of its values."""
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve_attenuation(total: DataFrame | None, hardware: DataFrame | None, in_vivo: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(hardware, in-vivo) factor tables from those given; the total stands in for hardware where only it is known."""
    if total is not None and hardware is None and in_vivo is None:
        return total, None
    return hardware, in_vivo


def correction_factors(rows: DataFrame, sens: DataFrame, acf: DataFrame, scatter: DataFrame, invert_sens: bool = False) -> DataFrame:
    """Adds sens (default 1; its inverse, 0 staying 0, if asked), atten (default 1) and scatter (default 0) by canonical pair."""
    e = lookup.lookup_pair(rows, sens, "sens", 1.0)
    if invert_sens:
        e = e.withColumn("sens", F.when(F.col("sens") != 0, 1 / F.col("sens")).otherwise(0.0))
    return lookup.lookup_pair(lookup.lookup_pair(e, acf, "atten", 1.0), scatter, "scatter", 0.0)


def precompute(
    rows: DataFrame, sens: DataFrame | None = None, total: DataFrame | None = None, hardware: DataFrame | None = None, in_vivo: DataFrame | None = None, randoms: DataFrame | None = None, scatter: DataFrame | None = None
) -> DataFrame:
    """Adds sens, atten, invivo, randoms, scatter of every row, from histograms (d1, d2, value) by canonical pair.

    What is not given is 1, or 0 for randoms and scatter; randoms without a
    histogram are the rows' own.  Without a total, attenuation is the product of
    the hardware's and the in-vivo factors that are given.  A pair that a given
    histogram lacks counts as 1 (randoms, scatter: 0).
    """
    e = rows if "randoms" in rows.columns else rows.withColumn("randoms", F.lit(0.0))
    for name, table, default in (("sens", sens, 1.0), ("__total", total, 1.0), ("__hardware", hardware, 1.0), ("invivo", in_vivo, 1.0), ("scatter", scatter, 0.0)):
        e = e.withColumn(name, F.lit(default)) if table is None else lookup.lookup_pair(e, table, name, default)
    if randoms is not None:
        e = lookup.lookup_pair(e, randoms, "randoms", 0.0)
    atten = F.col("__total") if total is not None else F.col("__hardware") * F.col("invivo")
    return e.withColumn("atten", atten).drop("__total", "__hardware")


def sensitivity(matrix: DataFrame, factors: DataFrame, threshold: float = 0.0, scale: float = 1.0, key: str = "bin") -> DataFrame:
    """(vox, sens): back projection of the factors, zero below the threshold."""
    return _above(project.back(matrix, factors, key), threshold, scale)


def sensitivity_lors(lors: DataFrame, threshold: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(vox, sens) of lines that carry their factor as value: no join with a written matrix."""
    return _above(project.back_lors(lors), threshold, scale)


def _above(image: DataFrame, threshold: float, scale: float) -> DataFrame:
    return image.select("vox", F.when(F.col("value") > threshold, F.col("value") * scale).otherwise(0.0).alias("sens"))


def start_image(sens: DataFrame, value: float = START, given: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """The given image (t, vox, value), or one value everywhere; 0 where the mask (vox, value), or without one sens, is not positive."""
    e = sens.select("vox", F.col("sens").alias("__m"))
    if mask is not None:
        e = e.drop("__m").join(mask.select("vox", F.col("value").alias("__m")), "vox")
    e = e.select(F.lit(0).alias("t"), "vox", "__m", F.lit(value).alias("value")) if given is None else e.join(given.select("t", "vox", "value"), "vox")
    return e.select("t", "vox", F.when(F.col("__m") > 0, F.col("value")).otherwise(F.lit(0.0)).alias("value"))


def ratio_step(matrix: DataFrame, image: DataFrame, data: DataFrame, key: str = "bin", floor: float = FLOOR) -> DataFrame:
    """(t, vox, value): back projection of data / estimate; data has key, value and the correction columns."""
    proj = project.forward(matrix, image, key).withColumnRenamed("value", "proj")
    rows = data.join(proj, key, "left").withColumn("proj", F.coalesce("proj", F.lit(0.0)))
    ratio = lookup.em_ratio(rows, floor).select(key, F.col("ratio").alias("value"))
    return project.back(matrix, ratio, key).select(F.lit(0).alias("t"), "vox", "value")


def osem(matrix: DataFrame, data: DataFrame, sens: DataFrame, iterations: int, subsets: int, key: str = "bin", threshold: float = 0.0, given: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(t, vox, value) after iterations x subsets updates; subset k has rows with key % subsets = k.

    Each update is one join and two aggregates; the image is written to the
    shared folder after each, so lineage stays short and a lost executor costs
    one step.  With subsets, matrix and data are written once with a folder for
    each, so that an update reads its own part alone.
    """
    image = cut(start_image(sens, given=given, mask=mask), "image0")
    if subsets > 1:
        own = (F.col(key) % subsets).cast("int")
        matrix, data = (cut(d.withColumn("__subset", own), n, "__subset") for d, n in ((matrix, "matrix"), (data, "data")))
    scaled = sens.withColumn("sens", F.col("sens") / subsets)
    for it in range(iterations):
        for k in range(subsets):
            part = lambda d, k=k: d.where(F.col("__subset") == k).drop("__subset") if subsets > 1 else d
            update = ratio_step(part(matrix), image, part(data), key)
            zeros = image.select("t", "vox", F.lit(0.0).alias("value"))
            update = update.unionByName(zeros).groupBy("t", "vox").agg(F.sum("value").alias("value"))
            image = cut(img.em_update(image, update, scaled, threshold), f"image{it}-{k}")
    return image


# --- expectation maximisation on lines that carry their segments

#: Voxels of an image that goes to every task as one array; larger ones are met in slabs of so many.
SLAB_VOXELS = 1 << 23


def em_lines(
    events: DataFrame, g: Grid = GRID, tof: tuple[float, float] | None = None, motion: DataFrame | None = None, rays: int = 1,
    crystal: tuple[float, float, float] = (0.0, 0.0, 0.0), key: str = "event_id", data: tuple[str, ...] = ("value", "sens", "atten", "randoms", "scatter", "invivo"),
) -> DataFrame:
    """(key, data, segments): one row a line with all its (vox, w); lines outside the field of view are left out.

    events has x1 .. z2, key and the columns of data; with tof also tof_ps,
    with motion (rows of RIGID transforms) ts_ms, with rays > 1 the crystals'
    normals, whose size is crystal (axial, across, depth): the weights are then
    the average over the rays, gathered by line once, in one exchange.
    """
    e = events
    if rays > 1:
        e = project.crystal_rays(e, rays, *crystal, key=key)
    if motion is not None:
        e = temporal.move_rigid(temporal.motion_asof(e, motion, temporal.RIGID))
    e = project.siddon_segments(e, g, tof, (key, *data))
    if rays > 1:
        share = F.transform(F.flatten(F.collect_list("segments")), lambda s: F.struct(s["vox"].alias("vox"), (s["w"] / rays).alias("w")))
        e = e.groupBy(key).agg(*[F.first(c).alias(c) for c in data], share.alias("segments"))
    return e


def fold(lines: DataFrame, image: DataFrame, g: Grid = GRID, key: str = "event_id", slab: int = SLAB_VOXELS) -> DataFrame:
    """lines with proj: the sum of w * x over their segments; image is (vox, value), absent voxels are 0.

    An image of at most `slab` voxels goes to every task as one array, and the
    sum is taken within the row.  A larger one is cut into slabs of
    consecutive voxels: lines meet a slab's array by an equi join on its
    number, are added up there, and their partial sums by line.
    """
    size = -(-g.voxels // slab)
    number = F.floor(F.col("vox") / slab)
    cells = image.groupBy(number.alias("__slab")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("vox") % slab).alias("k"), F.col("value").alias("v")))).alias("__m"))
    cells = cells.select("__slab", F.transform(F.sequence(F.lit(0), F.lit(min(slab, g.voxels) - 1)), lambda k: F.coalesce(F.try_element_at("__m", k.cast("long")), F.lit(0.0))).alias("__x"))
    sum_of = lambda s: F.aggregate(s, F.lit(0.0), lambda acc, t: acc + t["w"] * F.get("__x", (t["vox"] % slab).cast("int")))
    if size == 1:
        row = F.broadcast(cells.select("__x"))  # one array of at most `slab` values
        return lines.crossJoin(row).withColumn("proj", sum_of(F.col("segments"))).drop("__x")
    own = F.array_distinct(F.transform("segments", lambda t: F.floor(t["vox"] / slab)))
    parts = lines.select(key, "segments", F.explode(own).alias("__slab"))
    parts = parts.withColumn("segments", F.filter("segments", lambda t: F.floor(t["vox"] / slab) == F.col("__slab")))
    sums = parts.join(cells, "__slab").groupBy(key).agg(F.sum(sum_of(F.col("segments"))).alias("proj"))
    return lines.join(sums, key, "left").withColumn("proj", F.coalesce("proj", F.lit(0.0)))


def unfold(lines: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, vox, value): the sum of w * value over the lines' segments; each task adds up its own before the exchange."""
    e = lines.withColumn("__y", value).where(F.col("__y") != 0).select(*by, "__y", F.explode("segments").alias("s"))
    return e.groupBy(*by, "s.vox").agg(F.sum(F.col("s.w") * F.col("__y")).alias("value"))


def em_step(lines: DataFrame, image: DataFrame, g: Grid = GRID, key: str = "event_id", floor: float = FLOOR, slab: int = SLAB_VOXELS) -> DataFrame:
    """(t, vox, value): back projection of data / estimate, without a matrix: the estimate and the ratio are made within the row."""
    e = lookup.em_ratio(fold(lines, image, g, key, slab), floor)
    return unfold(e, F.col("ratio")).select(F.lit(0).alias("t"), "vox", "value")


def sensitivity_of(lines: DataFrame, threshold: float = 0.0, scale: float = 1.0) -> DataFrame:
    """(vox, sens) of lines with sens and atten."""
    return _above(unfold(lines, F.col("sens") * F.col("atten")), threshold, scale)


def osem_lines(
    lines: DataFrame, sens: DataFrame, iterations: int, subsets: int, g: Grid = GRID, key: str = "event_id", threshold: float = 0.0,
    given: DataFrame | None = None, mask: DataFrame | None = None, slab: int = SLAB_VOXELS,
) -> DataFrame:
    """(t, vox, value) after iterations x subsets updates of em_step; subset k has lines with key % subsets = k.

    The lines are written once, by subset; an update reads its own and the
    image, and exchanges sums by voxel.  The image is written after each.
    """
    image = cut(start_image(sens, given=given, mask=mask), "image0")
    own = F.pmod(F.col(key), F.lit(subsets)).cast("int")
    lines = cut(lines.withColumn("__subset", own), "lines", "__subset")
    scaled = sens.withColumn("sens", F.col("sens") / subsets)
    for it in range(iterations):
        for k in range(subsets):
            update = em_step(lines.where(F.col("__subset") == k).drop("__subset"), image.select("vox", "value"), g, key, slab=slab)
            zeros = image.select("t", "vox", F.lit(0.0).alias("value"))
            update = update.unionByName(zeros).groupBy("t", "vox").agg(F.sum("value").alias("value"))
            image = cut(img.em_update(image, update, scaled, threshold), f"image{it}-{k}")
    return image


# --- low rank


def _vectors(table: DataFrame, by: str, value: str, ranks: list[int], name: str) -> DataFrame:
    """(by, name): the values of a table (rank, by, value) as one array, in the order of ranks; absent ones are 0."""
    held = table.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("__m"))
    return held.select(by, F.array(*[F.coalesce(F.try_element_at("__m", F.lit(r)), F.lit(0.0)) for r in ranks]).alias(name))


def _ranks(h: DataFrame) -> list[int]:
    return sorted(r["rank"] for r in h.select("rank").distinct().collect())  # a short table


def low_rank_forward(matrix: DataFrame, w: DataFrame, h: DataFrame, frames: DataFrame) -> DataFrame:
    """(bin, value): sum of weight * W[rank, vox] * H[rank, frame of the bin]; H is a short table.

    Ranks go together as one array a voxel and one a frame, so the join has a
    row for each weight, whatever their number.
    """
    ranks = _ranks(h)
    x = frames.join(_vectors(h, "frame", "h", ranks, "__h"), "frame").select("bin", "__h")
    e = matrix.join(x, "bin").join(_vectors(w, "vox", "value", ranks, "__w"), "vox")
    dot = F.aggregate(F.zip_with("__w", "__h", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return e.groupBy("bin").agg(F.sum(F.col("w") * dot).alias("value"))


def low_rank_sums(matrix: DataFrame, data: DataFrame, frames: DataFrame) -> DataFrame:
    """(vox, frame, s): the sum of weight * y by voxel and frame, from which both updates follow without the matrix."""
    y = data.where("value <> 0").select("bin", F.col("value").alias("__y")).join(frames.select("bin", "frame"), "bin")
    return matrix.join(y, "bin").groupBy("vox", "frame").agg(F.sum(F.col("w") * F.col("__y")).alias("s"))


def update_w(sums: DataFrame, h: DataFrame) -> DataFrame:
    """(rank, vox, value): sum over frames of s * H[rank, frame]."""
    return sums.join(h, "frame").groupBy("rank", "vox").agg(F.sum(F.col("s") * F.col("h")).alias("value"))


def update_h(sums: DataFrame, w: DataFrame) -> DataFrame:
    """(rank, frame, value): sum over voxels of s * W[rank, vox]."""
    return sums.join(w.select("rank", "vox", F.col("value").alias("__w")), "vox").groupBy("rank", "frame").agg(F.sum(F.col("s") * F.col("__w")).alias("value"))


def low_rank_back_w(matrix: DataFrame, data: DataFrame, h: DataFrame, frames: DataFrame) -> DataFrame:
    """(rank, vox, value): sum of weight * y * H[rank, frame]."""
    return update_w(low_rank_sums(matrix, data, frames), h)


def low_rank_back_h(matrix: DataFrame, data: DataFrame, w: DataFrame, frames: DataFrame) -> DataFrame:
    """(rank, frame, value): sum of weight * y * W[rank, vox]."""
    return update_h(low_rank_sums(matrix, data, frames), w)


def low_rank_dual(matrix: DataFrame, data: DataFrame, w: DataFrame, h: DataFrame, frames: DataFrame) -> DataFrame:
    """(rank, vox, frame, value): the updates of W (frame null) and of H (vox null) from one pass over the matrix."""
    sums = low_rank_sums(matrix, data, frames)
    kinds = dict(h.dtypes)
    one = update_w(sums, h).select("rank", "vox", F.lit(None).cast(kinds["frame"]).alias("frame"), "value")
    two = update_h(sums, w).select("rank", F.lit(None).cast(dict(w.dtypes)["vox"]).alias("vox"), "frame", "value")
    return one.unionByName(two)


def low_rank_sensitivity_h(w: DataFrame, sens: DataFrame) -> DataFrame:
    """(rank, c): sum over voxels of W * sensitivity, which scales the update of H."""
    return w.join(sens.select("vox", "sens"), "vox").groupBy("rank").agg(F.sum(F.col("value") * F.col("sens")).alias("c"))


def low_rank_scaling(h: DataFrame) -> DataFrame:
    return h.groupBy("rank").agg(F.sum("h").alias("c"))


def low_rank_em(
    matrix: DataFrame, data: DataFrame, w: DataFrame, h: DataFrame, frames: DataFrame, sens: DataFrame,
    iterations: int, subsets: int = 1, update: str = "dual", floor: float = FLOOR, threshold: float = 1e-8,
) -> tuple[DataFrame, DataFrame]:
    """(W, H) after iterations x subsets updates of W ("w"), of H ("h") or of both ("dual").

    matrix is (bin, vox, w); data has bin, value and the correction columns;
    w is (rank, vox, value), h a short table (rank, frame, h), frames
    (bin, frame) with one row a bin; subset k has the bins with bin % subsets
    = k.  In dual mode H stays through the first iteration, and both updates
    come from one pass over the matrix with the W and H before them.  Cells
    without an update become 0, voxels without a sensitivity stay.  W and H
    are written to the shared folder after each update.
    """
    if update not in ("w", "h", "dual"):
        raise ValueError("update must be w, h or dual")
    w = cut(w.select("rank", "vox", "value"), "w0")
    h = cut(h.select("rank", "frame", "h"), "h0")
    whole = w.select("vox").distinct().join(sens.select("vox", "sens"), "vox", "left")
    scaled = cut(whole.select("vox", (F.coalesce("sens", F.lit(0.0)) / subsets).alias("sens")), "sens")
    rows = data.join(frames.select("bin"), "bin", "left_semi")
    if subsets > 1:  # a folder for each subset, so that an update reads its own part alone
        own = F.pmod("bin", F.lit(subsets)).cast("int")
        matrix, rows = (cut(t.withColumn("__subset", own), n, "__subset") for t, n in ((matrix, "matrix"), (rows, "rows")))
    for it in range(iterations):
        for k in range(subsets):
            m, d = (t.where(F.col("__subset") == k).drop("__subset") if subsets > 1 else t for t in (matrix, rows))
            proj = low_rank_forward(m, w, h, frames).withColumnRenamed("value", "proj")
            ratio = lookup.em_ratio(d.join(proj, "bin", "left").withColumn("proj", F.coalesce("proj", F.lit(0.0))), floor)
            ratio = ratio.select("bin", F.col("ratio").alias("value"))
            new_h = update == "h" or (update == "dual" and it > 0)
            sums = low_rank_sums(m, ratio, frames)
            if update != "h" and new_h:
                sums = cut(sums, f"sums{it}-{k}")  # read twice
            uw, uh = update_w(sums, h), update_h(sums, w)
            old_w, old_h = w, h
            if update != "h":
                filled = uw.select("rank", "vox", "value").unionByName(old_w.select("rank", "vox", F.lit(0.0).alias("value")))
                filled = filled.groupBy(F.col("rank").alias("t"), "vox").agg(F.sum("value").alias("value"))
                scaling = low_rank_scaling(old_h).withColumnRenamed("rank", "t")
                w = img.em_update(old_w.withColumnRenamed("rank", "t"), filled, scaled, threshold, scaling)
                w = cut(w.withColumnRenamed("t", "rank"), f"w{it}-{k}")
            if new_h:
                scaling = low_rank_sensitivity_h(old_w, scaled)
                e = old_h.join(uh.select("rank", "frame", F.col("value").alias("__u")), ["rank", "frame"], "left").join(scaling, "rank", "left")
                c = F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(threshold))
                h = cut(e.select("rank", "frame", (F.col("h") * F.coalesce("__u", F.lit(0.0)) / c).alias("h")), f"h{it}-{k}")
    return w, h


def bootstrap_split(rows: DataFrame, parts: int, seed: int, key: str = "event_id") -> DataFrame:
    """Adds part: a table split into disjoint tables by a hash of the row's ordinal, so that every run agrees."""
    return rows.withColumn("part", F.pmod(F.col(key) * 2654435761 + seed * 40503, F.lit(1_000_003)) % parts)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def generated(spark: SparkSession, n: int, value: float) -> DataFrame:
    """A uniform histogram: (bin, value)."""
    return spark.range(n).select(F.col("id").alias("bin"), F.lit(value).alias("value"))
