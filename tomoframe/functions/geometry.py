"""Scanner geometry as a dataclass, generated tables and column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scanner:
    """Cylindrical scanner; detector id = position + ring * dets_per_ring + doi * (rings * dets_per_ring)."""

    axial_fov: float = 200.0
    crystal_size_z: float = 1.0
    crystal_size_trans: float = 1.0
    crystal_depth: float = 10.0
    radius: float = 200.0
    dets_per_ring: int = 48
    rings: int = 12
    num_doi: int = 2
    max_ring_diff: int = 8
    min_ang_diff: int = 6
    dets_per_block: int = 4

    @property
    def detectors(self) -> int:
        return self.dets_per_ring * self.rings * self.num_doi

    @property
    def num_r_ring(self) -> int:
        return self.dets_per_ring // 2 + 1 - self.min_ang_diff

    @property
    def num_r(self) -> int:
        return self.num_doi**2 * self.num_r_ring

    @property
    def num_z_diff(self) -> int:
        m = self.max_ring_diff
        return (m + 1) * self.rings - m * (m + 1) // 2 - self.rings

    @property
    def num_z(self) -> int:
        return self.rings + 2 * self.num_z_diff

    @property
    def bins(self) -> int:
        return self.num_r * self.dets_per_ring * self.num_z

    @property
    def r_cut(self) -> int:
        return self.min_ang_diff // 2 + (self.min_ang_diff % 2 != 0 and self.dets_per_ring % 4 == 0)

    @staticmethod
    def from_json(text: str) -> Scanner:
        """The geometry of a scanner definition; see scanner_file."""
        return scanner_file(text).scanner


#: Newest version of a scanner definition that is understood (fixed value).
NEWEST = 3.2


@dataclass(frozen=True)
class ScannerFile:
    """A scanner definition: name, version, geometry, what scatter needs (None if not given), and the files it names."""

    name: str
    version: float
    scanner: Scanner
    collimator: float | None = None
    fwhm: float | None = None
    lld: float | None = None
    coordinates: str | None = None
    mask: str | None = None


def json_value(raw: dict, *names: str, default: object = None, needed: bool = False) -> object:
    """The value under the first of some names that is there, else the default; a needed one that is missing is an error."""
    for n in names:
        if n in raw:
            return raw[n]
    if needed:
        raise ValueError(f"{names[0]} is missing")
    return default


def scanner_file(text: str) -> ScannerFile:
    """A scanner definition from JSON.

    The version, the name, the sizes and the counts are needed; crystals per
    block are 1 where they are not given.  A newer version is an error.
    """
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError("the scanner definition is no JSON") from e
    need = lambda *n: json_value(raw, *n, needed=True)
    version = float(need("VERSION"))
    if version > NEWEST + 1e-6:
        raise ValueError(f"version {version} is newer than {NEWEST}")
    sizes = {"axial_fov": "axialFOV", "crystal_size_z": "crystalSize_z", "crystal_size_trans": "crystalSize_trans", "crystal_depth": "crystalDepth", "radius": "scannerRadius"}
    counts = {"dets_per_ring": "detsPerRing", "rings": "numRings", "num_doi": "numDOI", "max_ring_diff": "maxRingDiff", "min_ang_diff": "minAngDiff"}
    other = {"rings": "num_rings"}
    given = {k: float(need(v)) for k, v in sizes.items()} | {k: int(need(other.get(k, k), v)) for k, v in counts.items()}
    given["dets_per_block"] = int(json_value(raw, "dets_per_block", "detsPerBlock", default=1))
    return ScannerFile(
        need("scannerName"), version, Scanner(**given),
        *(json_value(raw, k) for k in ("collimatorRadius", "fwhm", "energyLLD", "detCoord", "detMask")),
    )


FAKE = Scanner()


def periodic_diff(a: Column, b: Column, n: int) -> Column:
    d = F.abs(a - b) % n
    return F.least(d, n - d)


def ring_pos(d: Column, s: Scanner = FAKE) -> Column:
    return d % s.dets_per_ring


def ring(d: Column, s: Scanner = FAKE) -> Column:
    return F.floor(d / s.dets_per_ring) % s.rings


def doi(d: Column, s: Scanner = FAKE) -> Column:
    return F.floor(d / (s.dets_per_ring * s.rings))


def block(d: Column, s: Scanner = FAKE) -> Column:
    return F.floor(d % s.dets_per_ring / s.dets_per_block)


def det_lut(spark: SparkSession, s: Scanner = FAKE, places: int = 5) -> DataFrame:
    """(det_id, x, y, z, nx, ny, nz) from the closed form, rounded; one row a detector."""
    d = F.col("det_id")
    blocks = s.dets_per_ring // s.dets_per_block
    angle = F.lit(2e0) * F.pi() * block(d, s) / blocks
    radius = F.lit(s.radius) + F.lit(s.crystal_depth) * doi(d, s) + F.lit(s.crystal_depth) / 2
    inside = F.lit(0.0) if s.dets_per_block == 1 else (F.lit(-0.5) + (d % s.dets_per_ring % s.dets_per_block + F.lit(0.5)) / s.dets_per_block) * (s.crystal_size_trans * s.dets_per_block)
    r = lambda c: F.round(c, places) + F.lit(0.0)
    return spark.range(s.detectors).withColumnRenamed("id", "det_id").select(
        "det_id",
        r(radius * F.cos(angle) + inside * F.cos(angle + F.pi() / 2)).alias("x"),
        r(radius * F.sin(angle) + inside * F.sin(angle + F.pi() / 2)).alias("y"),
        r(F.lit(-s.axial_fov / 2) + (ring(d, s) + F.lit(0.5)) * (s.axial_fov / s.rings)).alias("z"),
        r(F.cos(angle)).alias("nx"),
        r(F.sin(angle)).alias("ny"),
        F.lit(0.0).alias("nz"),
    )


def ring_map(spark: SparkSession, s: Scanner = FAKE) -> DataFrame:
    """(d1r, d2r, r_ring, phi): the detector pairs of one ring that have a bin; about dets_per_ring squared / 2 rows.

    Two (r, phi) can name the same pair; the last in order of (phi, r) counts.
    """
    n, half = s.dets_per_ring, s.dets_per_ring // 2
    phi, r = F.floor(F.col("id") / s.num_r_ring), F.col("id") % s.num_r_ring
    base = r - n // 4 + s.r_cut
    second = F.when(phi % 2 != 0, half + 1).otherwise(half) - base
    wrap = lambda x: F.when(x < 0, x + n).otherwise(x)
    a, b = (wrap(base) + F.floor(phi / 2)) % n, (wrap(second) + F.floor(phi / 2)) % n
    table = spark.range(n * s.num_r_ring).select("id", F.least(a, b).alias("d1r"), F.greatest(a, b).alias("d2r"), r.alias("r_ring"), phi.alias("phi"))
    return table.groupBy("d1r", "d2r").agg(F.max_by(F.struct("r_ring", "phi"), "id").alias("at")).select("d1r", "d2r", "at.r_ring", "at.phi")


def z_map(spark: SparkSession, s: Scanner = FAKE) -> DataFrame:
    """(z_bin, z1, z2) of all legal ring pairs: at most rings squared rows."""
    z1, z2 = F.floor(F.col("id") / s.rings), F.col("id") % s.rings
    dz = F.abs(z2 - z1)
    z_bin = dz * s.rings + F.least(z1, z2) - F.floor(dz * (dz - 1) / 2) + F.when(z1 > z2, s.num_z_diff).otherwise(0)
    return spark.range(s.rings**2).where(dz <= s.max_ring_diff).select(z_bin.alias("z_bin"), z1.alias("z1"), z2.alias("z2"))


def pair_to_bin(rows: DataFrame, ring_pairs: DataFrame, s: Scanner = FAKE, on_illegal: str = "drop") -> DataFrame:
    """Adds r, phi, z_bin, bin to rows with (d1, d2).

    The pair is ordered by ring position.  Pairs outside the ring map or with
    too large a ring difference are dropped, or raise an error.
    """
    swap = (F.least("d1", "d2") % s.dets_per_ring) > (F.greatest("d1", "d2") % s.dets_per_ring)
    a = F.when(swap, F.greatest("d1", "d2")).otherwise(F.least("d1", "d2"))
    b = F.when(swap, F.least("d1", "d2")).otherwise(F.greatest("d1", "d2"))
    e = rows.withColumns({"__a": a, "__b": b})
    z1, z2 = ring(F.col("__a"), s), ring(F.col("__b"), s)
    e = e.withColumns({"d1r": ring_pos(F.col("__a"), s), "d2r": ring_pos(F.col("__b"), s), "__z1": z1, "__z2": z2, "__dz": F.abs(z2 - z1)})
    # the ring map has at most dets_per_ring squared / 2 rows, whatever the data
    e = e.join(F.broadcast(ring_pairs), ["d1r", "d2r"], "left")
    legal = F.col("r_ring").isNotNull() & (F.col("__dz") <= s.max_ring_diff)
    if on_illegal == "error":
        e = e.withColumn("r_ring", F.when(legal, F.col("r_ring")).otherwise(F.raise_error(F.lit("pair outside the histogram"))))
    else:
        e = e.where(legal)
    z = F.col("__dz") * s.rings + F.least("__z1", "__z2") - F.floor(F.col("__dz") * (F.col("__dz") - 1) / 2)
    z = z + F.when(F.col("__z1") > F.col("__z2"), s.num_z_diff).otherwise(0)
    r = F.col("r_ring") * s.num_doi**2 + doi(F.col("__a"), s) + doi(F.col("__b"), s) * s.num_doi
    e = e.withColumns({"r": r, "z_bin": z})
    e = e.withColumn("bin", F.col("z_bin") * s.dets_per_ring * s.num_r + F.col("phi") * s.num_r + F.col("r"))
    return e.drop("__a", "__b", "__z1", "__z2", "__dz", "d1r", "d2r", "r_ring")


def bin_to_pair(rows: DataFrame, ring_pairs: DataFrame, planes: DataFrame, s: Scanner = FAKE) -> DataFrame:
    """Adds r, phi, z_bin, d1, d2 to rows with bin; the inverse of pair_to_bin up to the order of the pair."""
    plane = s.dets_per_ring * s.num_r
    e = rows.withColumns({"z_bin": F.floor(F.col("bin") / plane), "phi": F.floor(F.col("bin") % plane / s.num_r), "r": F.col("bin") % plane % s.num_r})
    e = e.withColumn("r_ring", F.floor(F.col("r") / s.num_doi**2))
    e = e.join(F.broadcast(ring_pairs), ["r_ring", "phi"]).join(F.broadcast(planes), "z_bin")
    case, per = F.col("r") % s.num_doi**2, s.dets_per_ring * s.rings
    d1 = F.col("d1r") + F.col("z1") * s.dets_per_ring + case % s.num_doi * per
    d2 = F.col("d2r") + F.col("z2") * s.dets_per_ring + F.floor(case / s.num_doi) * per
    return e.select("bin", "r", "phi", "z_bin", d1.alias("d1"), d2.alias("d2"))


def with_lor(rows: DataFrame, det: DataFrame) -> DataFrame:
    """Adds x1, y1, z1, x2, y2, z2 from the detector table (a scanner's detectors: a dimension table of fixed size)."""
    one = det.select(F.col("det_id").alias("d1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"))
    two = det.select(F.col("det_id").alias("d2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    return rows.join(F.broadcast(one), "d1").join(F.broadcast(two), "d2")


def in_plane_angle_diff(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """Angle in degrees, 0 to 180, between the two endpoints seen from the axis."""
    d = F.abs(F.atan2(y1, x1) - F.atan2(y2, x2))
    return F.degrees(F.pi() - F.abs(d - F.pi()))
