"""Single scatter through attenuation and emission images, and the scatter estimate that is fitted to the tails."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomoframe.functions.scalars import erfc
from tomoframe.operators import algebra, project, recon, scatter
from tomoframe.operators.scatter import SPACE, Space
from tomoframe.sources.views import GRID, Grid

#: Irrational steps of the additive recurrence that places a point within its cell, one an axis.
SHIFTS = (0.8191725133961645, 0.6710436067037893, 0.5497004779019703)
#: Least attenuation (1/cm) of a voxel that scatters; fewest cells of points along an axis; least sensitivity.
LEAST_MU, LEAST_CELLS, EPS = 0.005, 5, 1.1920929e-7


#: Fewest points that a simulation takes.
LEAST_POINTS = 10


@dataclass(frozen=True)
class Detection:
    """What a scanner detects: lower energy bound and energy resolution (keV), crystal depth, radii (mm), and the
    attenuation of the crystal, one value a whole keV from 1 on."""

    crystal: Sequence[float]
    radius: float = 200.0
    depth: float = 20.0
    collimator: float = 190.0
    lld: float = 400.0
    fwhm: float = 80.0

    @property
    def sigma(self) -> float:
        return self.fwhm / (2 * math.sqrt(2 * math.log(2)))

    def window(self, energy: Column) -> Column:
        """Share of the photons of an energy that the window lets through, doubled."""
        return erfc((F.lit(self.lld) - energy) / F.lit(math.sqrt(2) * self.sigma))

    def stopped(self, path: Column, energy: Column) -> Column:
        """Share of the photons stopped on a path through the crystal."""
        table = F.array(*[F.lit(float(v)) for v in self.crystal])
        return 1 - F.exp(-path * F.get(table, F.floor(energy).cast("int") - 1))


def sample_points(spark: SparkSession, mu: DataFrame, d: Detection, share: float, g: Grid = GRID) -> DataFrame:
    """(point, sx, sy, sz, density): one point in each cell of a coarse grid, where matter scatters.

    share is the number of cells along an axis over that of voxels, 5 cells at
    least.  A point's place in its cell follows from its number alone, so a
    task that is run again places it alike.
    """
    n = [max(LEAST_CELLS, int(share * k)) for k in (g.nx, g.ny, g.nz)]
    at = (F.col("id") % n[0], F.floor(F.col("id") / n[0]) % n[1], F.floor(F.col("id") / (n[0] * n[1])))
    pos = {}
    for a, i, k, voxels, size, off, shift in zip("xyz", at, n, (g.nx, g.ny, g.nz), (g.vx, g.vy, g.vz), (g.ox, g.oy, g.oz), SHIFTS, strict=True):
        u = (F.col("id") + 1) * F.lit(shift)
        pos[a] = (i + u - F.floor(u)) * F.lit(voxels * size / k) + F.lit(off + size / 2 - voxels * size / 2)
    e = algebra.read_points(mu, spark.range(math.prod(n)).withColumns(pos), g)
    e = e.where((F.col("value") > LEAST_MU) & (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) < d.collimator))
    return e.select(F.col("id").alias("point"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), F.col("value").alias("density"))


def end_position(k: str, radius: float, s: Space = SPACE) -> dict[str, Column]:
    """x, y, z of an end from its plane p and angle a, all with the suffix k."""
    turn = (F.col(f"a{k}") + F.lit(0.5)) * F.lit(2 * math.pi / s.angles)
    return {f"x{k}": F.cos(turn) * radius, f"y{k}": F.sin(turn) * radius, f"z{k}": (F.col(f"p{k}") + F.lit(0.5)) * F.lit(s.axial / s.planes) - F.lit(s.axial / 2)}


def _crossing(ox: Column, oy: Column, dx: Column, dy: Column, radius: float) -> Column:
    """Parameter at which a ray from within a cylinder leaves it."""
    a, b, c = dx * dx + dy * dy, ox * dx + oy * dy, ox * ox + oy * oy - F.lit(radius * radius)
    return (-b + F.sqrt(b * b - a * c)) / a


def crystal_path(ox: Column, oy: Column, dx: Column, dy: Column, dz: Column, d: Detection) -> Column:
    """Length between the inner and the outer face of the crystals of a ray from o along d."""
    out, inn = _crossing(ox, oy, dx, dy, d.radius + d.depth), _crossing(ox, oy, dx, dy, d.radius)
    return (out - inn) * F.sqrt(dx * dx + dy * dy + dz * dz)


def paths(points: DataFrame, mu: DataFrame, emission: DataFrame, d: Detection, s: Space = SPACE, g: Grid = GRID) -> DataFrame:
    """(end, point, density, ux, uy, uz, dist, depth, facing, clear, att, lam): the way from each point to each end of the space.

    Both sizes are settings, not data: the cells' ends and the sampled points.
    Every line integral is taken once an end, not once a pair of ends.
    """
    ends = points.sparkSession.range(s.planes * s.angles).select(F.col("id").alias("end"), F.floor(F.col("id") / s.angles).alias("p1"), (F.col("id") % s.angles).alias("a1"))
    e = ends.withColumns(end_position("1", d.radius, s)).crossJoin(points)
    e = e.withColumns({f"{a}2": F.col(f"s{a}") for a in "xyz"})
    e = recon.cut(e.withColumns({f"d{a}": F.col(f"{a}1") - F.col(f"s{a}") for a in "xyz"}), "paths")
    m = project.siddon(e, g, keep=("end", "point"))
    lines = mu.select("vox", F.col("value").alias("__m")).join(emission.select("vox", F.col("value").alias("__l")), "vox")
    sums = m.join(lines, "vox").groupBy("end", "point").agg((F.sum(F.col("w") * F.col("__m")) / 10).alias("att"), F.sum(F.col("w") * F.col("__l")).alias("lam"))
    dist = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    plate = F.when(F.col("sz") < 0, F.lit(-s.axial / 2)).otherwise(F.lit(s.axial / 2))
    t = (plate - F.col("sz")) / F.col("dz")
    through = F.hypot(F.col("sx") + t * F.col("dx"), F.col("sy") + t * F.col("dy")) < d.collimator
    e = e.withColumns({"dist": dist, "depth": crystal_path(F.col("sx"), F.col("sy"), F.col("dx"), F.col("dy"), F.col("dz"), d)})
    e = e.withColumns({f"u{a}": F.col(f"d{a}") / F.col("dist") for a in "xyz"})
    clear = (F.abs("sz") <= s.axial / 2) | F.coalesce(through, F.lit(False))
    e = e.withColumns({"facing": F.abs(F.col("x1") * F.col("ux") + F.col("y1") * F.col("uy")) / d.radius, "clear": clear})
    e = e.join(sums, ["end", "point"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("att", "lam")})
    return e.select("end", "point", "density", "ux", "uy", "uz", "dist", "depth", "facing", "clear", "att", "lam")


def simulate(points: DataFrame, mu: DataFrame, emission: DataFrame, d: Detection, s: Space = SPACE, g: Grid = GRID) -> DataFrame:
    """(p1, a1, p2, a2, value) for all cells: coincidences with one photon scattered once, over the line's own efficiency.

    The two ways to a point meet by an equi join on the point, and each task
    adds up its points by cell before anything is exchanged; a cell and its
    mirror image are equal, so one of the two is computed.
    """
    if points.limit(LEAST_POINTS).count() < LEAST_POINTS:
        raise ValueError(f"fewer than {LEAST_POINTS} scatter points")
    way = recon.cut(paths(points, mu, emission, d, s, g), "ways")
    one = way.select("point", "density", *[F.col(c).alias(f"{c}1") for c in way.columns if c not in ("point", "density")])
    two = way.select("point", *[F.col(c).alias(f"{c}2") for c in way.columns if c not in ("point", "density")])
    cos = -(F.col("ux1") * F.col("ux2") + F.col("uy1") * F.col("uy2") + F.col("uz1") * F.col("uz2"))
    e = one.join(two, "point").where("end1 < end2 AND clear1 AND clear2").withColumn("cos", cos)
    e = e.withColumn("energy", F.lit(511.0) / (F.lit(2.0) - F.col("cos"))).where(F.col("energy") > d.lld)
    full, low = F.lit(511.0), F.col("energy")
    straight = {k: d.window(full) * d.stopped(F.col(f"depth{k}"), full) for k in "12"}
    bent = {k: d.window(low) * d.stopped(F.col(f"depth{k}"), low) for k in "12"}
    weaker = scatter.mu_scaling(low)
    first = F.col("lam1") * F.exp(-F.col("att1") - F.col("att2") * weaker) * straight["1"] * bent["2"]
    second = F.col("lam2") * F.exp(-F.col("att1") * weaker - F.col("att2")) * straight["2"] * bent["1"]
    part = F.col("density") * scatter.klein_nishina(F.col("cos")) * (first + second) * F.col("facing1") * F.col("facing2")
    part = part / (F.col("dist1") * F.col("dist1") * F.col("dist2") * F.col("dist2") * F.lit(4 * math.pi))
    half = e.groupBy("end1", "end2").agg(F.sum(part).alias("sum"))
    half = _ends(half, s).withColumns(end_position("1", d.radius, s) | end_position("2", d.radius, s))
    v = [F.col(f"{a}2") - F.col(f"{a}1") for a in "xyz"]
    size2 = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    mid = [(F.col(f"{a}1") + F.col(f"{a}2")) / 2 for a in "xy"]
    own = d.window(full) * d.window(full) * F.lit(1 / (4 * math.pi)) / size2 / size2
    for k, sign in (("1", -1), ("2", 1)):
        ray = [c * (sign / 2) for c in v]
        own = own * d.stopped(crystal_path(mid[0], mid[1], *ray, d), full) * F.abs(F.col(f"x{k}") * v[0] + F.col(f"y{k}") * v[1]) / d.radius
    half = half.select("end1", "end2", F.greatest(F.lit(0.0), F.col("sum") / own).alias("value"))
    both = half.select(F.explode(F.array(F.struct(F.col("end1").alias("i"), F.col("end2").alias("j")), F.struct(F.col("end2").alias("i"), F.col("end1").alias("j")))).alias("c"), "value")
    n = s.planes * s.angles
    cells = points.sparkSession.range(n * n).select(F.floor(F.col("id") / n).alias("end1"), (F.col("id") % n).alias("end2"))
    e = cells.join(both.select(F.col("c.i").alias("end1"), F.col("c.j").alias("end2"), "value"), ["end1", "end2"], "left")
    return _ends(e, s).select("p1", "a1", "p2", "a2", F.coalesce("value", F.lit(0.0)).alias("value"))


def _ends(e: DataFrame, s: Space) -> DataFrame:
    out = {}
    for k in "12":
        out |= {f"p{k}": F.floor(F.col(f"end{k}") / s.angles), f"a{k}": F.col(f"end{k}") % s.angles}
    return e.withColumns(out)


def inside(mu: DataFrame, radius: float, least: float, s: Space = SPACE, g: Grid = GRID) -> DataFrame:
    """(p1, a1, p2, a2, inside) for all cells: the line integral of mu is above least."""
    n = s.planes * s.angles
    e = _ends(mu.sparkSession.range(n * n).select(F.floor(F.col("id") / n).alias("end1"), (F.col("id") % n).alias("end2")), s)
    cell = ("p1", "a1", "p2", "a2")
    lines = e.where("end1 <> end2").withColumns(end_position("1", radius, s) | end_position("2", radius, s))
    m = project.siddon(lines, g, keep=cell).join(mu.select("vox", F.col("value").alias("__m")), "vox")
    hit = m.groupBy(*cell).agg(F.sum(F.col("w") * F.col("__m")).alias("__s"))
    return e.join(hit, list(cell), "left").select(*cell, (F.coalesce("__s", F.lit(0.0)) > least).alias("inside"))


def measured(lors: DataFrame, s: Space = SPACE) -> DataFrame:
    """(p1, a1, p2, a2, prompts, randoms): sums by nearest cell, over the sensitivity; 0 where that is as good as none.

    lors has the line's ends, prompts, randoms and sens.
    """
    over = lambda c: F.when(F.col("sens") > EPS, F.col(c) / F.col("sens")).otherwise(F.lit(0.0))
    random = F.when(F.col("randoms") > 0, over("randoms")).otherwise(F.lit(0.0))
    return scatter.cells(lors, s).groupBy("p1", "a1", "p2", "a2").agg(F.sum(over("prompts")).alias("prompts"), F.sum(random).alias("randoms"))


def tail_factor(scattered: DataFrame, tail: DataFrame, counts: DataFrame) -> DataFrame:
    """One row, factor: prompts less randoms over simulated scatter, each summed over all tail cells, those without a count too."""
    cell = ["p1", "a1", "p2", "a2"]
    e = tail.join(scattered, cell).join(counts, cell, "left")
    net = F.coalesce("prompts", F.lit(0.0)) - F.coalesce("randoms", F.lit(0.0))
    return e.agg((F.sum(net) / F.sum("value")).alias("factor"))


def estimate(lors: DataFrame, points: DataFrame, mu: DataFrame, emission: DataFrame, d: Detection, width: int, least: float, s: Space = SPACE, g: Grid = GRID) -> DataFrame:
    """(p1, a1, p2, a2, value): the simulated scatter, scaled so that it meets the measured tails beside the object."""
    raw = recon.cut(simulate(points, mu, emission, d, s, g), "scatter")
    tail = scatter.tails(inside(mu, d.radius, least, s, g), width, s)
    factor = tail_factor(raw, tail, measured(lors, s))
    return raw.crossJoin(factor).select("p1", "a1", "p2", "a2", (F.col("value") * F.col("factor")).alias("value"))  # one row
