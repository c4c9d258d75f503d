"""Projectors by name, forward and back, with one set of settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomoframe.operators import footprint, project
from tomoframe.operators.psf import ProjectionPsf
from tomoframe.sources.views import GRID, Grid


@dataclass(frozen=True)
class Projector:
    """name: "siddon" or "dd" (distance-driven).

    tof: FWHM in ps and number of sigmas.  rays: lines from crystal to crystal
    that are averaged, for siddon.  crystal: axial size, size across and depth.
    psf: kernels across the line, for dd.  Lines need x1 .. z2, dd and rays the
    normals nx1 .. nz2, tof tof_ps.
    """

    name: str = "siddon"
    grid: Grid = GRID
    tof: tuple[float, float] | None = None
    rays: int = 1
    crystal: tuple[float, float, float] = (1.0, 1.0, 0.0)
    psf: ProjectionPsf | None = None

    def __post_init__(self) -> None:
        if self.name not in ("siddon", "dd"):
            raise ValueError(f"unknown projector {self.name}")
        if self.name == "siddon" and self.psf is not None:
            raise ValueError("kernels across the line need the distance-driven projector")
        if self.name == "dd" and self.rays != 1:
            raise ValueError("several rays need siddon")

    def columns(self) -> set[str]:
        """Columns that the lines have to have."""
        out = set(footprint.ENDS)
        if self.name == "dd" or self.rays > 1:
            out |= set(footprint.NORMALS)
        return out | {"tof_ps"} if self.tof else out

    def matrix(self, lors: DataFrame, key: str = "bin", adjoint: bool = False) -> DataFrame:
        """(key, vox, w) of the lines."""
        missing = (self.columns() | {key}) - set(lors.columns)
        if missing:
            raise ValueError(f"the lines lack {sorted(missing)}")
        if self.name == "dd":
            axial, trans, _ = self.crystal
            return footprint.distance_driven(lors, self.grid, trans, axial, (key,), self.tof, self.psf, adjoint)
        if self.rays > 1:
            lors = project.crystal_rays(lors, self.rays, *self.crystal, key=key)
        m = project.siddon(lors, self.grid, self.tof, (key,))
        return m.withColumn("w", F.col("w") / self.rays) if self.rays > 1 else m

    def forward(self, lors: DataFrame, image: DataFrame, key: str = "bin") -> DataFrame:
        """(key, value): the projection of an image (vox, value) along each line that meets it."""
        return project.forward(self.matrix(lors, key), image, key)

    def back(self, lors: DataFrame, key: str = "bin") -> DataFrame:
        """(vox, value): the sum of w * value of lines with their value, which travels with the line where the projector lets it."""
        lors = lors.where("value <> 0")
        if self.name == "dd":
            axial, trans, _ = self.crystal
            return footprint.back_lors(lors, self.grid, trans, axial, self.tof, self.psf)
        if self.rays > 1:
            lors = project.crystal_rays(lors, self.rays, *self.crystal, key=key).withColumn("value", F.col("value") / self.rays)
        return project.back_lors(lors, self.grid, self.tof)
