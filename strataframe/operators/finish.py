"""Finishing a raster: which sides may be trimmed, coverage, halos, and the order in which the steps apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Grid
from . import rasters, regions

#: Parts of a name that tell which way the strips of a survey run.
AXES = {"_GLAS_": "x", "_NFI_": "y"}


def strip_axis(name: str, height: int, width: int) -> str:
    """Along which axis strips run: told by the name, else by the raster's longer side."""
    return next((axis for part, axis in AXES.items() if part in name), "x" if width > height else "y")


def protected_sides(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> dict[str, bool]:
    """Sides beyond which points lie: there the frame cuts the survey, and no edge of the survey can be trimmed."""
    row, col = grid.index(F.col(x), F.col(y))
    lo_r, hi_r, lo_c, hi_c = points.agg(F.min(row), F.max(row), F.min(col), F.max(col)).first()  # four numbers
    if lo_r is None:
        return dict.fromkeys(("north", "south", "west", "east"), False)
    return {"north": lo_r < 0, "south": hi_r >= grid.height, "west": lo_c < 0, "east": hi_c >= grid.width}


def footprint(points: DataFrame, grid: Grid, reach: float, strip: int = 0, axis: str = "x", x: str = "x", y: str = "y") -> DataFrame:
    """The cells that the data supports: within ``reach`` of an occupied cell, holes closed, ``strip`` cells taken off
    both ends of each row (axis x) or column (axis y), but for sides that the frame cuts."""
    row, col = grid.index(F.col(x), F.col(y))
    inside = row.between(0, grid.height - 1) & col.between(0, grid.width - 1)
    have = points.filter(inside).select(row.alias("row"), col.alias("col")).distinct()
    cells = rasters.near(have, max(0, int(reach / grid.cell)), grid.height, grid.width).select("row", "col")
    cells = cells.unionByName(regions.holes(cells, grid.height, grid.width).select("row", "col"))
    if not strip:
        return cells
    side = protected_sides(points, grid, x, y)
    lo, hi = ("west", "east") if axis == "x" else ("north", "south")
    return rasters.stripped(cells, strip, "row" if axis == "x" else "col", side[lo], side[hi])


def finalise(cells: DataFrame, grid: Grid, support: DataFrame | None = None, strip: int = 0, axis: str = "x", erode: int = 0, fill: bool = True, protected: dict[str, bool] | None = None) -> DataFrame:
    """Fill enclosed voids, trim (strip or erode, not both), keep supported cells and those that they enclose, and see to
    it that no valid cell holds the sentinel. An empty result is an error when it is counted by the caller."""
    if strip and erode:
        raise ValueError("either strip or erode")
    whole = regions.filled(cells, grid.height, grid.width) if fill else cells.select("row", "col", "z")
    out = whole
    if strip:
        side = protected or {}
        lo, hi = ("west", "east") if axis == "x" else ("north", "south")
        out = rasters.stripped(out, strip, "row" if axis == "x" else "col", side.get(lo, False), side.get(hi, False))
    elif erode:
        out = rasters.eroded(out, erode, grid.height, grid.width)
    if support is not None:
        out = out.join(support.select("row", "col"), ["row", "col"], "left_semi")
        inner = regions.holes(out, grid.height, grid.width).select("row", "col")
        out = out.unionByName(whole.join(inner, ["row", "col"], "left_semi"))
    return rasters.enforced(out)


def with_halo(cells: DataFrame, neighbours: DataFrame, height: int, width: int, halo: int) -> DataFrame:
    """``row, col, z, kind`` of a tile with a halo: its own cells, then real ones of its neighbours (in this tile's rows and
    columns), and mirrored ones where there are none."""
    around = F.col("row").between(-halo, height - 1 + halo) & F.col("col").between(-halo, width - 1 + halo)
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    own = cells.filter(inside).select("row", "col", F.col("z").cast("double").alias("z"), F.lit("own").alias("kind"))
    real = neighbours.filter(around & ~inside).groupBy("row", "col").agg(F.min("z").cast("double").alias("z")).withColumn("kind", F.lit("neighbour"))
    # Row r is mirrored to -1 - r at the top and to 2 h - 1 - r at the bottom; columns likewise.
    flip = lambda c, n: F.explode(F.array(F.col(c), -1 - F.col(c), 2 * n - 1 - F.col(c)))
    seen = own.select(flip("row", height).alias("row"), "col", "z").select("row", flip("col", width).alias("col"), "z").filter(around & ~inside)
    mirrored = seen.join(real.select("row", "col"), ["row", "col"], "left_anti").withColumn("kind", F.lit("mirrored"))
    return own.unionByName(real).unionByName(mirrored)


def centred(cells: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Cells moved into the middle of a canvas, cut off beyond it."""
    dr, dc = (to_height - height) // 2, (to_width - width) // 2
    return cells.withColumns({"row": F.col("row") + dr, "col": F.col("col") + dc}).filter(F.col("row").between(0, to_height - 1) & F.col("col").between(0, to_width - 1))


def dark_patch(grey: DataFrame, below: int = 40, least: int = 2) -> DataFrame:
    """``label, cells, row, col``: the largest connected patch of dark cells and its centre."""
    dark = grey.filter(F.col("grey") < below)
    c = regions.components(dark).groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.avg("row").alias("row"), F.avg("col").alias("col")).filter(F.col("cells") >= least)
    return c.orderBy(F.desc("cells"), "label").limit(1)


def cropped(points: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    """The points in a box, as a filter on the scan; an empty box is an error."""
    got = points.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    if got.isEmpty():
        raise ValueError("no points in the box")
    return got
