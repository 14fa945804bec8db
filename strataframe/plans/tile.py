"""One tile from points to a finished raster: classify, clean, de-duplicate, interpolate, finish, shade, and an account of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import fixed
from ..model import Grid, cell_for_density, radius_for_density, snap_outward
from ..operators import cells, ground, neighbors, rasters, regions, surface
from .config import Config


@dataclass
class Result:
    grid: Grid
    cells: DataFrame
    account: dict
    relief: DataFrame | None = None


def classify(points: DataFrame, config: Config) -> DataFrame:
    if config.ground == "adjudicated":
        return ground.adjudicate(points, ground.Adjudication.of(**config.overrides))
    return ground.sequence(points, [(p.kernel, p.parameters()) for p in config.passes])


def process(points: DataFrame, config: Config, grid: Grid | None = None, progress: Callable[[str, str, float], None] = lambda *_: None) -> Result:
    """``points``: xi, yi in decimetres and zi in centimetres. ``grid``: a lattice to adopt, in decimetres; otherwise one is
    chosen from the ground's density. The stages' results are checkpointed where later stages read them twice."""
    account: dict = {}
    progress("classify", config.ground, 0.0)
    own = fixed(classify(points.select("xi", "yi", "zi"), config).filter("is_ground").select("xi", "yi", "zi"))
    account["ground_points"] = own.count()
    if account["ground_points"] < 500:
        raise ValueError(f"only {account['ground_points']} ground points")
    places = cells.dedupe_xy(own, "xi", "yi", "zi", config.dedupe).select("xi", "yi", F.col("zi").alias("z"))
    if config.cleanup:
        progress("clean", f"{config.cleanup_height_cm:g} cm", 0.3)
        places = neighbors.heights_above_floor(places, config.cleanup_radius_dm).filter(F.col("above") <= config.cleanup_height_cm).select("xi", "yi", "z")
    places = fixed(places)
    row = places.groupBy(F.expr("xi div 50"), F.expr("yi div 50")).agg(F.count(F.lit(1)).alias("n"), F.min("xi").alias("x0"), F.max("xi").alias("x1"), F.min("yi").alias("y0"), F.max("yi").alias("y1")).agg(F.sum("n"), F.count(F.lit(1)), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    density = row[0] / (row[1] * 25)
    account |= {"points": row[0], "density": density}
    if grid is None:
        cell = max(1, round(10 * (config.cell_m or cell_for_density(density))))
        grid = snap_outward(row[2], row[4], row[3] + 1, row[5] + 1, cell)
    radius = 10 * (config.radius_m or radius_for_density(density, config.neighbours))
    account |= {"cell_m": grid.cell / 10, "radius_m": radius / 10, "rows": grid.height, "cols": grid.width}

    progress("interpolate", config.engine, 0.4)
    c = int(grid.cell)
    # Engines count rows upwards from the axis; the grid counts them downwards from its top.
    lattice = grid.cells(points.sparkSession).select(F.floor(F.col("y") / c).alias("row"), F.floor(F.col("x") / c).alias("col"), F.col("x").cast("long").alias("xi"), F.col("y").cast("long").alias("yi"))
    if config.engine == "minimum curvature":
        core = -(-1500 // c) * c
        z = surface.curvature_blocks(places, c, core, -(-200 // c) * c, scale=0.1)
    elif config.engine == "kriging":
        bins = neighbors.variogram(neighbors.sampled(places, ["xi", "yi"], max(1, row[0] // 20_000)), radius)
        fit = neighbors.fitted(bins).first()
        z = surface.krige(places, lattice, ("spherical", fit["nugget"], fit["sill"], fit["reach"]), config.neighbours, radius)
    elif config.engine == "spline":
        z = surface.spline(places, lattice, 48, 2 * radius)
    elif config.engine == "tin":
        z = surface.tin(places, c, -(-1500 // c) * c, -(-200 // c) * c)
    else:
        z = surface.idw(places, lattice, config.neighbours, radius)
    top = round(grid.origin_y / c) - 1
    left = round(grid.origin_x / c)
    z = z.select((F.lit(top) - F.col("row")).alias("row"), (F.col("col") - left).alias("col"), "z").filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))

    progress("finish", "coverage", 0.7)
    r, k = grid.index(F.col("xi") + F.lit(0.5), F.col("yi") + F.lit(0.5))
    covered = places.select(r.alias("row"), k.alias("col")).distinct()
    support = rasters.near(covered, max(1, round(40 / c)), grid.height, grid.width).select("row", "col")
    z = fixed(z.join(support, ["row", "col"], "left_semi"))
    if config.fill_voids:
        z = regions.filled(z, grid.height, grid.width)
    if config.strip_cells:
        z = rasters.stripped(z, config.strip_cells)
    elif config.erode_cells:
        z = rasters.eroded(z, config.erode_cells, grid.height, grid.width)
    z = fixed(rasters.enforced(z))
    account["cells"] = z.count()
    if not account["cells"]:
        raise ValueError("the finished raster is empty")
    progress("done", "", 1.0)
    relief = rasters.composite(z, grid.height, grid.width, float(grid.cell)) if config.relief else None
    return Result(grid, z, account, relief)
