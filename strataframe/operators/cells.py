"""Aggregates by cell, strip, class and height: partial aggregation on the map side, one shuffle by cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import fixed


def cell(v: str, size: int) -> Column:
    """The index of a non-negative integer coordinate's cell."""
    return F.expr(f"{v} div {size}")


def by_cell(points: DataFrame, size: int, *more: str):
    return points.groupBy(cell("xi", size).alias("cx"), cell("yi", size).alias("cy"), *more)


KEEP = {"lowest": F.min, "highest": F.max}


def dedupe_xy(points: DataFrame, x: str, y: str, z: str, keep: str = "mean", order: list[str] | None = None, snap: float | None = None) -> DataFrame:
    """One point for each place: ``x, y, z, n``. ``first`` needs the columns that say what comes first; ``snap`` rounds
    coordinates half to even to a multiple first."""
    if snap:
        points = points.withColumns({c: F.bround(F.col(c) / snap) * snap for c in (x, y)})
    if keep == "mean":
        value = F.sum(z) / F.count(z)
    elif keep == "first":
        value = F.min_by(z, F.struct(*order))
    elif keep in KEEP:
        value = KEEP[keep](z)
    else:
        raise ValueError(f"keep must be mean, first, lowest or highest, not {keep}")
    return points.groupBy(x, y).agg(value.alias(z), F.count(z).alias("n"))


def floors(points: DataFrame, size: int, low: float = 0.1, least: int = 3) -> DataFrame:
    """``cx, cy, n, floor, spread``: a low percentile of each cell and the distance to the opposite one; least and greatest
    height in cells of fewer points."""
    q = F.percentile("zi", F.array(F.lit(low), F.lit(1 - low)))
    got = by_cell(points, size).agg(F.count(F.lit(1)).alias("n"), q.alias("_q"), F.min("zi").alias("_lo"), F.max("zi").alias("_hi"))
    full = F.col("n") >= least
    lo, hi = F.when(full, F.col("_q")[0]).otherwise(F.col("_lo")), F.when(full, F.col("_q")[1]).otherwise(F.col("_hi"))
    return got.select("cx", "cy", "n", F.round(lo, 4).alias("floor"), F.round(hi - lo, 4).alias("spread"))


def plane_by_cell(points: DataFrame, size: int, least: int = 4) -> DataFrame:
    """``cx, cy, n, a, b, c, sse``: the least-squares plane z = a + b dx + c dy of each cell of ``least`` points, from exact
    integer sums about the cell's corner; cells whose points lie on a line have none."""
    sums = plane_sums(points.withColumns({"_dx": F.col("xi") % size, "_dy": F.col("yi") % size}), [cell("xi", size).alias("cx"), cell("yi", size).alias("cy")], "zi")
    return solved_plane(sums.filter(F.col("n") >= least))


def plane_sums(rows: DataFrame, keys: list, z: str) -> DataFrame:
    dx, dy, h = F.col("_dx"), F.col("_dy"), F.col(z)
    terms = {"sx": dx, "sy": dy, "sz": h, "sxx": dx * dx, "sxy": dx * dy, "syy": dy * dy, "sxz": dx * h, "syz": dy * h, "szz": h * h}
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(k) for k, t in terms.items()])


def solved_plane(sums: DataFrame) -> DataFrame:
    """Cramer's rule on the moments about the mean, scaled by n to stay whole."""
    d = lambda c: F.col(c).cast("double")
    n = d("n")
    m = {k: n * d(f"s{k}") - d(f"s{k[0]}") * d(f"s{k[1]}") for k in ("xx", "xy", "yy", "xz", "yz", "zz")}
    got = sums.withColumns({f"_{k}": v for k, v in m.items()}).withColumn("_det", F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")).filter("_det > 0")
    got = got.withColumns({"b": (F.col("_xz") * F.col("_yy") - F.col("_yz") * F.col("_xy")) / F.col("_det"), "c": (F.col("_yz") * F.col("_xx") - F.col("_xz") * F.col("_xy")) / F.col("_det")})
    got = got.withColumns({"a": (d("sz") - F.col("b") * d("sx") - F.col("c") * d("sy")) / n, "sse": (F.col("_zz") - F.col("b") * F.col("_xz") - F.col("c") * F.col("_yz")) / n})
    return got.drop("sx", "sy", "sz", "sxx", "sxy", "syy", "sxz", "syz", "szz", "_xx", "_xy", "_yy", "_xz", "_yz", "_zz", "_det")


#: The same in SQL, for rows ``n, sx, sy, ...``.
PLANE_SQL = """
m AS (SELECT *, n * sxx - sx * sx AS mxx, n * sxy - sx * sy AS mxy, n * syy - sy * sy AS myy, n * sxz - sx * sz AS mxz, n * syz - sy * sz AS myz, n * szz - sz * sz AS mzz FROM s),
f AS (SELECT *, (mxz * myy - myz * mxy) / (mxx * myy - mxy * mxy) AS b, (myz * mxx - mxz * mxy) / (mxx * myy - mxy * mxy) AS c FROM m WHERE mxx * myy - mxy * mxy > 0),
pl AS (SELECT *, (sz - b * sx - c * sy) / n AS a, (mzz - b * mxz - c * myz) / n AS sse FROM f)"""
SUMS_SQL = "count(*) AS n, " + ", ".join(f"CAST(sum({e}) AS DOUBLE) AS s{k}" for k, e in {"x": "dx", "y": "dy", "z": "h", "xx": "dx * dx", "xy": "dx * dy", "yy": "dy * dy", "xz": "dx * h", "yz": "dy * h", "zz": "h * h"}.items())


def bands(h: Column, edges: list[int]) -> Column:
    """The number of edges at or below h: 0 below the first."""
    return reduce(lambda a, b: a + b, [(h >= e).cast("int") for e in edges])


def above_floor(points: DataFrame, size: int) -> DataFrame:
    """The points with ``h``, their height above their cell's floor."""
    f = floors(points, size).select("cx", "cy", "floor")
    return points.withColumns({"cx": cell("xi", size), "cy": cell("yi", size)}).join(f, ["cx", "cy"]).withColumn("h", F.col("zi") - F.col("floor"))


def shares(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """``key, value, n, share`` of each value among its key's rows."""
    got = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key)) if key else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return got.withColumn("share", F.col("n") / total)


def strip_medians(points: DataFrame, size: int, least: int = 3, strips: int = 2) -> DataFrame:
    """``cx, cy, n_strips, spread``: the range of the strips' median heights in a cell."""
    each = by_cell(points, size, "psid").agg(F.count(F.lit(1)).alias("n"), F.median("zi").alias("m")).filter(F.col("n") >= least)
    return each.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n_strips"), (F.max("m") - F.min("m")).alias("spread")).filter(F.col("n_strips") >= strips)


def quantiles(values: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, linear between ranks, as ``percentile`` has them; no task holds all values, as ``percentile``'s does.
    Values are dealt out by range; of the ranks that are asked for only the range that holds one is sorted."""
    v = F.col(column).cast("double")
    dealt = fixed(values.filter(v.isNotNull()).select(v.alias("v")).repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first").collect()  # a row for each range
    total, known = sum(p["n"] for p in parts), {}

    def at(rank: int) -> float:
        if rank not in known:
            before = 0
            for p in parts:
                if rank < before + p["n"]:
                    break
                before += p["n"]
            known[rank] = dealt.filter(F.col("part") == p["part"]).orderBy("v").offset(rank - before).first()["v"]
        return known[rank]

    def between(share: float) -> float | None:
        if not total:
            return None
        place = share * (total - 1)
        lo = int(place)
        return at(lo) if place == lo else (lo + 1 - place) * at(lo) + (place - lo) * at(lo + 1)

    return [between(share) for share in shares]
