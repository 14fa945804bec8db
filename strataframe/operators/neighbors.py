"""Neighbourhood joins: a distance predicate becomes an equi-join on buckets some radii wide.

One side stays in its own bucket; a row of the other is unfolded to each bucket that its disc reaches, which is one for most
rows and four at a corner. Catalyst then plans an ordinary hash or merge join, which AQE splits where a bucket is crowded.
Distances are compared as squares, so whole coordinates stay exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import fixed

#: Radii to a bucket: wider ones unfold fewer rows and try more pairs.
WIDE = 3


def bucket(df: DataFrame, size: float, x: str, y: str) -> DataFrame:
    return df.withColumns({"_bx": F.floor(F.col(x) / size), "_by": F.floor(F.col(y) / size)})


def around(df: DataFrame, size: float, reach: float, x: str, y: str) -> DataFrame:
    """Each row in every bucket that lies within ``reach`` of it along both axes."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)))
    return df.withColumn("_bx", span(x)).withColumn("_by", span(y))


def radius_pairs(a: DataFrame, b: DataFrame, radius: float, x: str = "xi", y: str = "yi", strict: bool = False) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` within ``radius``: the columns of ``a``, those of ``b`` with 2 at the end,
    and ``d2``. The side ``b`` is unfolded, so the smaller one belongs there."""
    size = WIDE * radius
    other = around(b, size, radius, x, y).select("_bx", "_by", *[F.col(c).alias(f"{c}2") for c in b.columns])
    near = bucket(a, size, x, y).join(other, ["_bx", "_by"]).drop("_bx", "_by")
    dx, dy = F.col(f"{x}2") - F.col(x), F.col(f"{y}2") - F.col(y)
    near = near.withColumn("d2", dx * dx + dy * dy)
    return near.filter(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius)


def space_pairs(a: DataFrame, b: DataFrame, radius: float, x: str, y: str, height: str) -> DataFrame:
    """``radius_pairs`` in space, with buckets along the height (tenths of the others' unit) too, and the squared distance
    ``d``: crowds that stand over one another don't meet."""
    size = 2 * radius
    level = lambda df, by: F.floor(F.col(height) / (10.0 * radius)) + by
    other = around(b, size, radius, x, y).withColumn("_o", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("_bz", level(b, F.col("_o")))
    other = other.select("_bx", "_by", "_bz", *[F.col(c).alias(f"{c}2") for c in b.columns])
    near = bucket(a, size, x, y).withColumn("_bz", level(a, F.lit(0))).join(other, ["_bx", "_by", "_bz"]).drop("_bx", "_by", "_bz")
    dx, dy, dz = F.col(f"{x}2") - F.col(x), F.col(f"{y}2") - F.col(y), (F.col(f"{height}2") - F.col(height)) / 10.0
    near = near.withColumn("d2", dx * dx + dy * dy)
    return near.withColumn("d", F.col("d2") + dz * dz).filter(F.col("d") <= radius * radius)


def knn(a: DataFrame, b: DataFrame, k: int, radius: float, key: list[str], order: list[str], x: str = "xi", y: str = "yi", strict: bool = False, beyond: float = -1) -> DataFrame:
    """The ``k`` nearest rows of ``b`` within the radius for each row of ``a``, with their rank ``k``; ``order``: columns of
    the pair that break ties. ``beyond`` leaves out neighbours within that distance."""
    pairs = radius_pairs(a, b, radius, x, y, strict)
    if beyond >= 0:
        pairs = pairs.filter(F.col("d2") > beyond * beyond)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("d2", *order))
    return pairs.withColumn("k", rank).filter(F.col("k") <= k)


def nearest(a: DataFrame, b: DataFrame, key: list[str], order: list[str], start: float, x: str = "xi", y: str = "yi") -> DataFrame:
    """The nearest row of ``b`` for each row of ``a`` however far."""
    return nearest_k(a, b, 1, key, order, start, x, y).drop("d")


def nearest_k(a: DataFrame, b: DataFrame, k: int, key: list[str], order: list[str], start: float, x: str = "xi", y: str = "yi", height: str | None = None, apart: bool = False, beyond: float = -1) -> DataFrame:
    """The ``k`` nearest rows of ``b`` for each row of ``a`` however far, all of them where ``b`` has fewer: the columns
    of the pair, ``d2``, the squared distance ``d`` and the rank ``k``. ``key``: unique columns of ``a``; ``height``: a column
    in tenths of the others' unit that counts too; ``apart``: a row is no neighbour of itself;
    ``beyond`` leaves out neighbours within that distance.

    Discs twice as wide each round, for the rows that have not found theirs. A row is done when its k-th neighbour is no
    farther than the disc is wide, as all that are nearer lie in the disc, or when the disc covers both tables."""
    left, found, radius = a, None, start
    axes = {x: 1, y: 1, **({height: 10} if height else {})}
    spans = [(F.max(c) - F.min(c)) / by for c, by in axes.items()]
    extent = sum(float(v or 0) for v in a.select(*axes).unionByName(b.select(*axes)).agg(*spans).first())  # no two rows are farther apart
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("d", *order))
    while True:
        pairs = space_pairs(left, b, radius, x, y, height) if height else radius_pairs(left, b, radius, x, y).withColumn("d", F.col("d2"))
        if apart:
            pairs = pairs.filter(" or ".join(f"{c} <> {c}2" for c in key))
        if beyond >= 0:
            pairs = pairs.filter(F.col("d") > beyond * beyond)
        hit = fixed(pairs.withColumn("k", rank).filter(F.col("k") <= k))
        last = radius >= extent
        done = hit if last else hit.join(hit.filter((F.col("k") == k) & (F.col("d") <= radius * radius)).select(*key), key, "left_semi")
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        left = fixed(left.join(done.select(*key).distinct(), key, "left_anti"))
        if left.isEmpty():
            return found
        radius *= 2


def nearest_outside(x: np.ndarray, y: np.ndarray, ask: np.ndarray, k: int, buffer: float, radius: float, room: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """``nearest_places`` for the points ``ask`` (indices)."""
    return nearest_places(x, y, x[ask], y[ask], k, buffer, radius, room)


def nearest_places(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, k: int, buffer: float, radius: float, room: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For the places (u, v) the indices of their ``k`` nearest, nearer ones first and ties by index, farther than
    the buffer and within the radius; -1 where there are no more; and the squared distances. Coordinates are whole. Points lie
    in buckets as wide as the search, of which nine are looked through; it widens for those that have not found theirs."""
    n, none = max(len(x), 1), np.iinfo(np.int64).max
    best = np.full((len(u), k), none)
    todo = np.arange(len(u) if len(x) else 0)
    area = max(float(np.ptp(x)) * float(np.ptp(y)), 1.0) if len(x) else 1.0
    reach = min(radius, np.sqrt(1.6 * k * area / (np.pi * n) + max(buffer, 0.0) ** 2))
    while len(todo):
        size = max(int(np.ceil(reach)), 1)
        x0, y0 = min(x.min(), u.min()), min(y.min(), v.min())
        across = int((max(x.max(), u.max()) - x0) // size) + 3
        bucket = ((y - y0) // size + 1) * across + (x - x0) // size + 1
        order = np.argsort(bucket, kind="stable")
        held = bucket[order]
        own = ((v[todo] - y0) // size + 1) * across + (u[todo] - x0) // size + 1
        spans = [(np.searchsorted(held, own + r * across - 1, "left"), np.searchsorted(held, own + r * across + 1, "right")) for r in (-1, 0, 1)]
        total = sum(hi - lo for lo, hi in spans)
        by_size, at = np.argsort(total, kind="stable"), 0
        while at < len(todo):
            # As many as fit the room, whose candidates are padded to those of the last.
            take = max(int(np.searchsorted(np.arange(1, len(todo) - at + 1) * np.maximum(total[by_size[at:]], 1), room, "right")), 1)
            i = by_size[at : at + take]
            at += take
            j = np.arange(max(int(total[i[-1]]), k))[None, :]
            (lo0, hi0), (lo1, hi1), (lo2, hi2) = ((lo[i, None], hi[i, None]) for lo, hi in spans)
            end0, end1, end2 = hi0 - lo0, hi0 - lo0 + hi1 - lo1, hi0 - lo0 + hi1 - lo1 + hi2 - lo2
            other = order[np.clip(np.where(j < end0, lo0 + j, np.where(j < end1, lo1 + j - end0, lo2 + j - end1)), 0, n - 1)]
            d2 = (x[other] - u[todo[i], None]) ** 2 + (y[other] - v[todo[i], None]) ** 2
            key = np.where((j < end2) & (d2 > buffer * buffer if buffer >= 0 else True) & (d2 <= reach * reach), d2 * n + other, none)
            key.partition(k - 1, axis=1)
            best[todo[i]] = np.sort(key[:, :k], axis=1)
        if reach >= radius:
            break
        todo = todo[best[todo, -1] == none]
        reach = min(2 * reach, radius)
    return np.where(best == none, -1, best % n), np.where(best == none, -1, best // n)


def heights_above_floor(points: DataFrame, radius: float, z: str = "z", low: float = 0.1, least: int = 3) -> DataFrame:
    """``xi, yi, z, n, above``: height over a low percentile of the neighbours, the point itself among them; 0 with few."""
    p = points.select("xi", "yi", z)
    near = radius_pairs(p, p, radius).groupBy("xi", "yi", z).agg(F.count(F.lit(1)).alias("n"), F.percentile(f"{z}2", low).alias("_f"))
    return near.select("xi", "yi", z, "n", (F.round(F.when(F.col("n") >= least, F.col(z) - F.col("_f")).otherwise(0.0), 4) + 0.0).alias("above"))


def heights_above_plane(points: DataFrame, radius: float, z: str = "z", least: int = 6) -> DataFrame:
    """``xi, yi, z, n, above``: height over a plane through the lower neighbours. A plane through all neighbours comes first;
    those on or below it give the second. Points with fewer than ``least`` neighbours get 0."""
    from .cells import plane_sums, solved_plane

    p = points.select("xi", "yi", z)
    near = radius_pairs(p, p, radius).withColumns({"_dx": F.col("xi2") - F.col("xi"), "_dy": F.col("yi2") - F.col("yi")})
    first = solved_plane(plane_sums(near, ["xi", "yi", z], f"{z}2").filter(F.col("n") >= least)).select("xi", "yi", z, "a", "b", "c")
    low = near.join(first, ["xi", "yi", z]).filter(F.col(f"{z}2") <= F.round(F.col("a") + F.col("b") * F.col("_dx") + F.col("c") * F.col("_dy"), 6))
    second = solved_plane(plane_sums(low, ["xi", "yi", z], f"{z}2").filter(F.col("n") >= 3))
    got = p.join(second.select("xi", "yi", z, "n", F.col("a").alias("_a")), ["xi", "yi", z], "left")
    return got.select("xi", "yi", z, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.round(F.coalesce(F.col(z) - F.col("_a"), F.lit(0.0)), 4) + 0.0).alias("above"))


def chosen(key: list[str], one_in: int, seed: int = 0) -> Column:
    """Whether a row is in a repeatable share of the rows, by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(one_in)) == 0 if one_in > 1 else F.lit(True)


def sampled(df: DataFrame, key: list[str], one_in: int, seed: int = 0) -> DataFrame:
    """A repeatable share of the rows, by a hash of their key."""
    return df.filter(chosen(key, one_in, seed))


def variogram(points: DataFrame, lag: float, bins: int = 12, least: int = 30, z: str = "z") -> DataFrame:
    """``bin, pairs, lag, semivariance`` of the pairs up to a lag, in equal bins."""
    p = points.select("xi", "yi", z)
    pairs = radius_pairs(p, p, lag).filter((F.col("xi") < F.col("xi2")) | ((F.col("xi") == F.col("xi2")) & (F.col("yi") < F.col("yi2"))))
    gap = F.col(z) - F.col(f"{z}2")
    b = F.least(F.floor(F.sqrt("d2") * bins / lag), F.lit(bins - 1).cast("bigint"))
    got = pairs.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.sqrt("d2")).alias("lag"), (F.sum(gap * gap) / (2 * F.count(F.lit(1)))).alias("semivariance"))
    return got.filter(F.col("pairs") >= least)


def model(name: str, h: Column, nugget: Column, sill: Column, reach: Column) -> Column:
    """A variogram model at distance h."""
    if name == "spherical":
        r = F.least(h / reach, F.lit(1.0))
        return nugget + sill * (1.5 * r - 0.5 * r * r * r)
    if name == "exponential":
        return nugget + sill * (1 - F.exp(-3 * h / reach))
    if name == "linear":
        return nugget + sill * h
    raise ValueError(f"unknown variogram model {name}")


def fitted(bins: DataFrame, name: str = "spherical", ranges: int = 24) -> DataFrame:
    """The parameters (nugget, sill, reach) of least squared error among ``ranges`` ranges and three nuggets; ``sse``: that
    error, in squares of the greatest semivariance."""
    top = bins.agg(F.max("semivariance").alias("_s"), F.max("lag").alias("_l"))  # a single row
    grid = top.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(ranges)))).withColumn("_n", F.explode(F.array(F.lit(0.0), F.lit(0.05), F.lit(0.2))))
    grid = grid.select("_s", F.round(F.col("_n") * F.col("_s"), 6).alias("nugget"), F.round((1 - F.col("_n")) * F.col("_s"), 6).alias("sill"), F.round(F.col("_l") * F.col("_i") / ranges, 6).alias("reach"))
    off = F.col("semivariance") - model(name, F.col("lag"), F.col("nugget"), F.col("sill"), F.col("reach"))
    error = bins.join(F.broadcast(grid)).groupBy("nugget", "sill", "reach").agg(F.round(F.sum(off * off) / F.first(F.col("_s") * F.col("_s")), 9).alias("sse"))  # a few dozen rows
    return error.orderBy("sse", "reach", "nugget").limit(1)


def matched(a: DataFrame, b: DataFrame, radius: float, x: str = "xi", y: str = "yi") -> DataFrame:
    """The rows of ``a`` that have a row of ``b`` within the radius: a semi-join by distance."""
    key = [c for c in a.columns]
    return radius_pairs(a, b.select(x, y), radius, x, y).select(*key).distinct()


def survivors(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Which points a filter let through, by their exact coordinates."""
    return before.join(after.select(*key).distinct(), key, "left_semi")


def thinned(points: DataFrame, size: int) -> DataFrame:
    """The point nearest to the centre of each cell."""
    p = points.withColumns({"cx": F.expr(f"xi div {size}"), "cy": F.expr(f"yi div {size}")})
    dx, dy = 2 * F.col("xi") - (2 * F.col("cx") + 1) * size, 2 * F.col("yi") - (2 * F.col("cy") + 1) * size
    first = F.min(F.struct((dx * dx + dy * dy).alias("d"), "xi", "yi", "z"))
    return p.groupBy("cx", "cy").agg(first.alias("_f")).select("cx", "cy", "_f.xi", "_f.yi", "_f.z")


def haloed(points: DataFrame, core: int, halo: int, x: str = "xi", y: str = "yi") -> DataFrame:
    """Each point once for every block whose core, widened by the halo on all sides, holds it: ``bi, bj, inner``."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / core), F.floor((F.col(c) + halo) / core)))
    got = points.withColumn("bi", span(y)).withColumn("bj", span(x))
    return got.withColumn("inner", (F.floor(F.col(y) / core) == F.col("bi")) & (F.floor(F.col(x) / core) == F.col("bj")))
