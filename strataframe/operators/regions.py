"""Connected regions of a raster: components, enclosed holes, filling and outlines.

Rows are cut into runs of occupied cells first, so that a region of n cells has far fewer nodes. Runs that touch in
neighbouring rows are edges, and the least label spreads along them with pointer jumping, each round checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import fixed
from .rasters import runs, shifted


def numbered_runs(cells: DataFrame) -> DataFrame:
    """``row, lo, hi, id``: an id that grows with row, then column."""
    return runs(cells).withColumn("id", F.shiftleft("row", 31) + F.col("lo"))


STRIDE = 10  # a bucket is 2 ** STRIDE columns wide


def touching(r: DataFrame, diagonal: bool) -> DataFrame:
    """``a, b`` of the runs that touch in neighbouring rows: an equi-join on row and bucket of columns, each run in every
    bucket that it reaches, so a row of any length is dealt out. A pair counts in the bucket where its overlap begins."""
    d = 1 if diagonal else 0
    reach = lambda lo, hi: F.explode(F.sequence(F.shiftright(lo, STRIDE), F.shiftright(hi, STRIDE)))
    own = r.withColumn("_b", reach(F.col("lo") - d, F.col("hi") + d))
    up = r.select((F.col("row") - 1).alias("row"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("id").alias("b"), reach(F.col("lo"), F.col("hi")).alias("_b"))
    meet = own.join(up, ["row", "_b"]).filter((F.col("lo") <= F.col("hi2") + d) & (F.col("lo2") <= F.col("hi") + d))
    return meet.filter(F.col("_b") == F.shiftright(F.greatest(F.col("lo") - d, F.col("lo2")), STRIDE)).select(F.col("id").alias("a"), "b")


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, label``: the least id that each node can reach. Each round takes the least label around, then the label of
    the label, so that long chains halve."""
    both = fixed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = fixed(nodes.select("id", F.col("id").alias("label")))
    while True:
        around = both.join(state.select(F.col("id").alias("b"), F.col("label").alias("_l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_l").alias("_m"))
        low = state.join(around, "id", "left").select("id", "label", F.least("label", F.coalesce("_m", "label")).alias("_n"))
        jump = state.select(F.col("id").alias("_n"), F.col("label").alias("_j"))
        new = fixed(low.join(jump, "_n", "left").select("id", F.least("_n", F.coalesce("_j", "_n")).alias("new"), "label"))
        changed = new.filter("new <> label").limit(1).count()
        state = new.select("id", F.col("new").alias("label"))
        if not changed:
            return state


def components(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """``row, col, label``: the connected component of each occupied cell, named by its first run."""
    r = fixed(numbered_runs(cells))
    named = r.join(labelled(r.select("id"), touching(r, diagonal)), "id")
    return named.select("row", F.explode(F.sequence("lo", "hi")).alias("col"), "label")


def sizes(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """``label, cells, row_lo, row_hi, col_lo, col_hi`` of each component."""
    c = components(cells, diagonal)
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi"))


def complement(cells: DataFrame, height: int, width: int) -> DataFrame:
    """The empty cells of a height x width grid."""
    every = cells.sparkSession.range(height * width).select(F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"))
    return every.join(cells.select("row", "col"), ["row", "col"], "left_anti")


def holes(cells: DataFrame, height: int, width: int, most: int | None = None) -> DataFrame:
    """``row, col, label``: empty cells that cannot reach the border through empty cells; ``most``: the largest hole."""
    empty = fixed(components(complement(cells, height, width)))
    each = empty.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.bool_or((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)).alias("_out")).filter("not _out")
    each = each.filter(F.col("_n") <= most) if most else each
    return empty.join(each.select("label"), "label", "left_semi").select("row", "col", "label")


def nearest_fill(cells: DataFrame, targets: DataFrame, z: str = "z", start: int = 2) -> DataFrame:
    """``row, col, z`` of the targets, from the nearest cell with data: least distance, then row, then column. Targets
    without data nearby look twice as far each round."""
    have, left, found, reach, past = cells.select("row", "col", F.col(z).alias("_z")).filter("_z is not null"), targets.select("row", "col"), None, start, 0
    if have.isEmpty():
        return left.withColumn(z, F.lit(None).cast("double")).limit(0)
    while True:
        disc = [(-r, -c, r * r + c * c, r, c) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if past * past < r * r + c * c <= reach * reach]
        hit = shifted(have, disc, "_d", "_r", "_c").join(left, ["row", "col"]).groupBy("row", "col").agg(F.min_by("_z", F.struct("_d", "_r", "_c")).alias(z))
        hit = fixed(hit)
        found = hit if found is None else found.unionByName(hit)
        left = fixed(left.join(hit, ["row", "col"], "left_anti"))
        if left.isEmpty():
            return found
        past, reach = reach, reach * 2


def filled(cells: DataFrame, height: int, width: int, most: int | None = None, smooth: float = 1.0, z: str = "z") -> DataFrame:
    """``row, col, z``: the raster with its enclosed holes filled from the nearest cells, the filled cells smoothed."""
    from .rasters import gaussian

    hole = fixed(holes(cells, height, width, most).select("row", "col"))
    near = nearest_fill(cells, hole, z)
    whole = cells.select("row", "col", F.col(z).cast("double").alias(z)).unionByName(near.select("row", "col", F.col(z).cast("double").alias(z)))
    if not smooth:
        return whole
    soft = gaussian(whole, smooth, z).join(hole, ["row", "col"]).select("row", "col", "blur")
    return whole.join(soft, ["row", "col"], "left").select("row", "col", F.coalesce("blur", z).alias(z))


def outlines(cells: DataFrame) -> DataFrame:
    """``label, cells, ring``: the outer ring of each component, counter-clockwise corners (x right, y up).

    Boundary edges are found by joins. Chaining them is the one sequential step: the edges of a component meet in one
    task, which a component's outline, not its area, bounds."""
    import pandas as pd

    c = fixed(components(cells))
    sides = [(0, 1, "e"), (0, -1, "w"), (1, 0, "s"), (-1, 0, "n")]
    edges = None
    for dr, dc, name in sides:
        beyond = c.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"))
        free = c.join(beyond, ["row", "col"], "left_anti").withColumn("side", F.lit(name))
        edges = free if edges is None else edges.unionByName(free)

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        step = {}
        for r, k, s in zip(frame["row"], frame["col"], frame["side"], strict=True):
            a, b = {"e": ((k + 1, r + 1), (k + 1, r)), "w": ((k, r), (k, r + 1)), "s": ((k, r + 1), (k + 1, r + 1)), "n": ((k + 1, r), (k, r))}[s]
            step.setdefault(a, []).append(b)
        best, area = [], -1.0
        while step:
            at = min(step)
            ring, first, before = [at], at, None
            while True:
                nexts = step[at]
                if len(nexts) == 1 or before is None:
                    nxt = nexts.pop(0)
                else:  # where two corners meet, turn so that the ring stays with its own cells
                    d = (at[0] - before[0], at[1] - before[1])
                    turn = {(-d[1], d[0]): 0, d: 1, (d[1], -d[0]): 2}
                    nexts.sort(key=lambda q, at=at, turn=turn: turn.get((q[0] - at[0], q[1] - at[1]), 3))
                    nxt = nexts.pop(0)
                if not nexts:
                    del step[at]
                before, at = at, nxt
                if at == first:
                    break
                ring.append(at)
            size = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
            if size > area:
                best, area = ring, size
        return pd.DataFrame({"label": [int(frame["label"].iloc[0])], "ring": [[{"x": float(x), "y": float(-y)} for x, y in best]]})

    rings = edges.groupBy("label").applyInPandas(chain, "label long, ring array<struct<x double, y double>>")
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("cells")).join(rings, "label")


def shoelace(ring: str):
    """The area within a ring of corners, by a fold over the array."""
    n = F.size(ring)
    at = lambda i: F.element_at(F.col(ring), i)
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: at(i)["x"] * at(F.when(i == n, 1).otherwise(i + 1))["y"] - at(F.when(i == n, 1).otherwise(i + 1))["x"] * at(i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def knee(cells: DataFrame, height: int, width: int, most: int = 8) -> DataFrame:
    """``radius, covered, gain``: cells within each radius of data; the knee is where the curve is furthest above its chord."""
    from .rasters import near_counts

    d = near_counts(cells, most, height, width).groupBy(F.ceil(F.sqrt("d2")).alias("radius")).agg(F.sum("n").alias("n"))
    w = Window.orderBy("radius")
    c = d.withColumn("covered", F.sum("n").over(w))
    ends = c.agg(F.min_by("covered", "radius").alias("c0"), F.max_by("covered", "radius").alias("c1"), F.min("radius").alias("r0"), F.max("radius").alias("r1"))  # a single row
    gain = F.col("covered") - (F.col("c0") + (F.col("c1") - F.col("c0")) * (F.col("radius") - F.col("r0")) / F.greatest(F.col("r1") - F.col("r0"), F.lit(1)))
    return c.join(F.broadcast(ends)).select("radius", "covered", F.round(gain, 4).alias("gain"))
