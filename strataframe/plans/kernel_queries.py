"""Queries that need linear solves, flood fills or iterative filters. Flood fills have recursive SQL; solves and filters are
tested by brute force and, on clouds whose answer is known, by the queries of ``analytic_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import fixed
from ..operators import cells as C
from ..operators import evaluate as E
from ..operators import ground as Gd
from ..operators import neighbors as J
from ..operators import rasters as X
from ..operators import regions as Rg
from ..operators import surface as S
from .binding import P, R, cloud, raster
from .cell_queries import FLOOR
from .join_queries import QG, Q, places
from .raster_queries import GRAD, gaussian_sql
from .raster_queries import surface as raster_and_size
from .registry import query


def one():
    return F.count(F.lit(1))


def bare(spark: SparkSession, d: str) -> DataFrame:
    """Ground at distinct places."""
    return places(cloud(spark, d).filter("ground"))


def lattice(points: DataFrame, size: int = 20) -> DataFrame:
    """The centres of the cells that hold points."""
    return points.select(F.expr(f"yi div {size}").alias("row"), F.expr(f"xi div {size}").alias("col")).distinct().select("row", "col", (F.col("col") * size + size // 2).alias("xi"), (F.col("row") * size + size // 2).alias("yi"))


#: Model, nugget, partial sill and range of the registered kriging queries, in square centimetres and decimetres.
VARIOGRAM = ("spherical", 200.0, 4000.0, 300.0)


@query()
def krige_ok(spark: SparkSession, d: str) -> DataFrame:
    q = bare(spark, d)
    return S.krige(q, lattice(q), VARIOGRAM).select("row", "col", F.round("z", 4).alias("z"), F.round("variance", 4).alias("variance"), "fallback")


@query()
def krige_uk1(spark: SparkSession, d: str) -> DataFrame:
    q = bare(spark, d)
    return S.krige(q, lattice(q), VARIOGRAM, order=1).select("row", "col", F.round("z", 4).alias("z"), "fallback")


@query()
def spline_tension(spark: SparkSession, d: str) -> DataFrame:
    q = bare(spark, d)
    return S.spline(q, lattice(q), k=24, radius=80.0).select("row", "col", F.round("z", 4).alias("z"))


@query()
def biharmonic_blocked(spark: SparkSession, d: str) -> DataFrame:
    return S.curvature_blocks(bare(spark, d), 10, 500, 200, scale=0.1).select("row", "col", F.round("z", 3).alias("z"), "constrained")


@query()
def tin_surface(spark: SparkSession, d: str) -> DataFrame:
    return S.tin(bare(spark, d), 20, 500, 100).select("row", "col", F.round("z", 3).alias("z"))


def _found(points: DataFrame) -> DataFrame:
    """Found ground against the truth, by class."""
    return points.groupBy("ground", "is_ground").agg(one().alias("n"))


@query()
def smrf_ground(spark: SparkSession, d: str) -> DataFrame:
    return _found(Gd.classified(cloud(spark, d).select("xi", "yi", "zi", "ground"), "smrf"))


@query()
def pmf_ground(spark: SparkSession, d: str) -> DataFrame:
    return _found(Gd.classified(cloud(spark, d).select("xi", "yi", "zi", "ground"), "pmf"))


@query()
def csf_ground(spark: SparkSession, d: str) -> DataFrame:
    return _found(Gd.classified(cloud(spark, d).select("xi", "yi", "zi", "ground"), "csf"))


@query()
def mcc_ground(spark: SparkSession, d: str) -> DataFrame:
    return _found(Gd.classified(cloud(spark, d).select("xi", "yi", "zi", "ground"), "mcc"))


@query()
def tsr_ground(spark: SparkSession, d: str) -> DataFrame:
    return _found(Gd.adjudicate(cloud(spark, d).select("xi", "yi", "zi", "ground")))


@query()
def two_passes(spark: SparkSession, d: str) -> DataFrame:
    return _found(Gd.sequence(cloud(spark, d).select("xi", "yi", "zi", "ground"), [("smrf", {"window": 16.0}), ("smrf", {"window": 32.0, "threshold": 0.5})]))


@query()
def ground_by_strip(spark: SparkSession, d: str) -> DataFrame:
    """Each strip classified on its own: how well the results agree."""
    p = cloud(spark, d).select("xi", "yi", "zi", "psid")
    got = Gd.classified_by(p, "psid", "smrf")
    return got.groupBy("psid").agg(one().alias("n"), F.count_if("is_ground").alias("ground"))


@query(P + """, w AS (SELECT *, lead(zi) OVER o - zi AS gap, row_number() OVER o AS k FROM p WINDOW o AS (PARTITION BY yi // 100, xi // 100 ORDER BY zi, xi, yi, psid)),
m AS (SELECT *, min(coalesce(gap, 0)) OVER (PARTITION BY yi // 100, xi // 100 ORDER BY k) AS least FROM w) SELECT count(*) AS n, count_if(least > 100)::BIGINT AS noise, sum(CASE WHEN least > 100 THEN zi ELSE 0 END)::BIGINT AS z FROM m""")
def elm_noise(spark: SparkSession, d: str) -> DataFrame:
    return Gd.low_noise(cloud(spark, d)).agg(one().alias("n"), F.count_if("noise").alias("noise"), F.sum(F.when(F.col("noise"), F.col("zi")).otherwise(0)).alias("z"))


@query(Q + """, n AS (SELECT a.xi, a.yi, sqrt((b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi) + ((b.z - a.z) / 10) * ((b.z - a.z) / 10)) AS d FROM q a JOIN q b ON b.yi BETWEEN a.yi - 120 AND a.yi + 120 AND b.xi BETWEEN a.xi - 120 AND a.xi + 120 AND (a.xi <> b.xi OR a.yi <> b.yi)),
k AS (SELECT xi, yi, list_sum(min(d, 8)) / 8 AS distance FROM n GROUP BY 1, 2), s AS (SELECT avg(distance) + 2.5 * stddev_pop(distance) AS b FROM k) SELECT distance > b AS outlier, count(*) AS n, round(avg(distance), 4) AS distance FROM k, s GROUP BY 1""")
def outlier_points(spark: SparkSession, d: str) -> DataFrame:
    return Gd.outliers(places(cloud(spark, d))).groupBy("outlier").agg(one().alias("n"), F.round(F.avg("distance"), 4).alias("distance"))


@query()
def height_above_tin(spark: SparkSession, d: str) -> DataFrame:
    """Heights over the triangulated ground, cut to a range, by class."""
    p = cloud(spark, d).groupBy("xi", "yi", "zi").agg(F.bool_or("ground").alias("is_ground"))
    h = Gd.heights_above_ground(p, 500, 100)
    keep = fixed(h.filter(F.col("hag").between(-50, 60000)).select("is_ground", "hag"), "heights")
    middle = {told: C.quantiles(keep.filter(F.col("is_ground") == told), "hag", [0.5])[0] for told in (True, False)}
    median = F.when(F.col("is_ground"), F.lit(middle[True])).otherwise(F.lit(middle[False])).cast("double")
    got = keep.groupBy("is_ground").agg(one().alias("n"), F.count_if(F.abs("hag") < 20).alias("near"))
    return got.select("is_ground", "n", F.round(median, 3).alias("median"), "near")


#: Connected components of the cells ``c``, by the least cell that each reaches: Spark names them by the same number.
LABELS = """lab(row, col, label) USING KEY (row, col) AS (SELECT row, col, row * 2147483648 + col FROM c
  UNION SELECT x.row, x.col, min(l.label) FROM lab l, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc), recurring.lab x WHERE x.row = l.row + dr AND x.col = l.col + dc AND l.label < x.label GROUP BY x.row, x.col)"""
RP = P.replace("WITH", "WITH RECURSIVE", 1)
RR = R.replace("WITH", "WITH RECURSIVE", 1)
SMALL = RP + ", r AS (SELECT yi // 5 AS row, xi // 5 AS col, CAST(sum(zi) AS BIGINT) // count(*) AS z FROM p GROUP BY 1, 2)"


@query(SMALL + ", c AS (SELECT row, col FROM r), " + LABELS + " SELECT label, count(*) AS cells, min(row) AS row_lo, max(row) AS row_hi, min(col) AS col_lo, max(col) AS col_hi FROM lab GROUP BY label")
def components(spark: SparkSession, d: str) -> DataFrame:
    return Rg.sizes(raster(cloud(spark, d), 5)).select("label", "cells", "row_lo", "row_hi", "col_lo", "col_hi")


@query(RR + ", c AS (SELECT row, col, z FROM r WHERE z % 7 < 4), " + LABELS + """, t AS (SELECT count(*) AS t FROM c)
SELECT label, count(*) AS cells, round(avg(row), 4) AS row, round(avg(col), 4) AS col, min(row) AS row_lo, max(row) AS row_hi, round(avg(z), 4) AS z, round(count(*) / any_value(t), 8) AS share
FROM lab JOIN c USING (row, col), t GROUP BY label ORDER BY cells DESC, label LIMIT 6""")
def largest_patches(spark: SparkSession, d: str) -> DataFrame:
    """The six largest connected patches of steep error, with their centres and shares."""
    r = raster(cloud(spark, d))
    bad = r.filter("z % 7 < 4")
    c = Rg.components(bad).join(bad.select("row", "col", "z"), ["row", "col"])
    total = bad.agg(one().alias("_t"))  # a single row
    g = c.groupBy("label").agg(one().alias("cells"), F.round(F.avg("row"), 4).alias("row"), F.round(F.avg("col"), 4).alias("col"), F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.round(F.avg("z"), 4).alias("z"))
    return g.join(F.broadcast(total)).withColumn("share", F.round(F.col("cells") / F.col("_t"), 8)).drop("_t").orderBy(F.desc("cells"), "label").limit(6)


#: The empty cells of the raster, and those of them in holes.
HOLES = SMALL + """, sz AS (SELECT max(row) AS h, max(col) AS w FROM r),
c AS (SELECT a.row, b.col FROM sz, LATERAL (SELECT unnest(range(0, h + 1)) AS row) a, LATERAL (SELECT unnest(range(0, w + 1)) AS col) b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.row = a.row AND r.col = b.col)),
""" + LABELS + """, inner_ AS (SELECT label, count(*) AS cells FROM lab, sz GROUP BY label HAVING NOT bool_or(row = 0 OR col = 0 OR row = h OR col = w))"""


@query(HOLES + " SELECT label, cells FROM inner_")
def fill_holes(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d), 5)
    h, w = r.agg(F.max("row"), F.max("col")).first()
    return Rg.holes(r, h + 1, w + 1).groupBy("label").agg(one().alias("cells"))


KERNEL1 = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in X.kernel(1.0))


@query(HOLES + f""", hole AS (SELECT row, col FROM lab JOIN inner_ USING (label) WHERE cells <= 400),
nf AS (SELECT a.row, a.col, arg_min(r.z, struct_pack(d := (r.row - a.row) * (r.row - a.row) + (r.col - a.col) * (r.col - a.col), y := r.row, x := r.col)) AS z FROM hole a JOIN r ON r.row BETWEEN a.row - 16 AND a.row + 16 AND r.col BETWEEN a.col - 16 AND a.col + 16 GROUP BY 1, 2),
whole AS (SELECT row, col, z::DOUBLE AS z FROM r UNION ALL SELECT row, col, z::DOUBLE FROM nf), k(o, w) AS (VALUES {KERNEL1}),
b1 AS (SELECT row, col + o AS col, sum(z * w) AS s, sum(w) AS n FROM whole, k GROUP BY 1, 2), b2 AS (SELECT row + o AS row, col, sum(s * w) / sum(n * w) AS z FROM b1, k GROUP BY 1, 2)
SELECT row, col, round(z, 4) AS z FROM whole WHERE (row, col) NOT IN (SELECT (row, col) FROM hole) UNION ALL SELECT b2.row, b2.col, round(b2.z, 4) FROM b2 JOIN hole USING (row, col)""")
def void_fill(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d), 5)
    h, w = r.agg(F.max("row"), F.max("col")).first()
    return Rg.filled(r, h + 1, w + 1, most=400).select("row", "col", F.round("z", 4).alias("z"))


@query()
def footprint_outlines(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d), 50)
    o = Rg.outlines(r)
    return o.select("label", "cells", F.size("ring").alias("corners"), F.round(Rg.shoelace("ring"), 4).alias("area"))


@query(SMALL + """, sz AS (SELECT max(row) AS h, max(col) AS w, FROM r), o AS (SELECT a, b, a * a + b * b AS d2 FROM (SELECT unnest(range(-8, 9)) AS a), (SELECT unnest(range(-8, 9)) AS b) WHERE a * a + b * b <= 64),
n AS (SELECT r.row + a AS row, r.col + b AS col, min(d2) AS d2 FROM r, o, sz WHERE r.row + a BETWEEN 0 AND h AND r.col + b BETWEEN 0 AND w GROUP BY 1, 2),
d AS (SELECT ceil(sqrt(d2))::BIGINT AS radius, count(*) AS n FROM n GROUP BY 1), c AS (SELECT radius, sum(n) OVER (ORDER BY radius)::BIGINT AS covered FROM d),
e AS (SELECT arg_min(covered, radius) AS c0, arg_max(covered, radius) AS c1, min(radius) AS r0, max(radius) AS r1 FROM c)
SELECT radius, covered, round(covered - (c0 + (c1 - c0) * (radius - r0)::DOUBLE / greatest(r1 - r0, 1)), 4) AS gain FROM c, e""")
def knee_radius(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d), 5)
    h, w = r.agg(F.max("row"), F.max("col")).first()
    return Rg.knee(r, h + 1, w + 1)


@query()
def buffered_loo(spark: SparkSession, d: str) -> DataFrame:
    loo = E.errors_of_all(E.left_out(bare(spark, d), VARIOGRAM), "z", "estimate")
    return loo.select(F.lit("all").alias("all"), "n", "median", "mae", "rmse", "p90")


@query(QG + """, f AS (SELECT *, ((xi // 50) * 7919 + (yi // 50) * 104729) % 3 AS fold FROM q), k AS (SELECT unnest(range(0, 3)) AS fold), b AS (SELECT k.fold, f.yi // 20 AS row, f.xi // 20 AS col, avg(f.z) AS z FROM f, k WHERE f.fold <> k.fold GROUP BY 1, 2, 3),
o AS (SELECT a AS dr, b AS dc, a * a + b * b AS d2 FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE a * a + b * b <= 4),
s AS (SELECT fold, row + dr AS row, col + dc AS col, z, row_number() OVER (PARTITION BY fold, row + dr, col + dc ORDER BY d2, row, col) AS i FROM b, o),
t AS (SELECT f.fold, abs(f.z - s.z) AS off FROM f JOIN s ON s.fold = f.fold AND s.row = f.yi // 20 AND s.col = f.xi // 20 AND i = 1)
SELECT fold, count(*) AS n, round(median(off), 4) AS median, round(avg(off), 4) AS mae, round(sqrt(avg(off * off)), 4) AS rmse, round(quantile_cont(off, 0.9), 4) AS p90 FROM t GROUP BY fold""")
def block_holdout(spark: SparkSession, d: str) -> DataFrame:
    return E.held_out_blocks(bare(spark, d))


def holdout_sql(cell: int, low: bool, reach: int = 40) -> str:
    """Errors of held-out blocks at the nearest cell with data, over all folds."""
    r, value = reach // cell, "min(f.z)" if low else "avg(f.z)"
    return f"""(WITH f AS (SELECT *, ((xi // 50) * 7919 + (yi // 50) * 104729) % 3 AS fold FROM q), k AS (SELECT unnest(range(0, 3)) AS fold),
b AS (SELECT k.fold, f.yi // {cell} AS row, f.xi // {cell} AS col, {value} AS z FROM f, k WHERE f.fold <> k.fold GROUP BY 1, 2, 3),
o AS (SELECT a AS dr, b AS dc, a * a + b * b AS d2 FROM (SELECT unnest(range(-{r}, {r + 1})) AS a), (SELECT unnest(range(-{r}, {r + 1})) AS b) WHERE a * a + b * b <= {r * r}),
s AS (SELECT fold, row + dr AS row, col + dc AS col, arg_min(z, struct_pack(d := d2, y := row, x := col)) AS z FROM b, o GROUP BY 1, 2, 3),
t AS (SELECT f.fold, f.z - s.z AS off FROM f JOIN s ON s.fold = f.fold AND s.row = f.yi // {cell} AND s.col = f.xi // {cell}),
e AS (SELECT fold, round(sqrt(avg(off * off)), 4) AS rmse, count(*) AS n FROM t GROUP BY fold)
SELECT {cell}::BIGINT AS cell, {low} AS low, round(avg(rmse), 4) AS rmse, sum(n)::BIGINT AS n FROM e)"""


@query(QG + " " + " UNION ALL ".join(f"SELECT * FROM {holdout_sql(c, w)}" for c in (10, 20, 40) for w in (False, True)))
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Cell sizes against thinning: every combination scored on held-out blocks, the best first."""
    q = bare(spark, d).persist()
    done, _ = E.sweep({"cell": [10, 20, 40], "low": [False, True]}, lambda cell, low: E.held_out_blocks(q, cell=cell, low=low).agg(F.round(F.avg("rmse"), 4).alias("rmse"), F.sum("n").alias("n")), "rmse")
    q.unpersist()
    return spark.createDataFrame([(r["cell"], r["low"], r["rmse"], r["n"]) for r in done], "cell long, low boolean, rmse double, n long")


@query(QG + """, h AS (SELECT *, ('0x' || substr(md5(xi || ',' || yi), 1, 8))::BIGINT % 10000 / 10000 AS h FROM q), a AS (SELECT yi // 20 AS row, xi // 20 AS col, avg(z) AS za FROM q GROUP BY 1, 2),
b AS (SELECT s AS share, yi // 20 AS row, xi // 20 AS col, avg(z) AS zb FROM h, (VALUES (0.75::DOUBLE), (0.5), (0.25)) v(s) WHERE h < s GROUP BY 1, 2, 3), e AS (SELECT share, abs(za - zb) AS off FROM a JOIN b USING (row, col))
SELECT share, count(*) AS n, round(median(off), 4) AS median, round(avg(off), 4) AS mae, round(sqrt(avg(off * off)), 4) AS rmse, round(quantile_cont(off, 0.9), 4) AS p90 FROM e GROUP BY share""")
def density_dilution(spark: SparkSession, d: str) -> DataFrame:
    """Rasters from shares of the ground against the raster of all of it."""
    q = bare(spark, d)
    cell = [F.expr("yi div 20").alias("row"), F.expr("xi div 20").alias("col")]
    whole = q.groupBy(*cell).agg(F.avg("z").alias("za"))
    part = E.diluted(q, [0.75, 0.5, 0.25], ["xi", "yi"]).groupBy("share", *cell).agg(F.avg("z").alias("zb"))
    return E.errors(part.join(whole, ["row", "col"]), "za", "zb", "share")


@query(GRAD + f""", l AS (SELECT row, col, tan, CASE WHEN min(col) OVER () = col THEN tan ELSE lag(tan) OVER x END + CASE WHEN max(col) OVER () = col THEN tan ELSE lead(tan) OVER x END + CASE WHEN min(row) OVER () = row THEN tan ELSE lag(tan) OVER y END + CASE WHEN max(row) OVER () = row THEN tan ELSE lead(tan) OVER y END - 4 * tan AS lt,
  CASE WHEN min(col) OVER () = col THEN z ELSE lag(z) OVER x END + CASE WHEN max(col) OVER () = col THEN z ELSE lead(z) OVER x END + CASE WHEN min(row) OVER () = row THEN z ELSE lag(z) OVER y END + CASE WHEN max(row) OVER () = row THEN z ELSE lead(z) OVER y END - 4 * z AS lap FROM sl WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)),
{gaussian_sql("f", 1.0)}, {gaussian_sql("c", 5.0)}, s AS (SELECT l.tan, l.lap, f.blur - c.blur AS up FROM l JOIN f USING (row, col) JOIN c USING (row, col) WHERE tan IS NOT NULL AND lap IS NOT NULL), m AS (SELECT quantile_cont(abs(lap), 0.9) AS b FROM s)
SELECT CASE WHEN abs(lap) > b THEN 'shoulder' WHEN up > 20 AND tan > tan(radians(5)) THEN 'mound' WHEN up < -20 AND tan > tan(radians(5)) THEN 'depression' ELSE 'planar' END AS landform, count(*) AS cells, round(avg(tan), 6) AS slope FROM s, m GROUP BY 1""")
def landform_classes(spark: SparkSession, d: str) -> DataFrame:
    """Planar, mound, depression and shoulder cells from prominence, slope and curvature."""
    r, h, w = raster_and_size(spark, d)
    fine, coarse = X.gaussian(r, 1.0).withColumnRenamed("blur", "f"), X.gaussian(r, 5.0).withColumnRenamed("blur", "c")
    s = X.laplacian(X.slope(r, h, w, 200.0), height=h, width=w).filter("tan is not null and lap is not null").join(fine, ["row", "col"]).join(coarse, ["row", "col"])
    bound = s.agg(F.percentile(F.abs("lap"), 0.9).alias("b"))  # a single row
    up = F.col("f") - F.col("c")
    kind = F.when(F.abs("lap") > F.col("b"), "shoulder").when((up > 20) & (F.col("tan") > F.tan(F.radians(F.lit(5.0)))), "mound").when((up < -20) & (F.col("tan") > F.tan(F.radians(F.lit(5.0)))), "depression").otherwise("planar")
    return s.join(F.broadcast(bound)).groupBy(kind.alias("landform")).agg(one().alias("cells"), F.round(F.avg("tan"), 6).alias("slope"))


@query()
def tile_to_raster(spark: SparkSession, d: str) -> DataFrame:
    """The whole path of a tile, from returns to the finished raster."""
    from .config import load
    from .tile import process

    return process(cloud(spark, d), load("cleanup", engine="minimum curvature", cell_m=2.0)).cells.select("row", "col", F.round("z", 3).alias("z"))


@query(GRAD + """, b AS (SELECT a.row, a.col, sum(b.z)::DOUBLE / count(b.z) AS m, median(b.z) AS md FROM r a JOIN r b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2)
SELECT count(*) AS cells, round(avg(abs(z - m)), 4) AS roughness, round(avg(CASE WHEN tan > tan(radians(20)) THEN 1 WHEN tan IS NOT NULL THEN 0 END), 8) AS steep, count_if(abs(z - m) > 100)::BIGINT AS specks, round(avg(CASE WHEN abs(z - md) > 30 THEN 1 ELSE 0 END), 8) AS pits FROM sl JOIN b USING (row, col) WHERE z IS NOT NULL""")
def texture_set(spark: SparkSession, d: str) -> DataFrame:
    """Roughness, pits, terracing and specks of a raster in one row."""
    r, h, w = raster_and_size(spark, d)
    b = X.box(X.slope(r, h, w, 200.0), 2).filter("z is not null")
    off = F.abs(F.col("z") - F.col("box_mean"))
    pit = X.median_filter(r, 2).join(r, ["row", "col"]).agg(F.round(F.avg((F.abs(F.col("z") - F.col("median")) > 30).cast("int")), 8).alias("pits"))  # a single row
    return b.agg(one().alias("cells"), F.round(F.avg(off), 4).alias("roughness"), F.round(F.avg((F.col("tan") > F.tan(F.radians(F.lit(20.0)))).cast("int")), 8).alias("steep"), F.count_if(off > 100).alias("specks")).join(F.broadcast(pit))


@query(P + """, a AS (SELECT DISTINCT xi, yi FROM p WHERE NOT ground), b AS (SELECT DISTINCT xi, yi FROM p WHERE ground),
n AS (SELECT a.xi, a.yi, min((b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi)) AS d2 FROM a JOIN b ON b.xi BETWEEN a.xi - 60 AND a.xi + 60 AND b.yi BETWEEN a.yi - 60 AND a.yi + 60 GROUP BY 1, 2)
SELECT (ceil(sqrt(d2) / 2) * 2)::BIGINT AS within, count(*) AS n FROM n GROUP BY 1""")
def tension_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest ground point of every return, however far, by widening rings."""
    p = cloud(spark, d)
    a, b = p.filter("not ground").select("xi", "yi").distinct(), p.filter("ground").select("xi", "yi").distinct()
    n = J.nearest(a, b, ["xi", "yi"], ["xi2", "yi2"], 5)
    return n.groupBy((F.ceil(F.sqrt("d2") / 2) * 2).alias("within")).agg(one().alias("n"))


@query(R + """, t AS (SELECT regr_count(z, col) AS n, covar_pop(col, col) AS cc, covar_pop(row, row) AS rr, covar_pop(col, row) AS cr, covar_pop(col, z) AS cz, covar_pop(row, z) AS rz, avg(z) AS mz, avg(col) AS mc, avg(row) AS mr FROM r),
e AS (SELECT r.row, r.col, z - mz - (cz * rr - rz * cr) / (cc * rr - cr * cr) * (col - mc) - (rz * cc - cz * cr) / (cc * rr - cr * cr) * (row - mr) AS e FROM r, t),
o AS (SELECT unnest(range(1, 25)) AS k), s AS (SELECT k, e.e, f.e AS e2 FROM e, o JOIN e f ON f.row = e.row AND f.col = e.col + k UNION ALL SELECT k, e.e, f.e FROM e, o JOIN e f ON f.row = e.row + k AND f.col = e.col),
g AS (SELECT k AS lag, count(*) AS pairs, sum((e - e2) * (e - e2)) / (2 * count(*)) AS g FROM s GROUP BY 1 HAVING count(*) >= 100), m AS (SELECT arg_min(g, lag) AS nugget, max(g) AS sill FROM g)
SELECT round(nugget, 2) AS nugget, round(sill, 2) AS sill, round(nugget / sill, 6) AS ratio, (SELECT min(lag) FROM g WHERE g >= 0.95 * sill) AS reach, (SELECT sum(pairs) FROM g)::BIGINT AS pairs,
  CASE WHEN nugget > 0.75 * sill THEN 'noise' WHEN nugget > 0.25 * sill THEN 'mixed' ELSE 'structure' END AS verdict FROM m""")
def fft_variogram(spark: SparkSession, d: str) -> DataFrame:
    """Residuals about the raster's plane, their semivariance in 24 bins of exact pair counts over the cells that both
    ends of a pair have: nugget, sill, the lag at which 95 % of it is reached, and a verdict."""
    e = X.about_plane(raster(cloud(spark, d)))
    offsets = [(0, -k, k) for k in range(1, 25)] + [(-k, 0, k) for k in range(1, 25)]
    bins = X.lag_sums(e, [(-r, -c, k) for r, c, k in offsets]).select("lag", "pairs", (F.col("total") / (2 * F.col("pairs"))).alias("g")).filter("pairs >= 100")
    top = bins.agg(F.min_by("g", "lag").alias("nugget"), F.max("g").alias("sill"), F.sum("pairs").alias("pairs"))  # a single row
    verdict = F.when(F.col("nugget") > 0.75 * F.col("sill"), "noise").when(F.col("nugget") > 0.25 * F.col("sill"), "mixed").otherwise("structure")
    reach = bins.crossJoin(F.broadcast(top.select("sill"))).filter("g >= 0.95 * sill").agg(F.min("lag").cast("bigint").alias("reach"))  # at most 24 rows
    return top.crossJoin(F.broadcast(reach)).select(F.round("nugget", 2).alias("nugget"), F.round("sill", 2).alias("sill"), F.round(F.col("nugget") / F.col("sill"), 6).alias("ratio"), "reach", "pairs", verdict.alias("verdict"))


@query(FLOOR.format(s=50) + """, h AS (SELECT p.ground, zi - floor AS h FROM p JOIN fl ON p.xi // 50 = fl.cx AND p.yi // 50 = fl.cy), v(threshold) AS (VALUES (10), (20), (30), (50), (100))
SELECT threshold, round(count_if(h > threshold AND ground) / count_if(ground), 8) AS ground_lost, round(count_if(h > threshold AND NOT ground) / count_if(NOT ground), 8) AS recall FROM h, v GROUP BY threshold""")
def cleanup_tradeoff(spark: SparkSession, d: str) -> DataFrame:
    """A rule's recall of canopy and cost in ground, over thresholds."""
    h = C.above_floor(cloud(spark, d), 50)
    ts = [10, 20, 30, 50, 100]
    row = h.agg(F.count_if("ground").alias("g"), F.count_if(~F.col("ground")).alias("c"), *[F.count_if((F.col("h") > t) & F.col("ground")).alias(f"g{t}") for t in ts], *[F.count_if((F.col("h") > t) & ~F.col("ground")).alias(f"c{t}") for t in ts])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.round(F.col(f"g{t}") / F.col("g"), 8).alias("ground_lost"), F.round(F.col(f"c{t}") / F.col("c"), 8).alias("recall")) for t in ts]))
    return row.select(each.alias("x")).select("x.*")


@query()
def guard_variants(spark: SparkSession, d: str) -> DataFrame:
    """How often the estimate is replaced, and how far it spreads, under each guard."""
    q = bare(spark, d)
    k = S.krige_guards(q, lattice(q), VARIOGRAM, list(S.GUARDS))
    return k.groupBy("guard").agg(one().alias("cells"), F.count_if("fallback").alias("fallbacks"), F.round(F.max("z") - F.min("z"), 3).alias("spread"))


@query()
def biharmonic_gated(spark: SparkSession, d: str) -> DataFrame:
    """The variant that relaxes by slope and curvature, on pooled returns."""
    return S.curvature_blocks(bare(spark, d), 10, 500, 200, scale=0.1, pool=0.75, variant="gated").select("row", "col", F.round("z", 3).alias("z"))


@query()
def quick_density(spark: SparkSession, d: str) -> DataFrame:
    """Ground density of a window by a coarse filter."""
    p = cloud(spark, d).filter("xi between 0 and 999 and yi between 0 and 499").select("xi", "yi", "zi")
    return Gd.classified(p, "smrf", window=16.0, cell=2.0).agg(one().alias("returns"), F.count_if("is_ground").alias("ground"), F.round(F.count_if("is_ground") / F.count_distinct(F.expr("xi div 50"), F.expr("yi div 50")) / 25, 6).alias("density"))


@query()
def finished_raster(spark: SparkSession, d: str) -> DataFrame:
    """A raster with its voids filled, trimmed to the footprint of the data."""
    from ..model import snap_outward
    from ..operators.finish import finalise, footprint

    p = cloud(spark, d)
    r = raster(p, 5)
    h, w = r.agg(F.max("row"), F.max("col")).first()
    g = snap_outward(0, 0, (w + 1) * 5, (h + 1) * 5, 5)
    cells = r.select((g.height - 1 - F.col("row")).alias("row"), "col", "z")
    at = p.select((F.col("xi") + 0.5).alias("x"), (F.col("yi") + 0.5).alias("y"))
    return finalise(cells, g, footprint(at, g, 10, 2)).select("row", "col", F.round("z", 4).alias("z"))


@query()
def dark_features(spark: SparkSession, d: str) -> DataFrame:
    """The largest dark patch of the relief."""
    from ..operators.finish import dark_patch

    r, h, w = raster_and_size(spark, d)
    return dark_patch(X.composite(r.withColumn("z", F.col("z") / 100), h, w, 2.0)).select("label", "cells", F.round("row", 4).alias("row"), F.round("col", 4).alias("col"))
