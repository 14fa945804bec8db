"""Queries on rasters: stencils, spans, masks, comparison, texture, relief."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import fixed
from ..operators import rasters as X
from ..operators.cells import quantiles
from .binding import G, P, R, cloud, last_cell, raster
from .registry import query


def one():
    return F.count(F.lit(1))


def surface(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    """The 2 m raster and its size, which comes from the points, so that the raster is made and shuffled only once."""
    p = cloud(spark, d)
    h, w = last_cell(p).first()  # two numbers
    return raster(p), h + 1, w + 1


#: The dense grid of the raster in SQL.
D = R + """, sz AS (SELECT max(row) AS h, max(col) AS w FROM r),
d AS (SELECT a.row, b.col, r.z, r.n, h, w FROM sz, LATERAL (SELECT unnest(range(0, h + 1)) AS row) a, LATERAL (SELECT unnest(range(0, w + 1)) AS col) b LEFT JOIN r ON r.row = a.row AND r.col = b.col)"""
GRAD = D + """, gr AS (SELECT *, (CASE WHEN col = 0 THEN lead(z) OVER x - z WHEN col = w THEN z - lag(z) OVER x ELSE (lead(z) OVER x - lag(z) OVER x) / 2 END) / 200 AS gx,
  (CASE WHEN row = 0 THEN lead(z) OVER y - z WHEN row = h THEN z - lag(z) OVER y ELSE (lead(z) OVER y - lag(z) OVER y) / 2 END) / 200 AS gy
  FROM d WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row)),
sl AS (SELECT row, col, z, n, sqrt(gx * gx + gy * gy) AS tan FROM gr)"""


@query(GRAD + " SELECT row, col, round(tan, 8) AS tan FROM sl WHERE tan IS NOT NULL")
def slope_cells(spark: SparkSession, d: str) -> DataFrame:
    r, h, w = surface(spark, d)
    return X.slope(r, h, w, 200.0).filter("tan is not null").select("row", "col", F.round("tan", 8).alias("tan"))


@query(GRAD + " SELECT count(tan) AS n, round(median(tan), 6) AS median, round(quantile_cont(tan, 0.95), 6) AS p95, round(max(tan), 6) AS max FROM sl")
def slope_stats(spark: SparkSession, d: str) -> DataFrame:
    """Nearly every slope is a value of its own, so the quantiles are found by rank."""
    r, h, w = surface(spark, d)
    s = fixed(X.slope(r, h, w, 200.0).filter("tan is not null").select("tan"), "slopes")
    median, p95 = (F.round(F.lit(v).cast("double"), 6) for v in quantiles(s, "tan", [0.5, 0.95]))
    return s.agg(F.count("tan").alias("n"), median.alias("median"), p95.alias("p95"), F.round(F.max("tan"), 6).alias("max"))


@query(GRAD + " SELECT count(tan) AS cells, round(stddev_pop(tan), 6) AS complexity, round(avg(tan), 6) AS mean_slope FROM sl HAVING count(tan) >= 10")
def terrain_complexity(spark: SparkSession, d: str) -> DataFrame:
    """The spread of slope magnitude over the gridded cloud."""
    r, h, w = surface(spark, d)
    s = X.slope(r, h, w, 200.0)
    return s.agg(F.count("tan").alias("cells"), F.round(F.stddev_pop("tan"), 6).alias("complexity"), F.round(F.avg("tan"), 6).alias("mean_slope")).filter("cells >= 10")


@query(GRAD + " SELECT CASE WHEN tan < tan(radians(5)) THEN 'flat' WHEN tan < tan(radians(20)) THEN 'moderate' WHEN tan < tan(radians(30)) THEN 'steep' ELSE 'very steep' END AS band, count(*) AS cells, sum(n)::BIGINT AS points, round(avg(z), 4) AS z FROM sl WHERE tan IS NOT NULL GROUP BY 1")
def slope_band_stats(spark: SparkSession, d: str) -> DataFrame:
    r, h, w = surface(spark, d)
    s = X.slope(r, h, w, 200.0).filter("tan is not null")
    t = lambda a: F.col("tan") < F.tan(F.radians(F.lit(float(a))))
    return s.groupBy(F.when(t(5), "flat").when(t(20), "moderate").when(t(30), "steep").otherwise("very steep").alias("band")).agg(one().alias("cells"), F.sum("n").alias("points"), F.round(F.avg("z"), 4).alias("z"))


@query(D + """, l AS (SELECT row, col, z, CASE WHEN col = 0 THEN z ELSE lag(z) OVER x END + CASE WHEN col = w THEN z ELSE lead(z) OVER x END + CASE WHEN row = 0 THEN z ELSE lag(z) OVER y END + CASE WHEN row = h THEN z ELSE lead(z) OVER y END - 4 * z AS lap
  FROM d WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row))
SELECT count(lap) AS n, sum(lap)::BIGINT AS total, min(lap) AS lo, max(lap) AS hi, round(quantile_cont(abs(lap), 0.9), 4) AS p90 FROM l""")
def laplacian_stats(spark: SparkSession, d: str) -> DataFrame:
    r, h, w = surface(spark, d)
    return X.laplacian(r, height=h, width=w).agg(F.count("lap").alias("n"), F.sum("lap").alias("total"), F.min("lap").alias("lo"), F.max("lap").alias("hi"), F.round(F.percentile(F.abs("lap"), 0.9), 4).alias("p90"))


BOX = D + ", b AS (SELECT a.row, a.col, a.z, sum(b.z)::DOUBLE / count(b.z) AS m, count(b.z) AS k FROM r a JOIN r b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3)"


@query(BOX + " SELECT count(*) AS cells, sum(k)::BIGINT AS neighbours, round(avg(abs(z - m)), 4) AS roughness, round(median(abs(z - m)), 4) AS median FROM b")
def box_roughness(spark: SparkSession, d: str) -> DataFrame:
    r, h, w = surface(spark, d)
    b = X.box(r, 2).filter("z is not null")
    off = F.abs(F.col("z") - F.col("box_mean"))
    return b.agg(one().alias("cells"), F.sum("box_n").alias("neighbours"), F.round(F.avg(off), 4).alias("roughness"), F.round(F.median(off), 4).alias("median"))


@query(R + ", b AS (SELECT a.row, a.col, a.z, median(b.z) AS m FROM r a JOIN r b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2, 3) SELECT count(*) AS cells, count_if(abs(z - m) > 30)::BIGINT AS pits, round(count_if(abs(z - m) > 30) / count(*), 8) AS share FROM b")
def median_pits(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d))
    b = X.median_filter(r, 2).join(r, ["row", "col"])
    pit = F.count_if(F.abs(F.col("z") - F.col("median")) > 30)
    return b.agg(one().alias("cells"), pit.alias("pits"), F.round(pit / one(), 8).alias("share"))


SPAN = R + ", sp AS (SELECT row, min(col) AS lo, max(col) AS hi, count(*) AS k FROM r GROUP BY row)"


@query(SPAN + " SELECT r.row, r.col, z FROM r JOIN sp ON r.row = sp.row WHERE r.col >= lo + 3 AND r.col <= hi - 3")
def transect_strip(spark: SparkSession, d: str) -> DataFrame:
    return X.stripped(raster(cloud(spark, d)), 3).select("row", "col", "z")


@query(SPAN + " SELECT r.row, r.col, z FROM r JOIN sp ON r.row = sp.row WHERE r.col <= hi - 3")
def transect_strip_protected(spark: SparkSession, d: str) -> DataFrame:
    """The low side is clipped by the frame, not by the survey, and stays."""
    return X.stripped(raster(cloud(spark, d)), 3, keep_lo=True).select("row", "col", "z")


@query(SPAN + " SELECT row, unnest(range(lo, hi + 1)) AS col FROM sp")
def row_span_footprint(spark: SparkSession, d: str) -> DataFrame:
    return X.span_footprint(raster(cloud(spark, d)))


@query(P + ", r AS (SELECT DISTINCT yi // 5 AS row, xi // 5 AS col FROM p), i AS (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS k FROM r), u AS (SELECT row, k, min(col) AS lo, max(col) AS hi FROM i GROUP BY 1, 2) SELECT row, count(*) AS runs, max(hi - lo + 1) AS longest FROM u GROUP BY row")
def runs_per_row(spark: SparkSession, d: str) -> DataFrame:
    return X.runs(raster(cloud(spark, d), 5)).groupBy("row").agg(one().alias("runs"), F.max(F.col("hi") - F.col("lo") + 1).alias("longest"))


@query(P + """, r AS (SELECT DISTINCT yi // 10 AS row, xi // 10 AS col FROM p), s AS (SELECT max(row) AS h, max(col) AS w FROM r),
o AS (SELECT a AS dr, b AS dc FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE abs(a) + abs(b) <= 2)
SELECT r.row, r.col FROM r, s, o LEFT JOIN r q ON q.row = r.row + dr AND q.col = r.col + dc GROUP BY r.row, r.col, h, w
HAVING bool_and(q.row IS NOT NULL OR r.row + dr < 0 OR r.col + dc < 0 OR r.row + dr > h OR r.col + dc > w)""")
def erode_mask(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d), 10)
    h, w = r.agg(F.max("row"), F.max("col")).first()
    return X.eroded(r, 2, h + 1, w + 1).select("row", "col")


@query(P + """, r AS (SELECT DISTINCT yi // 5 AS row, xi // 5 AS col FROM p), s AS (SELECT max(row) AS h, max(col) AS w FROM r),
o AS (SELECT a AS dr, b AS dc, a * a + b * b AS d2 FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE a * a + b * b <= 9),
n AS (SELECT row + dr AS row, col + dc AS col, min(d2) AS d2 FROM r, o GROUP BY 1, 2)
SELECT d2::BIGINT AS d2, count(*) AS cells FROM n, s WHERE row BETWEEN 0 AND h AND col BETWEEN 0 AND w GROUP BY d2""")
def support_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cells by their squared distance to data, within three cells."""
    r = raster(cloud(spark, d), 5)
    h, w = r.agg(F.max("row"), F.max("col")).first()
    return X.near(r, 3, h + 1, w + 1).groupBy(F.col("d2").cast("bigint").alias("d2")).agg(one().alias("cells"))


@query(GRAD + """, k AS (SELECT col, row, (tan > tan(radians(20)))::INT AS steep FROM sl WHERE tan IS NOT NULL), win AS (SELECT unnest(range(greatest(row // 10 - 1, 0), row // 10 + 1)) AS wr, col, steep FROM k),
w2 AS (SELECT wr, unnest(range(greatest(col // 10 - 1, 0), col // 10 + 1)) AS wc, steep FROM win) SELECT wr, wc, count(*) AS cells, round(avg(steep), 8) AS steep FROM w2 GROUP BY 1, 2 HAVING count(*) >= 200 ORDER BY steep DESC, wr, wc LIMIT 8""")
def window_scan_top8(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 20 cells every 10: the eight best covered and steepest."""
    r, h, w = surface(spark, d)
    k = X.slope(r, h, w, 200.0).filter("tan is not null").withColumn("steep", (F.col("tan") > F.tan(F.radians(F.lit(20.0)))).cast("int"))
    seq = lambda c: F.explode(F.expr(f"sequence(greatest({c} div 10 - 1, 0), {c} div 10)"))
    k = k.select(seq("row").alias("wr"), "col", "steep").select("wr", seq("col").alias("wc"), "steep")
    return k.groupBy("wr", "wc").agg(one().alias("cells"), F.round(F.avg("steep"), 8).alias("steep")).filter("cells >= 200").orderBy(F.desc("steep"), "wr", "wc").limit(8)


@query(R + """, m AS (SELECT avg(z) AS mu, avg(z::DOUBLE * z) - avg(z) * avg(z) AS v, count(*) AS n FROM r), q AS (SELECT a.z AS x, b.z AS y FROM r a JOIN r b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col))
SELECT count(*) AS pairs, round((sum(x::DOUBLE * y) - sum(x) * any_value(mu) - sum(y) * any_value(mu) + count(*) * any_value(mu) * any_value(mu)) / count(*) / any_value(v), 4) AS moran FROM q, m""")
def morans_i(spark: SparkSession, d: str) -> DataFrame:
    """Rook neighbours; sums of whole products, so that the order of summing does not matter."""
    r = raster(cloud(spark, d))
    zd = F.col("z").cast("double")
    m = r.agg((F.avg("z")).alias("mu"), (F.avg(zd * F.col("z")) - F.avg("z") * F.avg("z")).alias("v"))  # a single row
    q = X.lag_pairs(r, [(0, -1), (-1, 0)]).agg(one().alias("pairs"), F.sum(zd * F.col("z2")).alias("xy"), F.sum(F.col("z") + F.col("z2")).alias("s"))
    mu = F.col("mu")
    return q.join(F.broadcast(m)).select("pairs", F.round((F.col("xy") - F.col("s") * mu + F.col("pairs") * mu * mu) / F.col("pairs") / F.col("v"), 4).alias("moran"))


@query(R + """, o AS (SELECT a AS dr, b AS dc FROM (SELECT unnest(range(0, 6)) AS a), (SELECT unnest(range(-5, 6)) AS b) WHERE (a > 0 OR b > 0) AND a * a + b * b <= 25)
SELECT (dr * dr + dc * dc)::BIGINT AS lag2, count(*) AS pairs, round(sum((a.z - b.z) * (a.z - b.z))::DOUBLE / (2 * count(*)), 6) AS semivariance FROM r a, o JOIN r b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1""")
def lag_semivariance(spark: SparkSession, d: str) -> DataFrame:
    offsets = [(-a, -b, a * a + b * b) for a in range(6) for b in range(-5, 6) if (a > 0 or b > 0) and a * a + b * b <= 25]
    q = X.lag_pairs(raster(cloud(spark, d)), offsets, "lag2")
    gap = F.col("z") - F.col("z2")
    return q.groupBy(F.col("lag2").cast("bigint").alias("lag2")).agg(one().alias("pairs"), F.round(F.sum(gap * gap).cast("double") / (2 * one()), 6).alias("semivariance"))


@query(R + ", e AS (SELECT row, col, CASE WHEN z % 50 = 0 THEN 0 ELSE z END AS z FROM r), s AS (SELECT greatest(max(abs(z)), 1.0) * 1e-7 AS step FROM e) SELECT count(*) AS cells, count_if(e.z = 0)::BIGINT AS lifted, round(min(CASE WHEN e.z = 0 THEN step ELSE e.z END), 8)::DOUBLE AS least FROM e, s")
def enforce_mask(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth height is zero before; none is after, as the check confirms."""
    r = raster(cloud(spark, d)).withColumn("z", F.when(F.col("z") % 50 == 0, 0).otherwise(F.col("z")).cast("double"))
    done = X.verified(X.enforced(r.withColumn("_was", F.col("z") == 0)))
    return done.agg(one().alias("cells"), F.count_if("_was").alias("lifted"), F.round(F.min("z"), 8).alias("least"))


@query(R + " SELECT row // 4 AS row, col // 4 AS col, sum(z)::DOUBLE / count(*) AS z, count(*) AS n FROM r GROUP BY 1, 2")
def block_downsample(spark: SparkSession, d: str) -> DataFrame:
    return X.block_mean(raster(cloud(spark, d)), 4)


@query(R + " SELECT row, col, z FROM r WHERE row % 3 = 0 AND col % 3 = 0 AND row BETWEEN 5 AND 40 AND col BETWEEN 10 AND 60")
def decimated_window(spark: SparkSession, d: str) -> DataFrame:
    return raster(cloud(spark, d).filter(F.col("yi").between(100, 819) & F.col("xi").between(200, 1219))).filter("row % 3 = 0 and col % 3 = 0 and row between 5 and 40 and col between 10 and 60").select("row", "col", "z")


@query(R + """, s AS (SELECT i AS id, 3 + i * 0.25::DOUBLE AS r, 2 + i * 0.5::DOUBLE AS c FROM (SELECT unnest(range(0, 100)) AS i)), k AS (SELECT id, floor(r)::BIGINT AS r0, floor(c)::BIGINT AS c0, r - floor(r) AS fr, c - floor(c) AS fc FROM s)
SELECT k.id, CASE WHEN count(*) = 4 THEN round(sum((CASE WHEN q.row = r0 THEN 1 - fr ELSE fr END) * (CASE WHEN q.col = c0 THEN 1 - fc ELSE fc END) * q.z), 6) END AS value
FROM k JOIN r q ON q.row BETWEEN r0 AND r0 + 1 AND q.col BETWEEN c0 AND c0 + 1 GROUP BY k.id""")
def line_profile(spark: SparkSession, d: str) -> DataFrame:
    """Heights along a line by bilinear interpolation."""
    i = F.col("id")
    s = spark.range(100).select("id", (3 + i * 0.25).alias("r"), (2 + i * 0.5).alias("c"))
    return X.bilinear(s, raster(cloud(spark, d))).select("id", F.round("value", 6).alias("value"))


@query(SPAN + ", m AS (SELECT median(k) AS m FROM sp WHERE row BETWEEN (SELECT max(row) FROM sp) // 4 AND (SELECT max(row) FROM sp) * 3 // 4) SELECT min(CASE WHEN k >= 0.9 * m THEN row END) AS first_row, max(CASE WHEN k >= 0.9 * m THEN row END) AS last_row, any_value(m) AS width FROM sp, m")
def end_taper(spark: SparkSession, d: str) -> DataFrame:
    """Where a strip reaches nine tenths of its middle width."""
    s = X.spans(raster(cloud(spark, d)))
    top = s.agg(F.max("row").alias("top"))  # a single row
    mid = s.join(F.broadcast(top)).filter(F.expr("row between top div 4 and top * 3 div 4")).agg(F.median("n").alias("width"))
    full = s.join(F.broadcast(mid)).withColumn("ok", F.col("n") >= 0.9 * F.col("width"))
    return full.agg(F.min(F.when(F.col("ok"), F.col("row"))).alias("first_row"), F.max(F.when(F.col("ok"), F.col("row"))).alias("last_row"), F.max("width").alias("width"))


@query(SPAN + ", st AS (SELECT abs(lo - lag(lo) OVER (ORDER BY row)) AS s FROM sp) SELECT count(s) AS n, median(s) AS median, quantile_cont(s, 0.95) AS p95, max(s) AS max FROM st")
def boundary_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the boundary between neighbouring rows; one row of the raster is one row here."""
    st = X.spans(raster(cloud(spark, d))).withColumn("s", F.abs(F.col("lo") - F.lag("lo").over(Window.orderBy("row"))))
    return st.agg(F.count("s").alias("n"), F.median("s").alias("median"), F.percentile("s", 0.95).alias("p95"), F.max("s").alias("max"))


@query(SPAN + " SELECT hi % 8 AS phase, count(*) AS rows FROM sp GROUP BY 1")
def boundary_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Whether the boundary falls on the pitch of the solver's blocks more often than by chance."""
    return X.spans(raster(cloud(spark, d))).groupBy(F.pmod("hi", F.lit(8)).alias("phase")).agg(one().alias("rows"))


@query(P + """, r AS (SELECT DISTINCT yi // 5 AS row, xi // 5 AS col FROM p), e AS (SELECT r.row, r.col, (SELECT 1) AS u, count(q.row) AS nb FROM r LEFT JOIN r q ON abs(q.row - r.row) + abs(q.col - r.col) = 1 AND q.row BETWEEN r.row - 1 AND r.row + 1 AND q.col BETWEEN r.col - 1 AND r.col + 1 GROUP BY 1, 2)
SELECT count(*) AS area, sum(4 - nb)::BIGINT AS perimeter, round(sum(4 - nb) / (2 * sqrt(pi() * count(*))), 6) AS raggedness FROM e""".replace("LEFT JOIN r q ON abs(q.row - r.row) + abs(q.col - r.col) = 1 AND q.row BETWEEN r.row - 1 AND r.row + 1 AND q.col BETWEEN r.col - 1 AND r.col + 1", "CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dr, dc) LEFT JOIN r q ON q.row = r.row + dr AND q.col = r.col + dc"))
def edge_shape(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d), 5).select("row", "col")
    nb = X.shifted(r, [(0, 1), (1, 0), (0, -1), (-1, 0)]).groupBy("row", "col").agg(one().alias("nb"))
    e = r.join(nb, ["row", "col"], "left").withColumn("out", 4 - F.coalesce("nb", F.lit(0)))
    return e.agg(one().alias("area"), F.sum("out").alias("perimeter"), F.round(F.sum("out") / (2 * F.sqrt(F.pi() * one())), 6).alias("raggedness"))


CMP = G + ", cp AS (SELECT r.row, r.col, r.z AS za, g.z AS zb FROM r JOIN g ON r.row = g.row AND r.col = g.col)"


@query(CMP + """ SELECT count(*) AS cells_compared, round(sqrt(sum((za - zb) * (za - zb))::DOUBLE / count(*)), 6) AS rmse, round(sum(za - zb)::DOUBLE / count(*), 6) AS bias, round(sum(abs(za - zb))::DOUBLE / count(*), 6) AS mae,
  round(sqrt(sum((za - zb) * (za - zb))::DOUBLE / count(*)) / (quantile_cont(zb, 0.98) - quantile_cont(zb, 0.02)), 8) AS nrmse, (SELECT count(*) FROM r) AS coverage_candidate, (SELECT count(*) FROM g) AS coverage_reference FROM cp HAVING count(*) >= 100""")
def raster_compare_score(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    a, b = raster(p), raster(p.filter("ground"))
    gap = F.col("za") - F.col("zb")
    rmse = F.sqrt(F.sum(gap * gap).cast("double") / one())
    cover = a.agg(one().alias("coverage_candidate")).join(F.broadcast(b.agg(one().alias("coverage_reference"))))
    score = X.compared(a, b).agg(one().alias("cells_compared"), F.round(rmse, 6).alias("rmse"), F.round(F.sum(gap).cast("double") / one(), 6).alias("bias"), F.round(F.sum(F.abs(gap)).cast("double") / one(), 6).alias("mae"), F.round(rmse / (F.percentile("zb", 0.98) - F.percentile("zb", 0.02)), 8).alias("nrmse"))
    return score.filter("cells_compared >= 100").join(F.broadcast(cover))


@query(G + " SELECT count(*) AS cells, sum(r.z - g.z)::BIGINT AS gap FROM r JOIN g ON g.row = r.row + 2 AND g.col = r.col - 1")
def raster_offset_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two rasters on one lattice with different origins."""
    p = cloud(spark, d)
    return X.compared(raster(p), raster(p.filter("ground")), -2, 1).agg(one().alias("cells"), F.sum(F.col("za") - F.col("zb")).alias("gap"))


@query(G + ", c AS (SELECT yi // 20 AS row, xi // 20 AS col, max(zi) AS z FROM p WHERE psid % 2 = 0 GROUP BY 1, 2) SELECT count(*) AS cells, sum(r.z)::BIGINT AS a, sum(g.z)::BIGINT AS b, sum(c.z)::BIGINT AS c FROM r JOIN g USING (row, col) JOIN c USING (row, col)")
def common_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that three rasters have."""
    p = cloud(spark, d)
    a, b = raster(p).select("row", "col", F.col("z").alias("a")), raster(p.filter("ground")).select("row", "col", F.col("z").alias("b"))
    c = p.filter("psid % 2 = 0").groupBy(F.expr("yi div 20").alias("row"), F.expr("xi div 20").alias("col")).agg(F.max("zi").alias("c"))
    return a.join(b, ["row", "col"]).join(c, ["row", "col"]).agg(one().alias("cells"), *[F.sum(x).alias(x) for x in "abc"])


@query(G + " SELECT count(*) AS returns, count_if(p.zi < g.z - 5)::BIGINT AS below, round(count_if(p.zi < g.z - 5) / count(*), 8) AS share, median(CASE WHEN p.zi < g.z - 5 THEN g.z - p.zi END) AS median_depth, quantile_cont(CASE WHEN p.zi < g.z - 5 THEN g.z - p.zi END, 0.95) AS p95_depth FROM p JOIN g ON p.yi // 20 = g.row AND p.xi // 20 = g.col")
def returns_below(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    g = raster(p.filter("ground")).select("row", "col", "z")
    s = p.withColumns({"row": F.expr("yi div 20"), "col": F.expr("xi div 20")}).join(g, ["row", "col"])
    low = F.col("zi") < F.col("z") - 5
    depth = F.when(low, F.col("z") - F.col("zi"))
    return s.agg(one().alias("returns"), F.count_if(low).alias("below"), F.round(F.count_if(low) / one(), 8).alias("share"), F.median(depth).alias("median_depth"), F.percentile(depth, 0.95).alias("p95_depth"))


@query(R + ", v AS (SELECT a.row, a.col, greatest(abs(e.z - a.z), abs(s.z - a.z)) AS step FROM r a JOIN r e ON e.row = a.row AND e.col = a.col + 1 JOIN r s ON s.row = a.row + 1 AND s.col = a.col) SELECT count(*) AS n, round(quantile_cont(step, 0.5), 4) AS p50, round(quantile_cont(step, 0.9), 4) AS p90, round(quantile_cont(step, 0.99), 4) AS p99 FROM v")
def sharpness(spark: SparkSession, d: str) -> DataFrame:
    """Height differences over one cell."""
    r = raster(cloud(spark, d))
    q = X.lag_pairs(r, [(0, -1), (-1, 0)]).groupBy("row", "col").agg(F.max(F.abs(F.col("z2") - F.col("z"))).alias("step"), one().alias("k")).filter("k = 2")
    return q.agg(one().alias("n"), F.percentile("step", [0.5, 0.9, 0.99]).alias("q")).select("n", *[F.round(F.col("q")[i], 4).alias(f"p{k}") for i, k in enumerate((50, 90, 99))])


@query(G + " SELECT (SELECT count(*) FROM (SELECT row, col FROM r INTERSECT SELECT row, col FROM g)) AS both, (SELECT count(*) FROM (SELECT row, col FROM r UNION SELECT row, col FROM g)) AS either, (SELECT count(*) FROM (SELECT row, col FROM r EXCEPT SELECT row, col FROM g)) AS only_a")
def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    a, b = raster(p).select("row", "col"), raster(p.filter("ground")).select("row", "col")
    n = lambda df, c: df.agg(one().alias(c))  # noqa: E731 - single rows
    return n(a.intersect(b), "both").join(F.broadcast(n(a.union(b).distinct(), "either"))).join(F.broadcast(n(a.subtract(b), "only_a")))


@query(R + ", t AS (SELECT row // 25 AS tr, col // 25 AS tc, min(row) AS r0, min(col) AS c0, max(row) AS r1, max(col) AS c1 FROM r GROUP BY 1, 2) SELECT min(r0) AS row, min(c0) AS col, max(r1) - min(r0) + 1 AS height, max(c1) - min(c0) + 1 AS width, count(*) AS tiles FROM t")
def lattice_union(spark: SparkSession, d: str) -> DataFrame:
    t = raster(cloud(spark, d)).groupBy(F.expr("row div 25"), F.expr("col div 25")).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))
    return t.agg(F.min("r0").alias("row"), F.min("c0").alias("col"), (F.max("r1") - F.min("r0") + 1).alias("height"), (F.max("c1") - F.min("c0") + 1).alias("width"), one().alias("tiles"))


KS = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in X.kernel(1.0))


@query(R + f""", k(o, w) AS (VALUES {KS}), b AS (SELECT r.row + a.o AS row, r.col + c.o AS col, sum(r.z * a.w * c.w) / sum(a.w * c.w) AS blur FROM r, k a, k c GROUP BY 1, 2)
SELECT r.row, r.col, round(blur, 4) AS blur FROM r JOIN b USING (row, col)""")
def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    """The blur of the cells that have data."""
    r = raster(cloud(spark, d))
    return r.select("row", "col").join(X.gaussian(r, 1.0), ["row", "col"]).select("row", "col", F.round("blur", 4).alias("blur"))


@query(R + """, m AS (SELECT row, min(z) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS z, col FROM r), sz AS (SELECT max(row) AS h, max(col) AS w FROM r),
d AS (SELECT a.row, b.col, r.z FROM sz, LATERAL (SELECT unnest(range(0, h + 1)) AS row) a, LATERAL (SELECT unnest(range(0, w + 1)) AS col) b LEFT JOIN r ON r.row = a.row AND r.col = b.col),
e AS (SELECT row, col, z, min(z) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM d), f AS (SELECT row, col, z, min(o) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM e),
g1 AS (SELECT row, col, z, max(o) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM f), g2 AS (SELECT row, col, z, max(o) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM g1)
SELECT row, col, z - o AS above FROM g2 WHERE z IS NOT NULL AND z > o""")
def opening_residual(spark: SparkSession, d: str) -> DataFrame:
    """What a morphological opening takes off."""
    r, h, w = surface(spark, d)
    return X.opened(r, 2, height=h, width=w).filter("z > open").select("row", "col", (F.col("z") - F.col("open")).alias("above"))


def gaussian_sql(name: str, sigma: float) -> str:
    """``name``: row, col, blur of the cells around data, along rows and then along columns."""
    k = ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in X.kernel(sigma))
    return f"""{name}k(o, w) AS (VALUES {k}), {name}1 AS (SELECT row, col + o AS col, sum(z * w) AS s, sum(w) AS n FROM r, {name}k GROUP BY 1, 2),
{name} AS (SELECT row + o AS row, col, sum(s * w) / sum(n * w) AS blur FROM {name}1, {name}k GROUP BY 1, 2)"""


LIT = " + ".join(f"greatest(0, ({math.sin(math.radians(35.0))!r}::DOUBLE - {math.cos(math.radians(35.0))!r}::DOUBLE * ({math.sin(2 * math.pi * k / 8)!r}::DOUBLE * gx - {math.cos(2 * math.pi * k / 8)!r}::DOUBLE * gy)) / sqrt(1 + gx * gx + gy * gy))" for k in range(8))
SHADE = GRAD + f", sh AS (SELECT row, col, sqrt(gx * gx + gy * gy) AS tan, ({LIT}) / 8 AS shade FROM gr WHERE gx IS NOT NULL AND gy IS NOT NULL)"
RAYS = ", ".join(f"({k}, {dr}, {dc}, {dist!r}::DOUBLE)" for k, dr, dc, dist in X.rays(2.0))
HORIZON = f"""ray(k, dr, dc, dist) AS (VALUES {RAYS}), hk AS (SELECT r.row, r.col, k, max((b.z / 100 - r.z / 100) / dist) AS t FROM r, ray JOIN r b ON b.row = r.row + dr AND b.col = r.col + dc GROUP BY 1, 2, 3),
ho AS (SELECT r.row, r.col, 1 - coalesce(sum(sin(atan(greatest(t, 0)))), 0) / 16 AS svf, 90 - coalesce(sum(degrees(atan(t))), 0) / 16 AS open FROM r LEFT JOIN hk USING (row, col) GROUP BY 1, 2)"""
FIXED_BOUNDS = {"shade": (0, 1), "tan": (0, 2), "open": (45, 95), "svf": (0.5, 1)}


def composite_sql(bounds: dict | None) -> str:
    names = ("shade", "tan", "open", "svf")
    ends = ", ".join(f"{float(bounds[n][0])!r}::DOUBLE AS {n}_lo, {float(bounds[n][1])!r}::DOUBLE AS {n}_hi" if bounds else f"min({n}) AS {n}_lo, max({n}) AS {n}_hi" for n in names)
    n = ", ".join(f"CASE WHEN {c}_hi > {c}_lo THEN least(1, greatest(0, ({c} - {c}_lo) / ({c}_hi - {c}_lo))) ELSE 0 END AS {c}" for c in names)
    return SHADE + ", " + HORIZON + f", la AS (SELECT row, col, shade, tan, open, svf FROM sh JOIN ho USING (row, col)), en AS (SELECT {ends} FROM {'(SELECT 1)' if bounds else 'la'}), no AS (SELECT row, col, {n} FROM la, en)" + """,
x1 AS (SELECT *, shade * (1 - 0.67::DOUBLE) + abs(shade - tan) * 0.67::DOUBLE AS g FROM no), x2 AS (SELECT *, g * (1 - 0.67::DOUBLE) + (CASE WHEN g < 0.5 THEN 2 * g * open ELSE 1 - 2 * (1 - g) * (1 - open) END) * 0.67::DOUBLE AS g2 FROM x1),
x3 AS (SELECT *, g2 * (1 - 0.67::DOUBLE) + g2 * svf * 0.67::DOUBLE AS g3 FROM x2) SELECT row, col, greatest(1, round(g3 * 255))::INT AS grey FROM x3"""


@query(SHADE + " SELECT row, col, round(shade, 6) AS shade FROM sh")
def hillshade_cells(spark: SparkSession, d: str) -> DataFrame:
    r, h, w = surface(spark, d)
    return X.hillshade(r.withColumn("z", F.col("z") / 100), h, w, 2.0).filter("shade is not null").select("row", "col", F.round("shade", 6).alias("shade"))


@query(R + ", " + HORIZON + " SELECT row, col, round(svf, 6) AS svf, round(open, 6) AS open FROM ho")
def openness_svf(spark: SparkSession, d: str) -> DataFrame:
    r = raster(cloud(spark, d)).withColumn("z", F.col("z") / 100)
    return X.horizons(r, 2.0).select("row", "col", F.round("svf", 6).alias("svf"), F.round("open", 6).alias("open"))


@query(composite_sql(None))
def g1_composite(spark: SparkSession, d: str) -> DataFrame:
    r, h, w = surface(spark, d)
    return X.composite(r.withColumn("z", F.col("z") / 100), h, w, 2.0)


@query(composite_sql(FIXED_BOUNDS))
def g1_fixed_bounds(spark: SparkSession, d: str) -> DataFrame:
    r, h, w = surface(spark, d)
    return X.composite(r.withColumn("z", F.col("z") / 100), h, w, 2.0, FIXED_BOUNDS)


@query(R + ", " + HORIZON + ", e AS (SELECT min(open) AS lo, max(open) AS hi FROM ho) SELECT row, col, round(least(1, greatest(0, CASE WHEN hi > lo THEN (open - lo) / (hi - lo) ELSE 0 END)), 6) AS grey FROM ho, e")
def openness_grey(spark: SparkSession, d: str) -> DataFrame:
    """Openness alone, stretched between its least and greatest value."""
    o = X.horizons(raster(cloud(spark, d)).withColumn("z", F.col("z") / 100), 2.0)
    ends = o.agg(F.min("open").alias("lo"), F.max("open").alias("hi"))  # a single row
    return o.crossJoin(F.broadcast(ends)).select("row", "col", F.round(X.normalised(F.col("open"), F.col("lo"), F.col("hi")), 6).alias("grey"))


GAMMAS = (0.5, 0.8, 1.0, 1.5)


@query(GRAD + ", e AS (SELECT min(tan) AS lo, max(tan) AS hi FROM sl), v(gamma) AS (VALUES " + ", ".join(f"({g}::DOUBLE)" for g in GAMMAS) + ") SELECT gamma, count(*) AS cells, round(avg(((tan - lo) / (hi - lo)) ** gamma), 8) AS mean, round(stddev_pop(((tan - lo) / (hi - lo)) ** gamma), 8) AS spread FROM sl, e, v WHERE tan IS NOT NULL GROUP BY gamma")
def slope_gammas(spark: SparkSession, d: str) -> DataFrame:
    """The stretched slope under several gammas: how light it is and how much contrast is left."""
    r, h, w = surface(spark, d)
    s = X.slope(r, h, w, 200.0).filter("tan is not null").select("tan")
    ends = s.agg(F.min("tan").alias("lo"), F.max("tan").alias("hi"))  # a single row
    n = s.crossJoin(F.broadcast(ends)).select(X.normalised(F.col("tan"), F.col("lo"), F.col("hi")).alias("v"))
    each = n.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gamma"), X.adjusted(F.col("v"), gamma=g).alias("v")) for g in GAMMAS])).alias("x")).select("x.*")
    return each.groupBy("gamma").agg(one().alias("cells"), F.round(F.avg("v"), 8).alias("mean"), F.round(F.stddev_pop("v"), 8).alias("spread"))


@query(G + """, a AS (SELECT row, max(col) - min(col) + 1 AS w FROM r WHERE row % 5 = 0 GROUP BY row), b AS (SELECT row, max(col) - min(col) + 1 AS w FROM g WHERE row % 5 = 0 GROUP BY row)
SELECT (SELECT median(w) FROM a) AS width_all, (SELECT median(w) FROM b) AS width_ground, (SELECT median(w) FROM a) - (SELECT median(w) FROM b) AS lost""")
def strip_width(spark: SparkSession, d: str) -> DataFrame:
    """The median span of every fifth row of two masks, and what the one lacks."""
    p = cloud(spark, d)
    w = lambda r, c: X.spans(r.filter("row % 5 = 0")).agg(F.median(F.col("hi") - F.col("lo") + 1).alias(c))  # noqa: E731 - single rows
    both = w(raster(p), "width_all").join(F.broadcast(w(raster(p.filter("ground")), "width_ground")))
    return both.withColumn("lost", F.col("width_all") - F.col("width_ground"))


@query(R + """, o AS (SELECT * FROM r WHERE row < 30 AND col < 40), f AS (SELECT unnest([row, -1 - row, 59 - row]) AS row, col, z FROM o), m AS (SELECT row, unnest([col, -1 - col, 79 - col]) AS col, z FROM f),
x AS (SELECT * FROM m WHERE row BETWEEN -3 AND 32 AND col BETWEEN -3 AND 42 AND NOT (row BETWEEN 0 AND 29 AND col BETWEEN 0 AND 39)), n AS (SELECT row, col, z FROM r WHERE row BETWEEN -3 AND 32 AND col BETWEEN -3 AND 42 AND NOT (row BETWEEN 0 AND 29 AND col BETWEEN 0 AND 39))
SELECT kind, count(*) AS n, sum(z)::BIGINT AS z FROM (SELECT 'own' AS kind, z FROM o UNION ALL SELECT 'neighbour', z FROM n UNION ALL SELECT 'mirrored', z FROM x WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.row = x.row AND n.col = x.col)) GROUP BY kind""")
def haloed_tile(spark: SparkSession, d: str) -> DataFrame:
    """A tile with a halo of three cells: its neighbours' cells where there are some, mirrored ones elsewhere."""
    from ..operators.finish import with_halo

    r = raster(cloud(spark, d)).select("row", "col", "z")
    t = with_halo(r.filter("row < 30 and col < 40"), r.filter("row >= 30 or col >= 40"), 30, 40, 3)
    return t.groupBy("kind").agg(one().alias("n"), F.sum("z").cast("bigint").alias("z"))


DETAIL = R + ", b AS (SELECT a.row, a.col, a.z, sum(b.z)::DOUBLE / count(b.z) AS m FROM r a JOIN r b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3)"


@query(DETAIL + ", e AS (SELECT row, col, round(z - m, 6) AS d FROM b) SELECT count(*) AS pairs, round(avg(a.d * b.d), 2) AS coherent, round(avg((a.d - b.d) * (a.d - b.d)) / 2, 2) AS nugget FROM e a JOIN e b ON b.row = a.row AND b.col = a.col + 1")
def detail_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Detail beyond a 3 x 3 mean: what neighbouring cells share, and the semivariance at one cell."""
    r = raster(cloud(spark, d))
    e = X.box(r, 1).filter("z is not null").select("row", "col", F.round(F.col("z") - F.col("box_mean"), 6).alias("z"))
    gap = F.col("z") - F.col("z2")
    return X.lag_pairs(e, [(0, -1)]).agg(one().alias("pairs"), F.round(F.avg(F.col("z") * F.col("z2")), 2).alias("coherent"), F.round(F.avg(gap * gap) / 2, 2).alias("nugget"))
