"""Queries that join: neighbours, lattices, keys, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import neighbors as J
from .binding import P, cloud, raster, table
from .registry import query

#: Points at distinct places, with the whole centimetre below their mean height.
Q = P + ", q AS (SELECT xi, yi, CAST(sum(zi) AS BIGINT) // count(*) AS z FROM p GROUP BY xi, yi)"
QG = P + ", q AS (SELECT xi, yi, CAST(sum(zi) AS BIGINT) // count(*) AS z FROM p WHERE ground GROUP BY xi, yi)"


def one():
    return F.count(F.lit(1))


def places(points: DataFrame) -> DataFrame:
    return points.groupBy("xi", "yi").agg(F.expr("sum(zi) div count(1)").alias("z"))


def _near(r: int, a: str = "a", b: str = "b") -> str:
    return f"{b}.xi BETWEEN {a}.xi - {r} AND {a}.xi + {r} AND {b}.yi BETWEEN {a}.yi - {r} AND {a}.yi + {r} AND ({b}.xi - {a}.xi) * ({b}.xi - {a}.xi) + ({b}.yi - {a}.yi) * ({b}.yi - {a}.yi) <= {r * r}"


@query(Q + f" SELECT a.xi, a.yi, count(*) AS n FROM q a JOIN q b ON {_near(15)} GROUP BY 1, 2")
def radius_count(spark: SparkSession, d: str) -> DataFrame:
    q = places(cloud(spark, d)).select("xi", "yi")
    return J.radius_pairs(q, q, 15).groupBy("xi", "yi").agg(one().alias("n"))


@query(Q + f", c AS (SELECT DISTINCT xi // 10 AS cx, yi // 10 AS cy FROM q), k AS (SELECT cx, cy, cx * 10 + 5 AS xi, cy * 10 + 5 AS yi FROM c), s AS (SELECT k.cx, k.cy, count(g.xi) AS n FROM k a LEFT JOIN (SELECT xi, yi FROM q WHERE z % 3 = 0) g ON {_near(15, 'a', 'g')} , LATERAL (SELECT a.cx, a.cy) k GROUP BY 1, 2) SELECT cx, cy, n, n >= 3 AS supported FROM s")
def steep_support(spark: SparkSession, d: str) -> DataFrame:
    """Cells with at least three chosen points within 1.5 m of their centre; cells without any count 0."""
    q = places(cloud(spark, d))
    k = q.select(F.expr("xi div 10").alias("cx"), F.expr("yi div 10").alias("cy")).distinct().select("cx", "cy", (F.col("cx") * 10 + 5).alias("xi"), (F.col("cy") * 10 + 5).alias("yi"))
    n = J.radius_pairs(k, q.filter("z % 3 = 0").select("xi", "yi"), 15).groupBy("cx", "cy").agg(one().alias("n"))
    return k.select("cx", "cy").join(n, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") >= 3, F.lit(False)).alias("supported"))


FLOORED = Q + f", f AS (SELECT a.xi, a.yi, a.z, count(*) AS n, CASE WHEN count(*) >= 3 THEN a.z - quantile_cont(b.z, 0.1) ELSE 0 END AS above FROM q a JOIN q b ON {_near(8)} GROUP BY 1, 2, 3)"


@query(FLOORED + " SELECT xi, yi, z, n, round(above, 4)::DOUBLE + 0.0 AS above FROM f")
def height_above_floor(spark: SparkSession, d: str) -> DataFrame:
    return J.heights_above_floor(places(cloud(spark, d)), 8)


@query(FLOORED + " SELECT xi, yi, z FROM f WHERE round(above, 4) <= 20")
def clear_rule(spark: SparkSession, d: str) -> DataFrame:
    """The cleanup: points at most 20 cm above their neighbourhood's floor."""
    return J.heights_above_floor(places(cloud(spark, d)), 8).filter("above <= 20").select("xi", "yi", "z")


PLANE = Q + f""", e AS (SELECT a.xi, a.yi, a.z, b.xi - a.xi AS dx, b.yi - a.yi AS dy, b.z AS h FROM q a JOIN q b ON {_near(12)}),
s AS (SELECT xi, yi, z, {C.SUMS_SQL} FROM e GROUP BY 1, 2, 3 HAVING count(*) >= 6), {C.PLANE_SQL.strip()},
e2 AS (SELECT e.* FROM e JOIN pl ON e.xi = pl.xi AND e.yi = pl.yi WHERE h <= round(a + b * dx + c * dy, 6)), s2 AS (SELECT xi, yi, z, {C.SUMS_SQL} FROM e2 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
{C.PLANE_SQL.strip().replace("m AS", "m2 AS").replace("FROM s)", "FROM s2)").replace("f AS", "f2 AS").replace("FROM m ", "FROM m2 ").replace("pl AS", "pl2 AS").replace("FROM f)", "FROM f2)")}"""


@query(PLANE + " SELECT q.xi, q.yi, q.z, coalesce(pl2.n, 0) AS n, round(coalesce(q.z - pl2.a, 0), 4)::DOUBLE + 0.0 AS above FROM q LEFT JOIN pl2 ON q.xi = pl2.xi AND q.yi = pl2.yi")
def height_above_plane(spark: SparkSession, d: str) -> DataFrame:
    return J.heights_above_plane(places(cloud(spark, d)), 12)


def pairs_sql(lag: int, least: int = 30) -> str:
    """Bins of the pairs of ``q`` up to a lag."""
    d2 = "(b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi)"
    return f"SELECT least(floor(sqrt({d2}) * 12 / {lag}), 11)::BIGINT AS bin, count(*) AS pairs, avg(sqrt({d2})) AS lag, sum((a.z - b.z) * (a.z - b.z))::DOUBLE / (2 * count(*)) AS g FROM q a JOIN q b ON {_near(lag)} AND (a.xi < b.xi OR (a.xi = b.xi AND a.yi < b.yi)) GROUP BY 1 HAVING count(*) >= {least}"


def fit_sql(lag: int) -> str:
    """The spherical model of least squared error for those bins."""
    return f"""(WITH v AS ({pairs_sql(lag)}), t AS (SELECT max(g) AS s, max(lag) AS l FROM v),
y AS (SELECT s, round(n * s, 6) AS nugget, round((1 - n) * s, 6) AS sill, round(l * i / 24, 6) AS reach FROM t, (SELECT unnest(range(1, 25)) AS i), (VALUES (0.0::DOUBLE), (0.05), (0.2)) x(n)),
e AS (SELECT nugget, sill, reach, round(sum((g - (nugget + sill * (1.5 * least(lag / reach, 1) - 0.5 * least(lag / reach, 1) * least(lag / reach, 1) * least(lag / reach, 1)))) ** 2) / any_value(s * s), 9) AS sse FROM v, y GROUP BY 1, 2, 3)
SELECT nugget, sill, reach, sse FROM e ORDER BY sse, reach, nugget LIMIT 1)"""


@query(Q + f" SELECT bin, pairs, round(g, 6) AS semivariance FROM ({pairs_sql(50)})")
def variogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return J.variogram(places(cloud(spark, d)), 50).select("bin", "pairs", F.round("semivariance", 6).alias("semivariance"))


@query(Q + f" SELECT * FROM {fit_sql(50)}")
def variogram_fit_grid(spark: SparkSession, d: str) -> DataFrame:
    return J.fitted(J.variogram(places(cloud(spark, d)), 50))


LAGS = (30, 50, 70)


@query(Q + ", f AS (" + " UNION ALL ".join(f"SELECT {lag} AS lag, * FROM {fit_sql(lag)}" for lag in LAGS) + ") SELECT *, max(reach) OVER () <= 1.25 * min(reach) OVER () AS stable FROM f")
def range_stability(spark: SparkSession, d: str) -> DataFrame:
    """The fitted range at three greatest lags, and whether they agree within a quarter."""
    v = places(cloud(spark, d))
    fits = [J.fitted(J.variogram(v, lag)).select(F.lit(lag).alias("lag"), "nugget", "sill", "reach", "sse") for lag in LAGS]
    every = fits[0].unionByName(fits[1]).unionByName(fits[2])
    w = Window.partitionBy(F.lit(1))  # three rows
    return every.withColumn("stable", F.max("reach").over(w) <= 1.25 * F.min("reach").over(w))


KNN = Q + f", k AS (SELECT a.xi, a.yi, b.z AS bz, (b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi) AS d2, row_number() OVER (PARTITION BY a.xi, a.yi ORDER BY (b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi), b.xi, b.yi) AS k FROM q a JOIN q b ON {_near(20)})"


@query(KNN + " SELECT xi, yi, count(*) AS n, sum(d2)::BIGINT AS d2, sum(bz)::BIGINT AS z FROM k WHERE k <= 8 GROUP BY 1, 2")
def knn8(spark: SparkSession, d: str) -> DataFrame:
    q = places(cloud(spark, d))
    return J.knn(q, q, 8, 20, ["xi", "yi"], ["xi2", "yi2"]).groupBy("xi", "yi").agg(one().alias("n"), F.sum("d2").alias("d2"), F.sum("z2").alias("z"))


@query(Q + f", g AS (SELECT DISTINCT xi // 20 AS cx, yi // 20 AS cy, xi // 20 * 20 + 10 AS xi, yi // 20 * 20 + 10 AS yi FROM q), k AS (SELECT a.cx, a.cy, b.z, greatest((b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi), 1) AS d2, row_number() OVER (PARTITION BY a.cx, a.cy ORDER BY (b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi), b.xi, b.yi) AS k FROM g a JOIN q b ON {_near(50)}) SELECT cx, cy, count(*) AS n, round(sum(z::DOUBLE / d2) / sum(1::DOUBLE / d2), 4) AS z FROM k WHERE k <= 16 GROUP BY 1, 2 HAVING count(*) >= 4")
def idw_grid(spark: SparkSession, d: str) -> DataFrame:
    """Inverse squared distance of the sixteen nearest points within 5 m."""
    q = places(cloud(spark, d))
    g = q.select(F.expr("xi div 20").alias("cx"), F.expr("yi div 20").alias("cy")).distinct().select("cx", "cy", (F.col("cx") * 20 + 10).alias("xi"), (F.col("cy") * 20 + 10).alias("yi"))
    w = 1 / F.greatest("d2", F.lit(1).cast("bigint")).cast("double")
    k = J.knn(g, q, 16, 50, ["cx", "cy"], ["xi2", "yi2"])
    return k.groupBy("cx", "cy").agg(one().alias("n"), F.round(F.sum(F.col("z2") / F.greatest("d2", F.lit(1).cast("bigint"))) / F.sum(w), 4).alias("z")).filter("n >= 4")


@query(Q + ", c AS (SELECT xi // 10 AS cx, yi // 10 AS cy, xi, yi, z, row_number() OVER (PARTITION BY xi // 10, yi // 10 ORDER BY (2 * xi - (2 * (xi // 10) + 1) * 10) * (2 * xi - (2 * (xi // 10) + 1) * 10) + (2 * yi - (2 * (yi // 10) + 1) * 10) * (2 * yi - (2 * (yi // 10) + 1) * 10), xi, yi) AS k FROM q) SELECT cx, cy, xi, yi, z FROM c WHERE k = 1")
def thin_centre(spark: SparkSession, d: str) -> DataFrame:
    return J.thinned(places(cloud(spark, d)), 10)


@query(QG + ", e AS (SELECT DISTINCT xi, yi, zi FROM p WHERE psid <= 3), a AS (SELECT DISTINCT xi, yi, zi FROM p) SELECT count(*) AS n, count_if(EXISTS (SELECT 1 FROM e WHERE e.xi = a.xi AND e.yi = a.yi AND e.zi = a.zi))::BIGINT AS kept FROM a")
def semi_survivors(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    every = p.select("xi", "yi", "zi").distinct()
    kept = J.survivors(every, p.filter("psid <= 3"), ["xi", "yi", "zi"])
    return every.agg(one().alias("n")).join(F.broadcast(kept.agg(one().alias("kept"))))


@query(Q + f", m AS (SELECT DISTINCT xi, yi FROM p WHERE psid % 2 = 0), t AS (SELECT DISTINCT xi, yi FROM p WHERE psid % 2 = 1 AND ground), h AS (SELECT DISTINCT a.xi, a.yi FROM m a JOIN t b ON {_near(2)}), k AS (SELECT DISTINCT a.xi, a.yi FROM t a JOIN m b ON {_near(2)}) SELECT round((SELECT count(*) FROM h)::DOUBLE / (SELECT count(*) FROM m), 8) AS precision, round((SELECT count(*) FROM k)::DOUBLE / (SELECT count(*) FROM t), 8) AS recall")
def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two sets of points within 25 cm, both ways."""
    p = cloud(spark, d)
    m, t = p.filter("psid % 2 = 0").select("xi", "yi").distinct(), p.filter("psid % 2 = 1 and ground").select("xi", "yi").distinct()
    n = lambda df, c: df.agg(one().alias(c))  # noqa: E731 - single rows
    row = n(m, "m").join(F.broadcast(n(t, "t"))).join(F.broadcast(n(J.matched(m, t, 2), "h"))).join(F.broadcast(n(J.matched(t, m, 2), "k")))
    return row.select(F.round(F.col("h") / F.col("m"), 8).alias("precision"), F.round(F.col("k") / F.col("t"), 8).alias("recall"))


@query(Q + ", o AS (SELECT xi, yi, max(cls) AS label FROM p WHERE psid <= 3 GROUP BY 1, 2), n AS (SELECT a.xi, a.yi, b.label, row_number() OVER (PARTITION BY a.xi, a.yi ORDER BY (b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi), b.xi, b.yi) AS k FROM q a JOIN o b ON b.xi BETWEEN a.xi - 1 AND a.xi + 1 AND b.yi BETWEEN a.yi - 1 AND a.yi + 1 AND (b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi) <= 1) SELECT label::BIGINT AS label, count(*) AS n FROM n WHERE k = 1 GROUP BY label")
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    """Labels taken over from the nearest labelled point within 10 cm."""
    p = cloud(spark, d)
    o = p.filter("psid <= 3").groupBy("xi", "yi").agg(F.max("cls").alias("label"))
    return J.knn(places(p), o, 1, 1, ["xi", "yi"], ["xi2", "yi2"]).groupBy(F.col("label2").cast("bigint").alias("label")).agg(one().alias("n"))


@query("SELECT c_nationkey::BIGINT AS tile, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL) GROUP BY 1")
def anti_todo(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do: inputs without a finished record."""
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").groupBy(F.col("c_nationkey").cast("bigint").alias("tile")).agg(one().alias("n"))


@query(P + ", g AS (SELECT yi // 20 AS row, xi // 20 AS col, CAST(sum(zi) AS BIGINT) // count(*) AS z FROM p WHERE ground GROUP BY 1, 2) SELECT p.psid::BIGINT AS psid, count(*) AS n, count(g.z) AS sampled, sum(p.zi - g.z)::BIGINT AS off FROM p LEFT JOIN g ON p.yi // 20 = g.row AND p.xi // 20 = g.col GROUP BY 1")
def raster_sample(spark: SparkSession, d: str) -> DataFrame:
    """Points with the raster's value where they lie."""
    p = cloud(spark, d)
    g = raster(p.filter("ground")).select("row", "col", "z")
    s = p.withColumns({"row": F.expr("yi div 20"), "col": F.expr("xi div 20")}).join(g, ["row", "col"], "left")
    return s.groupBy(F.col("psid").cast("bigint").alias("psid")).agg(one().alias("n"), F.count("z").alias("sampled"), F.sum(F.col("zi") - F.col("z")).alias("off"))


@query(P + ", b AS (SELECT xi, yi, unnest(range((yi - 200 + 15000) // 1500 - 10, (yi + 200) // 1500 + 1)) AS bi FROM p), c AS (SELECT xi, yi, bi, unnest(range((xi - 200 + 15000) // 1500 - 10, (xi + 200) // 1500 + 1)) AS bj FROM b) SELECT bi, bj, count(*) AS n, count_if(yi // 1500 = bi AND xi // 1500 = bj)::BIGINT AS core FROM c GROUP BY 1, 2")
def halo_block_counts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 150 m with a halo of 20 m: how many points each gets, and how many are its own."""
    return J.haloed(cloud(spark, d).select("xi", "yi"), 1500, 200).groupBy("bi", "bj").agg(one().alias("n"), F.count_if("inner").alias("core"))


@query("SELECT n_nationkey::BIGINT AS tile, count(s_suppkey) AS clouds, CASE WHEN count(s_suppkey) = 0 THEN 'missing' WHEN count(s_suppkey) > 1 THEN 'ambiguous' ELSE 'paired' END AS status FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def tile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each reference with its one cloud, or why it has none."""
    s = table(spark, d, "supplier").filter("s_acctbal > 5000").withColumnRenamed("s_nationkey", "n_nationkey")
    n = table(spark, d, "nation").join(s, "n_nationkey", "left").groupBy(F.col("n_nationkey").cast("bigint").alias("tile")).agg(F.count("s_suppkey").alias("clouds"))
    return n.withColumn("status", F.when(F.col("clouds") == 0, "missing").when(F.col("clouds") > 1, "ambiguous").otherwise("paired"))


TILES = P + ", t AS (SELECT psid * 100 + xi // 500 AS tile, min(xi) AS x0, max(xi) AS x1, min(yi) AS y0, max(yi) AS y1 FROM p GROUP BY 1)"


@query(TILES + " SELECT a.tile, count(b.tile) AS overlaps, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))::BIGINT AS area FROM t a JOIN t b ON a.tile <> b.tile AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY 1")
def tile_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Tiles whose boxes meet: an interval join, by the 50 m columns that the boxes cover."""
    p = cloud(spark, d)
    t = p.groupBy(F.expr("psid * 100 + xi div 500").alias("tile")).agg(F.min("xi").alias("x0"), F.max("xi").alias("x1"), F.min("yi").alias("y0"), F.max("yi").alias("y1"))
    strip = t.withColumn("s", F.explode(F.expr("sequence(x0 div 500, x1 div 500)")))
    b = strip.select("s", *[F.col(c).alias(f"{c}_b") for c in ("tile", "x0", "x1", "y0", "y1")])
    # A pair meets in every column that both cover; it counts in the first.
    meet = strip.join(b, "s").filter("tile <> tile_b and x0 <= x1_b and x0_b <= x1 and y0 <= y1_b and y0_b <= y1 and s = greatest(x0, x0_b) div 500")
    area = (F.least("x1", "x1_b") - F.greatest("x0", "x0_b")) * (F.least("y1", "y1_b") - F.greatest("y0", "y0_b"))
    return meet.groupBy("tile").agg(one().alias("overlaps"), F.sum(area).alias("area"))


@query(P + ", s AS (SELECT * FROM (VALUES (0, 250, 250), (1, 1000, 500), (2, 1700, 800)) v(site, sx, sy)), c AS (SELECT DISTINCT xi // 200 * 200 + 100 AS cx, yi // 200 * 200 + 100 AS cy FROM p), r AS (SELECT cx, cy, site, (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy) AS d2, row_number() OVER (PARTITION BY cx, cy ORDER BY (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy), site) AS k FROM c, s) SELECT cx, cy, site::BIGINT AS site, d2 FROM r WHERE k = 1 AND d2 <= 490000")
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of three sites to each cell, within 70 m; the sites travel in the expression."""
    c = cloud(spark, d).select(F.expr("xi div 200 * 200 + 100").alias("cx"), F.expr("yi div 200 * 200 + 100").alias("cy")).distinct()
    to = [F.struct(((F.col("cx") - x) * (F.col("cx") - x) + (F.col("cy") - y) * (F.col("cy") - y)).alias("d2"), F.lit(i).cast("bigint").alias("site")) for i, x, y in ((0, 250, 250), (1, 1000, 500), (2, 1700, 800))]
    return c.withColumn("b", F.least(*to)).filter("b.d2 <= 490000").select("cx", "cy", "b.site", "b.d2")


@query(Q + f", k AS (SELECT a.xi, a.yi, p.cls, (b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi) AS d2, row_number() OVER (PARTITION BY a.xi, a.yi ORDER BY (b.xi - a.xi) * (b.xi - a.xi) + (b.yi - a.yi) * (b.yi - a.yi), b.xi, b.yi) AS k FROM q a JOIN (SELECT xi, yi, min(cls) AS cls FROM p GROUP BY 1, 2) p ON p.xi = a.xi AND p.yi = a.yi JOIN q b ON {_near(20)} AND (a.xi <> b.xi OR a.yi <> b.yi)) SELECT cls::BIGINT AS cls, count(*) AS n, sum(d2)::BIGINT AS d2 FROM k WHERE k = 1 GROUP BY cls")
def class_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance to the nearest other point, by class."""
    p = cloud(spark, d)
    q = p.groupBy("xi", "yi").agg(F.min("cls").alias("cls"))
    return J.knn(q, q.select("xi", "yi"), 1, 20, ["xi", "yi"], ["xi2", "yi2"], beyond=0).groupBy(F.col("cls").cast("bigint").alias("cls")).agg(one().alias("n"), F.sum("d2").alias("d2"))


@query("WITH n AS (SELECT c_custkey AS k, c_acctbal AS v, 1 AS new FROM customer WHERE c_custkey % 3 = 0), o AS (SELECT c_custkey AS k, 0.0::DOUBLE AS v, 0 AS new FROM customer) SELECT k, v, new::BIGINT AS new FROM n UNION ALL SELECT k, v, new::BIGINT FROM o WHERE k NOT IN (SELECT k FROM n)")
def keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    """New records over previous ones, by key."""
    from .batch import merged

    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("k"), F.lit(0.0).alias("v"), F.lit(0).cast("bigint").alias("new"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).cast("bigint").alias("new"))
    return merged(old, new, ["k"])


@query(P + ", g AS (SELECT psid, xi // 100 AS c, count(*) AS n, sum(zi) AS z FROM p GROUP BY 1, 2) SELECT psid::BIGINT AS psid, c, n, z::BIGINT AS z FROM g ORDER BY n DESC, psid, c LIMIT 18")
def densest_windows(spark: SparkSession, d: str) -> DataFrame:
    """The eighteen fullest windows; sorting keeps eighteen rows a task."""
    g = cloud(spark, d).groupBy(F.col("psid").cast("bigint").alias("psid"), F.expr("xi div 100").alias("c")).agg(one().alias("n"), F.sum("zi").alias("z"))
    return g.orderBy(F.desc("n"), "psid", "c").limit(18)


@query("SELECT c_mktsegment AS segment, count(*) AS n, count(o.o_orderkey) AS with_optimum, sum(CASE WHEN o.o_orderkey IS NULL THEN 1 ELSE 0 END)::BIGINT AS without FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) o ON o.o_custkey = c_custkey GROUP BY 1")
def lookup_optimum(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by key, with what it lacks counted."""
    o = table(spark, d, "orders").filter("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("k"))
    j = table(spark, d, "customer").join(o, "c_custkey", "left")
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(one().alias("n"), F.count("k").alias("with_optimum"), F.count_if(F.col("k").isNull()).alias("without"))


@query("SELECT DISTINCT p_brand AS name, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each name once, with the place where it came first."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("first"))
