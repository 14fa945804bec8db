"""Queries by cell, strip, class and height band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cells as C
from .binding import P, cloud, table
from .registry import query



def N(c="n"):  # noqa: N802
    return F.col(c).cast("bigint")


def one():
    return F.count(F.lit(1))


@query(P + " SELECT xi, yi, sum(zi)::DOUBLE / count(*) AS z_mean, count(*) AS n FROM p GROUP BY xi, yi")
def dedupe_mean(spark: SparkSession, d: str) -> DataFrame:
    return C.dedupe_xy(cloud(spark, d), "xi", "yi", "zi").withColumnRenamed("zi", "z_mean")


@query(P + " SELECT xi, yi, min(zi) AS z, count(*) AS n FROM p GROUP BY xi, yi")
def dedupe_lowest(spark: SparkSession, d: str) -> DataFrame:
    return C.dedupe_xy(cloud(spark, d), "xi", "yi", "zi", "lowest").withColumnRenamed("zi", "z")


@query(P + " SELECT xi, yi, max(zi) AS z, arg_min(zi, psid * 1000000000000 + zi) AS z_first, count(*) AS n FROM p GROUP BY xi, yi")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    return p.groupBy("xi", "yi").agg(F.max("zi").alias("z"), F.min_by("zi", F.struct("psid", "zi")).alias("z_first"), one().alias("n"))


@query(P + ", g AS (SELECT xi, yi, count(*) AS n FROM p GROUP BY 1, 2) SELECT sum(n)::BIGINT AS points_in, count(*) AS points_out, count_if(n > 1)::BIGINT AS collision_groups, sum(n - 1)::BIGINT AS dropped FROM g")
def dedupe_report(spark: SparkSession, d: str) -> DataFrame:
    return C.dedupe_xy(cloud(spark, d), "xi", "yi", "zi", "lowest").agg(F.sum("n").alias("points_in"), one().alias("points_out"), F.count_if(F.col("n") > 1).alias("collision_groups"), F.sum(F.col("n") - 1).alias("dropped"))


@query(P + ", s AS (SELECT CAST(round_even(xi / 4.0, 0) AS BIGINT) * 4 AS xs, CAST(round_even(yi / 4.0, 0) AS BIGINT) * 4 AS ys, zi FROM p) SELECT xs, ys, min(zi) AS z, count(*) AS n FROM s GROUP BY 1, 2")
def snap_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return C.dedupe_xy(cloud(spark, d), "xi", "yi", "zi", "lowest", snap=4.0).select(F.col("xi").cast("bigint").alias("xs"), F.col("yi").cast("bigint").alias("ys"), F.col("zi").alias("z"), "n")


@query(P + ", c AS (SELECT DISTINCT xi // 50 AS cx, yi // 50 AS cy FROM p) SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM c) AS cells, round((SELECT count(*) FROM p)::DOUBLE / ((SELECT count(*) FROM c) * 25), 6) AS density")
def covered_density(spark: SparkSession, d: str) -> DataFrame:
    return C.by_cell(cloud(spark, d), 50).agg(one().alias("k")).agg(F.sum("k").alias("n"), one().alias("cells")).withColumn("density", F.round(F.col("n") / (F.col("cells") * 25), 6))


@query(P + ", c AS (SELECT xi // 100 AS cx, yi // 100 AS cy, count(*) AS n FROM p GROUP BY 1, 2) SELECT median(n) / 100 AS density, count(*) AS cells FROM c")
def return_density(spark: SparkSession, d: str) -> DataFrame:
    return C.by_cell(cloud(spark, d), 100).agg(one().alias("n")).agg((F.median("n") / 100).alias("density"), one().alias("cells"))


@query(P + " SELECT xi // 50 AS cx, yi // 50 AS cy, count(*) AS n, sum(zi)::DOUBLE / count(*) AS z_mean, min(zi) AS z_min, max(zi) AS z_max FROM p GROUP BY 1, 2")
def cell_mean(spark: SparkSession, d: str) -> DataFrame:
    return C.by_cell(cloud(spark, d), 50).agg(one().alias("n"), (F.sum("zi") / F.count("zi")).alias("z_mean"), F.min("zi").alias("z_min"), F.max("zi").alias("z_max"))


FLOOR = P + """, q AS (SELECT xi // {s} AS cx, yi // {s} AS cy, count(*) AS n, quantile_cont(zi, 0.1) AS lo, quantile_cont(zi, 0.9) AS hi, min(zi) AS mn, max(zi) AS mx FROM p GROUP BY 1, 2),
fl AS (SELECT cx, cy, n, round(CASE WHEN n >= 3 THEN lo ELSE mn END, 4)::DOUBLE AS floor, round(CASE WHEN n >= 3 THEN hi - lo ELSE mx - mn END, 4)::DOUBLE AS spread FROM q)"""


@query(FLOOR.format(s=50) + " SELECT * FROM fl")
def cell_p10_floor(spark: SparkSession, d: str) -> DataFrame:
    return C.floors(cloud(spark, d), 50)


@query(FLOOR.format(s=50) + """, b AS (SELECT max(cx) AS w, max(cy) AS h, avg(floor) AS m FROM fl),
e AS (SELECT x AS cx, y AS cy, coalesce(fl.floor, round(m, 4)) AS f, fl.n, fl.spread, w, h
  FROM b, LATERAL (SELECT unnest(range(0, w + 1)) AS x) AS xs, LATERAL (SELECT unnest(range(0, h + 1)) AS y) AS ys LEFT JOIN fl ON fl.cx = x AND fl.cy = y),
sl AS (SELECT *, CASE WHEN cx = 0 THEN lead(f) OVER rx - f WHEN cx = w THEN f - lag(f) OVER rx ELSE (lead(f) OVER rx - lag(f) OVER rx) / 2 END / 500 AS gx,
  CASE WHEN cy = 0 THEN lead(f) OVER ry - f WHEN cy = h THEN f - lag(f) OVER ry ELSE (lead(f) OVER ry - lag(f) OVER ry) / 2 END / 500 AS gy
  FROM e WINDOW rx AS (PARTITION BY cy ORDER BY cx), ry AS (PARTITION BY cx ORDER BY cy)),
bad AS (SELECT cx, cy, n, f FROM sl WHERE n >= 4 AND spread > sqrt(gx * gx + gy * gy) * 500 * 1.5 + 20)
SELECT bad.cx, bad.cy, bad.n, count_if(p.zi > bad.f + 15)::BIGINT AS flagged FROM bad JOIN p ON p.xi // 50 = bad.cx AND p.yi // 50 = bad.cy GROUP BY 1, 2, 3""")
def cell_spread_rule(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose heights spread more than their slope explains, and their points well above the floor."""
    from ..operators.rasters import dense, gradient

    p = cloud(spark, d)
    f = C.floors(p, 50)
    size = f.agg(F.max("cx"), F.max("cy"), F.round(F.avg("floor"), 4)).first()  # three numbers
    grid = dense(f.select(F.col("cy").alias("row"), F.col("cx").alias("col"), F.col("floor").alias("z"), "n", "spread"), size[1] + 1, size[0] + 1)
    sloped = gradient(grid.fillna({"z": size[2]}), size[1] + 1, size[0] + 1, 500.0)
    bad = sloped.filter((F.col("n") >= 4) & (F.col("spread") > F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * 500 * 1.5 + 20)).select(F.col("col").alias("cx"), F.col("row").alias("cy"), "n", "z")
    return p.withColumns({"cx": C.cell("xi", 50), "cy": C.cell("yi", 50)}).join(bad, ["cx", "cy"]).groupBy("cx", "cy", "n").agg(F.count_if(F.col("zi") > F.col("z") + 15).alias("flagged"))


@query(P + """, s AS (SELECT xi // 50 AS cx, yi // 50 AS cy, psid, sum(zi)::DOUBLE / count(*) AS m FROM p GROUP BY 1, 2, 3),
c AS (SELECT cx, cy, count(*) AS n_sources, max(m) - min(m) AS gap, min(m) AS low FROM s GROUP BY 1, 2 HAVING count(*) >= 2 AND max(m) - min(m) > 20)
SELECT c.cx, c.cy, n_sources, round(gap, 6) AS gap, count_if(p.zi > low + 12)::BIGINT AS flagged FROM c JOIN p ON p.xi // 50 = c.cx AND p.yi // 50 = c.cy GROUP BY ALL""")
def source_disagreement(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    means = C.by_cell(p, 50, "psid").agg((F.sum("zi") / F.count("zi")).alias("m"))
    odd = means.groupBy("cx", "cy").agg(one().alias("n_sources"), (F.max("m") - F.min("m")).alias("gap"), F.min("m").alias("low")).filter("n_sources >= 2 and gap > 20")
    return p.withColumns({"cx": C.cell("xi", 50), "cy": C.cell("yi", 50)}).join(odd, ["cx", "cy"]).groupBy("cx", "cy", "n_sources", F.round("gap", 6).alias("gap")).agg(F.count_if(F.col("zi") > F.col("low") + 12).alias("flagged"))


@query(P + f", s AS (SELECT xi // 50 AS cx, yi // 50 AS cy, {C.SUMS_SQL} FROM (SELECT xi, yi, xi % 50 AS dx, yi % 50 AS dy, zi AS h FROM p) GROUP BY 1, 2 HAVING count(*) >= 4), {C.PLANE_SQL.strip()} SELECT cx, cy, n, round(a, 4) AS a, round(sqrt(b * b + c * c) * 10, 4) AS slope_pct, round(sqrt(greatest(sse / n, 0)), 4) AS resid_sd FROM pl")
def plane_fit_cells(spark: SparkSession, d: str) -> DataFrame:
    """Slope in per cent (centimetres a decimetre) and the spread about the plane."""
    got = C.plane_by_cell(cloud(spark, d), 50)
    return got.select("cx", "cy", "n", F.round("a", 4).alias("a"), F.round(F.sqrt(F.col("b") * F.col("b") + F.col("c") * F.col("c")) * 10, 4).alias("slope_pct"), F.round(F.sqrt(F.greatest(F.col("sse") / F.col("n"), F.lit(0.0))), 4).alias("resid_sd"))


H = FLOOR.format(s=200) + ", h AS (SELECT p.*, fl.cx, fl.cy, zi - floor AS h FROM p JOIN fl ON p.xi // 200 = fl.cx AND p.yi // 200 = fl.cy)"


@query(H + """ SELECT cx, cy, count(*) AS returns, round(quantile_cont(h, 0.9), 3) AS canopy_p90, round(count_if(h > 200) / count(*), 6) AS frac_over_2m,
  round(count_if(h >= 15 AND h < 35) / count(*), 6) AS frac_band, array_to_string(list_sort(list_distinct(list(psid))), ',') AS strips, count(DISTINCT psid) AS n_strips,
  count_if(cls = 2)::DOUBLE / 400 AS ground_per_m2 FROM h GROUP BY 1, 2""")
def scan_inventory(spark: SparkSession, d: str) -> DataFrame:
    h = C.above_floor(cloud(spark, d), 200)
    frac = lambda c: F.round(F.count_if(c) / one(), 6)
    return h.groupBy("cx", "cy").agg(one().alias("returns"), F.round(F.percentile("h", 0.9), 3).alias("canopy_p90"), frac(F.col("h") > 200).alias("frac_over_2m"), frac((F.col("h") >= 15) & (F.col("h") < 35)).alias("frac_band"), F.array_join(F.sort_array(F.collect_set("psid")).cast("array<string>"), ",").alias("strips"), F.count_distinct("psid").alias("n_strips"), (F.count_if(F.col("cls") == 2) / F.lit(400.0)).alias("ground_per_m2"))


@query(P + """, s AS (SELECT xi // 200 AS cx, yi // 200 AS cy, psid, count(*) AS n, min(angle) AS lo, max(angle) AS hi FROM p GROUP BY 1, 2, 3),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY cx, cy) AS share FROM s) SELECT cx, cy, psid, n, round(share, 6) AS share, lo AS angle_min, hi AS angle_max FROM t WHERE share >= 0.05""")
def strip_share(spark: SparkSession, d: str) -> DataFrame:
    s = C.by_cell(cloud(spark, d), 200, "psid").agg(one().alias("n"), F.min("angle").alias("angle_min"), F.max("angle").alias("angle_max"))
    s = s.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cx", "cy"))).filter("share >= 0.05")
    return s.select("cx", "cy", "psid", "n", F.round("share", 6).alias("share"), "angle_min", "angle_max")


EDGES = [0, 15, 20, 35, 100, 200, 800]


def _band_sql(col: str) -> str:
    return " + ".join(f"({col} >= {e})::INT" for e in EDGES)


@query(H + f" SELECT cx, cy, {_band_sql('h')} AS band, count(*) AS n FROM h GROUP BY ALL")
def height_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.above_floor(cloud(spark, d), 200).groupBy("cx", "cy", C.bands(F.col("h"), EDGES).alias("band")).agg(one().alias("n"))


@query(H + " SELECT psid, count(*) AS returns, round(count_if(h >= 15 AND h < 20) / count(*), 6) AS band_015_020, round(count_if(h >= 20 AND h < 35) / count(*), 6) AS band_020_035, round(count_if(h >= 35 AND h < 100) / count(*), 6) AS band_035_100, round(quantile_cont(h, 0.9), 3) AS p90 FROM h GROUP BY psid")
def band_fractions_by_strip(spark: SparkSession, d: str) -> DataFrame:
    frac = lambda lo, hi: F.round(F.count_if((F.col("h") >= lo) & (F.col("h") < hi)) / one(), 6).alias(f"band_{lo:03d}_{hi:03d}")
    return C.above_floor(cloud(spark, d), 200).groupBy("psid").agg(one().alias("returns"), frac(15, 20), frac(20, 35), frac(35, 100), F.round(F.percentile("h", 0.9), 3).alias("p90"))


THRESHOLDS = [5, 10, 15, 20, 30, 50, 100, 200]


@query(H + f" SELECT t AS threshold, count_if(h > t)::BIGINT AS removed, round(count_if(h > t) / count(*), 8) AS share FROM h, (SELECT unnest({THRESHOLDS}) AS t) GROUP BY t")
def removal_cost_curve(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the points; the thresholds are unfolded from the single row of counts."""
    row = C.above_floor(cloud(spark, d), 200).agg(one().alias("n"), *[F.count_if(F.col("h") > t).alias(f"t{t}") for t in THRESHOLDS])
    each = row.select("n", F.explode(F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("removed")) for t in THRESHOLDS])).alias("x"))
    return each.select("x.threshold", "x.removed", F.round(F.col("x.removed") / F.col("n"), 8).alias("share"))


@query(P + """, c AS (SELECT s, xi // s AS cx, yi // s AS cy, bool_or(cls = 2) AS two, bool_or(cls = 8) AS eight FROM p, (SELECT unnest([5, 50, 200]) AS s) GROUP BY 1, 2, 3)
SELECT s::BIGINT AS size_dm, count_if(two AND eight)::BIGINT AS both, count_if(two AND NOT eight)::BIGINT AS only_2, count_if(eight AND NOT two)::BIGINT AS only_8 FROM c GROUP BY s""")
def class_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each size from the cells of the next smaller one, so that the points are grouped once."""
    has = [F.bool_or(F.col("cls") == 2).alias("two"), F.bool_or(F.col("cls") == 8).alias("eight")]
    small = C.by_cell(cloud(spark, d), 5).agg(*has).withColumn("s", F.lit(5))
    sized = [small]
    for s, step in ((50, 10), (200, 4)):
        up = sized[-1].groupBy(F.expr(f"cx div {step}").alias("cx"), F.expr(f"cy div {step}").alias("cy")).agg(F.bool_or("two").alias("two"), F.bool_or("eight").alias("eight")).withColumn("s", F.lit(s))
        sized.append(up)
    every = sized[0].unionByName(sized[1]).unionByName(sized[2])
    two, eight = F.col("two"), F.col("eight")
    return every.groupBy(F.col("s").cast("bigint").alias("size_dm")).agg(F.count_if(two & eight).alias("both"), F.count_if(two & ~eight).alias("only_2"), F.count_if(eight & ~two).alias("only_8"))


@query(P + ", b AS (SELECT min(gps) AS lo, max(gps) AS hi FROM p) SELECT least((gps - lo) * 40 // (hi - lo), 39) AS slice, count(*) AS n, round(count_if(cls = 8) / count(*), 8) AS share_8 FROM p, b GROUP BY 1")
def time_bin_fraction(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    ends = p.agg(F.min("gps").alias("lo"), F.max("gps").alias("hi"))  # a single row
    return p.join(F.broadcast(ends)).groupBy(F.expr("least((gps - lo) * 40 div (hi - lo), 39)").alias("slice")).agg(one().alias("n"), F.round(F.count_if(F.col("cls") == 8) / one(), 8).alias("share_8"))


@query(P + ", s AS (SELECT xi, yi, zi, max(cls) AS source FROM p WHERE psid <= 4 GROUP BY ALL) SELECT p.cls::BIGINT AS cls, coalesce(s.source, -1)::BIGINT AS source, count(*) AS n FROM p LEFT JOIN s ON p.xi = s.xi AND p.yi = s.yi AND p.zi = s.zi GROUP BY 1, 2")
def provenance_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Classes against those of the source returns at the same place; -1 where there is none."""
    p = cloud(spark, d)
    s = p.filter("psid <= 4").groupBy("xi", "yi", "zi").agg(F.max("cls").alias("source"))
    return p.join(s, ["xi", "yi", "zi"], "left").groupBy(N("cls").alias("cls"), F.coalesce("source", F.lit(-1)).cast("bigint").alias("source")).agg(one().alias("n"))


@query(H + """ SELECT coalesce(cls::BIGINT, 0) AS cls, count(*) AS n, round(quantile_cont(h, 0.25), 4) AS q1, round(median(h), 4) AS q2, round(quantile_cont(h, 0.75), 4) AS q3,
  round(count_if(abs(h) <= 2) / count(*), 8) AS within_2, round(count_if(abs(h) <= 5) / count(*), 8) AS within_5, round(count_if(abs(h) <= 25) / count(*), 8) AS within_25 FROM h GROUP BY GROUPING SETS ((cls), ())""")
def residual_summary_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Each class and, as class 0, all together, by grouping sets."""
    h = C.above_floor(cloud(spark, d), 200)
    within = lambda t: F.round(F.count_if(F.abs("h") <= t) / one(), 8).alias(f"within_{t}")
    return h.rollup("cls").agg(one().alias("n"), F.percentile("h", [0.25, 0.5, 0.75]).alias("q"), within(2), within(5), within(25)).select(F.coalesce(N("cls"), F.lit(0).cast("bigint")).alias("cls"), "n", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)], "within_2", "within_5", "within_25")


STRIPS = ", st AS (SELECT xi // 200 AS cx, yi // 200 AS cy, psid, count(*) AS n, median(zi) AS m FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 3), ss AS (SELECT cx, cy, count(*) AS n_strips, max(m) - min(m) AS spread FROM st GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(P + STRIPS + " SELECT cx, cy, n_strips, spread FROM ss")
def strip_spread(spark: SparkSession, d: str) -> DataFrame:
    return C.strip_medians(cloud(spark, d), 200)


@query(H + STRIPS + """, b AS (SELECT cx, cy, count_if(h >= 15 AND h < 35)::DOUBLE / count(*) AS band FROM h GROUP BY 1, 2)
SELECT count(*) AS cells, round(regr_slope(spread, band), 4) AS slope, round(corr(spread, band), 6) AS r FROM ss JOIN b USING (cx, cy)""")
def regression_contrast(spark: SparkSession, d: str) -> DataFrame:
    p = cloud(spark, d)
    band = C.above_floor(p, 200).groupBy("cx", "cy").agg((F.count_if((F.col("h") >= 15) & (F.col("h") < 35)) / one()).alias("band"))
    both = C.strip_medians(p, 200).join(band, ["cx", "cy"])
    return both.agg(one().alias("cells"), F.round(F.regr_slope("spread", "band"), 4).alias("slope"), F.round(F.corr("spread", "band"), 6).alias("r"))


@query(P + ", b AS (SELECT zi // 25 AS bin, count(*) AS n FROM p GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM b) SELECT q, min(bin) * 25 AS z FROM c, (SELECT unnest([0.02::DOUBLE, 0.5, 0.98]) AS q) WHERE upto >= q * total GROUP BY q")
def hist_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from a histogram, which tiles can add up: 25 cm bins and a running sum over bins."""
    bins = cloud(spark, d).groupBy(F.expr("zi div 25").alias("bin")).agg(one().alias("n"))
    w = Window.orderBy("bin")
    c = bins.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return c.withColumn("q", F.explode(F.array(*[F.lit(q) for q in (0.02, 0.5, 0.98)]))).filter("upto >= q * total").groupBy("q").agg((F.min("bin") * 25).alias("z"))


@query(P + ", s AS (SELECT cls::BIGINT AS cls, nret AS value, count(*) AS n FROM p GROUP BY 1, 2) SELECT cls, value::BIGINT AS value, n, round(n / sum(n) OVER (PARTITION BY cls), 8) AS share FROM s")
def attribute_shares(spark: SparkSession, d: str) -> DataFrame:
    s = C.shares(cloud(spark, d), ["cls"], "nret")
    return s.select(N("cls").alias("cls"), N("nret").alias("value"), "n", F.round("share", 8).alias("share"))


@query(P + " SELECT cls::BIGINT AS cls, quantile_cont(angle, 0.0)::DOUBLE AS q0, quantile_cont(angle, 0.25) AS q1, quantile_cont(angle, 0.5) AS q2, quantile_cont(angle, 0.75) AS q3, quantile_cont(angle, 1.0)::DOUBLE AS q4 FROM p GROUP BY cls")
def attribute_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = cloud(spark, d).groupBy(N("cls").alias("cls")).agg(F.percentile("angle", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q"))
    return q.select("cls", *[F.col("q")[i].alias(f"q{i}") for i in range(5)])


@query(P + " SELECT cls::BIGINT AS cls, round(avg((nret = 1)::INT), 8) AS single, round(avg((nret > 1 AND ret = nret)::INT), 8) AS last, round(avg((ret > 1 AND ret < nret)::INT), 8) AS intermediate, round(avg((nret > 1 AND ret = 1)::INT), 8) AS first_of_several FROM p GROUP BY cls")
def return_structure(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(F.avg(F.expr(c).cast("int")), 8)
    return cloud(spark, d).groupBy(N("cls").alias("cls")).agg(share("nret = 1").alias("single"), share("nret > 1 and ret = nret").alias("last"), share("ret > 1 and ret < nret").alias("intermediate"), share("nret > 1 and ret = 1").alias("first_of_several"))


@query(P + " SELECT cls::BIGINT AS cls, count_if(psid & 1 = 1)::BIGINT AS bit_0, count_if((psid >> 1) & 1 = 1)::BIGINT AS bit_1, count_if((psid >> 2) & 1 = 1)::BIGINT AS bit_2 FROM p GROUP BY cls")
def flag_bits(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).groupBy(N("cls").alias("cls")).agg(*[F.count_if(F.getbit("psid", F.lit(b)) == 1).alias(f"bit_{b}") for b in range(3)])


@query(H + ", t AS (SELECT unnest([2, 5, 10, 20, 50, 100]) AS t) SELECT t::BIGINT AS threshold, count_if(abs(h) > t)::BIGINT AS over, round(sum(CASE WHEN abs(h) > t THEN h * h ELSE 0 END) / sum(h * h), 6) AS share_of_squares FROM h, t GROUP BY t")
def exceedance_curve(spark: SparkSession, d: str) -> DataFrame:
    h, ts = C.above_floor(cloud(spark, d), 200), [2, 5, 10, 20, 50, 100]
    row = h.agg(F.sum(F.col("h") * F.col("h")).alias("all"), *[F.count_if(F.abs("h") > t).alias(f"n{t}") for t in ts], *[F.sum(F.when(F.abs("h") > t, F.col("h") * F.col("h")).otherwise(0)).alias(f"s{t}") for t in ts])
    each = row.select("all", F.explode(F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"n{t}").alias("over"), F.col(f"s{t}").alias("s")) for t in ts])).alias("x"))
    return each.select("x.threshold", "x.over", F.round(F.col("x.s") / F.col("all"), 6).alias("share_of_squares"))


@query(H + """, m AS (SELECT psid, round(median(h), 4) AS m FROM h GROUP BY psid) SELECT a.psid::BIGINT AS a, b.psid::BIGINT AS b, round(abs(a.m - b.m), 4) AS divergence FROM m a JOIN m b ON a.psid < b.psid""")
def filter_divergence(spark: SparkSession, d: str) -> DataFrame:
    m = C.above_floor(cloud(spark, d), 200).groupBy("psid").agg(F.round(F.median("h"), 4).alias("m"))
    a, b = m.select(N("psid").alias("a"), F.col("m").alias("ma")), m.select(N("psid").alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.abs(F.col("ma") - F.col("mb")), 4).alias("divergence"))


@query(H + """, i AS (SELECT cx, cy, count(*) AS returns, count(DISTINCT psid) AS strips, quantile_cont(h, 0.9) AS p90, count_if(h > 200)::DOUBLE / count(*) AS over2 FROM h GROUP BY 1, 2)
SELECT least(strips, 3)::BIGINT AS strips, count(*) AS cells, count_if(p90 > 800)::BIGINT AS tall, count_if(over2 > 0.35)::BIGINT AS wooded, sum(returns)::BIGINT AS returns FROM i GROUP BY 1""")
def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    i = C.above_floor(cloud(spark, d), 200).groupBy("cx", "cy").agg(one().alias("returns"), F.count_distinct("psid").alias("strips"), F.percentile("h", 0.9).alias("p90"), (F.count_if(F.col("h") > 200) / one()).alias("over2"))
    return i.groupBy(F.least("strips", F.lit(3)).alias("strips")).agg(one().alias("cells"), F.count_if(F.col("p90") > 800).alias("tall"), F.count_if(F.col("over2") > 0.35).alias("wooded"), F.sum("returns").alias("returns"))


@query(H + ", i AS (SELECT cx, cy, count_if(h > 200)::DOUBLE / count(*) AS v FROM h GROUP BY 1, 2) SELECT round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS max, count(*) AS cells FROM i")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    v = C.above_floor(cloud(spark, d), 200).groupBy("cx", "cy").agg((F.count_if(F.col("h") > 200) / one()).alias("v"))
    return v.agg(F.round(F.median("v"), 6).alias("median"), F.round(F.percentile("v", 0.9), 6).alias("p90"), F.round(F.max("v"), 6).alias("max"), one().alias("cells"))


@query(P + " SELECT min(zi) AS z_min, max(zi) AS z_max, quantile_cont(zi, 0.02) AS p2, quantile_cont(zi, 0.98) AS p98, quantile_cont(zi, 0.98) - quantile_cont(zi, 0.02) AS relief, count(*) AS n, round(count_if(nret > 1) / count(*), 8) AS multi_return, count(DISTINCT gps // 86400) AS days FROM p")
def pool_traits(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("zi", [0.02, 0.98])
    return cloud(spark, d).agg(F.min("zi").alias("z_min"), F.max("zi").alias("z_max"), q.alias("q"), one().alias("n"), F.round(F.count_if(F.col("nret") > 1) / one(), 8).alias("multi_return"), F.count_distinct(F.expr("gps div 86400")).alias("days")).select("z_min", "z_max", F.col("q")[0].alias("p2"), F.col("q")[1].alias("p98"), (F.col("q")[1] - F.col("q")[0]).alias("relief"), "n", "multi_return", "days")


@query(P + """, l AS (SELECT xi // 200 AS cx, yi // 200 AS cy, min(zi) AS lo, max(zi) AS hi, quantile_cont(zi, 0.02) AS p2, quantile_cont(zi, 0.98) AS p98 FROM p GROUP BY 1, 2)
SELECT min(lo) AS lo_min, max(lo) AS lo_max, min(hi) AS hi_min, max(hi) AS hi_max, round(median(p2), 4) AS p2_median, round(median(p98), 4) AS p98_median, round(avg((p98 - p2)), 4) AS mean_spread FROM l""")
def layer_endpoints(spark: SparkSession, d: str) -> DataFrame:
    l = C.by_cell(cloud(spark, d), 200).agg(F.min("zi").alias("lo"), F.max("zi").alias("hi"), F.percentile("zi", [0.02, 0.98]).alias("q"))  # noqa: E741
    return l.agg(F.min("lo").alias("lo_min"), F.max("lo").alias("lo_max"), F.min("hi").alias("hi_min"), F.max("hi").alias("hi_max"), F.round(F.median(F.col("q")[0]), 4).alias("p2_median"), F.round(F.median(F.col("q")[1]), 4).alias("p98_median"), F.round(F.avg(F.col("q")[1] - F.col("q")[0]), 4).alias("mean_spread"))


@query(P + " SELECT cls::BIGINT AS cls, count(*) AS n FROM p WHERE cls IN (2, 8) AND xi BETWEEN 100 AND 900 AND yi BETWEEN 50 AND 800 AND zi BETWEEN -50 AND 60000 GROUP BY cls")
def crop_classes(spark: SparkSession, d: str) -> DataFrame:
    """A box, a height cut and a set of classes; all of them are filters on the scan."""
    p = cloud(spark, d).filter(F.col("cls").isin(2, 8) & F.col("xi").between(100, 900) & F.col("yi").between(50, 800) & F.col("zi").between(-50, 60000))
    return p.groupBy(N("cls").alias("cls")).agg(one().alias("n"))


@query(H + " SELECT CASE WHEN h > -20 AND h < 20 AND cls <> 2 THEN 8 WHEN h > 200 AND cls = 2 THEN 1 ELSE cls END::BIGINT AS cls, count(*) AS n, sum(zi)::BIGINT AS z FROM h GROUP BY 1")
def reclassify(spark: SparkSession, d: str) -> DataFrame:
    """Near the floor becomes 8, high ground is demoted to 1, nothing is deleted."""
    h, k = F.col("h"), F.col("cls")
    new = F.when((h > -20) & (h < 20) & (k != 2), 8).when((h > 200) & (k == 2), 1).otherwise(k)
    return C.above_floor(cloud(spark, d), 200).groupBy(new.cast("bigint").alias("cls")).agg(one().alias("n"), F.sum("zi").alias("z"))


@query(H + """, i AS (SELECT cx, cy, quantile_cont(h, 0.9) AS p90, count_if(h > 200)::DOUBLE / count(*) AS over2, count_if(h >= 15 AND h < 35)::DOUBLE / count(*) AS band, count(DISTINCT psid) AS strips FROM h GROUP BY 1, 2)
SELECT cx, cy, concat_ws('|', CASE WHEN p90 > 800 THEN 'tall' END, CASE WHEN over2 > 0.35 THEN 'wooded' END, CASE WHEN band > 0.03 THEN 'understory' END, CASE WHEN strips >= 3 THEN 'overlap' END) AS labels FROM i""")
def suggests_labels(spark: SparkSession, d: str) -> DataFrame:
    i = C.above_floor(cloud(spark, d), 200).groupBy("cx", "cy").agg(F.percentile("h", 0.9).alias("p90"), (F.count_if(F.col("h") > 200) / one()).alias("over2"), (F.count_if((F.col("h") >= 15) & (F.col("h") < 35)) / one()).alias("band"), F.count_distinct("psid").alias("strips"))
    tag = lambda c, name: F.when(F.expr(c), name)
    return i.select("cx", "cy", F.concat_ws("|", tag("p90 > 800", "tall"), tag("over2 > 0.35", "wooded"), tag("band > 0.03", "understory"), tag("strips >= 3", "overlap")).alias("labels"))


@query(P + ", c AS (SELECT psid, xi // 200 AS cx, yi // 200 AS cy, count(*) AS n, stddev_pop(zi) AS sd FROM p GROUP BY 1, 2, 3) SELECT psid, arg_min((cx, cy), (sd, cx, cy)).cx AS cx, arg_min((cx, cy), (sd, cx, cy)).cy AS cy, round(min(sd), 4) AS sd FROM (SELECT psid, cx, cy, round(sd, 6) AS sd FROM c WHERE n >= 2) GROUP BY psid".replace("(cx, cy)", "{'cx': cx, 'cy': cy}"))
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The flattest cell of each strip."""
    c = C.by_cell(cloud(spark, d), 200, "psid").agg(one().alias("n"), F.round(F.stddev_pop("zi"), 6).alias("sd")).filter("n >= 2")
    best = c.groupBy("psid").agg(F.min(F.struct("sd", "cx", "cy")).alias("b"))
    return best.select("psid", "b.cx", "b.cy", F.round("b.sd", 4).alias("sd"))


@query("""SELECT regexp_extract(p_type, '^(\\w+) (\\w+) (\\w+)$', 1) AS region, regexp_extract(p_type, '(\\w+)$', 1) AS campaign, regexp_extract(p_brand, '(\\d+)', 1) AS id, count(*) AS n FROM part GROUP BY ALL""")
def parse_names(spark: SparkSession, d: str) -> DataFrame:
    """The fields of a name by pattern, as file names are parsed."""
    part = table(spark, d, "part")
    pick = lambda c, p: F.regexp_extract(c, p, 1)
    return part.groupBy(pick("p_type", r"^(\w+) (\w+) (\w+)$").alias("region"), pick("p_type", r"(\w+)$").alias("campaign"), pick("p_brand", r"(\d+)").alias("id")).agg(one().alias("n"))
