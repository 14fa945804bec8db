import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataframe.operators import evaluate as E
from strataframe.operators import ground as G
from strataframe.operators import neighbors as J
from strataframe.operators import surface as S

V = ("spherical", 0.5, 20.0, 60.0)


def plane(spark, n=300, seed=0, a=100.0, b=0.5, c=-0.25):
    rng = np.random.default_rng(seed)
    xy = np.unique(rng.integers(0, 200, (n, 2)), axis=0)
    return spark.createDataFrame(pd.DataFrame({"xi": xy[:, 0], "yi": xy[:, 1], "z": a + b * xy[:, 0] + c * xy[:, 1]}))


def grid(spark, lo=40, hi=160, step=20):
    return spark.createDataFrame([(y // step, x // step, x, y) for y in range(lo, hi, step) for x in range(lo, hi, step)], "row long, col long, xi long, yi long")


def test_universal_kriging_reproduces_a_plane(spark):
    g = grid(spark)
    got = S.krige(plane(spark), g, V, order=1, radius=60.0).join(g, ["row", "col"])
    off = F.abs(F.col("z") - (100 + 0.5 * F.col("xi") - 0.25 * F.col("yi")))
    assert got.filter(~F.col("fallback")).agg(F.max(off)).first()[0] < 1e-3 and got.count() == g.count()


def test_kriging_against_a_dense_solve(spark):
    rng = np.random.default_rng(3)
    dx, dy, z = rng.normal(0, 10, (1, 12)), rng.normal(0, 10, (1, 12)), rng.normal(50, 1, (1, 12))
    est, var, bad = S.krige_stack(dx, dy, z, V, ridge=0.0)
    d = np.hypot(dx[0][:, None] - dx[0], dy[0][:, None] - dy[0])
    a = np.ones((13, 13))
    a[:12, :12], a[12, 12] = S.variogram_value(V[0], d, *V[1:]), 0
    w = np.linalg.solve(a, np.r_[S.variogram_value(V[0], np.hypot(dx, dy)[0], *V[1:]), 1])
    assert w[:12].sum() == pytest.approx(1) and (bad[0] or est[0] == pytest.approx(w[:12] @ z[0]))


def test_degenerate_neighbours_fall_back_within_their_range():
    z = np.array([[1.0, 2.0, 3.0, 4.0]])
    est, var, bad = S.krige_stack(np.zeros((1, 4)), np.zeros((1, 4)), z, ("spherical", 0.0, 1.0, 5.0), ridge=0.0)
    assert bad[0] and 1 <= est[0] <= 4 and np.isnan(var[0])


def test_kriging_reruns_are_equal(spark):
    run = lambda: sorted(map(tuple, S.krige(plane(spark), grid(spark), V, radius=60.0).collect()))
    assert run() == run()


def test_spline_passes_near_its_points_and_keeps_a_constant(spark):
    flat = plane(spark, b=0.0, c=0.0)
    got = S.spline(flat, grid(spark), k=20, radius=80.0)
    assert got.agg(F.max(F.abs(F.col("z") - 100))).first()[0] < 1e-6


def test_exponential_integral():
    known = {0.1: 1.8229239584, 1.0: 0.2193839344, 2.0: 0.0489005107, 10.0: 4.15696893e-06}
    for x, v in known.items():
        assert S.exp1(np.array([x]))[0] == pytest.approx(v, rel=1e-7)


def test_minimum_curvature_against_a_dense_solve():
    rng = np.random.default_rng(5)
    shape = (9, 8)
    data = np.where(rng.random(shape) < 0.25, rng.normal(0, 3, shape), np.nan)
    weight = np.where(np.isfinite(data), np.where(rng.random(shape) < 0.5, np.inf, 2.0), 0.0)
    got = S.minimum_curvature(data, weight, 1e-12, 20000)
    n = data.size
    a = np.stack([S._bend(np.eye(n)[i].reshape(shape)).ravel() for i in range(n)], 1)
    b = np.zeros(n)
    has, pin = np.isfinite(data).ravel(), np.isinf(weight).ravel()
    soft = has & ~pin
    a[soft, soft] += 2.0
    b[soft] = 2.0 * data.ravel()[soft]
    a[pin] = np.eye(n)[pin]
    b[pin] = data.ravel()[pin]
    assert np.allclose(got.ravel(), np.linalg.solve(a, b), atol=1e-5)


def test_minimum_curvature_extends_a_plane():
    r, c = np.mgrid[:20, :20]
    want = 3 + 0.2 * r - 0.1 * c
    data = np.where((r * 7 + c * 3) % 11 == 0, want, np.nan)
    assert np.abs(S.minimum_curvature(data, np.where(np.isfinite(data), np.inf, 0.0)) - want).max() < 1e-4


def test_blocks_of_minimum_curvature(spark):
    got = S.curvature_blocks(plane(spark, 2000), 5, 100, 40).withColumn("off", F.abs(F.col("z") - (100 + 0.5 * (F.col("col") * 5 + 2) - 0.25 * (F.col("row") * 5 + 2)))).filter("row between 4 and 35 and col between 4 and 35")
    assert got.agg(F.percentile("off", 0.95)).first()[0] < 1.5


def test_triangulation_is_delaunay():
    rng = np.random.default_rng(2)
    x, y = rng.random(60) * 100, rng.random(60) * 100
    tri = S.triangulate(x, y)
    assert len(tri) > 60
    for a, b, c in tri:
        d = 2 * (x[a] * (y[b] - y[c]) + x[b] * (y[c] - y[a]) + x[c] * (y[a] - y[b]))
        ux = ((x[a] ** 2 + y[a] ** 2) * (y[b] - y[c]) + (x[b] ** 2 + y[b] ** 2) * (y[c] - y[a]) + (x[c] ** 2 + y[c] ** 2) * (y[a] - y[b])) / d
        uy = ((x[a] ** 2 + y[a] ** 2) * (x[c] - x[b]) + (x[b] ** 2 + y[b] ** 2) * (x[a] - x[c]) + (x[c] ** 2 + y[c] ** 2) * (x[b] - x[a])) / d
        r = np.hypot(x[a] - ux, y[a] - uy)
        others = np.setdiff1d(np.arange(60), [a, b, c])
        assert (np.hypot(x[others] - ux, y[others] - uy) > r - 1e-7).all()


def test_tin_reproduces_a_plane(spark):
    got = S.tin(plane(spark, 1500), 10, 100, 30).withColumn("off", F.abs(F.col("z") - (100 + 0.5 * (F.col("col") + 0.5) * 10 - 0.25 * (F.col("row") + 0.5) * 10)))
    assert got.agg(F.max("off")).first()[0] < 1e-6 and got.count() > 300


@pytest.mark.parametrize("n", [3, 40, 300, 3000])
def test_the_triangulated_surface_without_triangles(n):
    """The surface found for queries alone is that of the triangulation; queries at points and outside the hull are among them."""
    rng = np.random.default_rng(n)
    x, y, z = rng.random(n) * 700 + 5e5, rng.random(n) * 700 - 3e4, rng.random(n) * 100
    qx, qy = np.r_[x[:50], rng.random(400) * 800 + 5e5 - 50], np.r_[y[:50], rng.random(400) * 800 - 3e4 - 50]
    want = S.linear_on(S.triangulate(x, y), x, y, z, qx, qy, 1.0)
    got = S.on_delaunay(x, y, z, qx, qy, room=20_000)
    both = np.isfinite(want)
    assert np.isfinite(got[both]).all() and np.allclose(got[both], want[both], atol=1e-6) and (np.isfinite(got) & ~both).mean() < 0.01


def test_the_triangulated_surface_on_a_lattice():
    """Many points on one circle: any of their triangles will do, and a plane is a plane; points on a line have no surface."""
    x, y = (a.ravel().astype(float) for a in np.mgrid[0:20, 0:20])
    qx, qy = (a.ravel() for a in np.mgrid[0:19.01:0.5, 0:19.01:0.25])
    assert np.allclose(S.on_delaunay(x, y, 3 + x - 2 * y, qx, qy), 3 + qx - 2 * qy)
    assert np.isnan(S.on_delaunay(np.arange(9.0), 2 * np.arange(9.0), np.ones(9), np.arange(9.0), 2 * np.arange(9.0))).all()


def test_tin_goes_on_beyond_the_hull(spark):
    """Two clouds of a plane at opposite corners, and one place apart: with ``far`` every cell of the bounding box has the plane."""
    p = plane(spark, 1500)
    p = p.unionByName(p.select((F.col("xi") + 700).alias("xi"), (F.col("yi") + 420).alias("yi"), (F.col("z") + 350 - 105).alias("z")))
    p = p.unionByName(spark.createDataFrame([(350, 900, 100 + 0.5 * 350 - 0.25 * 900)], "xi long, yi long, z double"))
    got = S.tin(p, 10, 100, 30, far=True).toPandas()
    assert len(got) == 90 * 100 and not got.duplicated(["row", "col"]).any()
    assert (got["z"] - (100 + 0.5 * (got["col"] + 0.5) * 10 - 0.25 * (got["row"] + 0.5) * 10)).abs().max() < 1e-6


def test_knn_against_brute_force(spark):
    p = plane(spark, 120, 9)
    a = p.toPandas()
    got = {(r["xi"], r["yi"]): [] for r in p.collect()}
    for r in J.knn(p, p, 5, 30, ["xi", "yi"], ["xi2", "yi2"]).orderBy("k").collect():
        got[r["xi"], r["yi"]].append((r["d2"], r["xi2"], r["yi2"]))
    for x, y in got:
        want = sorted((int((u - x) ** 2 + (v - y) ** 2), int(u), int(v)) for u, v in zip(a["xi"], a["yi"], strict=True) if (u - x) ** 2 + (v - y) ** 2 <= 900)[:5]
        assert got[x, y] == want


def test_nearest_reaches_far(spark):
    a, b = spark.createDataFrame([(0, 0), (500, 500)], "xi long, yi long"), spark.createDataFrame([(3, 4), (100, 100)], "xi long, yi long")
    got = {r["xi"]: (r["xi2"], r["d2"]) for r in J.nearest(a, b, ["xi", "yi"], ["xi2", "yi2"], 2).collect()}
    assert got == {0: (3, 25), 500: (100, 320000)}


def test_nearest_has_no_last_ring(spark):
    a, b = spark.createDataFrame([(0, 0), (20_000, -9000)], "xi long, yi long"), spark.createDataFrame([(1, 0)], "xi long, yi long")
    got = {r["xi"]: (r["xi2"], r["d2"]) for r in J.nearest(a, b, ["xi", "yi"], ["xi2", "yi2"], 2).collect()}
    assert got == {0: (1, 1), 20_000: (1, 19_999**2 + 9000**2)}
    assert J.nearest(a, b.limit(0), ["xi", "yi"], ["xi2", "yi2"], 4000).isEmpty()


def mound(seed=4, n=6000):
    rng = np.random.default_rng(seed)
    x, y = rng.random(n) * 60, rng.random(n) * 60
    z = 10 + 0.05 * x + 2 * np.exp(-((x - 30) ** 2 + (y - 30) ** 2) / 200) + rng.normal(0, 0.02, n)
    raised = rng.random(n) < 0.1
    return x, y, z + raised * rng.uniform(2, 8, n), ~raised


@pytest.mark.parametrize("kernel", ["smrf", "pmf", "csf", "mcc"])
def test_filters_find_raised_points(kernel):
    x, y, z, truth = mound()
    got = G.KERNELS[kernel](x, y, z)
    assert (got & ~truth).sum() <= 0.02 * (~truth).sum() and (got & truth).sum() >= 0.8 * truth.sum()


def test_adjudication_keeps_the_confident():
    x, y, z, truth = mound()
    got, sure, maybe = G.adjudicated(x, y, z, G.Adjudication())
    assert (got | ~sure).all() and (maybe | ~sure).all() and (got & truth).sum() >= 0.9 * truth.sum()


def test_blocks_agree_with_one_block(spark):
    x, y, z, truth = mound()
    p = spark.createDataFrame(pd.DataFrame({"xi": (x * 10).astype(int), "yi": (y * 10).astype(int), "zi": (z * 100).astype(int)}))
    whole = G.classified(p, "smrf", 10_000, 0, window=8.0).filter("is_ground").count()
    parts = G.classified(p, "smrf", 300, 250, window=8.0).filter("is_ground").count()
    assert abs(whole - parts) <= 0.03 * whole and G.classified(p, "smrf", 300, 250).count() == p.count()


def test_left_out_points_are_estimated(spark):
    got = E.left_out(plane(spark, 600), V, buffer=7.5, radius=80.0, order=1)
    assert E.errors(got.withColumn("g", F.lit(1)), "z", "estimate", "g").first()["median"] < 0.01


def test_lonely_points_are_estimated_from_afar(spark):
    """Points with too few neighbours near, and estimates beyond their neighbours' range, on a plane: all without error."""
    lonely = [(5000, 5000), (5300, -800), (-2000, 9000), (-2050, 9010)]
    p = plane(spark, 600).unionByName(spark.createDataFrame([(x, y, 100 + 0.5 * x - 0.25 * y) for x, y in lonely], "xi long, yi long, z double"))
    got = E.left_out(p, V, buffer=7.5, radius=30.0, order=1, guard="none", far=True).toPandas()
    assert len(got) == p.count() and set(lonely) <= set(zip(got["xi"], got["yi"], strict=True))
    assert (got["estimate"] - got["z"]).abs().max() < 0.05 and not got["fallback"].any()


def test_errors_of_all_are_those_of_one_group(spark):
    p = spark.range(1001).select(F.col("id").cast("double").alias("z"), (F.col("id") * 1.5 - 7).alias("estimate"))
    want = E.errors(p.withColumn("g", F.lit(1)), "z", "estimate", "g").drop("g").first()
    assert E.errors_of_all(p, "z", "estimate").first() == want
    assert E.errors_of_all(p.limit(0), "z", "estimate").first()["n"] == 0


@pytest.mark.parametrize("room", [500, 2_000_000])
def test_neighbours_in_buckets_against_brute_force(room):
    rng = np.random.default_rng(3)
    x, y = np.r_[rng.integers(0, 60, 150), rng.integers(0, 900, 60)], np.r_[rng.integers(0, 60, 150), rng.integers(0, 900, 60)]
    ask = np.flatnonzero(rng.random(210) < 0.7)
    near, d2 = J.nearest_outside(x, y, ask, 6, 7.5, 120.0, room)
    for i, p in enumerate(ask):
        apart = (x - x[p]) ** 2 + (y - y[p]) ** 2
        want = sorted((int(d), j) for j, d in enumerate(apart) if 7.5**2 < d <= 120**2)[:6]
        assert [(int(d), int(j)) for d, j in zip(d2[i], near[i], strict=True) if j >= 0] == want


def test_sweep_ranks_and_keeps_failures(spark):
    def run(a, b):
        if b == 2:
            raise ValueError("no")
        return spark.createDataFrame([(float(a),)], "score double")

    done, failed = E.sweep({"a": [3, 1], "b": [1, 2]}, run, "score")
    assert [d["a"] for d in done] == [1, 3] and len(failed) == 2 and "no" in failed[0]["error"]


@pytest.mark.parametrize("guard", ["range", "widened", "none"])
def test_each_guard_against_its_rule(guard):
    """Estimates of an extrapolated slope leave the neighbours' range by a known share of it: each guard lets through up to
    its own margin and replaces the rest by inverse distance."""
    for share in (-0.9, -0.3, 0.9):
        dx = np.array([[-1.0, -2.0, -1.0, -2.0, -1.5, -1.2]]) - share
        dy = np.array([[1.0, -1.0, -1.0, 1.0, 0.0, 0.4]])
        z = dx * 1.0
        est, _, bad = S.krige_stack(dx, dy, z, V, order=1, ridge=0.0, guard=guard)
        beyond = (0.0 - z.max()) / (z.max() - z.min())
        want = beyond > S.GUARDS[guard] + 1e-9
        assert bad[0] == want, (guard, share, beyond)
        if want:
            w = 1 / (dx**2 + dy**2)
            assert est[0] == pytest.approx((w * z).sum() / w.sum())
        else:
            assert est[0] == pytest.approx(0.0, abs=1e-6)
    assert S.GUARDS["widened"] == 1.0


def test_ridges_are_held_and_smooth_faces_let_go():
    """Protection is high where it is flat, or bent, however steep; a broad smooth face is relaxed."""
    r, c = np.mgrid[:80, :80]
    cell = 0.5
    face = 0.6 * c * cell
    assert S.held(np.zeros((80, 80)), cell).min() > 0.95 and S.held(face, cell)[20:60, 20:60].max() < 0.05
    ridge = face + np.where(np.abs(r - 40) <= 1, 1.0, 0.0)
    firm = S.held(ridge, cell)
    assert firm[39:42, 20:60].min() > 0.9 and firm[10:25, 20:60].max() < 0.1
    rng = np.random.default_rng(0)
    data = np.where(rng.random(ridge.shape) < 0.6, ridge, np.nan)
    got, relaxed = S.gated(data, cell)
    on = np.isfinite(data) & (np.abs(r - 40) == 0) & (np.abs(c - 40) < 20)
    assert np.abs(got - ridge)[on].max() < 0.05 and relaxed > 0


def test_nearest_k_against_brute_force(spark):
    """However far, in the plane and in space, in a crowd and alone."""
    rng = np.random.default_rng(7)
    xyz = np.unique(np.r_[rng.integers(0, 60, (150, 3)), rng.integers(0, 4000, (30, 3))], axis=0)
    p = spark.createDataFrame([tuple(map(int, v)) for v in xyz], "xi long, yi long, z long")
    near = J.nearest_k(p, p, 5, ["xi", "yi", "z"], ["xi2", "yi2", "z2"], 4, height="z", apart=True).groupBy("xi", "yi", "z").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    d = ((xyz[:, None, :2] - xyz[None, :, :2]) ** 2).sum(-1) + ((xyz[:, None, 2] - xyz[None, :, 2]) / 10) ** 2
    want = {tuple(v): np.sort(np.delete(row, i))[:5].sum() for i, (v, row) in enumerate(zip(xyz.tolist(), d, strict=True))}
    assert len(near) == len(want) and all(r["n"] == 5 and r["s"] == pytest.approx(want[r["xi"], r["yi"], r["z"]]) for r in near)
    few = J.nearest_k(p.limit(1), p.limit(3), 9, ["xi", "yi", "z"], ["xi2", "yi2", "z2"], 4, height="z")
    assert few.count() == 3


def test_remedy_only_where_it_is_needed(spark):
    made = []

    def estimate(df):
        made.append(df.count())
        return df.withColumn("fallback", F.col("xi") >= 95)

    points = spark.range(100).select(F.col("id").alias("xi"))
    _, share, used = E.remedied(points, estimate, lambda p: p.filter("xi < 50"), most=0.05)
    assert (share, used, made) == (0.05, False, [100])
    _, share, used = E.remedied(points, estimate, lambda p: p.filter("xi < 50"), most=0.04)
    assert (share, used, made) == (0.0, True, [100, 100, 50])


def test_too_few_returns_are_an_error(spark):
    p = spark.createDataFrame([(i, i, i) for i in range(20)], "xi long, yi long, zi long")
    with pytest.raises(G.TooFew, match="20 returns"):
        G.adjudicate(p)


def test_long_rows_touch_once(spark):
    from strataframe.operators import regions as Rg

    cells = spark.createDataFrame([(0, c) for c in range(1000, 2100)] + [(1, c) for c in (1023, 1024, 2047, 2049)] + [(2, 1025)], "row long, col long")
    r = Rg.numbered_runs(cells)
    straight, diagonal = (sorted(map(tuple, Rg.touching(r, d).collect())) for d in (False, True))
    assert len(straight) == len(set(straight)) == 3 and len(diagonal) == len(set(diagonal)) == 4
    assert Rg.sizes(cells).count() == 2 and Rg.sizes(cells, True).count() == 1


def test_utm_of_known_places(spark):
    from strataframe.functions.projection import utm

    got = spark.createDataFrame([(-87.0, 0.0), (-90.0, 20.0), (-84.5, 45.0), (None, 1.0)], "lon double, lat double")
    rows = got.select(*[c.alias(n) for c, n in zip(utm(F.col("lon"), F.col("lat"), 16), "en", strict=True)]).collect()
    assert (rows[0]["e"], rows[0]["n"]) == (pytest.approx(500000.0), pytest.approx(0.0, abs=1e-6)) and rows[3]["e"] is None
    # A quarter of a meridian is 10,001,965.729 m long on this ellipsoid; the arc to 45 degrees is 4,984,944.378 m.
    mid = spark.createDataFrame([(-87.0, 45.0), (-87.0, 89.999999)], "lon double, lat double").select(utm(F.col("lon"), F.col("lat"), 16)[1].alias("n")).collect()
    assert mid[0]["n"] == pytest.approx(0.9996 * 4984944.378, abs=0.01) and mid[1]["n"] == pytest.approx(0.9996 * 10001965.729, abs=0.2)


def test_lonely_cells_are_kriged_from_afar(spark):
    """A cell with a single point within the radius has an estimate from its nearest, on the plane."""
    p = plane(spark).unionByName(spark.createDataFrame([(900, 900, 325.0)], "xi long, yi long, z double"))
    g = grid(spark).unionByName(spark.createDataFrame([(45, 45, 905, 905)], "row long, col long, xi long, yi long"))
    assert S.krige(p, g, V, order=1, radius=60.0, guard="none").count() == g.count() - 1
    got = S.krige(p, g, V, order=1, radius=60.0, guard="none", far=True).join(g, ["row", "col"])
    off = F.abs(F.col("z") - (100 + 0.5 * F.col("xi") - 0.25 * F.col("yi")))
    assert got.count() == g.count() and got.agg(F.max(off)).first()[0] < 0.5
    assert S.spline(p, g, k=12, radius=60.0, far=True).count() == g.count()


def test_guards_solved_together_are_those_solved_apart(spark):
    rng = np.random.default_rng(11)
    xy = np.unique(rng.integers(0, 200, (250, 2)), axis=0)
    p = spark.createDataFrame(pd.DataFrame({"xi": xy[:, 0], "yi": xy[:, 1], "z": 0.1 * xy[:, 0] ** 2}))
    g, v = grid(spark, -30, 240, 15), ("spherical", 0.0, 20.0, 300.0)
    got = sorted(map(tuple, S.krige_guards(p, g, v, list(S.GUARDS)).select("guard", "row", "col", "z", "fallback").collect()))
    apart = sorted((name, *r) for name in S.GUARDS for r in map(tuple, S.krige(p, g, v, guard=name).select("row", "col", "z", "fallback").collect()))
    assert [(r[:3], r[4]) for r in got] == [(r[:3], r[4]) for r in apart] and np.allclose([r[3] for r in got], [r[3] for r in apart])
    assert any(r[4] for r in got)


def test_nearest_fill_takes_the_nearest_by_row_and_column():
    """Against brute force, with a wide gap, whose cells were asked for ring by ring, each on its own."""
    rng = np.random.default_rng(2)
    for shape, share in (((9, 14), 0.1), ((20, 6), 0.5), ((1, 8), 0.3), ((15, 15), 0.02)):
        a = np.where(rng.random(shape) < share, rng.random(shape), np.nan)
        a.flat[3] = 7.0
        have = np.argwhere(np.isfinite(a))
        want = a.copy()
        for r, c in np.argwhere(~np.isfinite(a)):
            want[r, c] = a[tuple(min(have.tolist(), key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p[0], p[1])))]
        assert np.array_equal(G.fill_nearest(a), want)


def test_heights_beyond_the_hull_are_over_the_nearest_ground(spark):
    """Beside the ground's outline, and where no block with ground reaches, a return still has a height if it is asked for."""
    ground = [(0, 0, 0), (90, 0, 0), (0, 90, 0), (90, 90, 20)]
    rows = [(i, x, y, z, True) for i, (x, y, z) in enumerate(ground)] + [(10, 40, 40, 300, False), (11, 99, 95, 320, False), (12, 5000, 5000, 700, False)]
    p = spark.createDataFrame(rows, "id long, xi long, yi long, zi long, is_ground boolean")
    got = {r["id"]: r["hag"] for r in G.heights_above_ground(p, 500, 100, far=True).collect()}
    assert len(got) == 7 and got[11] == 300 and got[12] == 680
    plain = {r["id"]: r["hag"] for r in G.heights_above_ground(p, 500, 100).collect()}
    assert plain[11] is None and plain[12] is None and plain[10] == got[10]


def sparse(slope, n=6000, seed=10):
    """A third of a return to a square metre on an even slope, every third one raised by 1 m to 50 m."""
    rng = np.random.default_rng(seed)
    x, y = rng.random(n) * 150, rng.random(n) * 120
    raised = rng.random(n) < 1 / 3
    return x, y, slope * x + raised * rng.integers(1, 51, n), ~raised


@pytest.mark.parametrize("kernel", ["pmf", "csf"])
def test_raised_returns_are_no_wider_than_their_cell(kernel):
    """Gaps were filled from the nearest cell, so a lonely raised return was as wide as the gap about it, and ground."""
    x, y, z, truth = sparse(0.005)
    got = G.KERNELS[kernel](x, y, z)
    assert (got == truth).all()


def test_gaps_follow_the_slope():
    """On a slope nothing stands out, so gaps take the nearest cell; raised cells are left out of them there too."""
    a = np.where(np.random.default_rng(1).random((90, 90)) < 0.3, np.arange(90.0), np.nan)
    assert np.array_equal(G.fill_low(a)[20:70, 20:70], G.fill_nearest(a)[20:70, 20:70])
    a[np.isfinite(a) & (np.random.default_rng(2).random(a.shape) < 0.3)] += 20
    off = np.where(np.isfinite(a), np.nan, G.fill_low(a) - np.arange(90.0))[20:70, 20:70]
    assert np.nanmax(off) < 6
    empty = np.full((3, 4), np.nan)
    assert np.isnan(G.fill_low(empty)).all() and np.array_equal(G.fill_low(np.where(np.arange(6).reshape(2, 3) == 4, 5.0, np.nan)), np.full((2, 3), 5.0))


def test_outliers_are_found_from_blocks_and_beyond(spark, monkeypatch):
    """Mean distances to the nearest in space against brute force, on steep ground and far from all others; pairs were written
    for every point and round, now only for points that no block's halo serves."""
    rng = np.random.default_rng(6)
    p = np.unique(np.r_[np.c_[rng.integers(0, 400, (300, 2)), rng.integers(0, 9000, 300)], [[9000, -7000, 5], [9003, -7000, 5], [200, 200, 90_000]]], axis=0)
    d = np.sqrt(((p[:, None, :2] - p[None, :, :2]) ** 2).sum(-1) + ((p[:, None, 2] - p[None, :, 2]) / 10) ** 2)
    want = np.sort(d, 1)[:, 1:9].mean(1)
    frame = spark.createDataFrame(pd.DataFrame(p, columns=["xi", "yi", "z"]))
    joined, join = [], G.nearest_k
    monkeypatch.setattr(G, "nearest_k", lambda a, *rest, **named: joined.append(a.count()) or join(a, *rest, **named))
    got = {(r["xi"], r["yi"], r["z"]): r for r in G.outliers(frame).collect()}
    assert len(got) == len(p) and all(abs(got[tuple(q)]["distance"] - w) < 1e-6 for q, w in zip(p.tolist(), want, strict=True))
    assert {q for q, r in got.items() if r["outlier"]} == set(map(tuple, p[want > want.mean() + 2.5 * want.std()].tolist())) and joined == [3]
    few = {r["xi"]: r["distance"] for r in G.outliers(frame.filter("xi > 5000")).collect()}
    assert few == {9000: 3 / 8, 9003: 3 / 8} and G.outliers(frame.limit(0)).count() == 0


def test_smrf_tells_a_lone_raised_return_between_distant_neighbours():
    i, j = (v.ravel().astype(float) for v in np.mgrid[:12, :12])
    x, y = 16 * j + (3 * i) % 5, 16 * i + (2 * j) % 5
    raised = (i % 5 == 2) & (j % 5 == 2)
    got = G.smrf(x, y, 0.01 * x + raised)
    assert (got == ~raised).all()


def test_falls_are_those_of_openings_of_openings():
    rng = np.random.default_rng(5)
    bounds = 0.05 * np.arange(1, 12)
    for shape in ((30, 41), (1, 25), (25, 3)):
        a, asked = rng.normal(size=shape), rng.random(shape) < 0.4
        last, want = a, np.zeros(shape, bool)
        for radius, bound in enumerate(bounds, 1):
            cur = G.opening(last, radius)
            want |= last - cur > bound
            last = cur
        assert (G.falls(a, asked, bounds) == (want & asked)).all()


def test_pmf_keeps_all_ground_of_a_sparse_tilted_cloud():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 150, (2, 1100))
    raised = rng.random(1100) < 1 / 3
    got = G.pmf(x, y, 0.05 * x + np.where(raised, rng.integers(1, 50, 1100), 0))
    assert (got == ~raised).all()


def test_neighbours_on_a_line_are_no_plane():
    """Four neighbours near on one line say nothing of the plane: farther ones do, and the plane comes back exactly."""
    dx, dy = np.array([[2.0, 4.0, 6.0, 9.0]]), np.array([[1.0, 2.0, 3.0, 4.5]])
    est, _, bad = S.krige_stack(dx, dy, 7e4 + 0.5 * dx + 0.25 * dy, V, order=1, guard="none")
    assert bad[0] and 7e4 < est[0] < 7.1e4
    dy = dy + np.array([[0, 0, 0, 0.5]])  # hardly more than a line
    est, _, bad = S.krige_stack(dx, dy, 7e4 + 0.5 * dx + 0.25 * dy, V, order=1, guard="none")
    assert not bad[0] and abs(est[0] - 7e4) < 1e-6


def test_cells_and_points_beside_a_line_are_estimated_from_afar(spark):
    line = [(100_000 + 10 * i, 5000 + 10 * i) for i in range(20)]
    around = [(100_000 + 400 * i, 3000 + 700 * j) for i in range(-2, 4) for j in range(-1, 9)]
    p = spark.createDataFrame([(x, y, 100 + 0.5 * x + 0.25 * y) for x, y in line + around], "xi long, yi long, z double")
    g = spark.createDataFrame([(i, i, 100_000 + 7 * i, 5010 + 7 * i) for i in range(12)], "row long, col long, xi long, yi long")
    got = S.krige(p, g, V, order=1, radius=60.0, guard="none", far=True).join(g, ["row", "col"]).toPandas()
    assert len(got) == 12 and not got["fallback"].any()
    assert (got["z"] - 100 - 0.5 * got["xi"] - 0.25 * got["yi"]).abs().max() < 1e-5
    loo = E.left_out(p, V, radius=60.0, order=1, guard="none", far=True).toPandas()
    assert len(loo) == p.count() and not loo["fallback"].any() and (loo["estimate"] - loo["z"]).abs().max() < 1e-5
