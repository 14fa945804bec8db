import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataframe.operators import rasters as X
from strataframe.operators import regions as G


def cells(spark, a):
    a = np.asarray(a, float)
    rows = [(int(r), int(c), float(a[r, c])) for r, c in np.argwhere(np.isfinite(a))]
    return spark.createDataFrame(rows, "row long, col long, z double")


def array(df, shape, z="z"):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", z).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(2, 7), st.integers(2, 7), st.integers(0, 2**31))
def test_gradient_is_numpys(spark, h, w, seed):
    a = np.random.default_rng(seed).integers(0, 50, (h, w)).astype(float)
    got = X.gradient(X.dense(cells(spark, a), h, w), h, w, 0.5)
    gy, gx = np.gradient(a, 0.5)
    assert np.allclose(array(got, a.shape, "gx"), gx) and np.allclose(array(got, a.shape, "gy"), gy)


def test_gradient_is_null_beside_a_gap(spark):
    a = np.arange(25.0).reshape(5, 5)
    a[2, 2] = np.nan
    got = array(X.slope(X.dense(cells(spark, a), 5, 5), 5, 5, 1.0), a.shape, "tan")
    gy, gx = np.gradient(a)
    assert np.array_equal(np.isnan(got), np.isnan(gx + gy))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**31), st.integers(1, 2))
def test_erosion_and_opening(spark, seed, n):
    rng = np.random.default_rng(seed)
    mask = rng.random((8, 9)) < 0.8
    want = mask.copy()
    for _ in range(n):
        p = np.pad(want, 1, constant_values=True)
        want = want & p[2:, 1:-1] & p[:-2, 1:-1] & p[1:-1, 2:] & p[1:-1, :-2]
    got = X.eroded(cells(spark, np.where(mask, 1.0, np.nan)), n, 8, 9)
    assert np.array_equal(np.isfinite(array(got, mask.shape)), want)
    from strataframe.operators.ground import opening

    a = rng.integers(0, 30, (8, 9)).astype(float)
    assert np.array_equal(array(X.opened(X.dense(cells(spark, a), 8, 9), n), a.shape, "open"), opening(a, n))


def test_slide_against_brute_force():
    from strataframe.operators.ground import slide

    a = np.random.default_rng(1).normal(size=(11, 7))
    for r in (1, 2, 3, 5):
        want = np.array([[a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1].min() for j in range(7)] for i in range(11)])
        assert np.array_equal(slide(a, r, True), want)


def test_strip_takes_both_ends_unless_protected(spark):
    a = np.full((40, 100), np.nan)
    a[:, 10:60] = 1
    c = cells(spark, a)
    got = X.stripped(c, 10).agg(F.min("col"), F.max("col"), F.count("*")).first()
    assert tuple(got) == (20, 49, 40 * 30)
    assert tuple(X.stripped(c, 10, keep_lo=True).agg(F.min("col"), F.max("col")).first()) == (10, 49)


def test_spans_give_one_run_a_row(spark):
    a = np.full((30, 30), np.nan)
    for i in range(30):
        a[i, max(0, i - 3) : i + 3 : 2] = 1
    r = X.runs(X.span_footprint(cells(spark, a))).groupBy("row").count()
    assert r.filter("count > 1").count() == 0 and r.count() == 30


def test_components_holes_and_fill(spark):
    a = np.full((12, 20), np.nan)
    a[1:6, 1:6] = 130.0
    a[3:5, 2:4] = np.nan
    a[8:11, 10:18] = 130.0
    c = cells(spark, a)
    s = {r["cells"] for r in G.sizes(c).collect()}
    assert s == {21, 24}
    assert {tuple(r) for r in G.holes(c, 12, 20).select("row", "col").collect()} == {(3, 2), (3, 3), (4, 2), (4, 3)}
    assert G.holes(c, 12, 20, most=3).count() == 0
    full = G.filled(c, 12, 20)
    assert full.count() == 49 and full.agg(F.max(F.abs(F.col("z") - 130))).first()[0] < 1e-3


def test_nearest_fill_breaks_ties_by_row_and_column(spark):
    a = np.full((1, 9), np.nan)
    a[0, 0], a[0, 8] = 1.0, 2.0
    c = cells(spark, a)
    got = G.nearest_fill(c, spark.createDataFrame([(0, 4), (0, 7)], "row long, col long"))
    assert {r["col"]: r["z"] for r in got.collect()} == {4: 1.0, 7: 2.0}


def test_outlines_hold_their_area(spark):
    a = np.full((10, 12), np.nan)
    a[2:6, 3:9] = 1
    a[3, 4] = np.nan
    o = G.outlines(cells(spark, a)).withColumn("area", G.shoelace("ring")).collect()
    assert len(o) == 1 and o[0]["cells"] == 23 and o[0]["area"] == 24.0


def test_gaussian_keeps_a_constant_over_gaps(spark):
    a = np.full((9, 9), 5.0)
    a[3:5, 3:6] = np.nan
    got = X.gaussian(cells(spark, a), 1.0)
    assert got.agg(F.max(F.abs(F.col("blur") - 5))).first()[0] < 1e-9


def test_enforced_values_verify_and_zeros_do_not(spark):
    c = cells(spark, [[0.0, 3.0], [2.0, 0.0]])
    assert X.verified(X.enforced(c)).count() == 4
    with pytest.raises(Exception, match="sentinel"):
        X.verified(c).count()


def test_flat_terrain_sees_the_whole_sky(spark):
    got = X.horizons(cells(spark, np.full((6, 6), 7.0)), 1.0, 8, 3).collect()
    assert all(r["svf"] == 1.0 and r["open"] == 90.0 for r in got)
    assert X.hillshade(X.dense(cells(spark, np.zeros((4, 4))), 4, 4), 4, 4, 1.0).agg(F.round(F.max("shade"), 6)).first()[0] == round(float(np.sin(np.radians(35))), 6)


def test_conform_refuses_much(spark):
    c = cells(spark, np.ones((4, 4)))
    assert X.conformed(c, 4, 4, 3, 5).count() == 12
    with pytest.raises(ValueError):
        X.conformed(c, 4, 4, 9, 4)


def test_shade_is_null_beside_a_gap(spark):
    a = np.zeros((5, 5))
    a[2, 2] = np.nan
    got = array(X.hillshade(X.dense(cells(spark, a), 5, 5), 5, 5, 1.0), a.shape, "shade")
    gy, gx = np.gradient(a)
    assert np.array_equal(np.isnan(got), np.isnan(gx + gy))


def far_apart(spark, a, step=200_000):
    """The same patch twice, at both ends of a diagonal whose bounding box no disk would hold."""
    c = cells(spark, a)
    return c.unionByName(c.select((F.col("row") + step).alias("row"), (F.col("col") + step).alias("col"), "z")), step + a.shape[0], step + a.shape[1]


def test_stencils_work_on_the_data_not_on_their_bounding_box(spark):
    rng = np.random.default_rng(5)
    a = np.where(rng.random((7, 8)) < 0.85, rng.integers(0, 40, (7, 8)).astype(float), np.nan)
    both, h, w = far_apart(spark, a)
    # The patch at the first corner has the grid's border above and before it, nothing behind: a frame of gaps stands there.
    wide = np.pad(a, ((0, 3), (0, 3)), constant_values=np.nan)
    plain = X.dense(cells(spark, a), 10, 11)
    for f, name in (
        (lambda g, h, w: X.slope(g, h, w, 1.0), "tan"), (lambda g, h, w: X.laplacian(g, height=h, width=w), "lap"), (lambda g, h, w: X.box(g, 2), "box_mean"),
        (lambda g, h, w: X.opened(g, 1, height=h, width=w), "open"), (lambda g, h, w: X.hillshade(g, h, w, 1.0), "shade"), (lambda g, h, w: X.gaussian(g, 1.0), "blur"),
    ):
        near = array(f(both, h, w).filter("row between 0 and 6 and col between 0 and 7"), a.shape, name)
        want = array(f(plain.filter("z is not null") if name in ("blur", "box_mean", "open", "lap") else plain, 10, 11).filter("row between 0 and 6 and col between 0 and 7"), a.shape, name)
        assert np.allclose(near, want, equal_nan=True), name
        assert f(both, h, w).filter("row > 1000").count()
    gy, gx = np.gradient(wide)
    got = array(X.slope(both, h, w, 1.0).filter("row between 0 and 6 and col between 0 and 7"), a.shape, "tan")
    assert np.allclose(got, np.hypot(gx, gy)[:7, :8], equal_nan=True)
    moving = X.lag_sums(both, [(0, 1, 1), (2, 0, 2)]).collect()
    for lag, gap in ((1, a[:, 1:] - a[:, :-1]), (2, a[2:] - a[:-2])):
        r = next(r for r in moving if r["lag"] == lag)
        assert r["pairs"] == 2 * np.isfinite(gap).sum() and r["total"] == pytest.approx(2 * np.nansum(gap**2))
    mid = array(X.median_filter(cells(spark, a), 1), a.shape, "median")
    p = np.pad(a, 1, constant_values=np.nan)
    med = np.nanmedian(np.stack([p[1 + r : 8 + r, 1 + c : 9 + c] for r in (-1, 0, 1) for c in (-1, 0, 1)]), 0)
    assert np.allclose(mid, np.where(np.isfinite(a), med, np.nan), equal_nan=True)


def test_size_of_the_raster_comes_without_a_shuffle(spark, monkeypatch):
    """The raster is planned once: its last row and column are found in the points, and are the raster's own."""
    from strataframe.plans import binding, raster_queries

    made = []
    monkeypatch.setattr(raster_queries, "raster", lambda p, size=20: made.append(p) or binding.raster(p, size))
    r, h, w = raster_queries.surface(spark, "/root/testdata/sf0.001")
    assert (h, w) == tuple(v + 1 for v in r.agg(F.max("row"), F.max("col")).first())
    assert "hashpartitioning" not in binding.last_cell(made[0])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("side", [4, 9, 1024])
def test_counted_distances_are_those_of_near(spark, side):
    rng = np.random.default_rng(7)
    held = cells(spark, np.where(rng.random((30, 23)) < 0.01, 1.0, np.nan))
    want = sorted(map(tuple, X.near(held, 5, 28, 23).groupBy("d2").count().collect()))
    assert sorted(map(tuple, X.near_counts(held, 5, 28, 23, side).collect())) == want


def test_openness_is_stretched_without_a_task_that_holds_all(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["haloed_openness"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
