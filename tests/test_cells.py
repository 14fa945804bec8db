import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataframe.operators import cells as C
from strataframe.operators import neighbors as J


def test_dedupe_rules(spark):
    p = spark.createDataFrame(list(zip([0, 0, 1, 1, 1, 2], [0] * 6, [10.0, 10.4, 5.0, 5.2, 5.4, 7.0], strict=True)), "x long, y long, z double")
    got = lambda keep, **k: sorted(round(r["z"], 6) for r in C.dedupe_xy(p, "x", "y", "z", keep, **k).collect())
    assert got("lowest") == [5.0, 7.0, 10.0] and got("mean") == [5.2, 7.0, 10.2] and got("highest") == [5.4, 7.0, 10.4]
    assert got("first", order=["z"]) == [5.0, 7.0, 10.0]
    with pytest.raises(ValueError):
        C.dedupe_xy(p, "x", "y", "z", "median")


def test_pairs_about_a_plane_keep_their_mean(spark):
    rng = np.random.default_rng(0)
    x, y = rng.permutation(2000), rng.integers(0, 2000, 2000)
    both = pd.DataFrame({"x": np.r_[x, x], "y": np.r_[y, y], "z": np.r_[np.full(2000, -16.0), np.full(2000, 12.0)]})
    p = spark.createDataFrame(both)
    assert C.dedupe_xy(p, "x", "y", "z").agg(F.avg("z")).first()[0] == pytest.approx(-2.0)
    assert C.dedupe_xy(p, "x", "y", "z", "lowest").agg(F.avg("z")).first()[0] == pytest.approx(-16.0)


def test_plane_by_cell_is_least_squares(spark):
    rng = np.random.default_rng(7)
    f = pd.DataFrame({"xi": rng.integers(0, 100, 400), "yi": rng.integers(0, 100, 400), "zi": rng.integers(0, 500, 400)})
    for r in C.plane_by_cell(spark.createDataFrame(f), 50).collect():
        own = f[(f["xi"] // 50 == r["cx"]) & (f["yi"] // 50 == r["cy"])]
        a = np.c_[np.ones(len(own)), own["xi"] % 50, own["yi"] % 50]
        want, rest, *_ = np.linalg.lstsq(a, own["zi"].to_numpy(float), rcond=None)
        assert np.allclose([r["a"], r["b"], r["c"]], want) and r["sse"] == pytest.approx(rest[0])


def test_heights_above_floor_and_plane(spark):
    rng = np.random.default_rng(1)
    xy = np.unique(rng.integers(0, 60, (500, 2)), axis=0)
    z = (200 + 3 * xy[:, 0]).astype(int)
    z[::10] += 300
    p = spark.createDataFrame(pd.DataFrame({"xi": xy[:, 0], "yi": xy[:, 1], "z": z}))
    up = {(r["xi"], r["yi"]): r["above"] for r in J.heights_above_plane(p, 8).collect()}
    raised = {tuple(v) for v in xy[::10].tolist()}
    assert min(up[k] for k in raised) > 100 and sorted(abs(v) for k, v in up.items() if k not in raised)[int(0.9 * len(up)) - len(raised)] < 60
    floor = {(r["xi"], r["yi"]): (r["z"], r["n"], r["above"]) for r in J.heights_above_floor(p, 8).collect()}
    for i in range(0, len(xy), 37):
        near = z[((xy - xy[i]) ** 2).sum(1) <= 64]
        want = z[i] - np.quantile(near, 0.1) if len(near) >= 3 else 0.0
        assert floor[tuple(xy[i].tolist())] == (z[i], len(near), pytest.approx(want, abs=1e-3))


def test_variogram_fit_finds_the_range(spark):
    lag = np.arange(2.0, 50, 4)
    r = np.minimum(lag / 30.0, 1)
    bins = spark.createDataFrame([(int(i), 100, float(l), float(10 * (1.5 * v - 0.5 * v**3))) for i, (l, v) in enumerate(zip(lag, r, strict=True))], "bin long, pairs long, lag double, semivariance double")
    fit = J.fitted(bins).first()
    assert abs(fit["reach"] - 30) < 3 and fit["nugget"] == 0.0


def test_variogram_of_all_pairs(spark):
    """Bins against every pair of a small lattice with gaps, neighbours at (0, 1) and (1, 0) among them."""
    rng = np.random.default_rng(3)
    xy = np.array([(x, y) for x in range(24) for y in range(24) if rng.random() < 0.8])
    z = rng.integers(0, 500, len(xy))
    i, j = np.triu_indices(len(xy), 1)
    d2 = ((xy[i] - xy[j]) ** 2).sum(1)
    near = d2 <= 100
    bin_, gap = np.minimum(np.floor(np.sqrt(d2[near]) * 12 / 10), 11).astype(int), (z[i] - z[j])[near] ** 2
    p = spark.createDataFrame([(int(x), int(y), int(v)) for (x, y), v in zip(xy, z, strict=True)], "xi long, yi long, z long")
    got = {r["bin"]: (r["pairs"], r["semivariance"]) for r in J.variogram(p, 10).collect()}
    assert got == {int(k): (int((bin_ == k).sum()), pytest.approx(gap[bin_ == k].mean() / 2)) for k in np.unique(bin_) if (bin_ == k).sum() >= 30}


def test_fitting_queries_read_all_places(spark, monkeypatch):
    from strataframe.plans import join_queries

    seen = []
    monkeypatch.setattr(join_queries, "cloud", lambda *_: spark.range(400).selectExpr("id % 20 as xi", "id div 20 as yi", "id * 7 % 13 as zi"))
    monkeypatch.setattr(J, "variogram", lambda points, lag, real=J.variogram: seen.append(points.count()) or real(points, lag))
    assert join_queries.variogram_fit_grid(spark, "").count() == 1 and join_queries.range_stability(spark, "").count() == 3
    assert seen == [400] * 4


def test_haloed_points_reach_every_block_that_needs_them(spark):
    p = spark.createDataFrame([(10, 10), (95, 50), (105, 50)], "xi long, yi long")
    got = {(r["xi"], r["bj"], r["inner"]) for r in J.haloed(p, 100, 10).collect() if r["bi"] == 0}
    assert (95, 0, True) in got and (95, 1, False) in got and (105, 0, False) in got and (105, 1, True) in got


def test_quantiles_by_rank_are_exact(spark, monkeypatch):
    """Over several ranges, with ties, nulls, one value and none; slopes are not gathered in one task."""
    from strataframe.operators.cells import quantiles
    from strataframe.plans import raster_queries

    v = np.round(np.random.default_rng(5).normal(size=2000), 2)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(4)
    assert np.allclose(quantiles(df, "v", [0.0, 0.37, 0.5, 0.95, 1.0]), np.quantile(v, [0.0, 0.37, 0.5, 0.95, 1.0]), atol=1e-12)
    assert quantiles(df.filter("v is null"), "v", [0.5]) == [None]
    assert quantiles(df.filter("v is not null").limit(1), "v", [0.1, 1.0]) == [df.filter("v is not null").limit(1).first()[0]] * 2
    plan = raster_queries.slope_stats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan
