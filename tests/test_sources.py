import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.model import Grid
from strataframe.plans.batch import Manifest, expand_inputs, run_batch
from strataframe.sources import las, rasters


def sample(n=10):
    i = np.arange(n)
    return dict(x=100 + i * 0.5, y=200 + i * 0.25, z=5 + i * 0.125, cls=i % 3, psid=i % 2 + 1, ret=i % 2 + 1, nret=np.full(n, 2), intensity=i * 10, gps=i * 1.5)


@pytest.mark.parametrize("version", [2, 4])
def test_las_round_trip(spark, tmp_path, version):
    path = str(tmp_path / "a.las")
    s = sample()
    las.write(path, **s, version=version, wkt="LOCAL_CS[]" if version == 4 else None)
    las.register(spark)
    got = spark.read.format("las").option("records", "4").load(path).orderBy("x").collect()
    assert len(got) == 10
    for k in ("x", "y", "z", "gps"):
        assert np.allclose([r[k] for r in got], s[k])
    for k in ("cls", "psid", "ret", "nret", "intensity"):
        assert [r[k] for r in got] == list(s[k])
    m = las.metadata(path)
    assert m["points"] == 10 and m["version"] == f"1.{version}" and m["returns_per_pulse"] == 2.0 and m["wkt"] == ("LOCAL_CS[]" if version == 4 else None)


def test_las_filters_and_errors(spark, tmp_path):
    a, b, empty = (str(tmp_path / f"{n}.las") for n in "abc")
    s = sample()
    las.write(a, **s)
    las.write(b, **{**s, "x": s["x"] + 1000})
    las.write(empty, [], [], [])
    las.register(spark)
    df = spark.read.format("las").load(f"{a},{b}")
    assert df.filter("x > 500").count() == 10 and df.filter("x >= 104.5 and cls = 0").count() == 5
    with pytest.raises(Exception, match="no points"):
        spark.read.format("las").load(empty).count()


def test_malformed_flag_needs_leave(tmp_path):
    path = str(tmp_path / "bad.las")
    las.write(path, **sample(), version=4, wkt="X", flag=False)
    with pytest.raises(ValueError, match="WKT flag"):
        las.metadata(path)
    m = las.metadata(path, nosrs=True)
    assert m["fell_back"] and m["wkt"] is None


def test_geotiff_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.tif")
    a = np.random.default_rng(0).random((130, 70)).astype(np.float32) + 1
    a[5, 6] = 0
    g = Grid(1000.0, 2000.0, 0.5, 70, 130, 0.499988)
    rasters.write_geotiff(path, g, a, 0.0)
    back, b, nodata = rasters.read_geotiff(path)
    assert back == g and np.array_equal(a, b) and nodata == 0.0
    got, c = rasters.cells_from(spark, path, (-9999.0,))
    assert c.count() == 130 * 70 - 1
    rasters.to_geotiff(c, g, path)
    assert np.array_equal(rasters.read_geotiff(path)[1], a)
    rgb = np.random.default_rng(1).integers(0, 255, (20, 30, 3)).astype(np.uint8)
    rasters.write_geotiff(path, Grid(0.0, 5.0, 1.0, 30, 20), rgb)
    assert np.array_equal(rasters.read_geotiff(path)[1], rgb)
    with pytest.raises(ValueError):
        rasters.write_geotiff(path, Grid(0, 0, 1, 30, 20), rgb)


def test_geojson(spark, tmp_path):
    from strataframe.operators.regions import outlines

    c = spark.createDataFrame([(r, k) for r in range(2, 5) for k in range(1, 3)], "row long, col long")
    path = str(tmp_path / "f.geojson")
    rasters.to_geojson(outlines(c), Grid(100.0, 50.0, 2.0, 10, 10), path)
    f = json.load(open(path))["features"]
    assert len(f) == 1 and f[0]["properties"]["area_m2"] == 24.0 and f[0]["geometry"]["coordinates"][0][0] == f[0]["geometry"]["coordinates"][0][-1]


def test_manifest_goes_on_where_it_stopped(tmp_path):
    out = tmp_path / "out.txt"
    seen = []

    def work(t):
        seen.append(t)
        if t == "bad":
            raise RuntimeError("broken tile")
        out.write_text("x")
        return {"output": str(out)}

    m = Manifest(str(tmp_path / "m.json"))
    run_batch({"small": 1, "large": 9, "bad": 5}, work, m)
    assert seen == ["large", "bad", "small"]
    again = Manifest(str(tmp_path / "m.json"))
    assert again.records["bad"]["error"] == "RuntimeError: broken tile" and again.todo(["small", "large", "bad"]) == ["bad"]
    out.unlink()
    assert again.todo(["small"]) == ["small"]


def test_inputs_expand_once(tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("d/a.las", "d/b.las", "c.las"):
        (tmp_path / n).write_text("")
    got = expand_inputs([str(tmp_path / "d"), str(tmp_path / "*.las"), str(tmp_path / "c.las"), str(tmp_path / "none.las")])
    assert [g.rsplit("/", 1)[1] for g in got] == ["a.las", "b.las", "c.las"]


def test_tiles_arrive_once(spark, tmp_path):
    from strataframe import streaming

    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    tile = lambda n: spark.range(n).select((F.col("id") * 7).alias("xi"), (F.col("id") * 3).alias("yi"), F.col("id").alias("zi"))
    tile(50).write.parquet(src)
    run = lambda: streaming.run_available(streaming.occupancy(streaming.arriving(spark, src, tile(1).schema)), out, chk)
    run()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 50
    tile(20).write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 70


def test_names_pairs_and_roots(spark, tmp_path):
    from strataframe.sources import files

    paths = ["/a/Ridge_North_GLAS_Apr2013_l1s201.las", "/a/Ridge_North_GLAS_Apr2013_l1s202.las", "/a/odd.txt"]
    refs = ["/r/Ridge_North_GLAS_Apr2013_l1s201_DTM.tif", "/r/Ridge_North_GLAS_Apr2013_l1s201_b.tif", "/r/Ridge_North_GLAS_Apr2013_l1s202_DTM.tif"]
    frame = lambda p: files.archive(spark.createDataFrame([(x,) for x in p], "path string"))
    got = {r["path"]: (r["region"], r["sensor"], r["campaign"], r["tile"]) for r in frame(paths).collect()}
    assert got[paths[0]] == ("Ridge_North", "GLAS", "Apr2013", "l1s201") and got[paths[2]] == ("", "", "", "")
    pairs, failed = files.paired(frame(paths[:2]), frame(refs), ["region", "sensor", "tile"])
    assert [r["reference"] for r in pairs.collect()] == [refs[2]] and [r["reason"] for r in failed.collect()] == ["ambiguous"]
    with pytest.raises(Exception, match="unknown region"):
        files.archive(spark.createDataFrame([(paths[0],)], "path string"), known=["Other"]).count()
    r = files.Roots({"data": "/a/b", "deep": "/a/b/c"})
    assert r.shorten("/a/b/c/d") == "{deep}/d" and r.expand("{data}/x") == "/a/b/x" and r.shorten("/q") == "/q"
    pts = spark.createDataFrame([(1.0, 2.0, "n")], "x double, y double, name string")
    files.points_geojson(pts, str(tmp_path / "p.json"))
    assert json.load(open(tmp_path / "p.json"))["features"][0]["properties"] == {"name": "n"}
    files.points_csv(pts, str(tmp_path / "csv"))
    files.sidecar(str(tmp_path / "s.json"), '{"a": 1}', {"cells": 3})
    assert json.load(open(tmp_path / "s.json")) == {"a": 1, "run": {"cells": 3}}
    tell = files.progress_lines(str(tmp_path / "l.jsonl"))
    tell("a", "b", 0.5)
    assert json.loads(open(tmp_path / "l.jsonl").read())["fraction"] == 0.5


def test_frames_protect_their_sides(spark):
    from strataframe.operators.finish import finalise, footprint, protected_sides, strip_axis

    rng = np.random.default_rng(0)
    xy = [(float(a), float(b)) for a, b in zip(rng.uniform(0, 200, 30000), rng.uniform(0, 200, 30000), strict=True)]
    p = spark.createDataFrame(xy, "x double, y double")
    whole, inner = Grid(0.0, 200.0, 2.0, 100, 100), Grid(40.0, 160.0, 2.0, 60, 60)
    assert not any(protected_sides(p, whole).values()) and all(protected_sides(p, inner).values())
    west = Grid(40.0, 200.0, 2.0, 80, 100)
    assert protected_sides(p, west) == {"north": False, "south": False, "west": True, "east": False}
    span = lambda g: footprint(p, g, 2.0, 10).agg(F.min("col"), F.max("col")).first()
    assert tuple(span(whole)) == (10, 89) and tuple(span(inner)) == (0, 59) and tuple(span(west)) == (0, 69)
    cells = spark.createDataFrame([(r, c, 130.0) for r in range(50) for c in range(50) if not (20 <= r < 25 and 20 <= c < 25)], "row long, col long, z double")
    g = Grid(0.0, 50.0, 1.0, 50, 50)
    assert finalise(cells, g).count() == 2500 and finalise(cells, g, erode=1).count() == 2500 and finalise(cells, g, strip=5).count() == 2000
    with pytest.raises(ValueError):
        finalise(cells, g, strip=1, erode=1)
    assert strip_axis("A_GLAS_b", 9, 1) == "x" and strip_axis("A_NFI_b", 1, 9) == "y" and strip_axis("x", 5, 3) == "y"


def test_arrays_and_layers(spark, tmp_path):
    """NumPy files element by element; point layers read back byte by byte."""
    import sqlite3
    import struct

    import numpy as np

    from strataframe.sources.arrays import read_arrays
    from strataframe.sources.layers import to_geopackage, to_shapefile

    (tmp_path / "in").mkdir()
    a, b = np.arange(12.0).reshape(3, 4), np.array([7, -1], np.int16)
    np.save(tmp_path / "in" / "a.npy", a)
    np.savez(tmp_path / "in" / "z.npz", b=b, a=a)
    rows = read_arrays(spark, f"{tmp_path}/in", batch=5).collect()
    assert len(rows) == 12 + 14 and all(r["value"] == (b if r["name"] == "b" else a)[tuple(r["at"])] for r in rows)

    points = spark.createDataFrame([(1.5, -2.0, 7, "é x", None), (3.0, 4.0, -1, None, 0.25)], "x double, y double, n long, name string, value double")
    assert to_geopackage(points, str(tmp_path / "p.gpkg"), epsg=32616) == 2
    con = sqlite3.connect(tmp_path / "p.gpkg")
    got = sorted((struct.unpack("<dd", g[13:]), n, t, v) for g, n, t, v in con.execute("SELECT geom, n, name, value FROM points"))
    assert got == [((1.5, -2.0), 7, "é x", None), ((3.0, 4.0), -1, None, 0.25)]
    assert con.execute("SELECT min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents").fetchone() == (1.5, -2.0, 3.0, 4.0, 32616)
    con.close()

    assert to_shapefile(points, str(tmp_path / "p")) == 2
    shp, dbf = (tmp_path / "p.shp").read_bytes(), (tmp_path / "p.dbf").read_bytes()
    assert len(shp) == 100 + 2 * 28 == 2 * struct.unpack(">i", shp[24:28])[0] and {struct.unpack("<dd", shp[k + 12 : k + 28]) for k in (100, 128)} == {(1.5, -2.0), (3.0, 4.0)}
    n, head, size = struct.unpack("<IHH", dbf[4:12])
    assert (n, head) == (2, 33 + 32 * 3) and len(dbf) == head + 2 * size + 1
    assert {dbf[head + k * size + 1 : head + k * size + 21].strip() for k in (0, 1)} == {b"7", b"-1"}
