"""Rasters in files: a small GeoTIFF reader and writer (one band or three, strips, deflate) and outlines as GeoJSON."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Grid

#: TIFF tags and the types used here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
SCALE, TIE, NODATA = 33550, 33922, 42113
CODE = {2: "c", 3: "H", 4: "I", 12: "d"}


def write_geotiff(path: str, grid: Grid, bands: np.ndarray, nodata: float | None = None, rows: int = 64) -> None:
    """``bands``: height x width, or height x width x 3; float32 or uint8. Strips are deflated one by one."""
    if (grid.origin_x, grid.origin_y, grid.cell) == (0, 0, 1):
        raise ValueError("the grid has an identity transform")
    a = np.ascontiguousarray(bands)
    if a.dtype not in (np.float32, np.uint8):
        a = a.astype(np.float32)
    n = 1 if a.ndim == 2 else a.shape[2]
    parts = [zlib.compress(a[i : i + rows].astype(a.dtype.newbyteorder("<")).tobytes(), 6) for i in range(0, a.shape[0], rows)]
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p) + len(p) % 2
    bits = a.dtype.itemsize * 8
    tags = {
        WIDTH: (4, [a.shape[1]]), HEIGHT: (4, [a.shape[0]]), BITS: (3, [bits] * n), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [2 if n == 3 else 1]), STRIPS: (4, offsets),
        SAMPLES: (3, [n]), ROWS: (4, [rows]), COUNTS: (4, [len(p) for p in parts]), PLANAR: (3, [1]), FORMAT: (3, [3 if a.dtype == np.float32 else 1] * n),
        SCALE: (12, [grid.cell, grid.dy, 0.0]), TIE: (12, [0.0, 0.0, 0.0, grid.origin_x, grid.origin_y, 0.0]),
    }
    if nodata is not None:
        tags[NODATA] = (2, [c.encode() for c in f"{nodata:g}\0"])
    extra, entries, base = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = b"".join(struct.pack("<" + CODE[kind], v) for v in values)
        if len(raw) > 4:
            place = struct.pack("<I", base + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHI", b"II", 42, at))
        for p in parts:
            f.write(p + b"\0" * (len(p) % 2))
        f.write(struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra)


def read_geotiff(path: str) -> tuple[Grid, np.ndarray, float | None]:
    """(grid, bands, nodata) of files as written here, and of plain strips without predictor."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    at = struct.unpack_from("<I", raw, 4)[0]
    tags = {}
    for i in range(struct.unpack_from("<H", raw, at)[0]):
        tag, kind, count = struct.unpack_from("<HHI", raw, at + 2 + 12 * i)
        size = struct.calcsize(CODE.get(kind, "I")) * count
        place = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from("<I", raw, at + 2 + 12 * i + 8)[0]
        if kind in CODE:
            tags[tag] = struct.unpack_from(f"<{count}{CODE[kind]}", raw, place)
    if tags[COMPRESSION][0] not in (1, 8, 32946) or tags.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("only plain and deflated strips are supported")
    n = tags.get(SAMPLES, (1,))[0]
    kind = {(32, 3): "<f4", (64, 3): "<f8", (8, 1): "u1", (16, 1): "<u2", (16, 2): "<i2", (32, 1): "<u4", (32, 2): "<i4"}[tags[BITS][0], tags.get(FORMAT, (1,))[0]]
    strips = (raw[o : o + c] for o, c in zip(tags[STRIPS], tags[COUNTS], strict=True))
    body = b"".join(zlib.decompress(s) if tags[COMPRESSION][0] != 1 else s for s in strips)
    a = np.frombuffer(body, kind).reshape(tags[HEIGHT][0], tags[WIDTH][0], n)
    sx, sy, _ = tags.get(SCALE, (1.0, 1.0, 0.0))
    tie = tags.get(TIE, (0.0,) * 6)
    text = b"".join(tags.get(NODATA, ())).rstrip(b"\0")
    return Grid(tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, tags[WIDTH][0], tags[HEIGHT][0], None if sx == sy else sy), a[:, :, 0] if n == 1 else a, float(text) if text else None


def cells_from(spark: SparkSession, path: str, sentinels: tuple[float, ...] = ()) -> tuple[Grid, DataFrame]:
    """(grid, cells ``row, col, z``): cells that hold the file's nodata, one of the sentinels, NaN or more than 1e30 are
    absent. A raster in a single file is bounded by that file."""
    import pandas as pd

    grid, a, nodata = read_geotiff(path)
    z = a.astype(float)
    ok = np.isfinite(z) & (np.abs(z) <= 1e30)
    for s in (*sentinels, *(() if nodata is None else (nodata,))):
        ok &= z != s
    r, c = np.nonzero(ok)
    return grid, spark.createDataFrame(pd.DataFrame({"row": r.astype("int64"), "col": c.astype("int64"), "z": z[ok]}))


def to_geotiff(cells: DataFrame, grid: Grid, path: str, nodata: float = 0.0, z: str = "z") -> None:
    """Cells as one file. The raster is put together on the driver, cell by cell from an iterator, as a single file must be;
    larger rasters belong in Parquet, by block."""
    a = np.full((grid.height, grid.width), nodata, np.float32)
    for row in cells.select("row", "col", F.col(z).cast("float").alias("z")).filter("z is not null").toLocalIterator(prefetchPartitions=True):
        a[row["row"], row["col"]] = row["z"]
    write_geotiff(path, grid, a, nodata)


def to_geojson(outlines: DataFrame, grid: Grid, path: str, kind: str = "active") -> None:
    """Rings in the grid's coordinates, with number, kind and area; one feature for each polygon."""
    features = []
    for i, o in enumerate(outlines.orderBy("label").toLocalIterator()):
        ring = [[grid.origin_x + p["x"] * grid.cell, grid.origin_y + p["y"] * grid.dy] for p in o["ring"]]
        area = o["cells"] * grid.cell * grid.dy
        features.append({"type": "Feature", "properties": {"poly_id": i, "kind": kind, "area_m2": area, "area_ha": area / 1e4}, "geometry": {"type": "Polygon", "coordinates": [ring + ring[:1]]}})
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
