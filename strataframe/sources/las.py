"""LAS files as a Spark data source, and a writer. Headers are read by struct offsets, points with NumPy, by ranges of records.

Compressed files (LAZ) need a codec that is not part of this engine and are refused. Public LAS 1.2-1.4 layouts; point
formats 0-3 and 6-8, of which the common fields are read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "x double, y double, z double, xi long, yi long, zi long, intensity int, ret int, nret int, cls int, angle double, psid int, gps double"
#: Offsets in a record by format: classification, scan angle, point source, GPS time, shortest record.
OLD, NEW = {0: None, 1: 20, 2: None, 3: 20}, {6: 22, 7: 22, 8: 22}
RECORD = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36, 8: 38}


@dataclass(frozen=True)
class Header:
    version: str
    point_format: int
    record: int
    points: int
    offset: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    by_return: tuple[int, ...]
    wkt_flag: bool
    wkt: str | None


def read_header(raw: bytes) -> Header:
    """A header from the first bytes of a file (with its records before the points, for the coordinate system)."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    encoding, minor, size = struct.unpack_from("<H", raw, 6)[0], raw[25], struct.unpack_from("<H", raw, 94)[0]
    offset, records = struct.unpack_from("<II", raw, 96)
    kind, record, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed points (LAZ) are not supported")
    returns = struct.unpack_from("<5I", raw, 111)
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    hx, lx, hy, ly, hz, lz = struct.unpack_from("<6d", raw, 179)
    if minor >= 4 and size >= 375:
        count = struct.unpack_from("<Q", raw, 247)[0]
        returns = struct.unpack_from("<15Q", raw, 255)
    wkt, at = None, size
    for _ in range(records):
        if at + 54 > len(raw):
            break
        number, length = struct.unpack_from("<HH", raw, at + 18)
        if number == 2112:
            wkt = raw[at + 54 : at + 54 + length].split(b"\0")[0].decode("utf-8", "replace")
        at += 54 + length
    return Header(f"1.{minor}", kind, record, count, offset, scale, shift, (lx, ly, lz), (hx, hy, hz), returns, bool(encoding & 16), wkt)


def head(path: str) -> Header:
    with open(path, "rb") as f:
        raw = f.read(4096)
        first = read_header(raw)
        return read_header(raw + f.read(first.offset - 4096)) if first.offset > 4096 else first


def metadata(path: str, nosrs: bool = False) -> dict:
    """What the header alone says. A version 1.4 file of a new point format must set the WKT flag; one that doesn't is an error
    unless ``nosrs`` says to do without the coordinate system."""
    h = head(path)
    malformed = h.point_format >= 6 and not h.wkt_flag
    if malformed and not nosrs:
        raise ValueError("Global encoding WKT flag not set")
    area = (h.high[0] - h.low[0]) * (h.high[1] - h.low[1])
    n = sum(h.by_return)
    return {
        "path": path, "version": h.version, "point_format": h.point_format, "points": h.points, "min_x": h.low[0], "min_y": h.low[1], "min_z": h.low[2],
        "max_x": h.high[0], "max_y": h.high[1], "max_z": h.high[2], "area": area, "density": h.points / area if area else 0.0,
        "returns_per_pulse": n / h.by_return[0] if h.by_return[0] else 0.0, "multi_return": 1 - h.by_return[0] / n if n else 0.0,
        "wkt": None if malformed else h.wkt, "fell_back": malformed, "by_return": list(h.by_return),
    }


def points(h: Header, raw: bytes) -> dict[str, np.ndarray]:
    """The fields of whole records."""
    if h.point_format not in RECORD:
        raise ValueError(f"point format {h.point_format} is not supported")
    a = np.frombuffer(raw, np.uint8).reshape(-1, h.record)
    field = lambda at, kind: np.ascontiguousarray(a[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    out = {f"{c}i": field(4 * i, "<i4").astype(np.int64) for i, c in enumerate("xyz")}
    out |= {c: out[f"{c}i"] * h.scale[i] + h.shift[i] for i, c in enumerate("xyz")}
    out["intensity"] = field(12, "<u2").astype(np.int32)
    if h.point_format >= 6:
        out["ret"], out["nret"] = (a[:, 14] & 15).astype(np.int32), (a[:, 14] >> 4).astype(np.int32)
        out["cls"], out["angle"], out["psid"] = a[:, 16].astype(np.int32), field(18, "<i2") * 0.006, field(20, "<u2").astype(np.int32)
        time = NEW[h.point_format]
    else:
        out["ret"], out["nret"] = (a[:, 14] & 7).astype(np.int32), ((a[:, 14] >> 3) & 7).astype(np.int32)
        out["cls"], out["angle"], out["psid"] = (a[:, 15] & 31).astype(np.int32), a[:, 16].view(np.int8).astype(float), field(18, "<u2").astype(np.int32)
        time = OLD[h.point_format]
    out["gps"] = field(time, "<f8") if time else np.full(len(a), np.nan)
    return out


def write(path: str, x, y, z, cls=None, psid=None, ret=None, nret=None, intensity=None, gps=None, scale: float = 0.001, shift=(0.0, 0.0, 0.0), version: int = 2, wkt: str | None = None, flag: bool = True) -> None:
    """A LAS 1.2 file of format 1, or with ``version=4`` a LAS 1.4 file of format 6."""
    x, y, z = (np.asarray(v, float) for v in (x, y, z))
    n, new = len(x), version >= 4
    of = lambda v, d=0: np.full(n, d) if v is None else np.asarray(v)
    ret, nret = of(ret, 1), of(nret, 1)
    kind = 6 if new else 1
    a = np.zeros((n, RECORD[kind]), np.uint8)

    def put(at, v, t):
        a[:, at : at + np.dtype(t).itemsize] = np.ascontiguousarray(np.asarray(v).astype(t)).view(np.uint8).reshape(n, np.dtype(t).itemsize)

    for i, v in enumerate((x, y, z)):
        put(4 * i, np.round((v - shift[i]) / scale), "<i4")
    put(12, of(intensity), "<u2")
    if new:
        a[:, 14], a[:, 16] = ret | (nret << 4), of(cls)
        put(20, of(psid), "<u2")
        put(22, of(gps, 0.0), "<f8")
    else:
        a[:, 14], a[:, 15] = ret | (nret << 3), of(cls)
        put(18, of(psid), "<u2")
        put(20, of(gps, 0.0), "<f8")
    vlr = b""
    if wkt:
        body = wkt.encode() + b"\0"
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(body), b"") + body
    size = 375 if new else 227
    counts = [int((ret == k).sum()) for k in range(1, 16)]
    head_ = bytearray(size)
    head_[:4] = b"LASF"
    struct.pack_into("<H", head_, 6, 16 if new and flag else 0)
    head_[24], head_[25] = 1, 4 if new else 2
    struct.pack_into("<H", head_, 94, size)
    struct.pack_into("<IIBHI", head_, 96, size + len(vlr), 1 if wkt else 0, kind, RECORD[kind], 0 if new else n)
    if not new:
        struct.pack_into("<5I", head_, 111, *counts[:5])
    struct.pack_into("<6d", head_, 131, scale, scale, scale, *shift)
    ends = [f(v) if n else 0.0 for v in (x, y, z) for f in (np.max, np.min)]
    struct.pack_into("<6d", head_, 179, *ends)
    if new:
        struct.pack_into("<Q", head_, 247, n)
        struct.pack_into("<15Q", head_, 255, *counts)
    with open(path, "wb") as f:
        f.write(bytes(head_) + vlr + a.tobytes())


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        self.step = int(options.get("records", 1_000_000))
        self.classes = None
        self.box: dict[tuple[str, str], float] = {}

    def partitions(self):
        out = []
        for p in self.paths:
            h = head(p)
            if not h.points:
                raise ValueError(f"{p} holds no points")
            if any((op == ">" and h.high["xyz".index(c)] <= v) or (op == "<" and h.low["xyz".index(c)] >= v) for (c, op), v in self.box.items()):
                continue
            out += [_Range(p, i, min(self.step, h.points - i)) for i in range(0, h.points, self.step)]
        return out or [_Range("", 0, 0)]

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        """Boxes on x, y and z rule out whole files; all filters are checked again by Spark."""
        for f in filters:
            name, column, value = type(f).__name__, getattr(f, "attribute", ()), getattr(f, "value", None)
            if name in ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual") and column and column[0] in ("x", "y", "z"):
                # A bound that equals the file's own edge still needs the file where equality counts.
                strict = name in ("GreaterThan", "LessThan")
                self.box[column[0], ">" if name.startswith("Greater") else "<"] = value if strict else np.nextafter(value, -np.inf if name.startswith("Greater") else np.inf)
            yield f

    def read(self, part):
        if not part.count:
            return
        h = head(part.path)
        with open(part.path, "rb") as f:
            f.seek(h.offset + part.first * h.record)
            got = points(h, f.read(part.count * h.record))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(got[n]) for n in names], names)


class LasSource(DataSource):
    """``spark.read.format("las").load("a.las,b.las")`` after ``register(spark)``."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    """Make the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)
