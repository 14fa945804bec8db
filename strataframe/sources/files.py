"""Names, listings and small sinks: which file is which tile, points as CSV and GeoJSON, a run's account, progress."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A tile's name: region, sensor, campaign (month and year), tile.
NAME = r"^(?:.*/)?(?<region>[A-Za-z_]+?)_(?<sensor>[A-Z]+)_(?<campaign>[A-Z][a-z]{2}\d{4})_(?<tile>l\d+s\d+)(?:_\w+)?\.\w+$"


def parsed(path: Column, pattern: str = NAME) -> dict[str, Column]:
    """The fields of a file name; empty where it does not fit."""
    return {k: F.regexp_extract(path, pattern, i + 1) for i, k in enumerate(("region", "sensor", "campaign", "tile"))}


def archive(listing: DataFrame, path: str = "path", known: list[str] | None = None) -> DataFrame:
    """``listing`` with the fields of its names. With ``known`` regions another region is an error when the plan runs."""
    out = listing.withColumns(parsed(F.col(path)))
    if known is not None:
        bad = (F.col("region") != "") & ~F.col("region").isin(known)
        out = out.filter(F.coalesce(F.assert_true(~bad, F.concat(F.lit("unknown region "), "region")).isNull(), F.lit(True)))
    return out


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of the files below a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def paired(clouds: DataFrame, references: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs, failures): clouds with their one reference, and those with none or several and why."""
    n = references.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("reference"))
    all_ = clouds.join(n, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    why = F.when(F.col("_n") == 0, "missing").otherwise("ambiguous")
    return all_.filter("_n = 1").drop("_n"), all_.filter("_n <> 1").select(*clouds.columns, why.alias("reason"))


class Roots:
    """Paths written with tokens for their roots, so that records can move; the longest root that fits is used."""

    def __init__(self, roots: dict[str, str]):
        self.roots = {k: v.rstrip("/") for k, v in roots.items()}

    def expand(self, path: str) -> str:
        for token, root in self.roots.items():
            path = path.replace(f"{{{token}}}", root)
        return path

    def shorten(self, path: str) -> str:
        for token, root in sorted(self.roots.items(), key=lambda kv: -len(kv[1])):
            if path == root or path.startswith(root + "/"):
                return f"{{{token}}}{path[len(root):]}"
        return path


def points_geojson(points: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """Points as features, one at a time; all other columns are properties."""
    with open(path, "w") as f:
        f.write('{"type": "FeatureCollection", "features": [\n')
        for i, r in enumerate(points.toLocalIterator()):
            row = r.asDict()
            at = [row.pop(x), row.pop(y)]
            f.write(",\n" * (i > 0) + json.dumps({"type": "Feature", "properties": row, "geometry": {"type": "Point", "coordinates": at}}, default=str))
        f.write("\n]}\n")


def points_csv(points: DataFrame, folder: str) -> None:
    points.write.mode("overwrite").option("header", "true").csv(folder)


def sidecar(path: str, config_json: str, account: dict | None = None) -> None:
    """A run's settings before it, and with its account after it, replaced as a whole."""
    record = json.loads(config_json) | ({"run": account} if account is not None else {})
    part = Path(path).with_suffix(".part")
    part.write_text(json.dumps(record, indent=1, sort_keys=True))
    os.replace(part, path)


def progress_lines(path: str) -> Callable[[str, str, float], None]:
    """A progress callback that appends a JSON line for each event."""

    def tell(stage: str, message: str, fraction: float) -> None:
        with open(path, "a") as f:
            f.write(json.dumps({"stage": stage, "message": message, "fraction": fraction}) + "\n")

    return tell
