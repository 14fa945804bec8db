"""The tables as a point cloud: integer decimetres across and centimetres up, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One return for each line item. The ground is smooth with some relief; a third of the returns stand above it.
BIND = """
SELECT l_partkey AS xi, l_suppkey * 10 + l_linenumber AS yi,
  (l_partkey * l_partkey + 100 * l_suppkey * l_suppkey) // 4000 + (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 31) % 50
    + CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) * 100 ELSE 0 END AS zi,
  l_linenumber AS psid, l_returnflag <> 'A' AS ground, CASE l_returnflag WHEN 'N' THEN 2 WHEN 'R' THEN 8 ELSE 1 END AS cls,
  1 + l_orderkey % (1 + l_linenumber % 4) AS ret, 1 + l_linenumber % 4 AS nret, CAST(round(l_discount * 100) AS BIGINT) - 5 AS angle,
  CAST(epoch(l_shipdate) AS BIGINT) AS gps
FROM lineitem"""
SPARK_BIND = BIND.replace("//", "DIV").replace("CAST(epoch(l_shipdate) AS BIGINT)", "unix_seconds(l_shipdate)")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``xi, yi, zi, psid, ground, cls, ret, nret, angle, gps``; only the columns that a query uses are read."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = items.schema["l_shipdate"].dataType.simpleString()
    if kind == "timestamp_ntz":
        items = items.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    body = SPARK_BIND.replace("FROM lineitem", "").strip().removeprefix("SELECT")
    return items.selectExpr(*_columns(body))


def _columns(body: str) -> list[str]:
    """The select list split at its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[at:i].strip())
            at = i + 1
    return [*out, body[at:].strip()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


P = f"WITH p AS ({BIND})"
#: Cells of 2 m with the whole centimetre below their mean height: the raster that the stencil queries work on.
R = P + ", r AS (SELECT yi // 20 AS row, xi // 20 AS col, CAST(sum(zi) AS BIGINT) // count(*) AS z, count(*) AS n FROM p GROUP BY 1, 2)"
#: The same from ground returns alone.
G = R + ", g AS (SELECT yi // 20 AS row, xi // 20 AS col, CAST(sum(zi) AS BIGINT) // count(*) AS z FROM p WHERE ground GROUP BY 1, 2)"


def raster(points: DataFrame, size: int = 20) -> DataFrame:
    """``row, col, z, n``: cells of ``size`` decimetres."""
    return points.groupBy(F.expr(f"yi div {size}").alias("row"), F.expr(f"xi div {size}").alias("col")).agg(F.expr("sum(zi) div count(1)").alias("z"), F.count(F.lit(1)).alias("n"))


def last_cell(points: DataFrame, size: int = 20) -> DataFrame:
    """The last row and column of ``raster``: a single row that is found without making the raster."""
    return points.agg(F.max(F.expr(f"yi div {size}")), F.max(F.expr(f"xi div {size}")))
