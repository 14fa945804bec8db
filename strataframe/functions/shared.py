"""Tables in the folder that the cluster shares: they cut lineage, are computed once and outlive lost executors."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset a session on this machine alone (tests) gets a folder of its
    own; on a cluster that is an error, as executors don't share a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "/tmp/checkpoints/strataframe"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str = "step") -> str:
    """A fresh path below the shared folder; it goes when the driver's process ends."""
    path = f"{root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def fixed(df: DataFrame, tag: str = "step", *by: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there, with a lineage and statistics of its own.
    ``by`` names columns to range-partition the files on."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    (df.repartitionByRange(*by) if by else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def swept(spark: SparkSession) -> None:
    """Have the driver's JVM look for what nothing refers to any more: Spark then deletes the shuffle files of steps whose
    results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may already be gone at interpreter exit
            return
