"""What the corpus operators share: scratch tables in the cluster's shared folder and row hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import delete, fixed, swept

#: ASCII white space; everything else belongs to a word.
WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def settle(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it cuts lineage, is computed once, and
    outlives lost executors. ``by`` names columns to range-partition the files on."""
    return fixed(df, tag, *by)


def forget(*frames: DataFrame) -> None:
    """Delete settled tables that no later step reads, and the shuffle files of the steps that led to them."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            delete(df.sparkSession, f.rsplit("/", 1)[0])
    if frames:
        swept(frames[0].sparkSession)


def words(text: Column) -> Column:
    """The words of a text, unchanged, as an array; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def one_per_id(df: DataFrame, key: str, *keep: str) -> DataFrame:
    """The rows of ``df`` that have a key, with columns ``keep``, one for each key. Of several rows with one key the
    least by ``keep`` stays. Only the key column is read to find out whether there are any; usually none is moved."""
    own = df.filter(F.col(key).isNotNull()).select(key, *keep)
    twice = own.groupBy(key).count().filter("count > 1").select(key)
    if twice.isEmpty():
        return own
    twice = settle(twice, "twice")
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in keep])
    least = own.join(twice, key, "left_semi").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return own.join(twice, key, "left_anti").unionByName(least)


def successors(ids: DataFrame, key: str) -> DataFrame:
    """``key, next``: for each distinct key the next larger one, after the largest the smallest. The keys are written
    in ranges; a window runs inside each file, and only one row a file meets in a single task."""
    files = settle(ids.select(key).distinct(), "ranges", key).withColumn("_f", F.col("_metadata.file_path"))
    inside = files.withColumn("_n", F.lead(key).over(Window.partitionBy("_f").orderBy(key)))
    firsts = files.groupBy("_f").agg(F.min(key).alias("_first"))
    all_files = Window.orderBy("_first")
    firsts = firsts.select("_f", F.coalesce(F.lead("_first").over(all_files), F.first("_first").over(all_files.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    return inside.join(firsts, "_f").select(key, F.coalesce("_n", "_after").alias("next"))
