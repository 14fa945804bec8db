"""Arriving tiles, beyond what a batch needs: a file stream with a checkpoint takes the place of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema, files_each: int = 16) -> DataFrame:
    """Point files as a stream; a file is taken once, however often the query is started again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def occupancy(points: DataFrame, size: int = 50) -> DataFrame:
    """Running counts and heights by cell; merged as tiles arrive."""
    return points.groupBy(F.expr(f"xi div {size}").alias("cx"), F.expr(f"yi div {size}").alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.min("zi").alias("z_min"), F.sum("zi").alias("z_sum"))


def windowed(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what there is, then stop; the next start goes on from the checkpoint."""
    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
