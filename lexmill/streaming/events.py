"""Structured Streaming: windowed counts with late data, and the latest row of each key kept by micro-batch upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n and total: events by window; rows later than the watermark are left out of closed windows."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once, remembered only as long as rows may come late."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_latest(events: DataFrame, path: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    """Keeps the latest row of each key as versions in a folder: every batch reads the version before it and writes the next.

    A batch that is run again after a failure writes the same version again.
    """
    spark = events.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        rest = [c for c in rows.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/version={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
