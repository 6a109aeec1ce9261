"""The request log and workflow effects as streams: the batch operators' counterparts with watermarks and keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive; timestamps without a zone are taken as UTC."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_totals(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", keys: list[str] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by window; state of a window goes when the watermark passes its end."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, pause: str = "30 minutes", late: str = "10 minutes", owner: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", pause), owner).agg(F.count(F.lit(1)).alias("n"))


def first_effects(events: DataFrame, key: Column, late: str = "1 day") -> DataFrame:
    """Effects of which no other with their key came within the watermark: each takes place once."""
    return events.withColumn("effect_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["effect_key"])


def late_scores(traces: DataFrame, scores: DataFrame, late: str = "1 hour") -> DataFrame:
    """Traces with the scores that reach them up to an hour later (request_id, ts; request_id, scored_at, score)."""
    a = traces.withWatermark("ts", late).alias("a")
    b = scores.withWatermark("scored_at", late).withColumnRenamed("request_id", "scored_id")
    return a.join(b, F.expr("request_id = scored_id and scored_at >= ts and scored_at <= ts + interval 1 hour"), "left_outer").drop("scored_id")


def run_into(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Takes in all that has arrived and ends."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
