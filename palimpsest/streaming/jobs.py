"""Structured Streaming jobs over the activity stream and the claim stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

WATERMARK = "10 minutes"


def activity_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events files as a stream."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a glob: a table may be one file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("method"), "value")


def hourly(events: DataFrame) -> DataFrame:
    counted = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))
    return counted.select(F.col("window.start").alias("hour"), "events", "users")


def presence(events: DataFrame) -> DataFrame:
    counted = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "5 minutes", "1 minute")).agg(F.approx_count_distinct("user_id").alias("users"))
    return counted.select(F.col("window.start").alias("start"), "users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The session's duration is last - first; the window's end is the last touch plus the gap."""
    counted = events.withWatermark("ts", WATERMARK).groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))
    return counted.select("user_id", "first_ts", "last_ts", "n_events")


def telemetry(events: DataFrame) -> DataFrame:
    return events.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("value") <= 10).alias("le_10"))


def drained(spark: SparkSession, stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    """The result of a stream run over all that is there now.

    Complete mode replaces the result in each batch: the last batch's table is the answer. Session windows
    and windows still open at the end are part of it, as nothing is dropped.
    """
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result")

    stream.writeStream.outputMode("complete" if complete else "append").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def ingested(spark: SparkSession, claims: DataFrame) -> DataFrame:
    """A snapshot table after the claims were delivered twice: each batch writes the next snapshot (copy on write), by upsert on id."""
    at = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    for _ in range(2):
        claims.write.mode("append").parquet(f"{at}/in")
    schema = claims.schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("id").agg(F.max("ts").alias("new_ts"))
        if batch_id:
            old = spark.read.schema(schema).parquet(f"{at}/snapshot-{batch_id - 1}")
            new = old.join(new, "id", "full").select("id", F.greatest("ts", "new_ts").alias("ts"))
        else:
            new = new.withColumnRenamed("new_ts", "ts")
        new.write.mode("overwrite").parquet(f"{at}/snapshot-{batch_id}")  # the same batch again writes the same snapshot

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress.batchId if hasattr(q.lastProgress, "batchId") else q.lastProgress["batchId"]
    return spark.read.schema(schema).parquet(f"{at}/snapshot-{last}")


def throttled_stream(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Touches at least so many seconds after the user's last recorded one, with keyed state."""
    import pandas as pd

    def step(key, batches, state):
        last = state.get[0] if state.exists else None
        kept = []
        for ts in sorted(t for b in batches for t in b["ts"]):
            if last is None or (ts - last).total_seconds() >= seconds:
                last = ts
                kept.append(ts)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(kept), "ts": kept})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp", "last timestamp", "append", "NoTimeout")
