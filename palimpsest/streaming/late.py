"""Rows that come late: append-mode jobs whose state expires, and a side table of what came after its window was closed.

A delivery is what arrives between two runs of a job. Before each delivery the watermark is the latest time of all
earlier ones less the delay (in milliseconds), and a window is closed once its end is not after the watermark. Closed windows are
written once and leave the state; rows that speak only of closed windows are counted nowhere, but ``late_rows`` keeps them.
Rows without a time belong to no window and are neither counted nor late.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

DELAY = "1 day"


def hourly(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events of each closed hour."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("hour"), "events")


def presence(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Distinct users of each closed sliding window of five minutes: exact, as a user counts once in a window, and both states expire."""
    seen = events.withWatermark("ts", delay).select("user_id", F.window("ts", "5 minutes", "1 minute").alias("window")).dropDuplicates(["user_id", "window"])
    return seen.groupBy("window").agg(F.count("user_id").alias("users")).select(F.col("window.start").alias("start"), "users")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Closed sessions. A row that comes after its user's session was closed, but isn't late itself, begins another one."""
    counted = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))
    return counted.select("user_id", "first_ts", "last_ts", "n_events")


def delivered(spark: SparkSession, deliveries: Iterable[DataFrame], job: Callable[[DataFrame], DataFrame], name: str, progress: list | None = None) -> DataFrame:
    """What a job over a stream of files writes in append mode when it is started anew for each delivery.

    State and offsets go on from the checkpoint; a batch that is run again overwrites its own folder only. ``progress`` gathers
    the progress of all batches.
    """
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = None

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result/batch_{number}")

    for rows in deliveries:
        rows.write.mode("append").parquet(f"{at}/in")
        out = job(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
        schema = out.schema
        run = out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        if progress is not None:
            progress.extend(run.recentProgress)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/result")


def _marks(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("batch long, latest timestamp").option("recursiveFileLookup", "true").parquet(f"{at}/marks")


def late_rows(spark: SparkSession, deliveries: Iterable[DataFrame], end: Callable[[Column], Column], name: str, delay: str = DELAY) -> DataFrame:
    """The side table: rows of each delivery whose last window (it ends at ``end(ts)``) was closed before, with the watermark then.

    A batch writes its late rows and then its own latest time. A batch that is run again looks at the marks of earlier
    batches only, so it writes the same.
    """
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([(-1, None)], "batch long, latest timestamp").coalesce(1).write.parquet(f"{at}/marks/batch_-1")
    schema = None

    def keep(batch: DataFrame, number: int) -> None:
        latest = _marks(batch.sparkSession, at).filter(F.col("batch") < number).agg(F.max("latest")).first()[0]
        mark = F.date_trunc("millisecond", F.lit(latest).cast("timestamp")) - F.expr(f"interval {delay}")
        batch.withColumn("watermark", mark).filter(end(F.col("ts")) <= F.col("watermark")).write.mode("overwrite").parquet(f"{at}/late/batch_{number}")
        batch.agg(F.lit(number).cast("long").alias("batch"), F.max("ts").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{at}/marks/batch_{number}")

    for rows in deliveries:
        rows.write.mode("append").parquet(f"{at}/in")
        schema = rows.withColumn("watermark", F.lit(None).cast("timestamp")).schema
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/late")


def once(rows: DataFrame, key: str = "id", delay: str = DELAY) -> DataFrame:
    """Rows of a stream by their time of arrival ``arrived``: those of a key that came within ``delay`` before are dropped, and the key leaves the state after it.

    The watermark goes by arrival, so that no row is late, however old its own time is. Rows without a key count as one key.
    """
    return rows.withWatermark("arrived", delay).dropDuplicatesWithinWatermark([key])


def redelivered(spark: SparkSession, deliveries: Iterable[DataFrame], name: str, key: str = "id", delay: str = DELAY, progress: list | None = None) -> DataFrame:
    """The table after deliveries that hold rows again: each key is inserted once, as it first came.

    Keys within ``delay`` are dropped by the stream's state; those that come again after it meet the stored keys, so a batch reads
    the keys of earlier batches (that column only). A batch that is run again looks at earlier batches only and writes the same.
    """
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = None
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{at}/in")
        schema = rows.schema

        def keep(batch: DataFrame, number: int, schema=schema) -> None:
            session = batch.sparkSession
            before = session.read.schema(schema).parquet(*(f"{at}/result/batch_{i}" for i in range(number))).select(key) if number else session.createDataFrame([], schema).select(key)
            known = batch[key].eqNullSafe(before[key])
            batch.join(before, known, "left_anti").write.mode("overwrite").parquet(f"{at}/result/batch_{number}")

        run = once(spark.readStream.schema(schema).parquet(f"{at}/in"), key, delay).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        if progress is not None:
            progress.extend(run.recentProgress)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/result")


def bucket_counts(events: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """(label, n, total, le_0, le_1, ...): the counters of a stream, to be written in update mode. The state is a row for each label."""
    return events.groupBy(label).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *(F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)))


def telemetry(spark: SparkSession, deliveries: Iterable[DataFrame], label: str, value: str, bounds: list[float], name: str = "telemetry") -> DataFrame:
    """Cumulative latency buckets (label, le, count, n, total) of log lines that are streamed in deliveries.

    The stream gives the labels that a batch changed; they replace their rows in the next version of the table (copy on write, a row
    for each label), and a version is a folder of its batch, so the one before stays whole if a batch fails.
    """
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema, last = None, -1

    def keep(batch: DataFrame, number: int) -> None:
        nonlocal last
        changed = batch
        if number:
            stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{at}/version_{number - 1}")
            same = stored[label].eqNullSafe(batch[label])
            changed = stored.join(batch, same, "left_anti").unionByName(batch)
        changed.write.mode("overwrite").parquet(f"{at}/version_{number}")
        last = number

    for rows in deliveries:
        rows.write.mode("append").parquet(f"{at}/in")
        out = bucket_counts(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), label, value, bounds)
        schema = out.schema
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    buckets = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("count")) for i, b in enumerate(bounds)))
    return spark.read.schema(schema).parquet(f"{at}/version_{last}").select(label, "n", "total", F.explode(buckets).alias("b")).select(label, "b.le", "b.count", "n", "total")
