"""Streamed ingest through the write gate: turns become claims, claims become decisions, decisions change the beliefs.

A micro-batch writes two tables, the decision ledger and the belief buckets that it changes, each under its batch number, and
then one commit row that lists, for each bucket of tenants, the batch that holds it. Readers go by the last commit only, so
they never see one table without the other. A batch that comes again after a failure, before or between the writes,
starts from the same commit and writes the same rows to the same place. Claims that the ledger has already are not
decided again, so turns that are delivered twice change nothing. No turn is too late: nothing is dropped by a watermark.

A batch's work follows the buckets of the tenants that it speaks of, but for one read of the ledger's ids. ``created_at`` is the latest
time of the batch's turns, so that it doesn't change when the batch is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embed import gram_vector
from ..operators import beliefs as bl
from ..operators.extract import claim_rows, extracted
from ..operators.vectors import nearest
from ..shared import written

BUCKETS = 64
BELIEFS = "user_id string, id string, content string, entity string, attribute string, value string, authority double, ts timestamp, valid_from timestamp, valid_to timestamp, superseded_by string, conflict_with array<string>, pinned boolean, retraction boolean, embedding array<float>"
LEDGER = "user_id string, id string, decision string, nearest_id string, similarity double, reason string, matched_signals array<string>, created_at timestamp"


def bucket(user: str = "user_id") -> Column:
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")


def commits(spark: SparkSession, at: str) -> dict[int, dict[int, int]]:
    """batch -> bucket -> the batch that holds it, of all commits: at most BUCKETS rows of the last two matter."""
    rows = spark.read.schema("batch long, held map<int,long>").option("recursiveFileLookup", "true").parquet(f"{at}/commits").orderBy(F.desc("batch")).limit(2).collect()
    return {r["batch"]: r["held"] for r in rows}


def started(spark: SparkSession, at: str) -> None:
    """The commit before the first batch, unless there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/commits")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([(-1, {})], "batch long, held map<int,long>").coalesce(1).write.parquet(f"{at}/commits/batch_-1")


def _held(spark: SparkSession, at: str, held: dict[int, int]) -> DataFrame:
    paths = [f"{at}/beliefs/batch_{n}/bucket={b}" for b, n in sorted(held.items())]
    return spark.read.schema(BELIEFS).parquet(*paths) if paths else spark.createDataFrame([], BELIEFS)


def beliefs(spark: SparkSession, at: str) -> DataFrame:
    """The beliefs as of the last commit."""
    done = commits(spark, at)
    return _held(spark, at, done[max(done)])


def ledger(spark: SparkSession, at: str, before: int | None = None) -> DataFrame:
    """All decisions of committed batches, with their batch."""
    last = max(commits(spark, at)) if before is None else before - 1
    schema = f"{LEDGER}, batch long"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/ledger") if last >= 0 else spark.createDataFrame([], schema)
    return rows.filter(F.col("batch") <= last)


def feed(decisions: DataFrame, user_id: str | None = None, limit: int = 100) -> DataFrame:
    """The newest decisions, of one tenant or of all, between 1 and 500 of them."""
    rows = decisions if user_id is None else decisions.filter(F.col("user_id") == user_id)
    return rows.orderBy(F.desc("created_at"), F.desc("batch"), "user_id", "id").limit(max(1, min(limit, 500)))


def decided(new: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """LEDGER rows of new claims (BELIEFS' columns) against the beliefs known before the batch."""
    number = F.xxhash64("user_id", "id")
    some = known.filter("valid_to is null and not pinned").withColumn("number", number)
    mine = new.withColumn("number", number)
    hits = nearest(mine.select(F.col("number").alias("id"), "user_id", F.col("embedding").alias("vector")), some.select(F.col("number").alias("id"), "user_id", "embedding"), 1)
    named = hits.join(mine.select(F.col("number").alias("qid"), "id"), "qid").join(some.select(F.col("number").alias("claim_id"), F.col("id").alias("nearest_id"), F.col("content").alias("nearest_content"), F.col("retraction").alias("nearest_is_retraction")), "claim_id")
    asked = new.select("id", "content", F.col("embedding").isNotNull().alias("has_vector"), F.when(F.col("retraction"), F.col("value")).alias("retraction"))
    out = bl.gate(asked, named.select("id", "nearest_id", "similarity", "nearest_content", "nearest_is_retraction"))
    return new.select("user_id", "id").join(out, "id").withColumn("created_at", now).select("user_id", "id", "decision", "nearest_id", "similarity", "reason", "matched_signals", "created_at")


def applied(known: DataFrame, new: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The beliefs after the decisions: touched ones are later, superseded and retracted ones closed, conflicts linked on both sides, all but touching claims added."""
    out = bl.touch_times(bl.close_intervals(known, decisions, now), decisions, new)
    gone = new.filter("retraction").select("user_id", F.col("value").alias("departed"), F.col("id").alias("by_id"))
    gone = bl.retracted(known, gone).select(F.col("id"), F.col("by_id").alias("closer"))
    out = out.join(gone, "id", "left").withColumn("valid_to", F.coalesce("valid_to", F.when(F.col("closer").isNotNull(), now))).withColumn("superseded_by", F.coalesce("superseded_by", "closer")).drop("closer")
    out = out.unionByName(new.join(decisions.filter("decision <> 'touch'").select("id"), "id", "left_semi"))
    links = bl.cross_links(decisions).withColumnRenamed("conflict_with", "more")
    merged = F.array_sort(F.array_distinct(F.concat(F.coalesce("conflict_with", F.array().cast("array<string>")), "more")))
    return out.join(links, "id", "left").withColumn("conflict_with", F.when(F.col("more").isNull(), F.col("conflict_with")).otherwise(merged)).drop("more").select(*(c.split()[0] for c in BELIEFS.split(", ")))


def claims_of(turns: DataFrame, user: Column, embed: Callable[[Column], Column] = gram_vector) -> DataFrame:
    """Claims of turns (conv_id, turn_no, role, text, ts) as new beliefs."""
    rows = claim_rows(extracted(turns), user.cast("string"), first=True)
    none = F.lit(None)
    return rows.select(
        "user_id", "id", "content", "entity", "attribute", "value", F.col("authority").cast("double").alias("authority"), "ts", F.col("ts").alias("valid_from"), none.cast("timestamp").alias("valid_to"), none.cast("string").alias("superseded_by"),
        none.cast("array<string>").alias("conflict_with"), F.lit(False).alias("pinned"), (F.col("triple.category") == "retraction").alias("retraction"), embed(F.col("content")).cast("array<float>").alias("embedding"),
    )


def take_batch(spark: SparkSession, at: str, turns: DataFrame, batch: int, user: Column, embed: Callable[[Column], Column] = gram_vector, stop: Callable[[str], None] = lambda step: None) -> None:
    """Decides one batch of turns and commits it; called again with the same batch it does the same again. ``stop`` is called after each write (tests fail there)."""
    done = commits(spark, at)
    before = done[max(b for b in done if b < batch)]
    fresh = claims_of(turns, user, embed)
    new = written(fresh.join(ledger(spark, at, batch).select("user_id", "id"), ["user_id", "id"], "left_anti").withColumn("bucket", bucket()), "claims")
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most BUCKETS
    new = new.drop("bucket")
    now = F.lit(turns.agg(F.max("ts")).first()[0])
    known = _held(spark, at, {b: n for b, n in before.items() if b in touched})
    decisions = written(decided(new, known, now), "decisions")
    decisions.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{at}/ledger/batch_{batch}")
    stop("ledger")
    applied(known, new, decisions, now).withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/beliefs/batch_{batch}")
    stop("beliefs")
    spark.createDataFrame([(batch, {**before, **{b: batch for b in touched}})], "batch long, held map<int,long>").coalesce(1).write.mode("overwrite").parquet(f"{at}/commits/batch_{batch}")
    stop("commit")


def ingest(spark: SparkSession, turns: DataFrame, at: str, user: Column, embed: Callable[[Column], Column] = gram_vector, stop: Callable[[str], None] = lambda step: None) -> None:
    """Runs a stream of turns (conv_id, turn_no, role, text, ts) through the gate to its present end; called again, it goes on where it stopped."""
    started(spark, at)
    take = lambda batch, number: take_batch(batch.sparkSession, at, batch, number, user, embed, stop)
    turns.writeStream.foreachBatch(take).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
