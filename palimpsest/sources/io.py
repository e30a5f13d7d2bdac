"""Sources and sinks: tolerant JSON lines, claim tables, nested conversation dumps, training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of JSON lines; blank lines are skipped, invalid ones never fail the read."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.filter(~bad).select("r.*").drop(CORRUPT), parsed.filter(bad).select("value")


def _bucket(user_id, buckets: int):
    return F.pmod(F.xxhash64(user_id), F.lit(buckets)).cast("int")


def read_claims(spark: SparkSession, path: str, user_id=None, with_vectors: bool = False, buckets: int = 64) -> DataFrame:
    """The claim table; a tenant's scan reads its own bucket's folder, and the tenant and null-vector filters reach the Parquet scan."""
    out = spark.read.parquet(path)
    if user_id is not None:
        asked = F.lit(user_id).cast(out.schema["user_id"].dataType)
        out = out.filter((F.col("tenant_bucket") == _bucket(asked, buckets)) & (F.col("user_id") == asked))
    return out.filter("embedding is not null") if with_vectors else out


def append_claims(claims: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends, partitioned by a bucket of the tenant."""
    claims.withColumn("tenant_bucket", _bucket(F.col("user_id"), buckets)).write.mode("append").partitionBy("tenant_bucket").parquet(path)


def without(rows: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(deletes.select(*keys), keys, "left_anti")


def unnested_sessions(dumps: DataFrame) -> DataFrame:
    """Rows (conv_id, session_id, session_no, position, speaker, content) of dumps (conv_id, conversation JSON keyed session_1, session_2, ...); other keys are left out."""
    message = "array<struct<speaker:string,text:string,dia_id:string>>"
    entry = F.explode(F.map_entries(F.from_json("conversation", "map<string,string>"))).alias("e")
    sessions = dumps.select("conv_id", entry).filter(F.col("e.key").rlike("^session_[0-9]+$"))
    rows = sessions.select("conv_id", F.col("e.key").alias("session_id"), F.regexp_extract("e.key", r"(\d+)", 1).cast("int").alias("session_no"), F.posexplode(F.from_json("e.value", message)).alias("position", "m"))
    return rows.select("conv_id", "session_id", "session_no", "position", F.col("m.speaker").alias("speaker"), F.col("m.text").alias("content"), F.col("m.dia_id").alias("dia_id"))


def write_training_set(rows: DataFrame, path: str, test_share: float = 0.1, seed: int = 7, group: str = "conv_id") -> DataFrame:
    """Writes JSON lines by split (whole groups, by hash) and returns the counts."""
    share = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(1000)) / 1000
    split = rows.withColumn("split", F.when(share < test_share, "test").otherwise("train"))
    split.write.mode("overwrite").partitionBy("split").json(path)
    schema = T.StructType([f for f in split.schema.fields if f.name != "split"] + [T.StructField("split", T.StringType())])
    return rows.sparkSession.read.schema(schema).json(path).groupBy("split").agg(F.count("*").alias("n"))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines: a fixed envelope, and all fields as a map."""
    lines = spark.read.text(path)
    envelope = F.from_json("value", "timestamp string, level string, component string, event string, trace_id string")
    return lines.select(envelope.alias("e"), F.from_json("value", "map<string,string>").alias("extras")).filter(F.col("e.event").isNotNull()).select("e.*", "extras")
