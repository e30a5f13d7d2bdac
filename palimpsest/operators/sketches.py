"""Approximate activity figures from mergeable summaries of short slots of time.

Summaries are written once for each slot and merged to any span of whole slots, so that a year of events isn't read again for the
users of a month. Distinct users are HyperLogLog sketches. Quantiles are counts by logarithmic bucket: sums of plain rows, repeatable,
with a bound on the relative error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOT = "5 minutes"
SPANS = {"5m": "5 minutes", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}
#: 2^12 registers: a standard error of 1.6 %, and at most 4 KB a slot.
LG_REGISTERS = 12
#: An estimated quantile is within this share of a value of that rank.
ERROR = 0.01


def _slot(slot: str) -> Column:
    return F.window("ts", slot)["start"].alias("slot")


def user_sketches(activity: DataFrame, slot: str = SLOT) -> DataFrame:
    """(slot, users, events): a sketch of the slot's users. Events without a time are in no slot; a null user counts as an event only."""
    rows = activity.filter("ts is not null").select(_slot(slot), F.col("user_id").cast("long").alias("user_id"))
    return rows.groupBy("slot").agg(F.hll_sketch_agg("user_id", LG_REGISTERS).alias("users"), F.count("*").alias("events"))


def active_users(sketches: DataFrame, now: Column, spans: dict[str, str] | None = None) -> DataFrame:
    """(span, users, events) of the slots that begin in each span before ``now`` or later; one pass, zeros for an empty span."""
    spans = spans or SPANS
    inside = lambda i: F.col("slot") >= now - F.expr(f"interval {i}")
    sums = sketches.agg(*(c for n, i in spans.items() for c in (F.hll_union_agg(F.when(inside(i), F.col("users"))).alias(f"u_{n}"), F.sum(F.when(inside(i), F.col("events"))).alias(f"e_{n}"))))
    zero = F.lit(0).cast("long")
    rows = F.array(*(F.struct(F.lit(n).alias("span"), F.coalesce(F.hll_sketch_estimate(f"u_{n}"), zero).alias("users"), F.coalesce(F.col(f"e_{n}"), zero).alias("events")) for n in spans))
    return sums.select(F.inline(rows))


def value_buckets(activity: DataFrame, label: str, value: str, slot: str = SLOT, error: float = ERROR) -> DataFrame:
    """(slot, label, sign, bucket, n, top): how many values lie in each logarithmic bucket. Nulls and NaN aren't counted."""
    x = F.col(value).cast("double")
    base = math.log((1 + error) / (1 - error))
    rows = activity.filter(F.col("ts").isNotNull() & x.isNotNull() & ~F.isnan(x)).select(_slot(slot), label, F.signum(x).cast("int").alias("sign"), F.when(x == 0, 0).otherwise(F.ceil(F.log(F.abs(x)) / base)).cast("int").alias("bucket"), x.alias("x"))
    return rows.groupBy("slot", label, "sign", "bucket").agg(F.count("*").alias("n"), F.max("x").alias("top"))


def quantiles(buckets: DataFrame, label: str, since: Column, percents: tuple[int, ...] = (50, 95, 99), error: float = ERROR) -> DataFrame:
    """(label, n, p50, ..., max_value) of the slots from ``since`` on: of the bucket that holds the value of rank ceil(p * n), its middle.

    The values of a bucket are within ``error`` of its middle. A label has as many rows here as its values have buckets, a few thousand.
    """
    gamma = (1 + error) / (1 - error)
    b = buckets.filter(F.col("slot") >= since).groupBy(label, "sign", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    rising = Window.partitionBy(label).orderBy("sign", F.col("sign") * F.col("bucket"))
    b = b.withColumn("upto", F.sum("n").over(rising)).withColumn("all", F.sum("n").over(Window.partitionBy(label)))
    middle = F.col("sign") * 2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1)
    at = lambda p: F.min_by(middle, F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("upto")))
    return b.groupBy(label).agg(F.sum("n").alias("n"), *(at(p).alias(f"p{p}") for p in percents), F.max("top").alias("max_value"))
