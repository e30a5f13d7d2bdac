"""Activity analytics: sessions, presence, leaderboards, quota.

Every operator is DataFrame in, DataFrame out; ``now`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scans import running_sum, spaced

GAP_MINUTES = 30


def sessions(activity: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """(user_id, session_no, n_events, first_ts, last_ts, seconds): a new session after more than the gap without a touch.

    Touches in one bin of the gap's length are of one session, so they are counted by user and bin before the shuffle.
    A user's bins are walked in order; their number is bounded by the time that the table spans, not by its rows.
    """
    gap = gap_minutes * 60_000_000
    t = F.unix_micros("ts")
    bins = activity.groupBy("user_id", (t - F.pmod(t, F.lit(max(gap, 1)))).alias("bin")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    by_user = Window.partitionBy("user_id").orderBy("bin")
    before = F.lag("last").over(by_user)
    # each touch without a time counts as a beginning
    new = F.when(F.col("bin").isNull(), F.col("n")).when(before.isNull() | (F.unix_micros("first") - F.unix_micros(before) > gap), 1).otherwise(0)
    numbered = bins.withColumn("new", new).withColumn("session_no", F.sum("new").over(by_user))
    return numbered.groupBy("user_id", "session_no").agg(F.sum("n").alias("n_events"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts")).withColumn("seconds", (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6)


def user_rollup(activity: DataFrame, users: DataFrame, now: Column, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Session statistics of every user, those without activity too."""
    recent = F.when(F.col("last_ts") > now - F.expr("interval 24 hours"), F.col("seconds")).otherwise(0.0)
    stats = sessions(activity, gap_minutes).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("seconds").alias("total_seconds"), F.sum(recent).alias("seconds_24h"), F.sum("n_events").alias("events"), F.max("last_ts").alias("last_seen"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "total_seconds", "seconds_24h", "events")]
    return users.join(stats, "user_id", "left").select("user_id", "email", "plan", *zero, "last_seen")


def overview(activity: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """One row: users by kind, distinct users in four spans, events of a day."""
    def since(interval: str) -> Column:
        return F.col("ts") > now - F.expr(f"interval {interval}")

    seen = activity.agg(*(F.count_distinct(F.when(since(i), F.col("user_id"))).alias(n) for n, i in (("active_5m", "5 minutes"), ("dau", "24 hours"), ("wau", "7 days"), ("mau", "30 days"))), F.count_if(since("24 hours")).alias("events_24h"))
    people = users.agg(F.count("*").alias("total_users"), F.count_if("is_active").alias("active_users"), F.count_if(F.col("created_at") > now - F.expr("interval 7 days")).alias("new_7d"))
    return people.crossJoin(seen)  # one row each


def recent_feed(activity: DataFrame, users: DataFrame, n: int = 50) -> DataFrame:
    newest = activity.orderBy(F.desc("ts"), "user_id", "path").limit(n)
    return newest.join(users.select("user_id", "email"), "user_id", "left").select("user_id", "email", "ts", "method", "path")


def hourly(activity: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return activity.filter(F.col("ts") > now - F.expr(f"interval {hours} hours")).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


def leaderboard(rollup: DataFrame, n: int = 10) -> DataFrame:
    """Users with most time, and their mean session."""
    return rollup.filter("total_seconds > 0").orderBy(F.desc("total_seconds"), "user_id").limit(n).select("user_id", "email", "total_seconds", (F.col("total_seconds") / F.col("sessions")).alias("mean_session"))


def profile_counts(users: DataFrame, **tables: DataFrame) -> DataFrame:
    """Users with the number of rows that each table (with user_id) has of them."""
    out = users.select("user_id", "email")
    for name, rows in tables.items():
        out = out.join(rows.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def throttled(activity: DataFrame, seconds: int = 60) -> DataFrame:
    """Touches that are recorded: at least so many seconds after the user's last recorded one.

    Slices of a user's time are folded on their own and then walked in order. Touches without a time don't count.
    """
    touches = activity.filter("ts is not null").select("user_id", F.unix_micros("ts").alias("t")).distinct()
    return spaced(touches, seconds * 1_000_000).withColumn("last_recorded", F.timestamp_micros("last_recorded"))


def storage(claims: DataFrame, columns: list[str]) -> DataFrame:
    """(user_id, bytes_used, n_claims): UTF-8 bytes of the text columns."""
    size = F.lit(0).cast("long")
    for c in columns:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return claims.groupBy("user_id").agg(F.sum(size).alias("bytes_used"), F.count("*").alias("n_claims"))


def quota_decision(used: Column, incoming: Column, quota: Column) -> Column:
    projected = F.coalesce(used, F.lit(0)) + F.coalesce(incoming, F.lit(0))
    return F.when(quota.isNull() | (quota <= 0), "unlimited").when(projected > 1.1 * quota, "blocked").when(projected > 0.9 * quota, "warned").otherwise("ok")


def quota_status(users: DataFrame, usage: DataFrame) -> DataFrame:
    share = F.when(F.col("quota_bytes") > 0, F.least(F.lit(1.0), F.coalesce("bytes_used", F.lit(0)) / F.col("quota_bytes"))).otherwise(0.0)
    return users.join(usage, "user_id", "left").select("user_id", "plan", "quota_bytes", F.coalesce("bytes_used", F.lit(0)).alias("bytes_used"), share.alias("share"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def admitted(incoming: DataFrame, usage: DataFrame, quotas: DataFrame, size: str) -> DataFrame:
    """Incoming rows in order, with the tenant's running bytes and whether the row still fits under 110 % of the quota."""
    rows = running_sum(incoming, "user_id", ["ts", "id"], size, "running").join(usage.select("user_id", "bytes_used"), "user_id", "left").join(quotas.select("user_id", "quota_bytes"), "user_id", "left")
    total = F.col("running") + F.coalesce("bytes_used", F.lit(0))
    return rows.withColumn("admitted", F.coalesce((F.col("quota_bytes") <= 0) | (total <= 1.1 * F.col("quota_bytes")), F.lit(True)))


def histogram(rows: DataFrame, label: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (value <= le) with sum and count by label: one pass, one shuffle of |bounds| sums a label."""
    sums = rows.groupBy(label).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *(F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)))
    buckets = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("count")) for i, b in enumerate(bounds)))
    return sums.select(label, "n", "total", F.explode(buckets).alias("b")).select(label, "b.le", "b.count", "n", "total")


def percentiles(rows: DataFrame, label: str, value: str) -> DataFrame:
    return rows.groupBy(label).agg(*(F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)), F.max(value).alias("max_value"))
