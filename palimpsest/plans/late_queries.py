"""Late data: the events in deliveries of eight days, a twentieth of them one delivery late."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import late
from . import activity_queries  # noqa: F401  its SQL is used below
from . import views as v
from .registry import ORACLES, query

SPAN = 8 * 86_400_000_000  # microseconds of a delivery


def deliveries(spark, sf):
    """The events by the delivery they come in, counted from the first event; every twentieth comes with the next one."""
    rows = v.read(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null")
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    number = F.floor((F.unix_micros("ts") - F.lit(first)) / SPAN) + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)
    count = 0 if first is None else (last - first) // SPAN + 2
    return [rows.filter(number == n) for n in range(count)] or [rows]


_ROWS = f"""+ rows_ as (select event_id, user_id, ts, (epoch_us(ts) - (select min(epoch_us(ts)) from events)) // {SPAN} + case when event_id % 20 = 0 then 1 else 0 end as delivery from events where ts is not null),
 latest as (select delivery, date_trunc('milliseconds', max(max(ts)) over (order by delivery)) - interval 1 day as after from rows_ group by delivery),
 marks as (select delivery, coalesce(lag(after) over (order by delivery), timestamp '1970-01-01') as w from latest),
 closed as (select max(after) as w from latest),
 r as (select rows_.*, w from rows_ join marks using (delivery))"""


@query("activity", _ROWS + " select hour, events from (select date_trunc('hour', ts)::timestamp as hour, count(*) as events from r where date_trunc('hour', ts) + interval 1 hour > w group by 1) where hour + interval 1 hour <= (select w from closed)")
def ss7_late_hourly(spark, sf):
    """SS7, SS1: hours in append mode; what comes after its hour was closed isn't counted."""
    return late.delivered(spark, deliveries(spark, sf), late.hourly, "late-hourly")


@query("activity", _ROWS + ", s as (select user_id, w, time_bucket(interval 1 minute, ts) - to_minutes(k) as start from r, unnest([0, 1, 2, 3, 4]) as u(k)) select start, users from (select start, count(distinct user_id) as users from s where start + interval 5 minutes > w group by 1) where start + interval 5 minutes <= (select w from closed)")
def ss7_late_presence(spark, sf):
    """SS7, SS2: exact distinct users of sliding windows in append mode."""
    return late.delivered(spark, deliveries(spark, sf), late.presence, "late-presence")


# A row that isn't late itself begins a session if the row before it is farther than the gap, or came earlier and its session was closed by
# then. Deliveries move the watermark by more than two gaps, so no session is joined and closed by three of them.
@query("activity", _ROWS + """, k as (select * from r where ts + interval 30 minutes > w),
 p as (select *, lag(ts) over u as before, lag(delivery) over u as came from k window u as (partition by user_id order by ts)),
 f as (select *, case when before is null or ts - before > interval 30 minutes then 1
   when came < delivery and before + interval 30 minutes <= w and not exists (select 1 from k q where q.user_id = p.user_id and q.delivery < p.delivery and q.ts > p.ts and q.ts - p.before <= interval 30 minutes) then 1 else 0 end as fresh from p),
 n as (select *, sum(fresh) over (partition by user_id order by ts) as s from f)
 select user_id, first_ts, last_ts, n_events from (select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_events from n group by user_id, s) where last_ts + interval 30 minutes <= (select w from closed)""")
def ss7_late_sessions(spark, sf):
    """SS7, SS3: sessions in append mode, each written once when it is closed."""
    return late.delivered(spark, deliveries(spark, sf), late.sessions, "late-sessions")


@query("activity", _ROWS + " select event_id, user_id, ts, w as watermark from r where date_trunc('hour', ts) + interval 1 hour <= w")
def ss7_late_rows(spark, sf):
    """SS7: the side table of the rows that came after their hour was closed."""
    return late.late_rows(spark, deliveries(spark, sf), lambda ts: F.date_trunc("hour", ts) + F.expr("interval 1 hour"), "late-rows")


def redeliveries(spark, sf):
    """The deliveries again, with arrival times: every tenth event comes once more with the next delivery, every fifteenth four deliveries later."""
    parts = deliveries(spark, sf)
    out = []
    for n in range(len(parts) + 4):
        rows = [parts[i].filter(again) for i, again in ((n, "true"), (n - 1, "event_id % 10 = 0"), (n - 4, "event_id % 15 = 0")) if 0 <= i < len(parts)]
        together = rows[0] if rows else parts[0].filter("false")
        for more in rows[1:]:
            together = together.unionByName(more)
        out.append(together.withColumn("arrived", F.expr(f"timestamp'2024-02-01 00:00:00' + interval {8 * n} days")))
    return out


@query("activity", "select event_id, user_id, ts from events where ts is not null")
def ss6_redelivery(spark, sf):
    """SS6: events that come again soon are dropped by state that expires, those that come later by the stored keys; each is there once."""
    return late.redelivered(spark, redeliveries(spark, sf), "redelivery", "event_id", "10 days").select("event_id", "user_id", "ts")


@query(sql=ORACLES["a16_histogram"])
def ss9_stream_buckets(spark, sf):
    """SS9: counters and latency buckets of the events as three deliveries, in update mode, with the rows of A16."""
    events = v.activity(spark, sf)
    parts = [events.filter(F.pmod(F.xxhash64("user_id", "ts"), F.lit(3)) == i) for i in range(3)]
    return late.telemetry(spark, parts, "method", "value", [1, 5, 10, 50]).withColumn("total", F.round("total", 2))
