"""Redelivery and streamed telemetry: once each, with a state that expires."""

import datetime as dt

from pyspark.sql import functions as F

from palimpsest.operators import activity
from palimpsest.streaming import late

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, arrived timestamp"


def deliveries(spark, days):
    """days: the ids that come on each day; their own time is long past."""
    return [spark.createDataFrame([(i, DAY - dt.timedelta(days=400 + (i or 0)), DAY + dt.timedelta(days=n)) for i in ids], SCHEMA) for n, ids in enumerate(days)]


def test_each_key_once_and_the_state_expires(spark):
    """Twice in a delivery, in the next one, and long after the state forgot it; a row without an id is one key; an empty delivery."""
    days = [[1, 1, 2, None, *range(100, 150)], [2, 3], [4], [], [5], [6], [1, 7, None], [8, 3], [9]]
    progress = []
    got = late.redelivered(spark, deliveries(spark, days), "once", delay="2 days", progress=progress).collect()
    assert sorted((r.id is None, r.id or 0) for r in got) == [(False, i) for i in (*range(1, 10), *range(100, 150))] + [(True, 0)]
    first = {1: 0, 2: 0, 3: 1, None: 0}
    assert all(r.arrived == DAY + dt.timedelta(days=first[r.id]) for r in got if r.id in first)
    held = [s["numRowsTotal"] for p in progress for s in p["stateOperators"]] if isinstance(progress[0], dict) else [s.numRowsTotal for p in progress for s in p.stateOperators]
    # the last watermark is day 7 less the delay, so what came up to day 3 is forgotten: 5, 6, 1, 7, None, 8, 3 and 9 are left
    assert max(held) >= 50 and held[-1] <= 8


def test_no_old_claim_is_lost(spark):
    """The watermark goes by arrival: a claim of any age is kept."""
    parts = deliveries(spark, [[1], [2], [3]])
    parts[2] = parts[2].withColumn("ts", F.lit("1970-01-01").cast("timestamp"))
    assert sorted(r.id for r in late.redelivered(spark, parts, "old", delay="1 hour").collect()) == [1, 2, 3]


def test_streamed_buckets_equal_the_batch(spark):
    rows = [(m, x) for m in ("a", "b", None) for x in (0.5, 1.0, 3.0, 70.0, None)] * 3
    events = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, method string, value double")
    parts = [events.filter("i < 4"), events.filter("false"), events.filter("i >= 4 and i < 30"), events.filter("i >= 30")]
    key = lambda d: sorted((str(r.method), r.le, r["count"], r.n, r.total) for r in d.collect())
    assert key(late.telemetry(spark, parts, "method", "value", [1, 5])) == key(activity.histogram(events, "method", "value", [1, 5]))
