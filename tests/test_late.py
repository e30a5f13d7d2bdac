"""Late rows: append-mode jobs against plain loops over the deliveries, bounded state, the side table."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.streaming import late

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def at(hours):
    return START + timedelta(hours=hours)


# (event, user, time) by delivery; the delay is a day
ROWS = [
    [(1, 1, at(0.5)), (2, 2, at(0.6)), (3, 1, at(40)), (4, 3, None)],
    [(5, 1, at(15.9)), (6, 1, at(16.2)), (7, 2, at(20)), (8, 2, at(80)), (9, 2, at(80)), (10, 1, at(0.7))],  # the watermark is 16: event 5 is late, as is 10
    [(11, 2, at(79)), (12, None, at(55)), (13, 1, at(56.5)), (14, 1, at(57)), (15, 9, at(200))],  # 56: 12 is late
]


def tables(spark):
    return [spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp") for rows in ROWS]


def on_time(end):
    """Rows whose last window is open when they come, and the last watermark."""
    latest, mark, kept, gone = START - timedelta(days=999), None, [], []
    for rows in ROWS:
        mark = latest - timedelta(days=1)
        for row in rows:
            if row[2] is not None:
                (kept if end(row[2]) > mark else gone).append(row)
        latest = max([latest, *(r[2] for r in rows if r[2] is not None)])
    return kept, gone, latest - timedelta(days=1)


def hour_end(t):
    return t.replace(minute=0, second=0, microsecond=0) + HOUR


def test_hours_and_late_rows(spark):
    kept, gone, last = on_time(hour_end)
    assert [r[0] for r in gone] == [5, 10, 12]
    want = {h: n for h, n in Counter(hour_end(t) - HOUR for _, _, t in kept).items() if h + HOUR <= last}
    progress = []
    got = late.delivered(spark, tables(spark), late.hourly, "test-hourly", progress).collect()
    assert {r["hour"]: r["events"] for r in got} == want and len(got) == len(want)
    states = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert states[-1]["numRowsTotal"] == 1  # of all hours only the open one is still held
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 3  # events 5, 10 and 12, each alone in its hour
    side = late.late_rows(spark, tables(spark), lambda ts: F.date_trunc("hour", ts) + F.expr("interval 1 hour"), "test-late").collect()
    assert {(r["event_id"], r["watermark"]) for r in side} == {(5, at(16)), (10, at(16)), (12, at(56))}


def test_sessions_are_written_once(spark):
    gap = timedelta(minutes=30)
    kept, _, last = on_time(lambda t: t + gap)
    want, by_user = [], {}
    for _, user, t in kept:
        by_user.setdefault(user, []).append(t)
    for user, times in by_user.items():
        runs = []
        for t in sorted(times):
            if runs and t - runs[-1][-1] <= gap:
                runs[-1].append(t)
            else:
                runs.append([t])
        want += [(user, r[0], r[-1], len(r)) for r in runs if r[-1] + gap <= last]
    progress = []
    got = [tuple(r) for r in late.delivered(spark, tables(spark), late.sessions, "test-sessions", progress).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert [p for p in progress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_presence_counts_a_user_once(spark):
    _, _, last = on_time(lambda t: t)
    got = {r["start"]: r["users"] for r in late.delivered(spark, tables(spark), late.presence, "test-presence").collect()}
    assert got[at(80)] == 1 and max(got) + timedelta(minutes=5) <= last  # two touches of one user


def test_no_rows_give_no_rows(spark):
    empty = [spark.createDataFrame([], "event_id long, user_id long, ts timestamp")]
    assert late.delivered(spark, empty, late.hourly, "test-none").count() == 0
    assert late.late_rows(spark, empty, lambda ts: ts, "test-none").count() == 0
