"""Scans in slices against plain loops; one user with nearly all rows is many tasks."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import activity as op
from palimpsest.operators.scans import running_sum, spaced

ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


def touches(seed, n, span):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(-span, span)) for _ in range(n)]


@pytest.mark.parametrize("step,span", [(10, 40), (10, 60_000), (7, 15_000), (1, 3000)])
def test_spaced_equals_a_loop(spark, step, span):
    rows = list(dict.fromkeys(touches(step + span, 2000, span)))
    want = {}
    for user, t in sorted(rows, key=lambda r: r[1]):
        n, last = want.get(user, (0, None))
        want[user] = (n + 1, t) if last is None or t - last >= step else (n, last)
    got = {r["user_id"]: (r["recorded"], r["last_recorded"]) for r in spaced(spark.createDataFrame(rows, "user_id long, t long"), step).collect()}
    assert got == want


def test_sessions_of_a_hot_user_equal_a_loop(spark):
    rows = touches(3, 3000, 40_000) + [(1, 0), (1, 30), (1, 60), (5, 0), (5, 31), (6, -1), (6, 29), (6, 59)]  # minutes: a gap of exactly 30 stays
    by_user = defaultdict(list)
    for user, t in rows:
        by_user[user].append(t)
    want = set()
    for user, times in by_user.items():
        runs = []
        for t in sorted(times):
            if runs and t - runs[-1][-1] <= 30:
                runs[-1].append(t)
            else:
                runs.append([t])
        want |= {(user, i + 1, len(r), r[0], r[-1]) for i, r in enumerate(runs)}
    table = spark.createDataFrame(rows, "user_id long, m long").select("user_id", F.timestamp_micros(F.col("m") * 60_000_000).alias("ts"))
    out = op.sessions(table)
    got = {(r["user_id"], r["session_no"], r["n_events"], r["a"] // 60_000_000, r["b"] // 60_000_000) for r in out.withColumn("a", F.unix_micros("first_ts")).withColumn("b", F.unix_micros("last_ts")).collect()}
    assert got == want


def test_sessions_count_before_the_shuffle(spark):
    plan = op.sessions(spark.range(10).select(F.lit(1).alias("user_id"), F.timestamp_micros("id").alias("ts")))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan.split("Exchange")[-1]


def test_running_sum_of_a_hot_key_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 1, 2, None]), rng.randrange(500), i, rng.choice([None, 1, 2, 3])) for i in range(4000)] + [(1, 7, 1, 5), (1, 7, 1, 5)]
    sums, want = {}, []
    for user, t, i, size in sorted(rows, key=lambda r: (r[1], r[2])):
        if size is not None:
            sums[user] = sums.get(user, 0) + size
        want.append([user, t, i, size, sums.get(user)])
    for a, b in zip(reversed(want[:-1]), reversed(want[1:])):  # ties share the last one's sum
        if a[:3] == b[:3]:
            a[4] = b[4]
    table = spark.createDataFrame(rows, "user_id long, ts long, id long, size long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as a large table: all partitions are kept
    try:
        got = [[r["user_id"], r["ts"], r["id"], r["size"], r["running"]] for r in running_sum(table, "user_id", ["ts", "id"], "size", "running").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_no_rows(spark):
    none = spark.createDataFrame([], "user_id long, ts timestamp, id long, size long")
    assert op.sessions(none).count() == 0 and op.throttled(none).count() == 0
    assert running_sum(none, "user_id", ["ts", "id"], "size", "running").count() == 0


def test_touches_without_a_time(spark):
    table = spark.createDataFrame([(1, None), (1, None), (1, ZERO + timedelta(hours=1))], "user_id long, ts timestamp")
    assert [(r["session_no"], r["n_events"]) for r in op.sessions(table).orderBy("session_no").collect()] == [(2, 2), (3, 1)]
    assert op.throttled(table).collect()[0]["recorded"] == 1


def test_far_negatives_are_of_other_conversations(spark):
    from palimpsest.operators.evaluate import far_negatives

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(20) for t in range(6)] + [(1, t, "user", f"hot {t}") for t in range(100, 400)] + [(1, 100, "user", "hot 100"), (99, 1, "assistant", "alone"), (None, 1, "assistant", "x"), (3, 7, "assistant", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn_no long, role string, text string")
    got = far_negatives(table, 4).collect()
    positives = [r for r in rows if r[2] == "assistant" and r[0] is not None]
    assert len(got) == 4 * len(positives) and all(r["neg_conv"] != r["conv_id"] for r in got)
    assert len({(r["conv_id"], r["pos_turn"], r["neg_conv"], r["neg_turn"], r["negative"]) for r in got}) == len(got)
    assert {(r["neg_conv"], r["neg_turn"], "user", r["negative"]) for r in got} <= set(rows)
    assert far_negatives(table.filter("conv_id = 1"), 4).count() == 0 and far_negatives(table.limit(0), 4).count() == 0


def test_why_matched(spark):
    from palimpsest.functions.text import why_matched

    rows = [("Where is Redis Cache?", "redis cache"), ("the cache is slow", "Redis Cache"), ("the car is slow", "my car"), (None, "a"), ("a", None), ("", "")]
    got = [r["w"] for r in spark.createDataFrame(rows, "q string, e string").select(why_matched(F.col("q"), F.col("e")).alias("w")).collect()]
    assert got == ["entity", "word", None, None, None, "entity"]
