"""Sketches against exact figures: distinct users and quantiles of merged slots."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import sketches as sk
from palimpsest.plans import views as v

NOW = dt.datetime(2024, 1, 31)
SCHEMA = "user_id long, ts timestamp, method string, value double"


def exact(values, percent):
    """The value of rank ceil(percent * n)."""
    values = sorted(values)
    return values[-(-percent * len(values) // 100) - 1]


def test_users_of_merged_slots(spark):
    """Many users at sf0.1 and a made-up stream of 60 000: within four standard errors, few users exactly; events are exact."""
    made = spark.range(60_000).select(F.col("id").alias("user_id"), (F.lit(NOW) - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 40_000).cast("int"))).alias("ts"))
    for rows in (v.activity(spark, "/root/testdata/sf0.1").select("user_id", "ts"), made):
        got = {r.span: r for r in sk.active_users(sk.user_sketches(rows), F.lit(NOW)).collect()}
        for span, interval in sk.SPANS.items():
            want = rows.filter(F.col("ts") >= F.lit(NOW) - F.expr(f"interval {interval}")).agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events")).first()
            assert got[span].events == want.events
            assert abs(got[span].users - want.users) <= 4 * 0.0163 * want.users


@pytest.mark.parametrize("kind", ["wide", "negative", "ties", "one"])
def test_quantiles_within_the_stated_error(spark, kind):
    rng = random.Random(kind)
    draw = {"wide": lambda: 10 ** rng.uniform(-6, 9), "negative": lambda: rng.choice([-1, 0, 1]) * rng.expovariate(0.1), "ties": lambda: float(rng.choice([0, 1, 1, 5])), "one": lambda: 3.5}[kind]
    values = [draw() for _ in range(1 if kind == "one" else 900)]
    rows = [(1, NOW - dt.timedelta(minutes=rng.randrange(5000)), "m", x) for x in values]
    rows += [(1, NOW, "m", None), (1, NOW, "m", float("nan")), (1, None, "m", 7.0), (1, NOW - dt.timedelta(days=30), "m", 1e12)]
    buckets = sk.value_buckets(spark.createDataFrame(rows, SCHEMA), "method", "value")
    r = sk.quantiles(buckets, "method", F.lit(NOW) - F.expr("interval 7 days"), (1, 50, 95, 99, 100)).first()
    assert (r.n, r.max_value) == (len(values), max(values))
    for p in (1, 50, 95, 99, 100):
        want = exact(values, p)
        assert abs(r[f"p{p}"] - want) <= sk.ERROR * abs(want) * (1 + 1e-9)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert {(r.users, r.events) for r in sk.active_users(sk.user_sketches(none), F.lit(NOW)).collect()} == {(0, 0)}
    assert sk.quantiles(sk.value_buckets(none, "method", "value"), "method", F.lit(NOW)).collect() == []
    nobody = spark.createDataFrame([(None, NOW, None, 2.0)], SCHEMA)
    assert {(r.users, r.events) for r in sk.active_users(sk.user_sketches(nobody), F.lit(NOW)).collect()} == {(0, 1)}
    assert [r.method for r in sk.quantiles(sk.value_buckets(nobody, "method", "value"), "method", F.lit(NOW)).collect()] == [None]
