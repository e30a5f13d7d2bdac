"""Lineage in full, chains, instants over time bins, identity probes: against plain loops and small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import beliefs, evaluate

DAY = dt.datetime(2024, 1, 1)


def ranked(spark, links):
    rows = spark.createDataFrame(links, "user_id long, id long, superseded_by long")
    return {(r.user_id, r.id): (r.head, r.ahead, r.length) for r in beliefs.chains(rows).collect()}


def test_chains_equal_a_walk(spark):
    """A long chain, trees, links to claims that aren't there, a circle with a tail, a link to itself, other tenants, repeated rows."""
    rng = random.Random(1)
    order = list(range(100))
    rng.shuffle(order)
    links = [(1, a, b) for a, b in zip(order, order[1:])] + [(1, order[-1], None)]
    links += [(2, i, rng.randint(i + 1, 40) if i < 40 and rng.random() < 0.9 else None) for i in range(41)]
    links += [(3, 1, 2), (3, 2, 3), (3, 3, 1), (3, 4, 1), (3, 5, 5), (3, 6, 99), (3, 7, 6), (3, 7, 6)]
    to = {(u, a): b for u, a, b in links}
    want = {}
    for u, a in to:
        at, steps = a, 0
        while to[(u, at)] is not None and (u, to[(u, at)]) in to and steps <= len(to):
            at, steps = to[(u, at)], steps + 1
        want[(u, a)] = (at, steps) if steps <= len(to) else (None, None)
    longest = {}
    for (u, _), (head, steps) in want.items():
        if head is not None:
            longest[(u, head)] = max(longest.get((u, head), 0), steps + 1)
    assert ranked(spark, links) == {k: (*x, longest.get((k[0], x[0]))) for k, x in want.items()}


def test_chains_of_an_empty_table(spark):
    assert beliefs.chains(spark.createDataFrame([], "user_id long, id long, superseded_by long")).collect() == []


def test_full_lineage(spark):
    claims = spark.createDataFrame([(1, i, DAY, None, 3 if i == 1 else None) for i in (1, 2, 3, 4)], "user_id long, id long, valid_from timestamp, valid_to timestamp, superseded_by long")
    t = [DAY + dt.timedelta(days=i) for i in range(5)]
    decisions = spark.createDataFrame(
        [(1, 1, None, "insert", "no_neighbour", t[0]), (1, 2, 1, "conflict", "no_cue", t[1]), (1, 3, 1, "supersede", "cue", t[2]), (1, 3, 2, "conflict", "no_cue", t[3]), (2, 4, 1, "conflict", "no_cue", t[4])],
        "user_id long, id long, nearest_id long, decision string, reason string, created_at timestamp",
    )
    got = {r.id: r for r in beliefs.full_lineage(claims, decisions).collect()}
    assert {i: r.conflict_with for i, r in got.items()} == {1: [2], 2: [1, 3], 3: [2], 4: None}
    assert [(e.new_id, e.decision) for e in got[1].ledger] == [(1, "insert"), (2, "conflict"), (3, "supersede")]
    assert [(e.new_id, e.decision) for e in got[2].ledger] == [(2, "conflict"), (3, "conflict")]
    assert got[4].ledger is None and got[3].supersedes == [1]


@pytest.mark.parametrize("fine", [0, 3, 20])
def test_binned_instants_equal_the_plain_join(spark, fine):
    """Versions of one entity, short and long, open, empty, reversed and without a beginning; instants on their edges."""
    rng = random.Random(fine)
    at = lambda: DAY + dt.timedelta(microseconds=rng.choice([rng.randrange(40), rng.randrange(10**6), rng.randrange(10**12)]))
    versions = [(1, "e", "a", i, str(i), None if rng.random() < 0.05 else at(), None if rng.random() < 0.1 else at()) for i in range(400)]
    claims = spark.createDataFrame(versions, "user_id long, entity string, attribute string, id long, value string, valid_from timestamp, valid_to timestamp")
    edges = [t for x in versions for t in x[5:] if t]
    asked = [(i, 1, "e", rng.choice(edges) if i % 2 else at()) for i in range(150)] + [(900, 1, "e", None), (901, 2, "e", DAY), (902, 1, None, DAY)]
    questions = spark.createDataFrame(asked, "qid long, user_id long, entity string, as_of timestamp")
    rows = lambda d: sorted((r.qid, r.id, r.value) for r in d.collect())
    want = rows(beliefs.beliefs_at(questions, claims))
    assert len(want) > 150
    assert rows(beliefs.beliefs_at_binned(questions, claims, fine)) == want
    assert rows(beliefs.beliefs_at_binned(questions.filter("qid = 1"), claims, fine)) == [x for x in want if x[0] == 1]
    assert rows(beliefs.beliefs_at_binned(questions.filter("false"), claims, fine)) == []


def test_a_hot_entity_is_many_keys(spark):
    """20 000 versions of one entity: what meets in the join before the exact check is a few rows for each instant."""
    claims = spark.range(20_000).select(F.lit(1).cast("long").alias("user_id"), F.lit("e").alias("entity"), F.lit("a").alias("attribute"), "id", F.lit("v").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("valid_from"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("valid_to"))
    questions = spark.range(2000).select(F.col("id").alias("qid"), F.lit(1).cast("long").alias("user_id"), F.lit("e").alias("entity"), F.timestamp_seconds(F.col("id") * 600 + 7).alias("as_of"))
    got = beliefs.beliefs_at_binned(questions, claims)
    assert got.filter("id <> qid * 10").isEmpty() and got.count() == 2000
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


def test_binned_instants_are_not_broadcast(spark):
    """Each instant has a copy for each level, which Spark's size estimates don't count: a broadcast side would be all copies of all instants."""
    claims = spark.range(500).select(F.lit(1).cast("long").alias("user_id"), F.lit("e").alias("entity"), F.lit("a").alias("attribute"), "id", F.lit("v").alias("value"), F.timestamp_seconds(F.col("id") * 60).alias("valid_from"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("valid_to"))
    questions = spark.range(500).select(F.col("id").alias("qid"), F.lit(1).cast("long").alias("user_id"), F.lit("e").alias("entity"), F.timestamp_seconds(F.col("id") * 60 + 7).alias("as_of"))
    got = beliefs.beliefs_at_binned(questions, claims)
    assert got.filter("id <> qid").isEmpty() and got.count() == 500
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_identity_probes(spark):
    surfaced = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3), ("r", 4), ("r", 4)], "qid string, id long")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (4, 4)], "a long, b long")
    assert sorted(evaluate.one_sided(surfaced, pairs).collect()) == [("q", 3, 4), ("r", 3, 4)]
    resolutions = spark.createDataFrame([("m", "x", "E"), ("n", "x", "F"), ("o", "y", "E"), ("p", "y", "E"), ("q", "z", None)], "mention string, norm string, entity string")
    assert [tuple(r) for r in evaluate.split_aliases(resolutions).collect()] == [("x", 2)]
    got = {r.probe: (r.passed, r.evidence) for r in evaluate.identity_audit(surfaced, pairs, resolutions).collect()}
    assert got == {"both_conflict_sides": (False, 2.0), "alias_names_one_entity": (False, 1.0)}
