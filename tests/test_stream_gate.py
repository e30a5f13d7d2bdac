"""The streamed gate: the same tables after a stop at any write, after redelivery, and as the batch functions give."""

import pytest
from pyspark.sql import functions as F

from palimpsest.streaming import gate

TURNS = "conv_id long, turn_no long, role string, text string, ts timestamp"
ROWS = [
    [(1, 0, "user", "We use Redis 6.2 on port 6379. The billing service runs on Heroku in the cloud.", "2024-01-01 10:00:00"), (2, 0, "user", "We use Kafka 3.1 for events in the billing service.", "2024-01-01 10:01:00")],
    [(1, 1, "user", "The billing service runs on Docker in the cloud now, moved off Heroku.", "2024-01-02 10:00:00"), (2, 1, "user", "We use Kafka 3.1 for events in the billing service.", "2024-01-02 10:01:00"), (1, 2, "user", "We use Redis 7.0 on port 6380.", "2024-01-02 10:02:00")],
    [(2, 2, "user", "We no longer use Kafka in production.", "2024-01-03 09:00:00"), (9, 0, "user", "Priya leads the rollout of the new billing service.", "2023-12-01 09:00:00")],
]


def put(spark, folder, rows):
    spark.createDataFrame(rows, TURNS.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)


def deliver(spark, folder, files, stops=()):
    """Each file is a batch; the nth step of ``stops`` fails in the nth batch, and the stream is started again."""
    left = list(stops)

    def stop(step):
        if left and left[0] == step:
            del left[0]
            raise RuntimeError("stopped")

    for rows in files:
        put(spark, f"{folder}/in", rows)
        while True:
            try:
                gate.ingest(spark, spark.readStream.schema(TURNS).parquet(f"{folder}/in"), f"{folder}/out", F.col("conv_id") % 2, stop=stop)
                break
            except Exception as e:  # as the stream reports it
                if "stopped" not in str(e):
                    raise
    assert not left
    return f"{folder}/out"


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield deliver(spark, str(tmp_path_factory.mktemp("plain")), ROWS)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def tables(spark, at):
    plain = lambda df: sorted(str(r) for r in df.drop("embedding").collect())
    return plain(gate.beliefs(spark, at)), plain(gate.ledger(spark, at))


def test_decisions_and_beliefs(spark, plain):
    at = plain
    beliefs = {r["id"]: r for r in gate.beliefs(spark, at).collect()}
    rows = gate.ledger(spark, at).collect()
    assert len({(r["user_id"], r["id"]) for r in rows}) == len(rows)
    assert {r["decision"] for r in rows} >= {"insert", "retract"}
    for r in rows:
        assert (r["id"] in beliefs) == (r["decision"] != "touch")
        if r["decision"] == "supersede":
            assert beliefs[r["nearest_id"]]["valid_to"] is not None
        if r["decision"] == "conflict":
            assert r["nearest_id"] in beliefs[r["id"]]["conflict_with"] and r["id"] in beliefs[r["nearest_id"]]["conflict_with"]
    kafka = [b for b in beliefs.values() if b["value"] == "Kafka" and not b["retraction"]]
    assert kafka and all(b["valid_to"] is not None and b["superseded_by"] for b in kafka)
    # a turn that is a month late is decided like any other
    assert any("Priya" in b["content"] for b in beliefs.values())


def test_stops_and_redelivery_change_nothing(spark, plain, tmp_path):
    """A stop after the ledger, after the beliefs and after the commit of a batch; then two files come again."""
    at = deliver(spark, str(tmp_path), [*ROWS, [*ROWS[0], *ROWS[1]]], ["ledger", "beliefs", "commit"])
    assert tables(spark, at) == tables(spark, plain)


def test_readers_see_commits_only(spark, plain):
    before = tables(spark, plain)
    put(spark, f"{plain}/../more", [(3, 0, "user", "We use MongoDB 5.0 for the catalogue of the shop.", "2024-02-01 10:00:00")])

    def stop(now):
        if now == "beliefs":
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        gate.take_batch(spark, plain, spark.read.schema(TURNS).parquet(f"{plain}/../more"), 3, F.col("conv_id") % 2, stop=stop)
    assert tables(spark, plain) == before


def test_feed_is_newest_first(spark, plain):
    rows = [r["created_at"] for r in gate.feed(gate.ledger(spark, plain), "0").collect()]
    assert rows and rows == sorted(rows, reverse=True)
    assert {r["user_id"] for r in gate.feed(gate.ledger(spark, plain), "1", 9999).collect()} == {"1"} and gate.feed(gate.ledger(spark, plain), limit=0).count() == 1
