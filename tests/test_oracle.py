"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.catalog import ORACLES, QUERIES
from palimpsest.functions import text as tx

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if hasattr(x, "asDict"):
        return plain(list(x.asDict().values()))
    if isinstance(x, dict):
        return plain(list(x.values()))
    if isinstance(x, bool) or x is None:
        return str(x)
    try:
        f = float(x)
    except (TypeError, ValueError):
        return str(x)
    return "None" if math.isnan(f) else f"{f:.6f}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    got = sorted("|".join(plain(r[c]) for c in columns) for r in mine.collect())
    at = [theirs.columns.index(c) for c in columns]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Every column of every row is worked out, and again with the same result."""
    sums = []
    for _ in range(2):
        out = QUERIES[name](spark, SF)
        rows = out.collect()
        sums.append((len(rows), sorted(plain(r) for r in rows)))
    assert sums[0] == sums[1]


def test_patterns_are_read_as_sql_reads_them(spark, tmp_path):
    """pf9_turn_predicates, and the polarity of rk6_polarity: letters that aren't ASCII beside a word, odd spaces and line ends, no text."""
    texts = ["esñó no", "ñno", "noñ señal", "éno: x", "hi\n", "hi ", "hi\x0b", " hi", "　got it　", " who is it? ", "name all", "ñlist the x", "no_", "no1", "ok!?", "", None]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(ORACLES["pf9_turn_predicates"])
    mine = QUERIES["pf9_turn_predicates"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, mine.collect()), key=repr) == sorted(want.fetchall(), key=repr)
    for p in [tx.NEGATION, tx.LIST_QUESTION, tx.PLEASANTRY, *tx.HINTS.values(), *tx.DATE_FORMS, *tx.INTENTS.values()]:
        got = {r.turn: r.x for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").select("turn", tx.matches(F.col("text"), p).alias("x")).collect()}
        assert got == dict(con.execute("select turn, regexp_matches(text, ?) from conversations", [p]).fetchall()), p
