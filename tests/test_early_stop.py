"""BM25 with early stop: the rows of the full search, from fewer postings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import early_stop as es
from palimpsest.operators import retrieve as rt
from palimpsest.plans import views as v

FIELDS = ["content", "entity"]
SCHEMA = "id long, user_id long, content string, entity string, extra string"


def rows(hits):
    return sorted((r.qid, r.claim_id, r["rank"], round(r.similarity, 7)) for r in hits.collect())


def corpus(spark, seed, n, words, repeat=1):
    """Words by a steep law, so that a few are in most claims; with copies, a null and an empty text."""
    rng = random.Random(seed)
    text = lambda: " ".join(f"w{min(words - 1, int(rng.paretovariate(0.6)) - 1)}" for _ in range(rng.randint(1, 30)))
    texts = [text() for _ in range(n)] * repeat
    return spark.createDataFrame([(i, i % 2, t, "e", "x") for i, t in enumerate([*texts, None, ""])], SCHEMA)


def asked(claims, every):
    return claims.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), "user_id", F.col("content").alias("text"))


@pytest.mark.parametrize(("seed", "n", "words", "repeat", "k"), [(1, 300, 200, 1, 5), (2, 60, 12, 1, 3), (3, 40, 30, 6, 4), (4, 4, 3, 1, 10)])
def test_same_rows_as_the_full_search(spark, seed, n, words, repeat, k):
    """Many terms, terms in most claims (weights under 0), repeated claims (ties at the threshold), fewer claims than k."""
    claims = corpus(spark, seed, n, words, repeat)
    questions = asked(claims, 7)
    assert rows(es.bm25(questions, claims, FIELDS, k)) == rows(rt.bm25(questions, claims, FIELDS, k))
    assert rows(es.bm25(questions, claims, FIELDS, k, exclude_self=False)) == rows(rt.bm25(questions, claims, FIELDS, k, exclude_self=False))


def test_empty_tables(spark):
    claims = corpus(spark, 5, 20, 10)
    assert rows(es.bm25(asked(claims, 3).filter("false"), claims, FIELDS)) == []
    assert rows(es.bm25(asked(claims, 3), claims.filter("false"), FIELDS)) == []


def test_frequent_terms_are_mostly_skipped(spark):
    """Three rare words and one that every second claim holds: its list isn't read, only what the others found is looked up."""
    rng = random.Random(6)
    texts = [" ".join([*(["common"] if i % 5 < 2 else []), *(f"r{rng.randint(0, 150)}" for _ in range(8))]) for i in range(3000)]
    claims = spark.createDataFrame([(i, 0, t, "", "x") for i, t in enumerate(texts)], SCHEMA)
    questions = claims.filter("id % 100 = 0").select(F.col("id").alias("qid"), "user_id", F.concat(F.lit("common "), F.substring_index("content", " ", -3)).alias("text"))
    hits, reads = es.stages(questions, claims, FIELDS, 5)
    assert rows(hits) == rows(rt.bm25(questions, claims, FIELDS, 5))
    r = reads.filter("term = 'common'").agg(F.sum("df"), F.sum("listed"), F.sum("looked_up")).first()
    assert r[1] + r[2] < 0.2 * r[0]


def test_whole_texts_of_the_given_table(spark):
    p = v.passages(spark, "/root/testdata/sf0.001")
    q = v.questions(p)
    assert rows(es.bm25(q, p, ["content", "entity", "attribute"], 10)) == rows(rt.bm25(q, p, ["content", "entity", "attribute"], 10))


@pytest.mark.parametrize(("seed", "n", "words", "repeat", "k"), [(7, 300, 200, 1, 5), (8, 60, 12, 2, 3), (9, 12, 6, 5, 40)])
def test_blocks_meet_in_tasks(spark, monkeypatch, seed, n, words, repeat, k):
    """Over many blocks and slices: the rows of the full search. Pairs of question and claim are made inside tasks, not by a shuffle."""
    monkeypatch.setattr(rt, "CLAIM_BLOCK", 150)
    monkeypatch.setattr(rt, "QUESTION_BLOCK", 60)
    claims = corpus(spark, seed, n, words, repeat)
    questions = asked(claims, 7)
    hits = es.bm25(questions, claims, FIELDS, k)
    assert "MapInArrow" in hits._jdf.queryExecution().toString()
    assert rows(hits) == rows(rt.bm25(questions, claims, FIELDS, k))


def test_slices_of_a_block():
    """A question's scores that reach its threshold don't depend on the other questions held with it; a short list is read instead of many lookups."""
    rng = np.random.default_rng(10)
    n_q, n_c, terms = 9, 50, 30
    held = rng.random((n_c, terms)) * (rng.random((n_c, terms)) < 0.3)
    w = np.where(rng.random((n_q, terms)) < 0.5, rng.random((n_q, terms)), 0) - 0.02 * (rng.random((n_q, terms)) < 0.1)
    full = w @ held.T
    row, term = np.nonzero(w)
    lists = es.Lists(*np.nonzero(held), held[held > 0])
    for theta in (np.zeros(n_q), np.sort(full, axis=1)[:, -5]):
        score, listed, looked_up = es.block_search(row, term, w[row, term], theta, np.full(n_q, -1), lists, n_c, 5, pairs=37)
        best = full >= np.sort(full, axis=1)[:, -5:-4]
        assert np.allclose(score[best & (full > 0)], full[best & (full > 0)]) and (listed + looked_up <= lists.n[np.searchsorted(lists.terms, term)]).all()
        for q in range(n_q):
            some = row == q
            alone = es.block_search(row[some] - q, term[some], w[row, term][some], theta[q : q + 1], np.array([-1]), lists, n_c, 5)
            assert np.allclose(alone[0][0], score[q]) and (alone[1] == listed[some]).all() and (alone[2] == looked_up[some]).all()
