"""op1, op6, op9: counts against plain loops, separation on held-out rows, defined results of odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import quality_classifier, quality_rules, toxicity

from .helpers import WORDS, docs, edge_docs, edge_rows, empty_docs, labels

SF = "/root/testdata/sf0.01"


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(runs)
    covered = {j for i, r in enumerate(runs) if twice[r] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_loops(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(WORDS[:30], k=rnd.randrange(60))) + "\n" + "same line\n" * rnd.randrange(3) + "#" * rnd.randrange(4) for _ in range(40)] + [r[1] for r in edge_rows()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality_rules(rows, labels(spark)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_of(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_score_is_the_mean_log_ratio(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices("the calm river flows by old mill and green hill".split(), k=40)) for _ in range(8)] + [" ".join(rnd.choices("$$$ buy!! NOW!! cheap!!! *** %%%".split(), k=40)) for _ in range(2)]
    table = docs(spark, texts)
    trusted = spark.createDataFrame([(i,) for i in range(4)], "doc_id long")
    raw, target = quality_rules.ngram_counts(table, trusted)
    want = Counter()
    for t in texts:
        want.update(quality_rules.ngram_buckets(np.frombuffer(t.encode(), np.uint8)).tolist())
    assert {int(b): int(raw[b]) for b in np.flatnonzero(raw)} == dict(want)
    assert target.sum() == sum(len(t) - 3 for t in texts[:4])
    rows = {r.doc_id: r for r in quality_rules.quality_rules(table, labels(spark, [(i, 1, 0) for i in range(4)])).collect()}
    assert rows[5].kept and not rows[9].kept and rows[9].score < -1 < 0 < rows[5].score


@pytest.mark.parametrize("operator", [lambda d, s: quality_rules.quality_rules(d, labels(s, [(1, 1, 0)])), lambda d, s: toxicity.toxicity(d, labels(s, [(1, 1, 0), (6, 0, 1)])), lambda d, s: quality_classifier.quality_classifier(d)])
def test_odd_rows(spark, operator):
    rows = operator(edge_docs(spark), spark).collect()
    assert len(rows) == len(edge_rows())
    assert len({str(r) for r in rows if r.doc_id == 1}) == 1
    assert operator(empty_docs(spark), spark).count() == 0


def test_filters_carry_columns_and_never_replace_them(spark):
    d = edge_docs(spark)
    for kept in (toxicity.drop_toxic(d, labels(spark)), quality_classifier.drop_bad(d)):
        assert kept.schema == d.schema
        assert {str(r) for r in kept.collect()} <= {str(r) for r in d.collect()}
    assert toxicity.drop_toxic(d, labels(spark)).count() == d.count()


def test_toxicity_on_held_out_labels(spark):
    d, all_ = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(d, all_.filter("doc_id % 3 <> 0"))
    rows = toxicity.graded(d.select("doc_id", "text"), model).join(all_.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    clean, bad = [r.toxic for r in rows if not r.label], [r.toxic for r in rows if r.label]
    assert sum(clean) <= 0.02 * len(clean) and sum(bad) >= 0.75 * len(bad)
    assert all(0 <= r.severity <= 2 for r in rows) and all((r.grade > 0) == r.toxic for r in rows)


def test_scores_equal_plain_loops(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices("Calm river $$$ buy *** Mill é FLOWS".split(), k=rnd.randrange(1, 60))) for _ in range(60)] + [None, "", "abc", "x y"]
    table = docs(spark, [t or "" for t in texts[:60]]).select("doc_id", "text").unionByName(spark.createDataFrame([(60 + i, t) for i, t in enumerate(texts[60:])], "doc_id long, text string"))
    ratio = np.array([rnd.uniform(-2, 2) for _ in range(quality_rules.BUCKETS)])
    weights = np.array([rnd.uniform(-3, 3) for _ in range(quality_classifier.BUCKETS + quality_classifier.SHAPES + 1)])
    words = {w for t in texts if t for w in re.findall(r"[^\W\d_]+", t.lower())}
    model = {f: rnd.uniform(-0.3, 0.3) for w in sorted(words) for f in toxicity.word_features(w)}, [-0.2, 0.4]
    one = {r.doc_id: r for r in quality_rules.scored(table, ratio).collect()}
    nine = {r.doc_id: r for r in quality_classifier.scored(table, weights).collect()}
    six = {r.doc_id: r for r in toxicity.graded(table, model).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        values = [ratio[quality_rules.ngram_buckets(np.frombuffer(raw[k : k + 4], np.uint8))[0]] for k in range(len(raw) - 3)]
        assert one[i].score == pytest.approx(sum(values) / len(values) if values else 0.0, abs=1e-8)
        assert one[i].kept == (not one[i].base_failed and one[i].score >= quality_rules.MIN_SCORE)
        data = np.frombuffer(raw, np.uint8)
        z = weights[-1] + 0.1 * sum(weights[k[0]] for k in quality_classifier.shape_tokens(quality_classifier.shape(data, np.array([0, len(raw)]))))
        values = [weights[quality_rules.ngram_buckets(data[k : k + 3], 3, quality_classifier.BUCKETS)[0]] for k in range(len(raw) - 2)]
        score = 1 / (1 + math.exp(-z - (sum(values) / len(values) if values else 0.0)))
        assert nine[i].score == pytest.approx(score, abs=2e-6) and nine[i].kept == (nine[i].score >= 0.5)
        x = sum(model[0][f] for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())) for f in toxicity.word_features(w))
        above = [1 / (1 + math.exp(k - x)) for k in model[1]]
        assert six[i].severity == pytest.approx(sum(above), abs=2e-6) and six[i].grade == sum(p >= 0.5 for p in above) and six[i].toxic == (above[0] >= 0.5)


def test_log_ratio_by_its_definition():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 50, 1000)
    good = rng.binomial(raw, 0.3)
    prior, total, kept = min(50_000.0, 0.01 * good.sum()), sum(c + 0.1 for c in raw), good.sum()
    for b, value in enumerate(quality_rules.log_ratio(raw, good)):
        p = (raw[b] + 0.1) / total
        assert value == pytest.approx(math.log((good[b] + prior * p) / (kept + prior)) - math.log(p))


def test_the_toxic_sample_is_bounded(spark):
    table = docs(spark, ["same id"] * 9000).withColumn("doc_id", F.when(F.col("doc_id") < 6000, F.col("doc_id") % 2).otherwise(F.col("doc_id")))
    sample = toxicity.sample_features(table, labels(spark, [(i, 1, i % 2) for i in [0, 1, *range(6000, 6300)]]), 10)
    assert sample.count() == 10
    everything = toxicity.sample_features(table, labels(spark, [(0, 1, 0), (1, 1, 1)]), 10).collect()
    assert sorted((r.doc_id, r.toxic) for r in everything) == [(0, 0), (1, 1)]


def test_ordinal_fit_recovers_thresholds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    z = x @ np.array([1.5, -1.0]) + rng.logistic(size=4000)
    grades = (z > -0.5).astype(int) + (z > 1.5)
    rows, cols = np.repeat(np.arange(4000), 2), np.tile([0, 1], 4000)
    w, t = toxicity.fit_ordinal(rows, cols, x.ravel(), grades, 2, rounds=2000)
    assert np.allclose(w, [1.5, -1.0], atol=0.15) and np.allclose(t, [-0.5, 1.5], atol=0.15)


def test_weak_labels_against_the_given_ones(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality_classifier.quality_classifier(d).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    v = np.zeros((quality_classifier.LABELLERS, 20_000), int)
    for j in range(quality_classifier.LABELLERS):
        right = rng.random(20_000) < 0.85
        v[j] = np.where(rng.random(20_000) < 0.3, 0, np.where(good == right, 2, 1))
    posterior, share = quality_classifier.label_model(dict(Counter(quality_classifier.patterns(v).tolist())))
    assert share == pytest.approx(0.8, abs=0.03)
    assert np.mean((posterior[quality_classifier.patterns(v)] > 0.5) == good) > 0.95
