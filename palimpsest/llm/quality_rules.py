"""Quality rules: base rules, then the log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

The method: each text is a bag of hashed byte n-grams. One multinomial is counted over the trusted
documents, one over every document of the corpus; a document's score is the mean over its n-grams of
log p(target) - log p(raw), so it does not depend on length. A document is kept if the score reaches a
fixed threshold, so the verdict is a function of text and counts alone: no random draw.

Defined results: null and empty texts have 0 words and fail the base rules (score 0); repeated rows get
equal rows; an empty table gives no rows; without trusted documents both multinomials are equal, every
score is 0 and only the base rules decide. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, labelled_sample, range_sums, small, table, with_columns, windows, word_hashes, word_table, mix

NGRAM = 4
BUCKETS = 1 << 16
MIN_SCORE = -0.6
TRUSTED = 20_000
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTER = (np.arange(256) & 0xC0) != 0x80
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def ngram_buckets(data: np.ndarray, n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the n bytes from each place on (the last n - 1 places are incomplete)."""
    x = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for k in range(n if len(x) else 0):
        x = (x << np.uint64(8)) | data[k : len(data) - n + 1 + k].astype(np.uint64)
    return (mix(x) % np.uint64(buckets)).astype(np.int64)


def ngram_counts(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket of all documents, and of the trusted ones (a bounded table, broadcast).

    Each task sums its own texts into BUCKETS numbers, so at most BUCKETS rows per task are shuffled and BUCKETS rows reach the driver.
    """
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(trusted.select(F.col(key).alias("k"), F.lit(1).alias("good"))), "k", "left").select("t", "good")

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at, to, data, offsets in chunks(batch.column("t")):
                found = ngram_buckets(data)
                inside = np.zeros(len(data) + 1, np.int64)
                for a, b, g in zip(offsets[:-1], offsets[1:], batch.column("good").slice(at, to - at).to_pylist(), strict=True):
                    if b - a >= NGRAM:
                        inside[a : b - NGRAM + 1] = 2 if g else 1
                inside = inside[: len(found)]
                raw += np.bincount(found[inside > 0], minlength=BUCKETS)
                good += np.bincount(found[inside > 1], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], names=["b", "raw", "good"])

    rows = marked.mapInArrow(count, "b long, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = rows.column("b").to_numpy()
    raw[at], good[at] = rows.column("raw").to_numpy(), rows.column("good").to_numpy()
    return raw, good


def log_ratio(raw: np.ndarray, good: np.ndarray, prior: float = 50_000.0) -> np.ndarray:
    """log p(target) - log p(raw) by bucket. The target is smoothed by ``prior`` n-grams spread as the raw corpus is, so rare buckets stay near 0."""
    if not raw.sum() or not good.sum():
        return np.zeros(len(raw))
    prior = min(prior, 0.01 * float(good.sum()))
    p = (raw + 0.1) / (raw + 0.1).sum()
    q = (good + prior * p) / (good.sum() + prior)
    return np.log(q / p)


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each row of a chunk: words, their code points, symbols, repeated lines, words in repeated windows of 8."""
    starts, ends, ranges = word_table(data, offsets)
    n_words = np.diff(ranges)
    space = _SPACE[data]
    chars, symbols = range_sums(_LETTER[data] & ~space, offsets), range_sums(_SYMBOLS[data], offsets)
    lines = np.zeros(len(n_words), np.int64)
    raw = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if n_words[i] and (found := raw[a:b].split(b"\n"))[1:]:
            found = [x for x in found if x.strip()]
            lines[i] = len(found) - len(set(found))
    keys, room = windows(word_hashes(data, starts, ends), ranges, 8)
    row = np.repeat(np.arange(len(n_words)), n_words).astype(np.uint64)
    places = np.flatnonzero(room)
    keys = mix(keys[places] + row[places] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        equal = keys[order][1:] == keys[order][:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, places[same], 1)
    np.add.at(step, places[same] + 8, -1)
    return [n_words, chars, symbols, lines, range_sums(np.cumsum(step[:-1]) > 0, ranges)]


def scored(docs: DataFrame, ratio: np.ndarray, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs with the columns of RESULT. One pass, no shuffle; only BUCKETS numbers are shipped to the tasks."""

    def make():
        def work(column):
            out = [[] for _ in RESULT]
            for _, _, data, offsets in chunks(column):
                base = base_counts(data, offsets)
                value = np.append(ratio[ngram_buckets(data)], np.zeros(min(NGRAM - 1, len(data)) + 1))
                score = np.zeros(len(offsets) - 1)
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    if b - a >= NGRAM:
                        score[i] = round(float(value[a : b - NGRAM + 1].mean()), 9)
                failed = (base[0] < 20) | (100 * base[4] > 30 * base[0])
                for o, v in zip(out, [*base, failed, score, ~failed & (score >= min_score)], strict=True):
                    o.append(v)
            return [np.concatenate(o) if o else np.zeros(0) for o in out]

        return work

    return with_columns(docs, [text], RESULT, make)


def quality_rules(docs: DataFrame, labels: DataFrame, trusted_limit: int = TRUSTED, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id and the columns of RESULT for every document.

    The trusted target is a bounded sample (``trusted_limit`` labelled documents, good and not toxic); the raw counts and the verdicts cover all documents.
    """
    trusted = labelled_sample(labels, (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), trusted_limit)
    ratio = log_ratio(*ngram_counts(docs, trusted))
    return scored(docs.select("doc_id", "text"), ratio, min_score=min_score).drop("text")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
