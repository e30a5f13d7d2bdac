"""Quality classifier: a weak-label model of overlapping heuristic labellers, then a hashed linear scorer.

Ten heuristics each vote good, bad or abstain on every document. The votes of all documents are counted
by pattern (at most 3^10 patterns, however many documents), and expectation-maximisation over those counts
estimates the share of good documents and what each labeller says of good and of bad ones. The posterior
of a document's pattern is its soft label; a bounded sample of documents (``sample_limit``) with these
labels trains a logistic scorer on hashed byte 3-grams and hashed shape tokens, which then scores every
document. No given label is used, so the labels table can measure it.

Defined results: null and empty texts have no n-grams; their shape tokens (no words) make them bad;
repeated rows get equal rows; an empty table gives no rows. Extra columns are ignored (or carried
through by ``drop_bad``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, range_sums, small, table, with_columns, windows, word_hashes, word_table
from .quality_rules import base_counts, ngram_buckets
from .toxicity import sigmoid

SAMPLE = 4_000
BUCKETS = 1 << 11
SHAPES = 80  # further buckets, for shape tokens
LABELLERS = 10
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LOWER = np.isin(np.arange(256), list(range(97, 123)))
_OTHER = ~(_UPPER | _LOWER | np.isin(np.arange(256), list(range(48, 58))) | np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]) | (np.arange(256) >= 128))
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def shape(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each row: words; symbols a word; share of other characters than letters and digits; share of words that end in one; words in repeated windows; words equal to one of the two before; upper-case share; repeated lines; words equal to the one before; different word pairs."""
    words, chars, symbols, lines, repeated = base_counts(data, offsets)
    starts, ends, ranges = word_table(data, offsets)
    n = np.maximum(words, 1)
    upper, lower = range_sums(_UPPER[data], offsets), range_sums(_LOWER[data], offsets)
    others = range_sums(_OTHER[data], offsets) / np.maximum(chars, 1)
    endings = range_sums(~_OTHER[data[ends - 1]], ranges) / n
    hashes = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(words)), words)
    back = np.zeros((2, len(hashes)), bool)
    for lag in (1, 2):
        if len(hashes) > lag:
            back[lag - 1, lag:] = (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
    next_word, room = windows(hashes, ranges, 2)
    pairs = np.array([len(np.unique(next_word[a:b][room[a:b]])) for a, b in zip(ranges[:-1], ranges[1:], strict=True)]) / np.maximum(words - 1, 1)
    rows = np.maximum(range_sums(data == 10, offsets) + 1, 1)
    return np.stack([words, symbols / n, others, endings, repeated / n, range_sums(back.any(0), ranges) / n, upper / np.maximum(upper + lower, 1), lines / rows, range_sums(back[0], ranges) / n, pairs])


def votes(s: np.ndarray) -> np.ndarray:
    """Votes of the labellers by row: 2 good, 1 bad, 0 abstain. They overlap: each kind of bad text draws several."""
    words, symbols, others, endings, repeated, near, upper, lines, twice, pairs = s

    def vote(bad, good):
        return np.where(bad, 1, np.where(good, 2, 0))

    return np.stack([
        vote(words < 20, words >= 50),
        vote(symbols > 0.15, symbols < 0.02),
        vote(others > 0.12, others < 0.08),
        vote(endings < 0.6, endings > 0.7),
        vote(repeated > 0.3, repeated < 0.02),
        vote(near > 0.3, near < 0.15),
        vote(upper > 0.3, upper < 0.12),
        vote(lines > 0.3, lines < 0.02),
        vote(twice > 0.15, twice < 0.06),
        vote((words >= 5) & (pairs < 0.5), pairs > 0.75),
    ])


def patterns(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(LABELLERS)[:, None]).sum(0)


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """How many documents have each pattern of votes: all documents, at most 3^10 numbers."""

    def count(batches):
        total = np.zeros(3**LABELLERS, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("t")):
                total += np.bincount(patterns(votes(shape(data, offsets))), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["p", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    return {r.p: r.n for r in rows}


def label_model(counts: dict[int, int], rounds: int = 100, prior: float = 0.8) -> tuple[np.ndarray, float]:
    """Posterior P(good) by pattern, and the share of good documents, by expectation-maximisation.

    Each labeller has, for either class, its chances of each vote. Starting point: a bad vote is rare on
    good documents, while a bad document, having one fault, still draws good votes from the other labellers.
    """
    found = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in found], float)
    every = np.arange(3**LABELLERS)
    cast = lambda p: np.stack([p // 3**j % 3 for j in range(LABELLERS)])
    chance = np.zeros((2, LABELLERS, 3))
    chance[0], chance[1] = (0.2, 0.5, 0.3), (0.17, 0.03, 0.8)
    share = prior

    def posterior(p):
        v = cast(p)
        log = [np.log(chance[c][np.arange(LABELLERS)[:, None], v]).sum(0) for c in (0, 1)]
        return sigmoid(log[1] - log[0] + np.log(share / (1 - share)))

    v = cast(found)
    for _ in range(rounds if len(found) else 0):
        good = posterior(found)
        for c, mass in ((0, n * (1 - good)), (1, n * good)):
            for j in range(LABELLERS):
                seen = np.bincount(v[j], mass, 3) + 0.01 * mass.sum() / 3 + 0.1
                chance[c, j] = seen / seen.sum()
        share = float(np.clip((n * good).sum() / n.sum(), 0.05, 0.99))
    return posterior(every), share


def shape_tokens(s: np.ndarray) -> list[np.ndarray]:
    """Hashed tokens of the shape: each number's bin, as buckets after the n-grams'."""
    edges = ([5, 20, 50, 200], [0.02, 0.05, 0.15], [0.08, 0.12, 0.2], [0.3, 0.6, 0.7], [0.02, 0.1, 0.3, 0.6], [0.05, 0.15, 0.3], [0.06, 0.12, 0.3], [0.02, 0.3], [0.06, 0.15, 0.5], [0.25, 0.5, 0.75])
    return [BUCKETS + 8 * k + np.searchsorted(e, x, "right") for k, (e, x) in enumerate(zip(edges, s, strict=True))]


def features(data: np.ndarray, offsets: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Dense rows of hashed features: n-gram shares, and shape tokens of weight 0.1."""
    out = np.zeros((len(offsets) - 1, BUCKETS + SHAPES), np.float32)
    found = ngram_buckets(data, 3, BUCKETS)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= 3:
            out[i, :BUCKETS] = np.bincount(found[a : b - 2], minlength=BUCKETS) / (b - a - 2)
    for t in shape_tokens(s):
        out[np.arange(len(out)), t] = 0.1
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Logistic weights for soft labels (the last is the intercept), by adaptive gradient steps."""
    x = np.hstack([x, np.full((len(x), 1), 1.0, np.float32)])
    w, total = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-12)
    for _ in range(rounds if len(x) else 0):
        g = x.T @ (sigmoid(x @ w) - y).astype(np.float32) / len(y) + l2 * w
        total += g * g
        w -= 0.5 * g / np.sqrt(total)
    return w


def fit(docs: DataFrame, sample_limit: int = SAMPLE) -> np.ndarray:
    """The scorer's weights. Vote counts cover all documents; only the fit uses a bounded sample, chosen by hash."""
    good, _ = label_model(pattern_counts(docs))
    chosen = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(sample_limit)
    texts = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"))  # of texts with one id always the same

    def run(batches):
        for batch in batches:
            for part in small(batch, "t"):
                for at, to, data, offsets in chunks(part.column("t")):
                    s = shape(data, offsets)
                    x = features(data, offsets, s)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(at, to - at), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(patterns(votes(s)))], names=["doc_id", "x", "p"])

    schema = T.StructType([texts.schema["doc_id"], T.StructField("x", T.BinaryType()), T.StructField("p", T.LongType())])
    got = texts.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, BUCKETS + SHAPES)
    return fit_scorer(x, good[got.column("p").to_numpy().astype(np.int64)] if len(x) else np.zeros(0))


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", cut: float = 0.5) -> DataFrame:
    """docs with score (P(good), 0 to 1) and kept (score reaches ``cut``). One pass, no shuffle."""

    def make():
        def work(column):
            out = [np.zeros(0)]
            for _, _, data, offsets in chunks(column):
                s = shape(data, offsets)
                z = np.full(len(offsets) - 1, weights[-1])
                for t in shape_tokens(s):
                    z += 0.1 * weights[t]
                value = weights[ngram_buckets(data, 3, BUCKETS)]
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    if b - a >= 3:
                        z[i] += value[a : b - 2].mean()
                out.append(np.round(sigmoid(z), 6))
            score = np.concatenate(out)
            return [score, score >= cut]

        return work

    return with_columns(docs, [text], RESULT, make)


def quality_classifier(docs: DataFrame, sample_limit: int = SAMPLE) -> DataFrame:
    """doc_id, score and kept of every document."""
    return scored(docs.select("doc_id", "text"), fit(docs, sample_limit)).drop("text")


def drop_bad(docs: DataFrame, sample_limit: int = SAMPLE) -> DataFrame:
    """The documents that the scorer keeps, with their columns."""
    names = {n: f"in_{i}" for i, n in enumerate(docs.columns)}
    out = scored(docs.withColumnsRenamed(names), fit(docs, sample_limit), names["text"])
    return out.filter(F.col("kept")).select([F.col(v).alias(k) for k, v in names.items()])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))
