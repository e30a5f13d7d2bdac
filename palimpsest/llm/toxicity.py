"""Toxicity: cumulative-link ordinal regression on sparse text features.

Each different word of a text gives hashed features: the word and its first 3, 4 and 5 letters. One weight
vector w is shared by all thresholds t1 < t2: P(grade > k) = sigmoid(x.w - t(k+1)) for the grades 0 (clean),
1 and 2. The expected severity is the sum of those probabilities, from 0 to 2.

Labels say toxic or not; toxic sample documents are graded 2 if they use at least the median number of
marker words (features that toxic documents have and clean ones hardly ever), else 1. The model is
fitted on a bounded sample of labelled documents (``sample_limit``), with an L1 penalty, so that only
features with evidence keep a weight; every document is scored, whole.

Defined results: null, empty and wordless texts have no features, so the severity of the intercepts
alone, grade 0; repeated rows get equal rows; of texts with one id the fit reads the smallest; an empty table gives no rows; without toxic labels, or
features that tell them apart, every grade is 0 and severity 0. Extra columns are ignored (or carried through by ``drop_toxic``).
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, small, table, with_columns, written

SAMPLE = 12_000
PREFIXES = (3, 4, 5)
MAX_FEATURES = 20_000
MIN_ODDS = 1.0  # features as frequent in toxic as in clean texts say nothing
CACHE_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
RESULT = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    return (crc32(word.encode("utf-8", "surrogatepass")), *(crc32(f"{n}^{word[:n]}".encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) > n))


def sparse_features(text: str | None) -> tuple[list[int], list[int]]:
    """Feature hashes of a text, and how many of its different words have each."""
    found: dict[int, int] = {}
    for word in set(_WORD.findall((text or "").lower())):
        for f in word_features(word):
            found[f] = found.get(f, 0) + 1
    return list(found), list(found.values())


def sample_features(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, toxic, f, c) of the labelled sample: the only texts that the fit depends on. One text for each id, so at most ``limit`` rows."""
    chosen = labelled_sample(labels, F.col("toxic").isNotNull(), limit)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = found.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.min("text").alias("text"))  # of texts with one id always the same

    def run(batches):
        for batch in batches:
            for part in small(batch, "text"):
                found = [sparse_features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array([f for f, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int32()))], names=["doc_id", "toxic", "f", "c"])

    return texts.mapInArrow(run, "doc_id long, toxic int, f array<long>, c array<int>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, l1: float = 1e-5, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds of the cumulative-link model, by accelerated proximal gradient steps on the mean log loss."""
    n, top = len(grades), int(grades.max(initial=0))
    v = np.ones(n_features)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = np.bincount(cols, values * np.bincount(rows, values * v[cols], n)[rows], n_features)
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1 / max(size / n, 1.0)
    w, thresholds = np.zeros(n_features), np.linspace(1.0, 2.0, max(top, 1))
    seen, t_seen, momentum = w.copy(), thresholds.copy(), 1.0
    for _ in range(rounds):
        x = np.bincount(rows, values * seen[cols], n)
        upper = sigmoid(np.append(t_seen, 40.0)[np.minimum(grades, len(t_seen))] - x)
        upper[grades == top] = 1.0
        lower = np.where(grades > 0, sigmoid(t_seen[np.maximum(grades - 1, 0)] - x), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gradient = np.bincount(cols, values * ((du - dl) / n)[rows], n_features)
        t_gradient = np.array([(np.where(grades == k, -du, 0) + np.where(grades == k + 1, dl, 0)).sum() / n for k in range(len(t_seen))])
        moved = seen - step * gradient
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        t_moved = np.maximum.accumulate(t_seen - step * t_gradient) + np.arange(len(t_seen)) * 1e-6
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        seen, t_seen = moved + (momentum - 1) / after * (moved - w), np.maximum.accumulate(t_moved + (momentum - 1) / after * (t_moved - thresholds))
        w, thresholds, momentum = moved, t_moved, after
    return w, thresholds


def fit(docs: DataFrame, labels: DataFrame, sample_limit: int = SAMPLE) -> tuple[dict[int, float], list[float]]:
    """Weights by feature hash (only those that aren't 0) and thresholds, from a bounded labelled sample."""
    sample = written(sample_features(docs, labels, sample_limit).withColumn("row", F.monotonically_increasing_id()), "features")
    one = sample.select("row", (F.col("toxic") > 0).alias("toxic")).orderBy("row").toArrow()  # at most as many rows as the sample has documents
    toxic = np.asarray(one.column("toxic").to_numpy(), bool)
    if not toxic.any():
        return {}, [40.0, 40.0]
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    each = sample.select("row", (F.col("toxic") > 0).cast("int").alias("t"), F.explode(F.arrays_zip("f", "c")).alias("x")).select("row", "t", "x.f", "x.c")
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n_clean + 1))
    counted = each.groupBy("f").agg(F.sum("t").alias("bad"), F.count("*").alias("n")).filter("n >= 3").withColumn("odds", odds).filter(F.abs("odds") >= MIN_ODDS)
    chosen = counted.orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "f").limit(MAX_FEATURES).select("f", ((F.col("odds") > 3) & (F.col("bad") >= 3)).alias("marker"))
    # only the chosen features' entries come to the driver: a few for each sampled document
    got = each.join(F.broadcast(chosen), "f").select("row", "f", "c", "marker").orderBy("row", "f").toArrow()
    rows = np.searchsorted(one.column("row").to_numpy(), got.column("row").to_numpy())
    if not got.num_rows:  # nothing tells toxic from clean texts
        return {}, [40.0, 40.0]
    ids, cols = np.unique(got.column("f").to_numpy(), return_inverse=True)
    values = got.column("c").to_numpy().astype(float)
    strength = np.bincount(rows, values * np.asarray(got.column("marker").to_numpy(), bool), len(toxic))
    grades = np.where(toxic, np.where(strength >= np.median(strength[toxic]), 2, 1), 0)
    w, thresholds = fit_ordinal(rows, cols, values, grades, len(ids))
    return {int(f): float(x) for f, x in zip(ids, w, strict=True) if x}, [float(t) for t in thresholds]


def graded(docs: DataFrame, model: tuple[dict[int, float], list[float]], text: str = "text", cut: float = 0.5) -> DataFrame:
    """docs with severity, grade and toxic: toxic if P(grade > 0) reaches ``cut``. One pass, no shuffle."""
    weights, thresholds = model

    def make():
        known: dict[str, float] = {}

        def worth(word: str) -> float:
            value = known.get(word)
            if value is None:
                if len(known) >= CACHE_WORDS:  # only a memory bound; what falls out is computed again
                    known.clear()
                value = known[word] = sum(weights.get(f, 0.0) for f in word_features(word))
            return value

        def work(column):
            # sorted: sums of floats are the same in every run
            x = np.array([sum(sorted(v for v in map(worth, set(_WORD.findall(t.lower()))) if v)) if t else 0.0 for t in column.to_pylist()])
            above = np.stack([sigmoid(x - t) for t in thresholds]) if len(x) else np.zeros((len(thresholds), 0))
            return [np.round(above.sum(0), 6), (above >= 0.5).sum(0).astype(np.int32), above[0] >= cut]

        return work

    return with_columns(docs, [text], RESULT, make)


def toxicity(docs: DataFrame, labels: DataFrame, sample_limit: int = SAMPLE) -> DataFrame:
    """doc_id, severity, grade and toxic of every document."""
    return graded(docs.select("doc_id", "text"), fit(docs, labels, sample_limit)).drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_limit: int = SAMPLE) -> DataFrame:
    """The documents that aren't toxic, with their columns."""
    names = {n: f"in_{i}" for i, n in enumerate(docs.columns)}
    out = graded(docs.withColumnsRenamed(names), fit(docs, labels, sample_limit), names["text"])
    return out.filter(~F.col("toxic")).select([F.col(v).alias(k) for k, v in names.items()])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
