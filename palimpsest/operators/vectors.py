"""Exact nearest neighbours by blocks: matrix products of question blocks and claim blocks of one tenant."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 2048
#: Questions whose similarities to a block of claims are held at once.
SLICE = 256


def _counts(rows: DataFrame) -> DataFrame:
    """(user_id, n): how many blocks a tenant's rows have."""
    return rows.groupBy("user_id").agg(F.ceil(F.count("*") / BLOCK).alias("n"))


def _blocks(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """(user_id, b, <prefix>: array of structs) of about BLOCK rows each; a large tenant has many."""
    dealt = rows.join(_counts(rows), "user_id").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")))
    return dealt.groupBy("user_id", "b").agg(F.collect_list(F.struct(*columns)).alias(prefix))


def unit(column) -> np.ndarray:
    """The rows of an array column, of length one; zero vectors stay zero."""
    m = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def products(k: int, floor: float):
    """For mapInArrow over rows (q, c) of question and claim blocks: each question's k best claims of the block."""

    def best(qid, q, at, cid, c, lo, hi) -> pa.RecordBatch:
        # rounded, as products of equal vectors may differ in their last bits
        sim = np.round(np.clip(q @ c.T, -1, 1), 12)
        sim[(sim < floor) | (qid[:, None] == cid[None, :]) | (lo[None, :] > at[:, None]) | (hi[None, :] <= at[:, None])] = -np.inf
        take = min(k, sim.shape[1])
        last = np.partition(sim, sim.shape[1] - take, axis=1)[:, sim.shape[1] - take, None]
        above, level = sim > last, sim == last
        rows, top = np.nonzero(above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= take - above.sum(axis=1, keepdims=True))))
        value, hit = sim[rows, top], cid[top]
        good = np.isfinite(value)
        return pa.RecordBatch.from_arrays([pa.array(qid[rows][good]), pa.array(hit[good]), pa.array(value[good])], names=["qid", "claim_id", "similarity"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = batch.column("q")[i].values, batch.column("c")[i].values
                cid = two.field("id").to_numpy()
                # in order of id: of equal values at the k-th place, the smallest ids stay
                order = np.argsort(cid, kind="stable")
                side = [x[order] for x in (cid, unit(two.field("embedding")), two.field("lo").to_numpy(), two.field("hi").to_numpy())]
                for start in range(0, len(one), SLICE):
                    some = one.slice(start, SLICE)
                    yield best(some.field("id").to_numpy(), unit(some.field("vector")), some.field("at").to_numpy(), *side)

    return run


def nearest(questions: DataFrame, claims: DataFrame, k: int, floor: float = -1.0, as_of: bool = False) -> DataFrame:
    """(qid, claim_id, similarity): each question's k most similar claims of its tenant, itself excluded, with at least ``floor``.

    questions: (id, user_id, vector, as_of where asked for); claims: (id, user_id, embedding, valid_from, valid_to).
    Only blocks of rows are joined, on tenant and claim block, so that a large tenant is as many keys as it has
    blocks: each question block is sent to every claim block of its tenant. Each pair of blocks gives at most k rows a question. Equal similarities go to the smallest claim_id.
    """
    q = _blocks(questions.filter("vector is not null").select("user_id", "id", "vector", (F.unix_micros("as_of") if as_of else F.lit(0).cast("long")).alias("at")), "q", ["id", "vector", "at"]).drop("b")
    lo, hi = (F.unix_micros("valid_from"), F.coalesce(F.unix_micros("valid_to"), F.lit((1 << 62)))) if as_of else (F.lit(0).cast("long"), F.lit(1).cast("long"))
    rows = claims.filter("embedding is not null").select("user_id", "id", "embedding", lo.alias("lo"), hi.alias("hi"))
    c = _blocks(rows, "c", ["id", "embedding", "lo", "hi"])
    q = q.join(_counts(rows), "user_id").select("user_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))

    pairs = q.join(c, ["user_id", "b"]).select("q", "c").mapInArrow(products(k, floor), "qid long, claim_id long, similarity double")
    best = Window.partitionBy("qid").orderBy(F.desc("similarity"), "claim_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def knn_edges(claims: DataFrame, k: int = 4, floor: float = 0.45) -> DataFrame:
    """Undirected edges (src < dst, weight) between each claim and its k nearest of the tenant."""
    q = claims.select("id", "user_id", F.col("embedding").alias("vector"))
    hits = nearest(q, claims.select("id", "user_id", "embedding"), k, floor)
    return hits.select(F.least("qid", "claim_id").alias("src"), F.greatest("qid", "claim_id").alias("dst"), F.round("similarity", 4).alias("weight")).distinct()
