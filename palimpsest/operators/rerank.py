"""Re-ranking: hits (qid, claim_id, similarity) and claims -> ranked rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors as vx
from .retrieve import top_k

WEIGHTS = {"semantic": 0.6, "recency": 0.2, "authority": 0.15, "pin": 0.05}
HALF_LIFE_DAYS = 30.0


def weighted(hits: DataFrame, claims: DataFrame, now: Column, k: int = 10, weights: dict[str, float] | None = None, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """semantic, recency, authority and pin, their weighted sum and its reason; the k best."""
    w = weights or WEIGHTS
    if abs(sum(w.values()) - 1) > 0.01 or min(w.values()) < 0:
        raise ValueError("weights must be non-negative and sum to 1")
    rows = hits.join(claims.select(F.col("id").alias("claim_id"), "ts", "authority", "pinned"), "claim_id")
    rows = rows.select("qid", "claim_id", F.col("similarity").alias("semantic"), vx.recency(now, F.col("ts"), half_life).alias("recency"), "authority", F.when(F.col("pinned"), 1.0).otherwise(0.0).alias("pin"), "ts")
    rows = rows.withColumn("final_score", sum((w[c] * F.col(c) for c in w), F.lit(0.0)))
    reason = F.format_string("semantic=%.2f, recency=%.2f, authority=%.2f, pin=%.2f, final=%.2f", "semantic", "recency", "authority", "pin", "final_score")
    return top_k(rows.withColumn("score_reason", reason), "final_score", k)


def pair_scored(hits: DataFrame, scores: DataFrame, keep: int, logits: bool = True) -> DataFrame:
    """Similarity replaced by an external pair score (qid, claim_id, score); the best ``keep``."""
    value = vx.sigmoid(F.col("score")) if logits else vx.clamp01(F.col("score"))
    return top_k(hits.select("qid", "claim_id").join(scores, ["qid", "claim_id"]).select("qid", "claim_id", value.alias("similarity")), "similarity", keep)


def two_stage(hits, scores, claims, now, keep: int = 25, k: int = 10) -> DataFrame:
    return weighted(pair_scored(hits, scores, keep).drop("rank"), claims, now, k)


def three_stage(hits, scores, order, claims, now, keep: int = 20, keep_list: int = 15, k: int = 10) -> DataFrame:
    """Pair score, then an external order (qid, claim_id, position) as 1 - position / n, then the weighted score."""
    first = pair_scored(hits, scores, keep).select("qid", "claim_id", "rank")
    repaired = order_repaired(first, order).filter(F.col("position") <= keep_list)
    n = F.count("*").over(Window.partitionBy("qid"))
    return weighted(repaired.withColumn("similarity", 1 - (F.col("position") - 1) / n).select("qid", "claim_id", "similarity"), claims, now, k)


def ensemble(primary: DataFrame, secondary: DataFrame, weight: float = 0.7) -> DataFrame:
    """weight * primary + rest * secondary; an absent score is the list's smallest for that question."""
    p, s = (x.select("qid", "claim_id", F.col("similarity").alias(n)) for x, n in ((primary, "p"), (secondary, "s")))
    low = [x.groupBy("qid").agg(F.min(n).alias(f"low_{n}")) for x, n in ((p, "p"), (s, "s"))]
    rows = p.join(s, ["qid", "claim_id"], "full").join(low[0], "qid", "left").join(low[1], "qid", "left")
    parts = [F.coalesce(n, f"low_{n}", F.lit(0.0)) for n in ("p", "s")]
    return rows.select("qid", "claim_id", (weight * parts[0] + (1 - weight) * parts[1]).alias("similarity"))


def polarity_adjusted(ranked: DataFrame, questions: DataFrame, claims: DataFrame, score: str = "final_score") -> DataFrame:
    """Agreeing polarity times 1.05 (1 at most), disagreeing times 0.7."""
    q = questions.select("qid", tx.is_negated(F.col("text")).alias("q_neg"))
    c = claims.select(F.col("id").alias("claim_id"), tx.is_negated(F.col("content")).alias("c_neg"))
    value = F.when(F.col("q_neg") == F.col("c_neg"), F.least(F.lit(1.0), F.col(score) * 1.05)).otherwise(F.col(score) * 0.7)
    return ranked.join(q, "qid").join(c, "claim_id").withColumn(score, value).drop("q_neg", "c_neg")


def order_repaired(hits: DataFrame, order: DataFrame) -> DataFrame:
    """(qid, claim_id, position): an external order made a permutation of the hits: unknown and repeated ids go, missing ones follow in rank order."""
    listed = order.join(hits.select("qid", "claim_id"), ["qid", "claim_id"], "left_semi").groupBy("qid", "claim_id").agg(F.min("position").alias("place"))
    rows = hits.select("qid", "claim_id", "rank").join(listed, ["qid", "claim_id"], "left")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("place").isNull(), "place", "rank"))).select("qid", "claim_id", "position")


def scored_with_cache(pairs: DataFrame, cache: DataFrame, scorer: Column) -> DataFrame:
    """Scores of pairs (pair_key, ...): cached ones are reused, only the others are scored."""
    known = pairs.join(cache.select("pair_key", "score"), "pair_key")
    return known.select("pair_key", "score").unionByName(pairs.join(cache, "pair_key", "left_anti").select("pair_key", scorer.alias("score")))


def pair_key(question: Column, content: Column) -> Column:
    return F.sha1(F.concat_ws("\u001f", question, content))


def lexical_overlap(question: Column, content: Column) -> Column:
    """Default pair score: share of the question's word tokens that the text has."""
    q = F.array_distinct(tx.scored_tokens(question))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tx.scored_tokens(content))) / F.size(q))


def skip_resolution(ranked: DataFrame, questions: DataFrame, claims: DataFrame, threshold: float = 0.70, gap: float = 0.15, classify: Callable[[Column], Column] = tx.classify_query) -> DataFrame:
    """(qid, skip, reason): whether conflict resolution can be left out for a question."""
    values = ranked.join(claims.select(F.col("id").alias("claim_id"), "entity", "attribute", "value"), "claim_id").filter("entity is not null and attribute is not null")
    clash = values.groupBy("qid", "entity", "attribute").agg(F.count_distinct(F.coalesce("value", F.lit(""))).alias("n")).groupBy("qid").agg((F.max("n") > 1).alias("clash"))
    top = ranked.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("final_score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("final_score"))).alias("second"))
    rows = questions.select("qid", classify(F.col("text")).alias("h"), tx.is_list_question(F.col("text")).alias("list")).join(top, "qid", "left").join(clash, "qid", "left")
    reason = F.when(F.col("first").isNull(), "no ranked hits").when(F.col("h.is_multi_hop"), "multi-hop question").when(F.col("h.is_temporal"), "temporal question").when(F.col("list"), "list question").when(F.col("first") < threshold, "low confidence").when(F.col("first") - F.col("second") < gap, "ambiguous").when(F.col("clash"), "value conflict").otherwise("unambiguous")
    return rows.select("qid", reason.isin("multi-hop question", "temporal question", "list question", "unambiguous").alias("skip"), reason.alias("reason"), (F.col("first") - F.col("second")).alias("gap"))
