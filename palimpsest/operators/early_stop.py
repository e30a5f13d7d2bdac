"""BM25 that stops early and gives the rows of the full search.

A posting is worth its question weight times its impact, and the impact doesn't depend on the question.

1. Posting lists are cut into levels of like impact (no list is sorted). The levels of a question's largest possible contributions are read until
   they hold SEEDS * k postings. The best 2k claims of these are scored in full; the score of the k-th is the threshold.
2. Blocks of postings meet blocks of the questions' weighted terms on tenant and claim block, as in ``retrieve.bm25``, so that no pair of question and
   claim is shuffled. In a pair of blocks, terms whose largest contributions in the block together stay under the threshold can't lift a claim to it by
   themselves: their lists aren't read. Of the other lists, in order of impact, only the beginning is read that can reach the threshold with the most of all other terms.
3. What was read raises the threshold: the k-th largest sum of the block is a lower bound of the k-th score. Claims whose sum and the most of
   the unread terms reach it are looked up for those terms, or these lists are read after all if they are shorter than the lookups.

Every claim that reaches the threshold has its whole score, and k of them exist, so the k best are those of the full search,
ties included (the threshold is lowered by more than the rounding of a similarity). Questions with fewer than k seeds, or with
a threshold of 0 or less, read their whole lists. Terms of a weight of 0 or less are always looked up and never count as a gain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written
from . import retrieve
from .retrieve import B, EPSILON, K1, _dealt, _gathered, _spread, _term_key, postings, tokens, top_k

#: Levels of impact: an impact lies between 0 and K1 + 1.
LEVELS = 64
#: How many postings are read for the first threshold, for each wanted hit. It changes the work, not the rows.
SEEDS = 4
#: Relative to a question's largest possible score: similarities are rounded to nine places.
SLACK = 4e-9
#: Relative to the largest impact: impacts are compared within lists after a list's number was added.
NEAR = 1e-9


def table(claims: DataFrame, fields: list[str]) -> tuple[DataFrame, int]:
    """(user_id, id, term, impact, level) of all postings, and the number of claims that have any. Stored once in the shared folder."""
    p = written(postings(claims, fields), "postings")
    n, average = p.groupBy("id").agg(F.max("dl").alias("dl")).agg(F.count("*"), F.avg("dl")).first()
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
    level = F.least(F.lit(LEVELS - 1), F.floor(F.col("impact") * LEVELS / (K1 + 1)))
    return p.withColumn("impact", impact).select("user_id", "id", "term", "impact", level.cast("int").alias("level")), n


def weights(questions: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """(qid, user_id, term, w): the questions' terms with their weights."""
    df = blocks.groupBy("term").agg(F.sum("n").alias("df")).withColumn("raw_idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = df.agg(F.avg("raw_idf").alias("mean_idf"))  # one row
    idf = df.crossJoin(mean).select("term", F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))
    asked = questions.select("qid", "user_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "user_id", "term").agg(F.count("*").alias("qtf"))
    return asked.join(idf, "term").select("qid", "user_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def _kth(rows: DataFrame, score: str, k: int, name: str) -> DataFrame:
    """(qid, name): the k-th largest score of each question that has k rows."""
    return top_k(rows, score, k, "id").filter(F.col("rank") == k).select("qid", F.col(score).alias(name))


def _looked_up(p: DataFrame, wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id, term, gain): postings of the wanted (qid, user_id, id) for the terms (qid, term, w)."""
    return p.join(wanted.select("qid", "user_id", "id"), ["user_id", "id"]).join(terms.select("qid", "term", "w"), ["qid", "term"]).select("qid", "user_id", "id", "term", (F.col("w") * F.col("impact")).alias("gain"))


class Lists:
    """The postings of a claim block: (row, term number, impact) by term, the largest impacts first."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((-impact, term))
        self.row, self.impact = row[order], impact[order]
        self.terms, self.start, self.n = np.unique(term[order], return_index=True, return_counts=True)
        place = np.repeat(np.arange(len(self.terms)), self.n)
        self.falling = place * 4.0 + (K1 + 1 - self.impact)
        cell = self.row * len(self.terms) + place
        self.by_cell = np.argsort(cell)
        self.cells = cell[self.by_cell]

    def of(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists' numbers, and whether there are such."""
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        return at, self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)

    def beginning(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many postings of each list have an impact of at least ``least``."""
        last = np.searchsorted(self.falling, at * 4.0 + (K1 + 1 - np.clip(least - NEAR, 0, K1 + 1)), "right")
        return np.clip(last - self.start[at], 0, self.n[at])

    def held(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The impacts of rows in lists, 0 where there is no posting."""
        cell = row * len(self.terms) + at
        found = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[found] == cell, self.impact[self.by_cell[found]], 0.0)


def _runs(sizes: np.ndarray, most: int):
    """Ranges (from, to) of items that have about ``most`` together."""
    run = np.cumsum(sizes) // most
    return zip(*(np.searchsorted(run, np.unique(run), side) for side in ("left", "right")), strict=True)


def block_search(row: np.ndarray, term: np.ndarray, w: np.ndarray, theta: np.ndarray, own: np.ndarray, lists: Lists, n_claims: int, k: int, pairs: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of questions x claims, 0 where a claim can't reach its question's threshold; and of each weighted term (row, term, w), how many postings were listed and looked up.

    theta: the questions' thresholds, 0 without one; own: the claim's row that is the question itself, or -1.
    """
    shape = (len(theta), n_claims)
    listed, looked_up = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    slack = SLACK * (K1 + 1) * np.bincount(row, np.maximum(w, 0), len(theta))
    bar = np.maximum(theta - slack, 0)
    at, there = lists.of(term)
    e = np.nonzero(there)[0]
    most = np.maximum(0, w[e] * lists.impact[lists.start[at[e]]])
    order = np.lexsort((most, row[e]))
    e, most = e[order], most[order]
    r, at, v = row[e], at[e], w[e]
    all_most = np.bincount(r, most, len(theta))
    first = np.concatenate([[0.0], np.cumsum(most)])[np.searchsorted(r, r)]
    essential = (v > 0) & (np.cumsum(most) - first >= bar[r])
    part = np.zeros(shape)

    def read(some: np.ndarray, n: np.ndarray) -> None:
        listed[e[some]] += n
        for i, j in _runs(n, pairs):
            x, times = some[i:j], n[i:j]
            cells = _spread(lists.start[at[x]], times)
            part.reshape(-1)[:] += np.bincount(np.repeat(r[x], times) * n_claims + lists.row[cells], np.repeat(v[x], times) * lists.impact[cells], part.size)

    some = np.nonzero(essential)[0]
    read(some, lists.beginning(at[some], (bar - all_most)[r[some]] / v[some] + most[some] / v[some]))
    itself = np.nonzero(own >= 0)[0]
    part[itself, own[itself]] = 0

    # a term of negative weight takes away from a sum, so that it is no lower bound
    rest = np.bincount(r[~essential], most[~essential], len(theta))
    if n_claims >= k:
        risen = np.partition(part, n_claims - k, axis=1)[:, n_claims - k] - slack
        bar = np.maximum(bar, np.where(np.bincount(row, w < 0, len(theta)) == 0, risen, 0))
    left = (part > 0) & (part + rest[:, None] >= bar[:, None])
    n_left = left.sum(axis=1)
    more = np.nonzero(~essential & (n_left[r] > 0))[0]
    lookups, length = np.bincount(r[more], n_left[r[more]], len(theta)), np.bincount(r[more], lists.n[at[more]], len(theta))
    by_list = (lookups > length)[r[more]]
    read(more[by_list], lists.n[at[more[by_list]]])
    more = more[~by_list]
    q, c = np.nonzero(left)
    begin = np.searchsorted(q, r[more])
    times = n_left[r[more]]
    for i, j in _runs(times, pairs):
        x, n = more[i:j], times[i:j]
        claim = c[_spread(begin[i:j], n)]
        impact = lists.held(claim, np.repeat(at[x], n))
        np.add.at(looked_up, e[np.repeat(x, n)[impact > 0]], 1)
        part.reshape(-1)[:] += np.bincount(np.repeat(r[x], n) * n_claims + claim, np.repeat(v[x], n) * impact, part.size)
    part[~left | (part < bar[:, None])] = 0
    return np.maximum(part, 0), listed, looked_up


def _searched(k: int, exclude_self: bool, counted: bool):
    """For mapInArrow over rows (q, c) of question and claim blocks: (qid, claim_id, score) of each question's k best, and of what rounding may put among them; or what was read (qid, term, listed, looked_up)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = batch.column("q")[i].values, batch.column("c")[i].values
                (qid, row), (cid, row_c) = (np.unique(x.field("id").to_numpy(), return_inverse=True) for x in (q, c))
                order = np.argsort(row, kind="stable")
                row, term, w, bars = (x[order] for x in (row, q.field("term").to_numpy(), q.field("w").to_numpy(), q.field("theta").to_numpy()))
                lists = Lists(row_c, c.field("term").to_numpy(), c.field("impact").to_numpy())
                same = np.minimum(np.searchsorted(cid, qid), len(cid) - 1)
                own = np.where((cid[same] == qid) & exclude_self, same, -1)
                step = max(1, retrieve.CELLS // len(cid))
                for at in range(0, len(qid), step):
                    few, some = qid[at : at + step], slice(*np.searchsorted(row, (at, at + step)))
                    theta = np.zeros(len(few))
                    theta[row[some] - at] = bars[some]
                    score, listed, looked_up = block_search(row[some] - at, term[some], w[some], theta, own[at : at + step], lists, len(cid), k)
                    if counted:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[row[some]], term[some], listed, looked_up)], names=["qid", "term", "listed", "looked_up"])
                        continue
                    slack = SLACK * (K1 + 1) * np.bincount(row[some] - at, np.maximum(w[some], 0), len(few))
                    take = min(k, len(cid))
                    last = np.partition(score, len(cid) - take, axis=1)[:, len(cid) - take]
                    rows, hit = np.nonzero((score > 0) & (score >= (last - slack)[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(few[rows]), pa.array(cid[hit]), pa.array(score[rows, hit])], names=["qid", "claim_id", "score"])

    return run


def stages(questions: DataFrame, claims: DataFrame, fields: list[str], k: int = 100, exclude_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """hits (qid, claim_id, similarity, rank), and reads (qid, term, df, listed, looked_up): how many of a list's postings were read after the threshold, and how."""
    p, n = table(claims, fields)
    levels = written(p.groupBy("user_id", "term", "level").agg(F.count("*").alias("n"), F.max("impact").alias("top")), "levels")
    w = written(weights(questions, levels, n), "weights")
    own = F.col("id") == F.col("qid") if exclude_self else F.lit(False)

    # what a level can give at most; terms without a posting for the question's tenant give nothing
    b = w.filter("w > 0").join(levels, ["user_id", "term"]).withColumn("most", F.col("w") * F.col("top"))
    before = Window.partitionBy("qid").orderBy(F.desc("most"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    seeds = b.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("ahead") < SEEDS * k)
    partial = p.join(seeds.select("qid", "user_id", "term", "level", "w"), ["user_id", "term", "level"]).filter(~own).groupBy("qid", "user_id", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("part"))
    full = _looked_up(p, top_k(partial, "part", 2 * k, "id"), w).groupBy("qid", "id").agg(F.sum("gain").alias("score"))
    threshold = _kth(full, "score", k, "theta").filter("theta > 0")

    number = _term_key(levels.groupBy("term").agg(F.sum("n").alias("df")))
    weighted = written(w.join(threshold, "qid", "left").select(F.col("qid").alias("id"), "user_id", number(F.col("term")).alias("term"), "w", F.coalesce("theta", F.lit(0.0)).alias("theta")), "weighted")
    c, counts = _dealt(p.select("user_id", "id", number(F.col("term")).alias("term"), "impact"), "id", retrieve.CLAIM_BLOCK)
    q, _ = _dealt(weighted, "id", retrieve.QUESTION_BLOCK)
    c = _gathered(c, ["user_id", "b"], "c", ["id", "term", "impact"])
    q = _gathered(q, ["user_id", "b"], "q", ["id", "term", "w", "theta"]).drop("b")
    q = q.join(counts, "user_id").select("user_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    blocks = q.join(c, ["user_id", "b"]).select("q", "c")
    total = blocks.mapInArrow(_searched(k, exclude_self, False), "qid long, claim_id long, score double")
    similarity = F.round(F.least(F.lit(1.0), F.col("score") / F.max("score").over(Window.partitionBy("qid"))), 9)
    hits = top_k(total.withColumn("similarity", similarity), "similarity", k).drop("score")

    read = blocks.mapInArrow(_searched(k, exclude_self, True), "qid long, number long, listed long, looked_up long").groupBy("qid", "number").agg(F.sum("listed").alias("listed"), F.sum("looked_up").alias("looked_up"))
    df = w.join(levels, ["user_id", "term"]).groupBy("qid", "term").agg(F.sum("n").alias("df"))
    reads = df.withColumn("number", number(F.col("term"))).join(read, ["qid", "number"]).select("qid", "term", "df", "listed", "looked_up")
    return hits, reads


def bm25(questions: DataFrame, claims: DataFrame, fields: list[str], k: int = 100, exclude_self: bool = True) -> DataFrame:
    """The rows of ``retrieve.bm25``, from a part of the postings."""
    return stages(questions, claims, fields, k, exclude_self)[0]
