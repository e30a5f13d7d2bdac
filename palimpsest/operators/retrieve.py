"""Lexical retrieval, fusion, boosts and expansion: questions x claims -> hits (qid, claim_id, similarity)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..shared import written

WORD = r"[\p{L}\p{N}_]+"
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Postings of a claim block, and weighted terms of a question block.
CLAIM_BLOCK, QUESTION_BLOCK = 1 << 18, 1 << 17
#: Sums of questions and claims that a task holds at once.
CELLS = 1 << 22
HELPER_SOURCES = ["message-window", "entity-synthesis"]
FIELD_WEIGHTS = {"content": 1.0, "entity": 0.4, "value": 0.4, "attribute": 0.2}


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def postings(claims: DataFrame, fields: list[str]) -> DataFrame:
    """(id, user_id, dl, term, tf): terms of the fields together; dl is the claim's number of tokens."""
    rows = claims.select("id", "user_id", tokens(F.concat_ws(" ", *fields)).alias("words"))
    return rows.select("id", "user_id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("id", "user_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(p: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return p.groupBy("term").agg(F.count("*").alias("df"))


def _dealt(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """rows with block b, about ``most`` rows each and a key's rows together; and (user_id, n), the tenants' numbers of blocks."""
    counts = rows.groupBy("user_id").agg(F.ceil(F.count("*") / most).alias("n"))
    return rows.join(counts, "user_id").withColumn("b", F.pmod(F.xxhash64(key), F.col("n"))).drop("n"), counts


def _gathered(rows: DataFrame, keys: list[str], name: str, columns: list[str]) -> DataFrame:
    """(keys, name: array of structs), a row a block. Dealt out before they are collected: a task holds the blocks of its share, not parts of all blocks of the rows that it reads."""
    return rows.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias(name))


def _term_key(df: DataFrame) -> Callable[[Column], Column]:
    """A 64-bit number of a term that no two terms of (term, df) share."""
    for seed in range(8):
        number = lambda t: F.xxhash64(t, F.lit(seed))  # noqa: B023, E731
        if not (r := df.agg(F.count("*").alias("n"), F.count_distinct(number(F.col("term"))).alias("d")).first()) or r.n == r.d:
            return lambda t, seed=seed: F.xxhash64(t, F.lit(seed))
    raise RuntimeError("no numbers for the terms without a collision")


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges first[i], ..., first[i] + n[i] - 1, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def block_scores(one: tuple, two: tuple, shape: tuple[int, int], columns: int = 512, pairs: int = 1 << 21) -> np.ndarray:
    """Sums of weight * impact over shared terms, of all questions and claims of two blocks. one, two: (row, term number, value).

    Terms that many of both have go by matrix products, some at a time; the others by their pairs.
    """
    out = np.zeros(shape)
    sides = []
    for row, term, value in (one, two):
        order = np.argsort(term, kind="stable")
        terms, start, n = np.unique(term[order], return_index=True, return_counts=True)
        sides.append((row[order], value[order], terms, start, n))
    _, i, j = np.intersect1d(sides[0][2], sides[1][2], assume_unique=True, return_indices=True)
    (row_q, w, _, start_q, n_q), (row_c, impact, _, start_c, n_c) = ((r, v, t, s[k], n[k]) for (r, v, t, s, n), k in zip(sides, (i, j), strict=True))
    work = n_q * n_c
    often = work * 32 >= shape[0] * shape[1]
    wide = np.nonzero(often)[0]
    for at in range(0, len(wide), columns):
        some = wide[at : at + columns]
        parts = []
        for row, value, start, n, size in ((row_q, w, start_q, n_q, shape[0]), (row_c, impact, start_c, n_c, shape[1])):
            cells = _spread(start[some], n[some])
            m = np.zeros((size, len(some)))
            m[row[cells], np.repeat(np.arange(len(some)), n[some])] = value[cells]
            parts.append(m)
        out += parts[0] @ parts[1].T
    rare = np.nonzero(~often)[0]
    run = np.cumsum(work[rare]) // pairs
    for k in np.unique(run):
        some = rare[run == k]
        left = _spread(start_q[some], n_q[some])
        times = np.repeat(n_c[some], n_q[some])
        right = _spread(np.repeat(start_c[some], n_q[some]), times)
        left = np.repeat(left, times)
        out += np.bincount(row_q[left] * shape[1] + row_c[right], w[left] * impact[right], shape[0] * shape[1]).reshape(shape)
    return out


def _best_of_blocks(k: int, exclude_self: bool):
    """For mapInArrow over rows (q, c) of question and claim blocks: (qid, claim_id, score) of each question's k best, and of what rounding may put among them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = batch.column("q")[i].values, batch.column("c")[i].values
                (qid, row_q), (cid, row_c) = (np.unique(x.field("id").to_numpy(), return_inverse=True) for x in (q, c))
                order = np.argsort(row_q, kind="stable")
                row_q, term, w = (x[order] for x in (row_q, q.field("term").to_numpy(), q.field("w").to_numpy()))
                held = (row_c, c.field("term").to_numpy(), c.field("impact").to_numpy())
                take, step = min(k, len(cid)), max(1, CELLS // len(cid))
                for at in range(0, len(qid), step):
                    few, some = qid[at : at + step], slice(*np.searchsorted(row_q, (at, at + step)))
                    score = block_scores((row_q[some] - at, term[some], w[some]), held, (len(few), len(cid)))
                    if exclude_self:
                        score[few[:, None] == cid[None, :]] = 0
                    # no score is above this, and similarities are rounded to nine places of a question's best
                    slack = 2e-9 * (K1 + 1) * np.bincount(row_q[some] - at, np.maximum(w[some], 0), len(few))
                    last = np.partition(score, len(cid) - take, axis=1)[:, len(cid) - take]
                    rows, hit = np.nonzero((score > 0) & (score >= (last - slack)[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(few[rows]), pa.array(cid[hit]), pa.array(score[rows, hit])], names=["qid", "claim_id", "score"])

    return run


def bm25(questions: DataFrame, claims: DataFrame, fields: list[str], k: int = 100, exclude_self: bool = True) -> DataFrame:
    """Okapi BM25, k1 1.5, b 0.75; terms in over half of all claims count a quarter of the mean idf. Scores over 0 only, divided by the question's best.

    The postings are stored once, in the shared folder. Blocks of them meet blocks of the questions' weighted terms, on tenant and claim block, so that
    no pair of question and claim is shuffled: a pair of blocks gives about k rows a question. The work is questions x claims, as in ``vectors.nearest``.
    """
    p = written(postings(claims, fields), "postings")
    size = p.groupBy("id").agg(F.max("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = written(corpus_statistics(p).crossJoin(size).withColumn("raw_idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))), "terms")  # size: one row
    number = _term_key(df)
    mean = df.agg(F.avg("raw_idf").alias("mean_idf"))
    idf = df.crossJoin(mean).select("term", F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))
    asked = questions.select("qid", "user_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "user_id", "term").agg(F.count("*").alias("qtf"))
    weighted = written(asked.join(idf, "term").select(F.col("qid").alias("id"), "user_id", number(F.col("term")).alias("term"), (F.col("qtf") * F.col("idf")).alias("w")), "weights")
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    c, counts = _dealt(p.crossJoin(size.select("avgdl")).select("user_id", "id", number(F.col("term")).alias("term"), impact.alias("impact")), "id", CLAIM_BLOCK)
    q, _ = _dealt(weighted, "id", QUESTION_BLOCK)
    c = _gathered(c, ["user_id", "b"], "c", ["id", "term", "impact"])
    q = _gathered(q, ["user_id", "b"], "q", ["id", "term", "w"]).drop("b")
    q = q.join(counts, "user_id").select("user_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    total = q.join(c, ["user_id", "b"]).select("q", "c").mapInArrow(_best_of_blocks(k, exclude_self), "qid long, claim_id long, score double")
    return top_k(total.withColumn("similarity", F.round(F.least(F.lit(1.0), F.col("score") / F.max("score").over(Window.partitionBy("qid"))), 9)), "similarity", k).drop("score")


def term_weights(claims: DataFrame) -> DataFrame:
    """(user_id, id, term, w): field-weighted counts of a claim's terms, stored in the shared folder."""

    def fielded(field: str, weight: float) -> Column:
        return F.transform(tokens(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    counted = F.flatten(F.array(*(fielded(*x) for x in FIELD_WEIGHTS.items())))
    return written(claims.select("user_id", "id", F.explode(counted).alias("t")).groupBy("user_id", "id", "t.term").agg(F.sum("t.w").alias("w")), "postings")


def candidates(questions: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, id, need): the claims under each question's rarest term of the tenant, with its number of terms; and (qid, term) of all terms. A term that no claim has leaves a question without any."""
    df = p.groupBy("user_id", "term").agg(F.count("*").alias("df"))
    asked = questions.select("qid", "user_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = written(asked.join(df, ["user_id", "term"], "left"), "asked")
    rarest = asked.groupBy("qid", "user_id").agg(F.count("*").alias("need"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("least")).filter("least.df > 0").select("qid", "user_id", "need", F.col("least.term").alias("term"))
    return rarest.join(p.select("user_id", "term", "id"), ["user_id", "term"]).select("qid", "id", "need"), asked.select("qid", "term")


def all_terms(questions: DataFrame, claims: DataFrame, k: int = 50) -> DataFrame:
    """Claims that hold every term of a question, ranked by field-weighted term counts, scaled from 0 to 1 for each question.

    A claim that holds them all holds the one that the fewest claims of the tenant have: only the claims under that term are looked at.
    """
    p = term_weights(claims)
    under, asked = candidates(questions, p)
    # rounded: equal sums are equal in any order
    found = under.join(asked, "qid").join(p.select("id", "term", "w"), ["id", "term"]).groupBy("qid", F.col("id").alias("claim_id"), "need").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 6).alias("score"))
    return top_k(min_max(found.filter("terms = need"), "score").withColumnRenamed("scaled", "similarity"), "similarity", k).drop("terms", "need", "score")


def min_max(rows: DataFrame, score: str) -> DataFrame:
    by = Window.partitionBy("qid")
    low, high = F.min(score).over(by), F.max(score).over(by)
    return rows.withColumn("scaled", F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def max_scaled(rows: DataFrame, score: str) -> DataFrame:
    return rows.withColumn("scaled", F.col(score) / F.max(score).over(Window.partitionBy("qid")))


def top_k(rows: DataFrame, score: str, k: int | Column, key: str = "claim_id") -> DataFrame:
    """The k best rows of each question with rank; Spark keeps only k a question in each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), key))).filter(F.col("rank") <= k)


def widened(rows: DataFrame, questions: DataFrame, k: int, classify: Callable[[Column], Column] = tx.classify_query) -> DataFrame:
    """top-k where temporal, multi-hop and counting questions get a larger k. ``classify`` gives a struct with top_k_multiplier."""
    hints = questions.select("qid", classify(F.col("text"))["top_k_multiplier"].alias("m"))
    return top_k(rows.join(hints, "qid"), "similarity", F.floor(F.col("m") * k)).drop("m")


def fused(legs: list[DataFrame], k: int, rank_base: int = 1, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of hit lists that have ranks from 1: sum of 1 / (60 + rank), divided by the question's best."""
    union = None
    for leg in legs:
        rows = leg.select("qid", "claim_id", (1.0 / (rrf_k + F.col("rank") - 1 + rank_base)).alias("share"))
        union = rows if union is None else union.unionByName(rows)
    total = max_scaled(union.groupBy("qid", "claim_id").agg(F.sum("share").alias("score")), "score")
    return top_k(total.select("qid", "claim_id", F.round("scaled", 9).alias("similarity")), "similarity", k)


def block_pairs(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], n: int, pairs: int = 1 << 21):
    """Arrays (row of one, row of two), each pair that shares a term once, some at a time; one, two: (row, term number), n: rows of two."""
    order = np.lexsort(one[::-1])
    row_q, term_q = (x[order] for x in one)
    order = np.argsort(two[1], kind="stable")
    row_c, term_c = (x[order] for x in two)
    start = np.searchsorted(term_c, term_q)
    found = np.searchsorted(term_c, term_q, "right") - start
    row_q, start, found = (x[found > 0] for x in (row_q, start, found))
    # a question's terms stay together; they have no more postings than the block
    total = np.cumsum(found)
    last = np.searchsorted(row_q, row_q, "right") - 1
    run = total[last] // pairs
    for at, end in zip(*(np.searchsorted(run, np.unique(run), side) for side in ("left", "right")), strict=True):
        hit = np.unique(np.repeat(row_q[at:end], found[at:end]) * n + row_c[_spread(start[at:end], found[at:end])])
        yield hit // n, hit % n


def _pairs_of_blocks(batches):
    """For mapInArrow over rows (q, c) of question and claim blocks: (qid, claim_id) that share a term."""
    for batch in batches:
        for i in range(batch.num_rows):
            q, c = batch.column("q")[i].values, batch.column("c")[i].values
            (qid, row_q), (cid, row_c) = (np.unique(x.field("id").to_numpy(), return_inverse=True) for x in (q, c))
            for left, right in block_pairs((row_q, q.field("term").to_numpy()), (row_c, c.field("term").to_numpy()), len(cid)):
                yield pa.RecordBatch.from_arrays([pa.array(qid[left]), pa.array(cid[right])], names=["qid", "claim_id"])


def entity_lookup(questions: DataFrame, entity_postings: DataFrame) -> DataFrame:
    """(qid, claim_id) of claims indexed under an entity or date that the question names.

    Blocks of names meet blocks of postings in tasks, as in ``bm25``: a pair lies in one pair of blocks, so that no pair is shuffled and no name is one key.
    """
    named = written(questions.select(F.col("qid").alias("id"), F.explode(F.array_union(tx.extract_entities(F.col("text")), tx.extract_dates(F.col("text")))).alias("term")), "named")
    terms = named.select("term").distinct()
    p = written(entity_postings.select("id", F.col("entity").alias("term")).join(terms, "term", "left_semi"), "postings")
    number = _term_key(terms)

    def blocks(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
        n = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).alias("n"))  # one row
        dealt = rows.crossJoin(n).select(F.pmod(F.xxhash64("id"), F.col("n")).alias("b"), "id", number(F.col("term")).alias("term"))
        return _gathered(dealt, ["b"], name, ["id", "term"]), n

    c, n = blocks(p, CLAIM_BLOCK, "c")
    q = blocks(named, QUESTION_BLOCK, "q")[0].crossJoin(n).select("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    return q.join(c, "b").select("q", "c").mapInArrow(_pairs_of_blocks, "qid long, claim_id long")


def entity_postings(claims: DataFrame, entity: str = "entity", content: str = "content") -> DataFrame:
    """(entity, id): claims under their entity, the names and the dates in their text, in lower case."""
    own = F.filter(F.array(F.lower(F.trim(F.col(entity)))), lambda e: e.isNotNull() & (e != ""))
    return claims.select("id", F.explode(F.array_distinct(F.concat(own, tx.extract_entities(F.col(content)), tx.extract_dates(F.col(content))))).alias("entity")).select("entity", "id")


def top_entities(index: DataFrame, n: int) -> DataFrame:
    return index.groupBy("entity").agg(F.count_distinct("id").alias("n_claims")).orderBy(F.desc("n_claims"), "entity").limit(n)


def boosted(hits: DataFrame, matched: DataFrame, boost: float = 0.15) -> DataFrame:
    """Similarity raised, to 1 at most, for hits that are among (qid, claim_id) matched."""
    m = matched.select("qid", "claim_id", F.lit(boost).alias("boost")).distinct()
    return hits.join(m, ["qid", "claim_id"], "left").withColumn("similarity", F.least(F.lit(1.0), F.col("similarity") + F.coalesce("boost", F.lit(0.0)))).drop("boost")


def date_boosted(hits: DataFrame, questions: DataFrame, claims: DataFrame, score: str = "similarity", boost: float = 0.15, classify: Callable[[Column], Column] = tx.classify_query) -> DataFrame:
    """For temporal questions, hits whose text names a date are raised."""
    temporal = questions.select("qid", classify(F.col("text"))["is_temporal"].alias("temporal"))
    dated = claims.select(F.col("id").alias("claim_id"), tx.has_date(F.col("content")).alias("dated"))
    up = F.when(F.col("temporal") & F.col("dated"), F.least(F.lit(1.0), F.col(score) + boost)).otherwise(F.col(score))
    return hits.join(temporal, "qid").join(dated, "claim_id").withColumn(score, up).drop("temporal", "dated")


def source_gate(hits: DataFrame, questions: DataFrame, claims: DataFrame, helpers: list[str] | None = None, classify: Callable[[Column], Column] = tx.classify_query) -> DataFrame:
    """Helper sources stay only for multi-hop and list questions."""
    wide = questions.select("qid", (classify(F.col("text"))["is_multi_hop"] | tx.is_list_question(F.col("text"))).alias("wide"))
    return hits.join(claims.select(F.col("id").alias("claim_id"), "source"), "claim_id").join(wide, "qid").filter(F.col("wide") | ~F.col("source").isin(helpers or HELPER_SOURCES)).drop("wide", "source")


def one_per_parent(hits: DataFrame, parents: DataFrame, score: str = "similarity") -> DataFrame:
    """The best chunk of each parent. parents: (claim_id, parent_id)."""
    rows = hits.join(parents, "claim_id", "left").withColumn("root", F.coalesce("parent_id", "claim_id"))
    best = F.row_number().over(Window.partitionBy("qid", "root").orderBy(F.desc(score), "claim_id"))
    return rows.withColumn("nth", best).filter("nth = 1").drop("nth", "root", "parent_id")


def neighbours_added(hits: DataFrame, edges: DataFrame, seeds: int = 3, k: int = 3) -> DataFrame:
    """hits and, for the best seeds of each question, their nearest neighbours that aren't hits yet."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = both.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).filter(F.col("nth") <= k)
    new = hits.filter(F.col("rank") <= seeds).select("qid", F.col("claim_id").alias("src")).join(near, "src").groupBy("qid", F.col("dst").alias("claim_id")).agg(F.max("weight").alias("similarity"))
    return union_pools(hits.select("qid", "claim_id", "similarity"), new.filter("claim_id <> qid"))


def union_pools(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first pool, then what is new in the second; distinct by (qid, claim_id)."""
    new = second.join(first, ["qid", "claim_id"], "left_anti").dropDuplicates(["qid", "claim_id"])
    columns = ["qid", "claim_id", "similarity"]
    return first.select(*columns, F.lit(0).alias("pool")).unionByName(new.select(*columns, F.lit(1).alias("pool")))


def sub_questions(questions: DataFrame, most: int = 3) -> DataFrame:
    """(qid, sub_no, text): the question and its parts."""
    return questions.select("qid", "user_id", F.posexplode(tx.decompose(F.col("text"), most)).alias("sub_no", "text"))


def second_pass_text(questions: DataFrame, hits: DataFrame, claims: DataFrame, low: float = 0.45, classify: Callable[[Column], Column] = tx.classify_query) -> DataFrame:
    """For multi-hop questions and weak best hits: the question followed by the best hit's beginning and its entity and attribute."""
    best = hits.filter("rank = 1").join(claims.select(F.col("id").alias("claim_id"), "content", "entity", "attribute"), "claim_id")
    hop = classify(F.col("text"))["is_multi_hop"]
    text = F.concat_ws(" ", "text", F.left("content", F.lit(160)), "entity", "attribute")
    return questions.join(best.select("qid", "content", "entity", "attribute", "similarity"), "qid").filter(hop | (F.col("similarity") < low)).select("qid", "user_id", text.alias("text"))
