"""Evaluation and training-set preparation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .scans import running_sum

ANCHOR_WORDS = 8


def _shared(one: Column, two: Column, once: bool) -> Column:
    """How many elements of two are in one; with ``once``, an element of one stands for one of two only. A merge of both in order, linear in their sizes."""
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).alias("n"))

    def merged(a: Column, b: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def after(x: Column, y: Column) -> Column:
                same = x == y
                return F.struct((s["i"] + (((x < y) | same) if once else (x < y)).cast("int")).alias("i"), (s["j"] + (x >= y).cast("int")).alias("j"), (s["n"] + same.cast("int")).alias("n"))

            return F.when((s["i"] <= F.size(a)) & (s["j"] <= F.size(b)), after(F.element_at(a, s["i"]), F.element_at(b, s["j"]))).otherwise(s)

        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(a) + F.size(b), F.lit(1))), start, step)["n"])

    return tx.let(F.struct(F.array_sort(one).alias("a"), F.array_sort(two).alias("b")), lambda t: merged(t["a"], t["b"]))


def _f1(overlap: Column, n: Column, m: Column) -> Column:
    return tx.let(overlap, lambda o: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (o == 0), 0.0).otherwise(2 * o / (n + m)))


def _of_tokens(tokens: Callable[[Column], Column], pred: Column, gold: Column, then: Callable[[Column, Column], Column]) -> Column:
    return tx.let(F.struct(tokens(pred).alias("p"), tokens(gold).alias("g")), lambda t: then(t["p"], t["g"]))


def context_recall(context: Column, gold: Column) -> Column:
    """Share of the gold's tokens that the context has; 1 without gold tokens."""
    return _of_tokens(tx.scored_tokens, context, gold, lambda c, g: F.when(F.size(g) == 0, 1.0).otherwise(_shared(c, g, False) / F.size(g)))


def token_f1_set(pred: Column, gold: Column) -> Column:
    return _of_tokens(lambda c: F.array_distinct(tx.scored_tokens(c)), pred, gold, lambda p, g: _f1(F.size(F.array_intersect(p, g)), F.size(p), F.size(g)))


def token_f1_bag(pred: Column, gold: Column) -> Column:
    return _of_tokens(tx.squad_tokens, pred, gold, lambda p, g: _f1(_shared(p, g, True), F.size(p), F.size(g)))


def exact_match(pred: Column, gold: Column) -> Column:
    return (F.array_join(tx.squad_tokens(pred), " ") == F.array_join(tx.squad_tokens(gold), " ")).cast("double")


def scores(pred: Column, gold: Column) -> dict[str, Column]:
    return {"context_recall": context_recall(pred, gold), "f1_set": token_f1_set(pred, gold), "f1_bag": token_f1_bag(pred, gold), "exact": exact_match(pred, gold)}


def hit_at(hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(qid, hit_at_k ...): whether a gold claim is among the first k, for questions that have hits."""
    good = gold.select("qid", "claim_id", F.lit(True).alias("good")).distinct()
    rows = hits.join(good, ["qid", "claim_id"], "left")
    return rows.groupBy("qid").agg(*(F.max(F.when(F.col("good") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks))


def by_category(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means by category, and over all (category null)."""
    return rows.rollup("category").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def ranking_accuracy(triples: DataFrame) -> DataFrame:
    """(accuracy, margin, n) of rows (pos, neg)."""
    both = triples.filter("pos is not null and neg is not null")
    return both.agg(F.round(F.avg(F.when(F.col("pos") > F.col("neg"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg(F.col("pos") - F.col("neg")), 6).alias("margin"), F.count("*").alias("n"))


def triples(turns: DataFrame, negatives: int, seed: int = 7) -> DataFrame:
    """Each assistant turn with user turns of its conversation as negatives, chosen by a seeded hash, numbered windows only (no collecting)."""
    pos = turns.filter("role = 'assistant'").select("conv_id", F.col("turn_no").alias("pos_turn"), F.col("text").alias("positive"))
    neg = turns.filter("role = 'user'").select("conv_id", "turn_no", F.col("text").alias("negative"))
    order = F.xxhash64("conv_id", "turn_no", F.lit(seed))
    neg = neg.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(order, "turn_no"))).filter(F.col("nth") <= negatives)
    return pos.join(neg.drop("turn_no"), "conv_id")


def far_negatives(turns: DataFrame, negatives: int, seed: int = 7) -> DataFrame:
    """(conv_id, pos_turn, positive, nth, neg_conv, neg_turn, negative): each assistant turn with user turns of other conversations.

    The different user turns are numbered in order of conversation, so a conversation's own are one run of numbers. A draw takes one of the other
    numbers, and skips the run. A positive's draws stand evenly apart from a seeded start, so they differ if there are
    enough other turns; without any there is no row. Turns without a conversation are left out.
    """
    asked = turns.filter("role = 'user' and conv_id is not null").select("conv_id", "turn_no", "text").distinct()
    numbered = running_sum(asked.withColumn("one", F.lit(1)).withColumn("all", F.lit(0)), "all", ["conv_id", "turn_no", "text"], "one", "number")
    own = numbered.groupBy("conv_id").agg(F.min("number").alias("low"), F.count("*").alias("size"))
    total = numbered.agg(F.count("*").alias("total"))  # one row
    pos = turns.filter("role = 'assistant' and conv_id is not null").select("conv_id", F.col("turn_no").alias("pos_turn"), F.col("text").alias("positive"))
    pos = pos.join(own, "conv_id", "left").crossJoin(total).withColumn("size", F.coalesce("size", F.lit(0))).withColumn("others", F.col("total") - F.col("size")).filter("others > 0")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", "conv_id", "pos_turn", F.lit(str(seed)))), 1, 13), 16, 10).cast("long")
    draws = pos.withColumn("nth", F.explode(F.lit(list(range(1, negatives + 1))))).withColumn("drawn", F.pmod(start + (F.col("nth") - 1) * F.expr(f"greatest(others div {negatives}, 1)"), F.col("others")) + 1)
    draws = draws.withColumn("number", F.when(F.col("drawn") >= F.col("low"), F.col("drawn") + F.col("size")).otherwise(F.col("drawn")))
    found = numbered.select("number", F.col("conv_id").alias("neg_conv"), F.col("turn_no").alias("neg_turn"), F.col("text").alias("negative"))
    return draws.join(found, "number").select("conv_id", "pos_turn", "positive", "nth", "neg_conv", "neg_turn", "negative")


def distinct_pairs(rows: DataFrame, query: str = "query", positive: str = "positive") -> DataFrame:
    """The different (query, positive) pairs of triples."""
    return rows.select(query, positive).distinct()


def first_ranks(hits: DataFrame, stale: DataFrame) -> DataFrame:
    """(qid, first_stale, first_fresh): the best ranks of hits that are among the stale claims (claim_id) and of those that aren't."""
    rows = hits.join(stale.select("claim_id", F.lit(True).alias("stale")).distinct(), "claim_id", "left")
    return rows.groupBy("qid").agg(F.min(F.when(F.col("stale"), F.col("rank"))).alias("first_stale"), F.min(F.when(F.col("stale").isNull(), F.col("rank"))).alias("first_fresh"))


def hard_negatives(hits: DataFrame, n: int) -> DataFrame:
    """The n best hits of each question that aren't gold (another label than the question's own)."""
    rows = hits.filter("label <> own")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("nth") <= n).select("qid", F.col("claim_id").alias("negative"))


def binary_examples(negatives: DataFrame) -> DataFrame:
    """(qid, claim_id, label): each question's own text as 1, its negatives as 0."""
    pair = F.explode(F.array(F.struct(F.col("qid").alias("claim_id"), F.lit(1).alias("label")), F.struct(F.col("negative").alias("claim_id"), F.lit(0).alias("label"))))
    return negatives.select("qid", pair.alias("e")).select("qid", "e.claim_id", "e.label").distinct()


def prompts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, prompt, completion) of questions (qid, question, answer) and their evidence lines (qid, position, text)."""
    lines = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("e"))
    context = F.array_join(F.transform("e", lambda x: F.concat(F.lit("<memory>"), x["text"], F.lit("</memory>"))), "\n")
    return questions.join(lines, "qid").select("qid", F.concat(context, F.lit("\n\nQuestion: "), "question", F.lit("\nAnswer:")).alias("prompt"), F.concat(F.lit(" "), "answer").alias("completion"))


def voted(candidates: DataFrame) -> DataFrame:
    """(qid, answer) of candidates (qid, n, answer): the most frequent normalized answer; if all differ, the one most like the others."""
    norm = F.regexp_replace(F.regexp_replace(F.lower(F.trim("answer")), r"[.,;:!?]+$", ""), r"\s+", " ")
    words = F.array_distinct(F.regexp_extract_all(F.lower("answer"), F.lit(r"(?U)\w+"), F.lit(0)))
    rows = candidates.withColumn("norm", norm)
    counts = rows.groupBy("qid", "norm").agg(F.count("*").alias("votes"), F.min(F.struct("n", "answer")).alias("first"))
    top = counts.groupBy("qid").agg(F.max(F.struct("votes", (-F.col("first.n")).alias("order"), F.col("first.answer").alias("answer"))).alias("top"))
    undecided = rows.join(top.filter("top.votes = 1").select("qid"), "qid", "left_semi").select("qid", "n", "answer", words.alias("words")).withColumn("m", F.size("words"))
    # the sum of F1 against all others without pairs: by shared word, how many answers of each length hold it
    said = undecided.select("qid", "n", "m", F.explode("words").alias("word"))
    held = said.groupBy("qid", "word", F.col("m").alias("other")).agg(F.count("*").alias("holders"))
    likeness = said.join(held, ["qid", "word"]).groupBy("qid", "n").agg(F.sum(2 * F.col("holders") / (F.col("m") + F.col("other"))).alias("total"))
    # an answer with words is wholly like itself: 1 of the total
    scored = undecided.join(likeness, ["qid", "n"], "left").withColumn("f1", F.round(F.coalesce(F.col("total") - 1, F.lit(0.0)), 9))
    central = scored.groupBy("qid").agg(F.max_by("answer", F.struct("f1", -F.col("n"))).alias("central"))
    return top.join(central, "qid", "left").select("qid", F.when((F.col("top.votes") > 1) | F.col("central").isNull(), F.col("top.answer")).otherwise(F.col("central")).alias("answer"))


def containing(needles: DataFrame, texts: DataFrame, words: int = ANCHOR_WORDS) -> DataFrame:
    """(qid, id) of texts that contain a needle: joined on a hash of a part of it, then checked exactly.

    The part is the needle's words but the first and the last, which may be cut from longer ones in the text, up to
    ``words`` of them; of needles of one or two words, their first three characters. Texts give one row for each
    different window of the lengths that the needles have. An empty needle is in every text.
    """
    split = F.filter(F.split("text", r"[\s]+"), lambda w: w != "")
    key = lambda a, i, n: F.xxhash64(F.slice(a, i, n))
    n = needles.withColumn("w", split).withColumn("inner", F.least(F.size("w") - 2, F.lit(words)))
    long_ = n.filter("inner > 0").select("qid", F.col("text").alias("needle"), F.col("inner").alias("len"), key(F.col("w"), F.lit(2), F.col("inner")).alias("k"))
    few = F.least(F.length("text"), F.lit(3))
    short = n.filter("inner <= 0").select("qid", F.col("text").alias("needle"), (-few).alias("len"), F.xxhash64(F.left("text", few)).alias("k"))
    asked = long_.unionByName(short)
    lengths = asked.agg(F.collect_set("len").alias("lengths"))  # one row of at most ``words`` + 4 numbers
    t = texts.select("id", "text", split.alias("w")).crossJoin(lengths)
    none = F.array().cast("array<bigint>")

    def windows(n):
        of_words = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: key(F.col("w"), i, n))).otherwise(none)
        of_chars = F.when(F.length("text") >= -n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") + n + 1)), lambda i: F.xxhash64(F.substring("text", i, -n)))).otherwise(none)
        return F.when(n > 0, of_words).otherwise(of_chars)

    anchors = t.select("id", F.explode(F.array_distinct(F.flatten(F.transform("lengths", windows)))).alias("k"))
    return anchors.join(asked, "k").select("id", "qid", "needle").distinct().join(texts.select("id", "text"), "id").filter(F.contains("text", "needle")).select("qid", "id")


def audit(hits: DataFrame, claims: DataFrame, structured: DataFrame) -> DataFrame:
    """(probe, passed, evidence): assertions over hits and beliefs."""
    named = hits.join(claims.select(F.col("id").alias("claim_id"), F.md5("content").alias("m"), F.length("content").alias("len")), "claim_id")
    twice = named.groupBy("qid", "m").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    noise = named.agg((F.count_if(F.col("len") < 20) / F.count("*")).alias("v"))
    open_ = structured.filter("valid_to is null").groupBy("user_id", "entity").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") != 1).alias("v"))
    gaps = structured.filter("superseded_by is not null and valid_to is null").agg(F.count("*").alias("v"))

    def row(df: DataFrame, probe: str, most: float) -> DataFrame:
        return df.select(F.lit(probe).alias("probe"), (F.col("v") <= most).alias("passed"), F.round(F.col("v").cast("double"), 6).alias("evidence"))

    return row(twice, "duplicates_in_hits", 5).unionByName(row(noise, "noise_share", 0.2)).unionByName(row(open_, "one_current_belief", 0)).unionByName(row(gaps, "closed_when_superseded", 0))


def one_sided(surfaced: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, a, b): conflicts (a, b) of which a question's surfaced claims (qid, id) hold one side only."""
    shown = surfaced.select("qid", "id").distinct()
    p = pairs.select("a", "b").filter("a <> b").distinct()
    sides = [shown.join(p.withColumn("id", F.col(c)), "id").select("qid", "a", "b") for c in ("a", "b")]
    return sides[0].unionByName(sides[1]).groupBy("qid", "a", "b").agg(F.count("*").alias("sides")).filter("sides = 1").drop("sides")


def split_aliases(resolutions: DataFrame) -> DataFrame:
    """(norm, n_entities): mentions in normal form that resolve to more than one entity."""
    return resolutions.groupBy("norm").agg(F.count_distinct("entity").alias("n_entities")).filter("n_entities > 1")


def identity_audit(surfaced: DataFrame, pairs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(probe, passed, evidence): both sides of a conflict are surfaced together, and an alias names one entity."""
    probes = {"both_conflict_sides": one_sided(surfaced, pairs), "alias_names_one_entity": split_aliases(resolutions)}
    rows = [faults.agg(F.count("*").alias("v")).select(F.lit(name).alias("probe"), (F.col("v") == 0).alias("passed"), F.col("v").cast("double").alias("evidence")) for name, faults in probes.items()]
    return rows[0].unionByName(rows[1])
