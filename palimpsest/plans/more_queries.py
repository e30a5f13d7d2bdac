"""Further queries: monitors, listings, set algebra, training sets, votes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import beliefs as bl
from ..operators import evaluate as ev
from ..operators import retrieve as rt
from ..operators import vectors as vec
from ..shared import shared_folder
from ..sources import io
from . import views as v
from .recall_queries import _DENSE, _has, dense
from .registry import query


@query(sql="select source, count(*) as n, count(*) filter (vec_id is null) as without_vector from documents left join (select distinct vec_id from embeddings) on doc_id = vec_id group by 1")
def a15_null_vectors(spark, sf):
    d, e = v.read(spark, sf, "documents"), v.read(spark, sf, "embeddings").select("vec_id").distinct()
    return d.join(e, d.doc_id == e.vec_id, "left").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id").isNull()).alias("without_vector"))


@query("turns", "select role, count(*) as n, count(distinct conv_id) as conversations, max(length(text)) as longest from turns group by 1")
def a20_profile(spark, sf):
    return v.turns(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"), F.max(F.length("text")).cast("long").alias("longest"))


@query("activity", "select user_id, ts, method, path from activity order by ts desc, user_id, path limit 500")
def k4_newest(spark, sf):
    """K4: newest first, the limit kept within 1 and 500."""
    n = max(1, min(9999, 500))
    return v.activity(spark, sf).orderBy(F.desc("ts"), "user_id", "path").limit(n).select("user_id", "ts", "method", "path")


@query("claims", "+ w as (select user_id, list_sort(list(distinct value)) as vals from claims where valid_to is null group by 1), o as (select user_id, list_sort(list(distinct value)) as vals from claims where valid_to is not null and ts < timestamp '1996-01-01' group by 1) select user_id, list_sort(list_intersect(w.vals, o.vals)) as both, list_sort(list_filter(w.vals, lambda x: not list_contains(o.vals, x))) as only_new, w.vals = o.vals as equal from w join o using (user_id)")
def st4_signal_sets(spark, sf):
    """ST4: intersection, residual and equality of value sets."""
    c = v.claims(spark, sf)
    new = c.filter("valid_to is null").groupBy("user_id").agg(F.array_sort(F.collect_set("value")).alias("new"))
    old = c.filter("valid_to is not null and ts < timestamp'1996-01-01 00:00:00'").groupBy("user_id").agg(F.array_sort(F.collect_set("value")).alias("old"))
    return new.join(old, "user_id").select("user_id", F.array_sort(F.array_intersect("new", "old")).alias("both"), F.array_sort(F.array_except("new", "old")).alias("only_new"), (F.col("new") == F.col("old")).alias("equal"))


@query("passages questions", _DENSE + " select d.qid, p.id, contains(lower(q.text), lower(p.entity)) as named from dense d join questions q using (qid) join passages p on p.id = d.claim_id where d.rank <= 20")
def pf15_why_matched(spark, sf):
    """PF15: whether a question names the entity of its hits."""
    p = v.passages(spark, sf)
    q = v.questions(p)
    hits = dense(p, q, 20).select("qid", F.col("claim_id").alias("id"))
    return hits.join(q.select("qid", "text"), "qid").join(p.select("id", "entity"), "id").select("qid", "id", F.contains(F.lower("text"), F.lower("entity")).alias("named"))


@query("passages questions", _DENSE + """ select qid, id, case when contains(t, e) then 'entity' when len(list_filter(string_split(e, ' '), lambda w: length(w) >= 4 and contains(t, w))) > 0 then 'word' end as why
 from (select d.qid, p.id, lower(q.text) as t, lower(array_to_string(string_split(p.content, ' ')[1:3], ' ')) as e from dense d join questions q using (qid) join passages p on p.id = d.claim_id where d.rank <= 20)""")
def pf15_word_matches(spark, sf):
    """PF15 with its word rule: the first three words of each hit, looked for in the question as a whole and word by word."""
    p = v.passages(spark, sf)
    q = v.questions(p)
    hits = dense(p, q, 20).select("qid", F.col("claim_id").alias("id"))
    phrase = F.array_join(F.slice(F.split("content", " "), 1, 3), " ")
    return hits.join(q.select("qid", "text"), "qid").join(p.select("id", phrase.alias("phrase")), "id").select("qid", "id", tx.why_matched(F.col("text"), F.col("phrase")).alias("why"))


@query("turns", """+ n as (select conv_id, turn_no, row_number() over (order by conv_id, turn_no, text) as number from (select distinct conv_id, turn_no, text from turns where role = 'user' and conv_id is not null)),
 own as (select conv_id, min(number) as low, count(*) as size from n group by 1),
 p as (select t.conv_id, turn_no as pos_turn, low, coalesce(size, 0) as size, (select count(*) from n) - coalesce(size, 0) as others from turns t left join own using (conv_id) where role = 'assistant' and t.conv_id is not null),
 d as (select *, (('0x' || substr(md5(conv_id || ':' || pos_turn || ':7'), 1, 13))::bigint + (nth - 1) * greatest(others // 2, 1)) % others + 1 as drawn from p, unnest([1, 2]) as u(nth) where others > 0)
 select d.conv_id, pos_turn, nth, n.conv_id as neg_conv, n.turn_no as neg_turn from d join n on n.number = case when drawn >= low then drawn + size else drawn end""")
def ev6_far_negatives(spark, sf):
    """EV6: each assistant turn with two user turns of other conversations as negatives, drawn by number from all."""
    return ev.far_negatives(v.turns(spark, sf), 2).select("conv_id", "pos_turn", "nth", "neg_conv", "neg_turn")


@query("passages questions", f"""+ sims as (select q.qid, p.id as claim_id, p.source, greatest(-1, least(1, list_cosine_similarity(q.vector::double[], p.embedding::double[]))) as similarity from questions q join passages p on q.user_id = p.user_id and p.id <> q.qid),
 near as (select *, row_number() over (partition by qid order by similarity desc, claim_id) as nth from sims qualify nth <= 40),
 hints as (select qid, {_has("text", tx.HINTS["is_multi_hop"])} as hop, hop or {_has("text", tx.LIST_QUESTION)} as wide, case when {_has("text", tx.HINTS["is_count"])} then 20 when hop or {_has("text", tx.HINTS["is_temporal"])} then 15 else 10 end as k from questions),
 gated as (select n.*, k, row_number() over (partition by qid order by similarity desc, claim_id) as rank from near n join hints using (qid) where wide or source not in ('src1', 'src2'))
 select qid, claim_id, round(similarity, 6) as similarity, rank from gated where rank <= k""")
def pf6_source_gate(spark, sf):
    """PF6, K3: helper sources only for wide questions, a wider top-k by hints."""
    p = v.passages(spark, sf)
    q = v.questions(p)
    hits = vec.nearest(q.withColumn("id", F.col("qid")), p, 40).drop("rank")
    gated = rt.source_gate(hits, q, p, helpers=["src1", "src2"])
    return rt.widened(gated, q, 10).select("qid", "claim_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("passages questions", _DENSE + " select d.qid, claim_id, rank from dense d join questions q on q.qid = d.qid where rank <= case when length(q.text) > 500 then 20 else 10 end")
def u5_classifier(spark, sf):
    """A caller's classifier decides how many hits a question gets, here by its length."""
    p = v.passages(spark, sf)
    q = v.questions(p)
    by_length = lambda c: F.struct(F.when(F.length(c) > 500, 2.0).otherwise(1.0).alias("top_k_multiplier"))
    return rt.widened(dense(p, q).drop("rank"), q, 10, by_length).select("qid", "claim_id", "rank")


@query("turns", "+ u as (select conv_id as qid, first(text order by turn_no) as question from turns where role = 'user' group by 1), a as (select conv_id as qid, first(text order by turn_no) as answer, string_agg('<memory>' || text || '</memory>', chr(10) order by turn_no, text) as lines from turns where role = 'assistant' group by 1) select qid, lines || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' as prompt, ' ' || answer as completion from u join a using (qid)")
def ev8_prompts(spark, sf):
    """EV8, J10: prompts of each conversation's assistant lines and its first question."""
    t = v.turns(spark, sf)
    first = lambda role, name: t.filter(F.col("role") == role).groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn_no").alias(name))
    evidence = t.filter("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.col("turn_no").alias("position"), "text")
    return ev.prompts(first("user", "question").join(first("assistant", "answer"), "qid"), evidence)


@query("turns", "+ c as (select conv_id as qid, turn_no as n, lower(trim(regexp_extract(text, '^\\S+'))) as answer from turns), k as (select qid, answer, count(*) as votes, min(n) as first from c group by 1, 2) select qid, max(votes) as votes from k group by 1")
def a17_vote_counts(spark, sf):
    """Votes of the most frequent first word among a conversation's turns."""
    c = v.turns(spark, sf).select(F.col("conv_id").alias("qid"), F.lower(F.trim(F.regexp_extract("text", r"^\S+", 0))).alias("answer"))
    return c.groupBy("qid", "answer").agg(F.count("*").alias("v")).groupBy("qid").agg(F.max("v").alias("votes"))


@query("turns", r"""+ c as (select conv_id as qid, turn_no as n, text as answer, regexp_replace(regexp_replace(lower(trim(text)), '[.,;:!?]+$', ''), '\s+', ' ', 'g') as norm, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as w from turns),
 k as (select qid, norm, count(*) as votes, min(n) as first_n, arg_min(answer, n) as answer from c group by 1, 2), top as (select qid, max(votes) as votes, first(answer order by votes desc, first_n) as answer from k group by 1),
 f as (select a.qid, a.n, a.answer, round(sum(coalesce(2.0::double * len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w), 0), 0)), 9) as f1 from c a join c b on a.qid = b.qid and a.n <> b.n group by all),
 central as (select qid, first(answer order by f1 desc, n) as answer from f group by 1) select qid, case when votes > 1 or central.answer is null then top.answer else central.answer end as answer from top left join central using (qid)""")
def a17_self_consistency(spark, sf):
    """The chosen answer among a conversation's turns."""
    t = v.turns(spark, sf)
    c = t.select(F.col("conv_id").alias("qid"), F.col("turn_no").cast("int").alias("n"), F.col("text").alias("answer"))
    return ev.voted(c)


@query()
def src8_training_set(spark, sf):
    """SRC8, EV6: triples written by split as JSON lines, with counts."""
    return io.write_training_set(ev.triples(v.turns(spark, sf), 2), f"{shared_folder(spark)}/training-{uuid.uuid4().hex}")


@query("claims", "select user_id, entity, max(ts) as ts, count(*) as n from claims group by 1, 2")
def st1_union_pools(spark, sf):
    """ST1, ST2: two overlapping pools united without repeats, then summed."""
    c = v.claims(spark, sf)
    pool = c.select("user_id", F.col("id").alias("claim_id"), F.lit(0).alias("qid"), F.lit(1.0).alias("similarity"))
    both = rt.union_pools(pool.filter("claim_id % 3 <> 0"), pool.filter("claim_id % 2 = 0 or claim_id % 3 = 0"))
    return both.join(c.withColumnRenamed("id", "claim_id"), "claim_id").groupBy("user_id", "entity").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))


@query("claims", "select id, coalesce(nullif(session_id, ''), 's' || (id % 3)) as session_id from (select id, case when id % 2 = 0 then 'own' else null end as session_id from claims)")
def b11_session_promotion(spark, sf):
    c = v.claims(spark, sf).select("id", F.when(F.col("id") % 2 == 0, "own").alias("session_id"), F.create_map(F.lit("session_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("raw_metadata"))
    return bl.promoted_session(c).select("id", "session_id")


@query("turns", "select conv_id, turn_no, length(text) // 4 as tokens from turns")
def u4_tokens(spark, sf):
    return v.turns(spark, sf).select("conv_id", "turn_no", tx.estimate_tokens(F.col("text")).alias("tokens"))
