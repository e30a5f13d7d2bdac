"""Recall queries: dense and lexical retrieval, fusion, re-ranking, resolution, graph, context, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import beliefs as bl
from ..operators import context as cx
from ..operators import early_stop as es
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import rerank as rr
from ..operators import retrieve as op
from ..operators import vector_index as vx
from ..operators import vectors as vec
from ..shared import written
from . import views as v
from .registry import query

FIELDS = ["content", "entity", "attribute"]
_NOW = "timestamp '2024-03-01'"
_DENSE = """+ sims as (select q.qid, p.id as claim_id, greatest(-1, least(1, list_cosine_similarity(q.vector::double[], p.embedding::double[]))) as similarity from questions q join passages p on q.user_id = p.user_id and p.id <> q.qid where p.valid_from <= q.as_of and (p.valid_to is null or p.valid_to > q.as_of)),
 dense as (select qid, claim_id, similarity, row_number() over (partition by qid order by similarity desc, claim_id) as rank from sims where similarity >= 0.2 qualify rank <= 100)"""
_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_LEX = f""", tok as (select id, user_id, unnest({_TOK.format("content || ' ' || entity || ' ' || attribute")}) as term from passages),
 post as (select id, user_id, term, count(*) as tf from tok group by all), len as (select id, count(*) as dl from tok group by 1), size as (select count(*) as n, avg(dl) as avgdl from len),
 df as (select term, count(*) as df from post group by 1), raw as (select term, ln((n - df + 0.5) / (df + 0.5)) as r from df, size), idf as (select term, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw),
 ask as (select qid, user_id, term, count(*) as qtf from (select qid, user_id, unnest({_TOK.format("text")}) as term from questions) group by all),
 sc as (select qid, id as claim_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from post join ask using (user_id, term) join idf using (term) join len using (id), size where id <> qid group by 1, 2 having sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0),
 lex0 as (select qid, claim_id, round(least(1.0, score / max(score) over (partition by qid)), 9) as similarity from sc), lex as (select *, row_number() over (partition by qid order by similarity desc, claim_id) as rank from lex0 qualify rank <= 100)"""
_FUSED = """, legs as (select qid, claim_id, 1.0::double / (60 + rank) as share from dense union all select qid, claim_id, 1.0::double / (60 + rank) from lex),
 rrf as (select qid, claim_id, sum(share) as score from legs group by 1, 2), fused0 as (select qid, claim_id, round(score / max(score) over (partition by qid), 9) as similarity from rrf), fused as (select *, row_number() over (partition by qid order by similarity desc, claim_id) as rank from fused0 qualify rank <= 50)"""
_SCORE = "0.6 * similarity + 0.2 * least(1, pow(0.5, epoch_us(timestamp '2024-03-01' - ts) / 86400e6 / 30)) + 0.15 * authority + 0.05 * pinned::int"


def _has(text: str, pattern: str) -> str:
    """SQL: whether the text has the pattern; false for null."""
    quoted = pattern.replace("'", "''")
    return f"coalesce(regexp_matches({text}, '{quoted}'), false)"


def _tokens(text: str) -> str:
    """SQL: the word tokens that evaluation counts."""
    stop = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'), lambda w: length(w) > 1 and not list_contains([{stop}], w))"


def _bare_tokens(text: str) -> str:
    """SQL: tokens without articles and punctuation. Words are put between marks first, as the engine's own word bounds know ASCII only."""
    marked = f"regexp_replace(lower(coalesce({text}, '')), '([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+)', chr(1) || '\\1' || chr(1), 'g')"
    bare = f"regexp_replace(replace(regexp_replace({marked}, '\\x01(a|an|the)\\x01', ' ', 'g'), chr(1), ''), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"list_filter(regexp_split_to_array({bare}, '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def _ranked(hits: int, keep: int) -> str:
    """SQL: the weighted ranking of the best hits as a WITH table."""
    return f""", ranked as (select d.qid, claim_id, {_SCORE} as f, row_number() over (partition by d.qid order by {_SCORE} desc, claim_id) as nth
 from dense d join passages p on p.id = claim_id where d.rank <= {hits} qualify nth <= {keep})"""


def _now():
    return F.expr("timestamp'2024-03-01 00:00:00'")


def _base(spark, sf):
    p = v.passages(spark, sf)
    return p, v.questions(p)


def dense(p, q, k=100):
    return vec.nearest(q.withColumn("id", F.col("qid")), p, k, 0.2, as_of=True)


def hybrid(p, q, k=50):
    return op.fused([dense(p, q), op.bm25(q, p, FIELDS)], k)


@query("passages questions", _DENSE + " select qid, claim_id, round(similarity, 6) as similarity, rank from dense where rank <= 20")
def r1_dense(spark, sf):
    """R1, PF3, PF5, J9, K1: cosine top-k at each question's own instant."""
    p, q = _base(spark, sf)
    return dense(p, q, 20).withColumn("similarity", F.round("similarity", 6))


def indexed(spark, sf, k=20, **options):
    p, q = _base(spark, sf)
    return vx.search(q.select(F.col("qid").alias("id"), "user_id", "vector", "as_of"), vx.built(p), k, 0.2, **options).withColumn("similarity", F.round("similarity", 6))


@query("passages questions", _DENSE + " select qid, claim_id, round(similarity, 6) as similarity, rank from dense where rank <= 20")
def r1_indexed(spark, sf):
    """R1 through the inverted-file index, its exact answer: probed cells first, then those that the bound can't rule out."""
    return indexed(spark, sf, exact=True)


@query()
def r1_approximate(spark, sf):
    """R1 from the probed cells of the index alone; a test measures its recall against the exact search."""
    return indexed(spark, sf)


@query("passages questions", "+" + _LEX.lstrip(", ") + " select qid, claim_id, round(similarity, 6) as similarity, rank from lex where rank <= 20")
def r2_bm25(spark, sf):
    """R2, A18, W5."""
    p, q = _base(spark, sf)
    return op.bm25(q, p, FIELDS, 20).withColumn("similarity", F.round("similarity", 6))


@query("passages questions", "+" + _LEX.lstrip(", ") + " select qid, claim_id, round(similarity, 6) as similarity, rank from lex where rank <= 20")
def r2_early_stop(spark, sf):
    """R2 with a rising threshold over blocks of postings: the same rows from a part of them."""
    p, q = _base(spark, sf)
    return es.bm25(q, p, FIELDS, 20).withColumn("similarity", F.round("similarity", 6))


@query("passages questions", f"""+ w as (select id, user_id, unnest({_TOK.format('content')}) as term, 1.0 as w from passages union all select id, user_id, unnest({_TOK.format('entity')}), 0.4 from passages union all select id, user_id, unnest({_TOK.format('attribute')}), 0.2 from passages),
 ask as (select qid, user_id, unnest(list_distinct({_TOK.format('text')})) as term from questions), need as (select qid, count(*) as need from ask group by 1),
 f as (select qid, id as claim_id, count(distinct term) as terms, sum(w)::double as score from w join ask using (user_id, term) group by 1, 2), g as (select * from f join need using (qid) where terms = need)
 select qid, claim_id, round(case when max(score) over (partition by qid) = min(score) over (partition by qid) then 1.0 else (score - min(score) over (partition by qid)) / (max(score) over (partition by qid) - min(score) over (partition by qid)) end, 6) as similarity from g""")
def r3_all_terms(spark, sf):
    """R3, W6. The ranking among all matches is compared; there are fewer than k."""
    p, q = _base(spark, sf)
    return op.all_terms(q, p.withColumn("value", F.lit("")), 1 << 20).select("qid", "claim_id", F.round("similarity", 6).alias("similarity"))


@query("passages questions", _DENSE + _LEX + _FUSED + " select qid, claim_id, round(similarity, 6) as similarity, rank from fused")
def r4_hybrid(spark, sf):
    """Reciprocal rank fusion of both legs."""
    p, q = _base(spark, sf)
    return hybrid(p, q).withColumn("similarity", F.round("similarity", 6))


@query("passages questions", _DENSE + _LEX + _FUSED + f" select qid, claim_id, round(similarity, 6) as semantic, round(final_score, 6) as final_score, rank from (select qid, claim_id, similarity, {_SCORE} as final_score, row_number() over (partition by qid order by {_SCORE} desc, claim_id) as rank from fused join passages p on p.id = claim_id) where rank <= 10")
def recall(spark, sf):
    """The flagship: R4, then RK1, the ten best claims of each question."""
    p, q = _base(spark, sf)
    return rr.weighted(hybrid(p, q), p, _now()).select("qid", "claim_id", F.round("semantic", 6).alias("semantic"), F.round("final_score", 6).alias("final_score"), "rank")


@query("passages questions", _DENSE + ", f as (select qid, claim_id, 1.0::double / (60 + rank - 1) as share from dense where rank <= 30 union all select qid, claim_id, 1.0::double / (60 + rank - 1) from dense where rank <= 15), g as (select qid, claim_id, sum(share) as s from f group by 1, 2), h as (select qid, claim_id, round(s / max(s) over (partition by qid), 9) as s from g) select qid, claim_id, round(s, 6) as similarity, row_number() over (partition by qid order by s desc, claim_id) as rank from h qualify rank <= 10")
def r5_multi_list(spark, sf):
    """Ranks from 0 over several lists."""
    p, q = _base(spark, sf)
    hits = dense(p, q, 30)
    return op.fused([hits, hits.filter("rank <= 15")], 10, rank_base=0).withColumn("similarity", F.round("similarity", 6))


@query("passages questions", _DENSE + " select d.qid, claim_id, round(least(1.0, similarity + case when p.entity = o.entity then 0.15 else 0 end), 6) as similarity, rank from dense d join passages p on p.id = claim_id join passages o on o.id = d.qid where rank <= 30")
def r6_entity_boost(spark, sf):
    """Hits under the question's own entity rise by 0.15."""
    p, q = _base(spark, sf)
    hits = written(dense(p, q, 30), "hits")
    own, named = p.select(F.col("id").alias("qid"), F.col("entity").alias("own")), p.select(F.col("id").alias("claim_id"), "entity")
    matched = hits.join(own, "qid").join(named, "claim_id").filter("entity = own").select("qid", "claim_id")
    return op.boosted(hits, matched).select("qid", "claim_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("passages questions", _DENSE + f"""
 select d.qid, claim_id, round(case when {_has("'when did ' || q.text", tx.HINTS["is_temporal"])} and ({" or ".join(_has("p.content", form) for form in tx.DATE_FORMS)}) then least(1.0, similarity + 0.15) else similarity end, 6) as similarity
 from dense d join passages p on p.id = claim_id join questions q on q.qid = d.qid where rank <= 30""")
def r7_date_boost(spark, sf):
    """R7 and RK7."""
    p, q = _base(spark, sf)
    asked = q.withColumn("text", F.concat(F.lit("when did "), "text"))
    return op.date_boosted(dense(p, q, 30), asked, p).select("qid", "claim_id", F.round("similarity", 6).alias("similarity"))


_G1 = """+ s as (select a.id as qid, b.id as claim_id, greatest(-1, least(1, list_cosine_similarity(a.embedding::double[], b.embedding::double[]))) as sim from passages a join passages b on a.user_id = b.user_id and a.id <> b.id),
 top as (select *, row_number() over (partition by qid order by sim desc, claim_id) as rank from s where sim >= 0.45 qualify rank <= 4), edges as (select distinct least(qid, claim_id) as src, greatest(qid, claim_id) as dst, round(sim, 4) as weight from top)"""


@query("passages", _G1 + " select * from edges")
def g1_knn_edges(spark, sf):
    p, _ = _base(spark, sf)
    return vec.knn_edges(p)


@query("passages", _G1 + ", both_ as (select src, dst from edges union all select dst, src from edges), l as (select x.id, count(*) as n_similar, count(*) filter (x.entity = y.entity) as same from both_ join passages x on x.id = src join passages y on y.id = dst group by 1) select p.id, entity, coalesce(n_similar, 0) as n_similar, case when entity is null then 0 else count(*) over (partition by user_id, entity) - 1 - coalesce(same, 0) end as n_same from passages p left join l using (id)")
def g6_relationships(spark, sf):
    """Of each claim, its similarity edges and the number of other claims of its entity that aren't edges already."""
    p, _ = _base(spark, sf)
    return gr.relationships(p, vec.knn_edges(p))


@query("passages questions", _DENSE + ", " + _G1.removeprefix("+ ") + """, both_ as (select src, dst, weight from edges union all select dst, src, weight from edges), near as (select *, row_number() over (partition by src order by weight desc, dst) as nth from both_ qualify nth <= 3),
 new as (select d.qid, n.dst as claim_id, max(weight) as similarity from dense d join near n on n.src = d.claim_id where d.rank <= 3 and n.dst <> d.qid group by 1, 2)
 select qid, claim_id, round(similarity, 6) as similarity, 0 as pool from dense where rank <= 10 union all select qid, claim_id, round(similarity, 6), 1 from new where not exists (select 1 from dense d where d.rank <= 10 and d.qid = new.qid and d.claim_id = new.claim_id)""")
def r8_neighbour_expansion(spark, sf):
    """R8, ST2: neighbours of the three best hits."""
    p, q = _base(spark, sf)
    return op.neighbours_added(dense(p, q, 10), vec.knn_edges(p)).withColumn("similarity", F.round("similarity", 6))


@query()
def r9_sub_questions(spark, sf):
    """R9, F13, ST1: hybrid retrieval of every sub-question (the halves of a text), merged by claim, ranked anew for the question itself."""
    p, q = _base(spark, sf)
    words = F.split("text", " ")
    half = F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))
    subs = op.sub_questions(q.withColumn("text", F.concat_ws(" and ", F.array_join(F.slice(words, 1, half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))))
    subs = subs.select("qid", "sub_no", "text").join(q.drop("text"), "qid")
    numbered = subs.withColumn("root", F.col("qid")).withColumn("qid", F.col("qid") * 10 + F.col("sub_no"))
    legs = [vec.nearest(numbered.withColumn("id", F.col("root")), p, 100, 0.2, as_of=True), op.bm25(numbered, p, FIELDS, 100, exclude_self=False)]
    hits = op.fused(legs, 20).withColumn("qid", F.floor(F.col("qid") / 10)).filter("qid <> claim_id")
    merged = op.top_k(hits.groupBy("qid", "claim_id").agg(F.max("similarity").alias("similarity")), "similarity", 50)
    return rr.weighted(merged, p, _now()).select("qid", "claim_id", F.round("final_score", 6).alias("final_score"), "rank")


@query("passages questions", _DENSE + f""",
 again as (select q.qid, q.user_id, concat_ws(' ', q.text, left(p.content, 160), p.entity, p.attribute) as text
 from questions q join dense d on d.qid = q.qid and d.rank = 1 join passages p on p.id = d.claim_id where {_has("q.text", tx.HINTS["is_multi_hop"])} or d.similarity < 0.9)"""
 + _LEX.replace("from questions", "from again") + " select qid, claim_id, round(similarity, 6) as similarity, rank from lex where rank <= 20")
def r10_second_pass(spark, sf):
    """Weak questions are asked again with their best hit's words."""
    p, q = _base(spark, sf)
    again = op.second_pass_text(q, dense(p, q, 5), p, low=0.9)
    return op.bm25(again, p, FIELDS, 20).select("qid", "claim_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("passages questions", _DENSE + " select qid, claim_id, round(similarity, 6) as similarity from (select d.*, row_number() over (partition by qid, p.id // 10 order by similarity desc, claim_id) as nth from dense d join passages p on p.id = claim_id where rank <= 50) where nth = 1")
def pf16_chunk_collapse(spark, sf):
    """PF16 and R11: of the chunks of one parent the best."""
    p, q = _base(spark, sf)
    parents = p.select(F.col("id").alias("claim_id"), F.floor(F.col("id") / 10).alias("parent_id"))
    return op.one_per_parent(dense(p, q, 50), parents).select("qid", "claim_id", F.round("similarity", 6).alias("similarity"))


@query("passages questions", _DENSE + ", a as (select qid, claim_id, similarity as p from dense where rank <= 20), b as (select qid, claim_id, 1 - similarity as s from dense where rank between 11 and 40) select qid, claim_id, round(0.7 * coalesce(p, (select min(p) from a x where x.qid = t.qid), 0) + 0.3 * coalesce(s, (select min(s) from b x where x.qid = t.qid), 0), 6) as similarity from (select * from a full join b using (qid, claim_id)) t")
def rk5_ensemble(spark, sf):
    """RK5, ST3: two rankers, an absent score counts as the list's smallest."""
    p, q = _base(spark, sf)
    hits = dense(p, q, 40)
    second = hits.filter("rank between 11 and 40").withColumn("similarity", 1 - F.col("similarity"))
    return rr.ensemble(hits.filter("rank <= 20"), second).withColumn("similarity", F.round("similarity", 6))


@query("passages questions", _DENSE + f", two as (select qid, claim_id, 1 / (1 + exp(-4 * (similarity - 0.5))) as similarity, row_number() over (partition by qid order by 1 / (1 + exp(-4 * (similarity - 0.5))) desc, claim_id) as r2 from dense where rank <= 50 qualify r2 <= 25) select qid, claim_id, round(f, 6) as final_score, rank from (select qid, claim_id, {_SCORE} as f, row_number() over (partition by qid order by {_SCORE} desc, claim_id) as rank from two join passages p on p.id = claim_id) where rank <= 10")
def rk3_two_stage(spark, sf):
    """RK2, RK3: external pair scores, then the weighted score."""
    p, q = _base(spark, sf)
    hits = dense(p, q, 50)
    scores = hits.select("qid", "claim_id", (4 * (F.col("similarity") - 0.5)).alias("score"))
    return rr.two_stage(hits, scores, p, _now()).select("qid", "claim_id", F.round("final_score", 6).alias("final_score"), "rank")


@query("passages questions", _DENSE + ", o as (select qid, claim_id, row_number() over (partition by qid order by claim_id) as position from dense where rank <= 10 and claim_id % 3 <> 0) select qid, claim_id, row_number() over (partition by qid order by o.position is null, o.position, d.rank) as position from dense d left join o using (qid, claim_id) where d.rank <= 10")
def rk8_order_repair(spark, sf):
    """RK8, RK4: an external order made a permutation."""
    p, q = _base(spark, sf)
    hits = dense(p, q, 10)
    from pyspark.sql.window import Window

    order = hits.filter("claim_id % 3 <> 0").select("qid", "claim_id", F.row_number().over(Window.partitionBy("qid").orderBy("claim_id")).alias("position"))
    bad = order.select("qid", (-F.col("claim_id") - 1).alias("claim_id"), "position")
    return rr.order_repaired(hits, order.unionByName(bad))


@query("passages questions", _DENSE + f""",
 one as (select qid, claim_id, row_number() over (partition by qid order by 1 / (1 + exp(-4 * (similarity - 0.5))) desc, claim_id) as nth from dense where rank <= 40 qualify nth <= 20),
 two as (select qid, claim_id, row_number() over (partition by qid order by claim_id % 7, nth) as position from one qualify position <= 15),
 three as (select qid, claim_id, 1 - (position - 1) / count(*) over (partition by qid) as similarity from two),
 four as (select qid, claim_id, {_SCORE} as f, row_number() over (partition by qid order by {_SCORE} desc, claim_id) as rank from three join passages p on p.id = claim_id)
 select qid, claim_id, round(f, 6) as final_score, rank from four where rank <= 10""")
def rk4_three_stage(spark, sf):
    p, q = _base(spark, sf)
    hits = dense(p, q, 40)
    scores = hits.select("qid", "claim_id", (4 * (F.col("similarity") - 0.5)).alias("score"))
    order = hits.select("qid", "claim_id", (F.col("claim_id") % 7).alias("position"))
    return rr.three_stage(hits, scores, order, p, _now()).select("qid", "claim_id", F.round("final_score", 6).alias("final_score"), "rank")


@query("passages questions", _DENSE + _ranked(30, 10) + f""",
 a as (select r.qid, claim_id, case when {_has("q.text", tx.NEGATION)} = {_has("p.content", tx.NEGATION)} then least(1.0, f * 1.05) else f * 0.7 end as g
 from ranked r join questions q on q.qid = r.qid join passages p on p.id = claim_id)
 select qid, claim_id, round(g, 6) as final_score, row_number() over (partition by qid order by g desc, claim_id) as rank from a""")
def rk6_polarity(spark, sf):
    p, q = _base(spark, sf)
    ranked = rr.weighted(dense(p, q, 30), p, _now())
    return op.top_k(rr.polarity_adjusted(ranked, q, p).drop("rank"), "final_score", 10).select("qid", "claim_id", F.round("final_score", 6).alias("final_score"), "rank")


@query("passages questions", _DENSE + f""",
 pairs as (select sha1(concat_ws(chr(31), q.text, p.content)) as pair_key, rank, list_distinct({_tokens("q.text")}) as asked, {_tokens("p.content")} as held
 from dense d join questions q on q.qid = d.qid join passages p on p.id = claim_id where rank <= 20)
 select pair_key, case when min(rank) <= 5 then 0.5 when len(any_value(asked)) = 0 then 0 else len(list_intersect(any_value(asked), any_value(held))) / len(any_value(asked)) end::double as score from pairs group by 1""")
def rk9_pair_reuse(spark, sf):
    """RK9, U2: cached pair scores are reused, the others scored by lexical overlap."""
    p, q = _base(spark, sf)
    pairs = dense(p, q, 20).join(q.select("qid", F.col("text").alias("question")), "qid").join(p.select(F.col("id").alias("claim_id"), "content"), "claim_id").withColumn("pair_key", rr.pair_key(F.col("question"), F.col("content")))
    cache = pairs.filter("rank <= 5").select("pair_key", F.lit(0.5).alias("score")).distinct()
    return rr.scored_with_cache(pairs.dropDuplicates(["pair_key"]), cache, rr.lexical_overlap(F.col("question"), F.col("content")))


@query("passages questions", _DENSE + _ranked(30, 10) + f""",
 groups as (select qid, count(distinct coalesce(label::varchar, '')) as n from ranked join passages p on p.id = claim_id where entity is not null and attribute is not null group by qid, entity, attribute),
 clash as (select qid, max(n) > 1 as clash from groups group by 1),
 top as (select qid, max(f) filter (nth = 1) as first, max(f) filter (nth = 2) as second from ranked group by 1),
 r as (select q.qid, first - second as gap, case when first is null then 'no ranked hits' when {_has("q.text", tx.HINTS["is_multi_hop"])} then 'multi-hop question' when {_has("q.text", tx.HINTS["is_temporal"])} then 'temporal question'
 when {_has("q.text", tx.LIST_QUESTION)} then 'list question' when first < 0.70 then 'low confidence' when first - second < 0.15 then 'ambiguous' when clash then 'value conflict' else 'unambiguous' end as reason
 from questions q left join top using (qid) left join clash using (qid))
 select qid, reason in ('multi-hop question', 'temporal question', 'list question', 'unambiguous') as skip, reason, round(gap, 6) as gap from r""")
def b8_skip_resolution(spark, sf):
    p, q = _base(spark, sf)
    ranked = rr.weighted(dense(p, q, 30), p, _now())
    return rr.skip_resolution(ranked, q, p.withColumn("value", F.col("label").cast("string"))).withColumn("gap", F.round("gap", 6))


@query("passages questions", _DENSE + """, k as (select d.qid, p.id, p.ts, p.entity, p.attribute, p.label::varchar as val from dense d join passages p on p.id = claim_id where rank <= 50), c as (select a.qid, a.entity, a.attribute, a.id, b.id as other, b.ts as bts, least(1.0, epoch_us(b.ts - a.ts) / 86400e6 / 90) as pen from k a join k b on a.qid = b.qid and a.entity = b.entity and a.attribute = b.attribute and a.ts < b.ts and a.val <> b.val)
 select qid, entity, attribute, id, round(max(pen), 6) as penalty, first(other order by bts desc, other) as winner, max(pen) >= 0.8 as dropped from c group by 1, 2, 3, 4""")
def b6_conflicts_in_hits(spark, sf):
    """B6 at retrieval: conflicts among each question's hits."""
    p, q = _base(spark, sf)
    kept = dense(p, q, 50).join(p.select(F.col("id").alias("claim_id"), F.col("id"), "ts", "entity", "attribute", F.col("label").cast("string").alias("value")), "claim_id")
    return bl.conflicts(kept, ["qid"]).withColumn("penalty", F.round("penalty", 6))


@query("passages questions", _DENSE + _ranked(50, 50) + """,
 kept as (select qid, p.id, entity, attribute, ts, f from ranked join passages p on p.id = claim_id),
 fair as (select qid from kept group by 1 having 2 * count(*) filter (id % 3 = 0) <= count(*))
 select a.qid, a.id, first(b.id order by b.f desc, b.id) as winner from kept a join kept b using (qid, entity, attribute)
 where a.qid in (from fair) and a.id % 3 = 0 and b.id % 3 <> 0 and b.ts > a.ts group by 1, 2""")
def b7_valid_drops(spark, sf):
    p, q = _base(spark, sf)
    kept = rr.weighted(dense(p, q, 50), p, _now(), 50).join(p.select(F.col("id").alias("claim_id"), F.col("id"), "entity", "attribute"), "claim_id").select("qid", "id", "entity", "attribute", "ts", "final_score")
    return bl.valid_drops(kept.filter("id % 3 = 0").select("qid", "id"), kept)


@query()
def c2_context(spark, sf):
    """Budget, greedy packing and rendering of the ten best claims; packing is tested against a plain loop."""
    p, q = _base(spark, sf)
    ranked = rr.weighted(hybrid(p, q), p, _now(), 50)
    asked = q.select("qid", "text", F.lit(16000).alias("context_window"), F.lit(None).cast("int").alias("output_reserve"), F.element_at(F.lit(list(cx.LAYOUTS)), (F.col("qid") % 5 + 1).cast("int")).alias("layout"))
    return cx.assembled(asked, ranked, p.withColumn("summary_medium", F.left("content", F.lit(400))).withColumn("summary_short", F.left("content", F.lit(120)))).select("qid", "budget_total", "budget_remaining", "n_selected", "dropped", F.md5("rendered").alias("rendered_md5"))


@query("passages questions", _DENSE + _LEX + _FUSED + " select qid, 'dense' as stage, count(*) as n from dense group by 1 union all select qid, 'fused', count(*) from fused group by 1 union all select qid, 'ranked', least(10, count(*)) from fused group by 1")
def c5_stage_trace(spark, sf):
    """Rows after each stage, by question."""
    p, q = _base(spark, sf)
    hits = dense(p, q)
    both = hybrid(p, q)
    ranked = rr.weighted(both, p, _now())
    return cx.trace(dense=hits, fused=both, ranked=ranked)


@query()
def g3_clusters(spark, sf):
    """Two principal components and k-means clusters of all vectors, with labels; a seeded model, checked by tests."""
    p, _ = _base(spark, sf)
    return gr.cluster_summary(gr.projected(p), p)


_GOLD = "+ g as (select item_id as qid, d.doc_id as gold from benchmark b join documents d on contains(d.text, b.text))"


@query(sql="select b.item_id as qid, d.doc_id as gold from benchmark b join documents d on contains(d.text, b.text)")
def ev_gold_documents(spark, sf):
    """J10's role here: benchmark passages and the documents that hold them, joined by a window of their words and then checked."""
    return ev.containing(v.read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), v.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("qid", F.col("id").alias("gold"))


@query("passages questions", _DENSE + " select p.attribute as category, count(*) as n, round(avg(hit5), 6) as hit_at_5, round(avg(hit20), 6) as hit_at_20 from (select qid, max(case when rank <= 5 and p.label = o.label then 1 else 0 end) as hit5, max(case when rank <= 20 and p.label = o.label then 1 else 0 end) as hit20 from dense d join passages p on p.id = claim_id join passages o on o.id = qid group by 1) x join passages p on p.id = x.qid group by rollup (p.attribute)")
def a12_hits_by_category(spark, sf):
    """EV4, A12: share of questions with a hit of their own label among the first k, by language and over all."""
    p, q = _base(spark, sf)
    hits = written(dense(p, q, 20), "hits")
    own, named = p.select(F.col("id").alias("qid"), F.col("label").alias("own")), p.select(F.col("id").alias("claim_id"), "label")
    gold = hits.join(own, "qid").join(named, "claim_id").filter("label = own").select("qid", "claim_id")
    scores = ev.hit_at(hits, gold, [5, 20]).join(p.select(F.col("id").alias("qid"), F.col("attribute").alias("category")), "qid")
    return ev.by_category(scores, ["hit_at_5", "hit_at_20"])


@query("passages questions", _DENSE + f""",
 t as (select d.qid, {_tokens("p.content")} as p, {_tokens("q.text")} as g, {_bare_tokens("p.content")} as bp, {_bare_tokens("q.text")} as bg
 from dense d join questions q on q.qid = d.qid join passages p on p.id = claim_id where rank = 1),
 n as (select qid, p, g, bp, bg, len(list_distinct(p)) as np, len(list_distinct(g)) as ng, len(list_intersect(p, g)) as both_,
 coalesce(list_sum(list_transform(list_intersect(bp, bg), lambda w: least(len(list_filter(bp, lambda x: x = w)), len(list_filter(bg, lambda x: x = w))))), 0) as bag from t)
 select qid, round(case when len(g) = 0 then 1 else len(list_filter(g, lambda w: list_contains(p, w))) / len(g) end, 6)::double as context_recall,
 round(case when np = 0 and ng = 0 then 1 when both_ = 0 then 0 else 2 * both_ / (np + ng) end, 6)::double as f1_set,
 round(case when len(bp) = 0 and len(bg) = 0 then 1 when bag = 0 then 0 else 2 * bag / (len(bp) + len(bg)) end, 6)::double as f1_bag,
 (array_to_string(bp, ' ') = array_to_string(bg, ' '))::int::double as exact from n""")
def ev2_answer_scores(spark, sf):
    """EV1-EV3: recall and both F1 of each question's words against its best hit; formulas are tested by value."""
    p, q = _base(spark, sf)
    best = dense(p, q, 1).join(p.select(F.col("id").alias("claim_id"), "content"), "claim_id")
    return best.join(q.select("qid", "text"), "qid").select("qid", *(F.round(c, 6).alias(n) for n, c in ev.scores(F.col("content"), F.col("text")).items()))


@query("turns", "+ e as (select *, sha1(conv_id || ':' || turn_no) as h from turns) select conv_id, count(*) filter (role = 'assistant') * least(2, greatest(count(*) filter (role = 'user'), 0)) as n_triples from e group by 1 having count(*) filter (role = 'assistant') > 0 and count(*) filter (role = 'user') > 0")
def ev6_triples(spark, sf):
    """EV6: each assistant turn with two seeded user turns of its conversation as negatives, counted by conversation."""
    return ev.triples(v.turns(spark, sf), 2).groupBy("conv_id").agg(F.count("*").alias("n_triples"))


@query("passages questions", _DENSE + ", h as (select d.qid, claim_id, row_number() over (partition by d.qid order by d.rank) as nth from dense d join passages p on p.id = claim_id join passages o on o.id = d.qid where d.rank <= 50 and p.label <> o.label) select qid, claim_id, 0 as label from h where nth <= 2 union select qid, qid, 1 from h where nth <= 2")
def ev7_hard_negatives(spark, sf):
    """EV7, EV9: the two most similar hits of another label, as binary examples."""
    p, q = _base(spark, sf)
    hits = dense(p, q, 50).join(p.select(F.col("id").alias("claim_id"), "label"), "claim_id")
    own = q.join(p.select(F.col("id").alias("qid"), F.col("label").alias("own")), "qid").select("qid", "own")
    return ev.binary_examples(ev.hard_negatives(hits.join(own, "qid"), 2))


@query("passages questions", _DENSE + " select round(avg(case when a > b then 1.0 else 0 end), 6) as accuracy, round(avg(a - b), 6) as margin, count(*) as n from (select qid, max(case when rank = 1 then similarity end) as a, max(case when rank = 10 then similarity end) as b from dense group by 1) where a is not null and b is not null")
def ev5_ranking_accuracy(spark, sf):
    p, q = _base(spark, sf)
    hits = dense(p, q, 10)
    pos = hits.filter("rank = 1").select("qid", F.col("similarity").alias("pos"))
    return ev.ranking_accuracy(pos.join(hits.filter("rank = 10").select("qid", F.col("similarity").alias("neg")), "qid"))


@query("passages questions", _DENSE + f""", claims as ({v.SQL["claims"]}),
 named as (select d.qid, md5(content) as m, length(content) as len from dense d join passages p on p.id = claim_id where rank <= 20),
 probes as (select 'duplicates_in_hits' as probe, 5 as most, count(*)::double as x from (select 1 from named group by qid, m having count(*) > 1)
 union all select 'noise_share', 0.2, count(*) filter (len < 20) / count(*) from named
 union all select 'one_current_belief', 0, count(*) from (select 1 from claims where valid_to is null group by user_id, entity having count(*) <> 1)
 union all select 'closed_when_superseded', 0, count(*) from claims where superseded_by is not null and valid_to is null)
 select probe, x <= most as passed, round(x, 6) as evidence from probes""")
def ev10_audit(spark, sf):
    """EV10: duplicates among hits, noise share, time travel and identity probes as assertions."""
    p, q = _base(spark, sf)
    return ev.audit(dense(p, q, 20), p, v.claims(spark, sf))
