"""Ingestion, date, predicate, entity and evaluation queries over rows that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import context as ctx
from ..operators import entities as en
from ..operators import evaluate as ev
from ..operators import extract as op
from ..operators import retrieve as rt
from . import views as v
from .registry import query


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(_sql_text, words)) + "]"


@query(sql="""select o_orderkey as turn_no, 'user: ' || case o_orderkey % 3 when 0 then 'We shipped it yesterday.' when 1 then 'They paid 3 days ago.' else 'Nothing was said about dates.' end
 || case o_orderkey % 3 when 2 then '' else ' [resolved: ' || strftime(d, '%Y-%m-%d') || ' (' || strftime(d, '%A %B %-d %Y') || ')]' end as content, 0.7::double as authority
 from (select o_orderkey, o_orderdate - to_days(case o_orderkey % 3 when 0 then 1 else 3 end) as d from orders)""")
def x17_message_claims(spark, sf):
    """Messages as claims, relative days resolved by the message's own time."""
    o = v.read(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "We shipped it yesterday.").when(F.col("o_orderkey") % 3 == 1, "They paid 3 days ago.").otherwise("Nothing was said about dates.")
    turns = o.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn_no"), F.lit("user").alias("role"), text.alias("text"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return op.message_claims(turns).select("turn_no", "content", "authority")


@query(sql="""select o_orderkey as qid, 'Order ' || o_orderkey || case o_orderkey % 3 when 1 then ' was placed yesterday.' else ' was placed' end as content, 'order ' || o_orderkey as entity, strftime(o_orderdate, '%Y-%m-%d') as value,
 round(([1.0, 0.6, 0.5, 0.0][o_orderkey % 4 + 1])::double * (case o_orderkey % 3 when 0 then 0.7 else 1.0 end)::double, 6) as confidence, case o_orderkey % 3 when 0 then 'assistant' else 'user' end as speaker from orders""")
def x18_model_answers(spark, sf):
    """X18, F25, F26, F32, PF10, PF11: fenced JSON answers as claims; denials go, made-up dates are repaired, odd confidences coerced."""
    o = v.read(spark, sf, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    asked = F.when(key % 3 == 0, "What is the priority of this order?").when(key % 3 == 1, "I changed it yesterday.").otherwise("My order matters.")
    confidence = F.element_at(F.lit(["1.7", "0.6", "high", "-1"]), (key % 4 + 1).cast("int"))

    def fact(content, value):
        return F.struct(content.alias("content"), F.concat(F.lit("order "), key).alias("entity"), F.lit("placed").alias("attribute"), value.alias("value"), confidence.alias("confidence"))

    facts = F.array(fact(F.concat(F.lit("Order "), key, F.lit(" was placed on "), day, F.lit(".")), day), fact(F.lit("Noted."), F.lit("")))
    answers = o.select(key.alias("qid"), asked.alias("user_query"), F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(facts.alias("facts"))), F.lit("\n```")).alias("answer"))
    return op.ingested_answers(answers).select("qid", "content", "entity", "value", F.round("confidence", 6).alias("confidence"), "speaker")


@query(sql="""select o_orderkey as id, 'customer ' || o_custkey || case when o_orderkey % 2 = 0 then ' did not' else '' end || ' place order ' || o_orderkey || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')' as content, 'customer ' || o_custkey as entity, 0.85::double as authority from orders
 union all select o_orderkey, 'Turn about ' || o_orderpriority, null, 0.75 from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'Session of ' || o_orderstatus, null, 0.8 from orders where o_orderkey % 7 = 0""")
def x19_tuple_records(spark, sf):
    """X19, PF12, PF13, F27: tuples and summaries as claims; open tuples and placeholder subjects go."""
    o = v.read(spark, sf, "orders")
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")

    def triple(s, verb, obj, time, negated):
        return F.struct(s.alias("s"), verb.alias("v"), obj.alias("o"), time.alias("time"), negated.alias("negated"))

    said = triple(F.concat(F.lit("customer "), "o_custkey"), F.lit("place"), F.concat(F.lit("order "), key), F.date_format("o_orderdate", "yyyy-MM-dd"), key % 2 == 0)
    tuples = F.array(said, triple(F.lit("User"), F.lit("said"), F.lit("hello"), none, F.lit(False)), triple(F.lit("someone else"), none, F.lit("it"), none, F.lit(False)))
    records = o.select(key.alias("id"), tuples.alias("tuples"), F.when(key % 3 == 0, F.concat(F.lit("Turn about "), "o_orderpriority")).otherwise("").alias("turn_summary"), F.when(key % 7 == 0, F.concat(F.lit("Session of "), "o_orderstatus")).alias("session_summary"))
    return op.tuple_claims(records)


@query(sql="""select o_orderkey as qid, case o_orderkey % 4 when 0 then date_trunc('month', o_orderdate) + interval 1 month - interval 1 second when 1 then date_trunc('day', o_orderdate) + interval 1 day - interval 1 second
 when 2 then date_trunc('year', o_orderdate) + interval 1 year - interval 1 second else timestamp '2024-01-15' - to_days((o_orderkey % 300 + 1)::int) end as as_of from orders""")
def f10_asked_instants(spark, sf):
    """the instant that a question asks about, at the end of the period it names."""
    o, key, d = v.read(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("What changed in "), F.date_format(d, "MMMM yyyy"), F.lit("?"))).when(key % 4 == 1, F.concat(F.lit("What was open on "), F.date_format(d, "yyyy-MM-dd"), F.lit("?")))
        .when(key % 4 == 2, F.concat(F.lit("What shipped in "), F.date_format(d, "yyyy"), F.lit("?"))).otherwise(F.concat(F.lit("Which one was first "), key % 300 + 1, F.lit(" days ago?")))
    )
    return o.select(key.alias("qid"), tx.parse_as_of(text, F.expr("timestamp'2024-01-15 00:00:00'")).alias("as_of"))


@query("turns", f"""+ t as (select conv_id, turn_no, text, lower(trim(text)) as low from turns) select conv_id, turn_no, regexp_matches(text, {_sql_text(tx.PLEASANTRY)}) as pleasantry, regexp_matches(text, {_sql_text(tx.LIST_QUESTION)}) as list_question, regexp_matches(text, {_sql_text(tx.NEGATION)}) as negated,
 low = '' or (length(low) <= 12 and len(list_filter(['hi', 'hello', 'thanks', 'thank you'], lambda p: contains(low, p))) > 0) or len(list_filter({_sql_list(tx.DENIALS)}, lambda p: contains(low, p))) > 0 as denial,
 low <> '' and len(list_filter({_sql_list(tx.FIRST_PERSON)}, lambda p: contains(' ' || low || ' ', p))) = 0 and (ends_with(regexp_replace(low, '[ .!]+$', ''), '?') or len(list_filter({_sql_list(tx.QUESTION_STARTS)}, lambda p: starts_with(low, p))) > 0) as pure_question from t""")
def pf9_turn_predicates(spark, sf):
    """PF9, PF10, PF11, F14, F15: what kind of message each turn is."""
    c = F.col("text")
    kinds = {"pleasantry": tx.matches(c, tx.PLEASANTRY), "list_question": tx.is_list_question(c), "negated": tx.is_negated(c), "denial": tx.looks_like_denial(c), "pure_question": tx.is_pure_question(c)}
    # of a turn without text nothing is known
    return v.turns(spark, sf).select("conv_id", "turn_no", *(F.when(c.isNotNull(), k).alias(n) for n, k in kinds.items()))


@query(sql="""with n as (select distinct lower(trim(p_name)) as canonical from part), a as (select canonical, canonical as alias from n union all select canonical, array_to_string(list_transform(string_split(canonical, ' '), lambda w: w[1]), '') from n where contains(canonical, ' '))
 select 'ent_' || left(sha1('7' || chr(31) || canonical), 12) as entity_id, canonical, alias from a""")
def e2_created_entities(spark, sf):
    """New entities with ids that depend on tenant and name alone, with the name and its acronym as aliases."""
    norm = tx.normalize_mention(F.col("p_name"))
    return en.created(v.read(spark, sf, "part").select(norm.alias("norm"), F.lit("new").alias("rule")), 7)


@query("claims", "select 'customer ' || (k - k % 10) as entity_id, count(*) as n, max(ts) as ts from (select split_part(entity, ' ', 2)::bigint as k, ts from claims) group by 1")
def e5_merged_claims(spark, sf):
    """E5: claims of merged entities point to the survivor."""
    c = v.claims(spark, sf)
    k = F.col("c_custkey")
    mapping = v.read(spark, sf, "customer").filter(k % 10 != 0).select(F.concat(F.lit("customer "), k).alias("loser"), F.concat(F.lit("customer "), k - k % 10).alias("survivor"))
    return en.merged(c.withColumnRenamed("entity", "entity_id"), mapping).groupBy("entity_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))


_WORD = r"[\p{L}\p{N}_\p{M}]"
_SQUAD = rf"list_filter(regexp_split_to_array(regexp_replace(array_to_string(list_transform(regexp_extract_all(lower(text), '{_WORD}+|[^{_WORD[1:]}+'), lambda w: case when w in ('a', 'an', 'the') then ' ' else w end), ''), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '')"


@query("turns", f"""+ t as (select conv_id, turn_no, {_SQUAD} as p from turns), g as (select conv_id, turn_no, p, lead(p) over (partition by conv_id order by turn_no) as g from t),
 o as (select *, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0) as m from g where g is not null)
 select conv_id, turn_no, round(case when len(p) = 0 and len(g) = 0 then 1.0 when m = 0 then 0.0 else 2.0 * m / (len(p) + len(g)) end::double, 6) as f1_bag, (array_to_string(p, ' ') = array_to_string(g, ' '))::int::double as exact from o""")
def ev3_answer_overlap(spark, sf):
    """EV3: bag F1 and exact match of each turn against the next."""
    t = v.turns(spark, sf).withColumn("gold", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn_no"))).filter("gold is not null")
    return t.select("conv_id", "turn_no", F.round(ev.token_f1_bag(F.col("text"), F.col("gold")), 6).alias("f1_bag"), ev.exact_match(F.col("text"), F.col("gold")).alias("exact"))


@query(sql="""with b as (select o_orderkey as qid, 1000 + o_orderkey % 8000 as w, length(o_orderpriority) // 4 as q, case when o_orderkey % 2 = 0 then 300 end as r from orders), p as (select *, coalesce(r, floor(w * 0.25::double)) as kept, floor(w * 0.1::double) as margin from b)
 select qid, (w - kept - q - 200 - margin)::int as budget, case greatest(kept, q, 200, margin) when kept then 'output_reserve' when q then 'query_tokens' when 200 then 'template_overhead' else 'safety_margin' end as largest from p""")
def c1_budgets(spark, sf):
    """Tokens left for claims, and the part that takes most."""
    key = F.col("o_orderkey")
    o = v.read(spark, sf, "orders").select(key.alias("qid"), (F.lit(1000) + key % 8000).alias("w"), F.when(key % 2 == 0, 300).alias("r"), F.col("o_orderpriority").alias("q"))
    return o.select("qid", ctx.budget(F.col("w"), F.col("r"), F.col("q")).alias("budget"), ctx.largest_reservation(F.col("w"), F.col("r"), F.col("q")).alias("largest"))


@query("passages", r"""+ w as (select id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_\p{M}]+')) as term from passages) select term, count(distinct id) as df from w group by 1""")
def a18_corpus_statistics(spark, sf):
    """In how many claims each term occurs."""
    p = v.passages(spark, sf)
    return rt.corpus_statistics(rt.postings(p, ["content"]))


@query("claims", """+ o as (select id, user_id, entity, ts, authority, case when id % 3 = 0 then '0.25' when id % 3 = 1 then 'unsure' end as said from claims)
 select id, case when id % 3 = 0 then 0.25 else authority end::double as confidence, entity as label from o""")
def pf14_claim_view(spark, sf):
    """PF14: a claim as the interface shows it: a numeric confidence, else its authority."""
    said = F.when(F.col("id") % 3 == 0, "0.25").when(F.col("id") % 3 == 1, "unsure")
    return v.claims(spark, sf).select("id", tx.coerce_confidence(said, F.col("authority")).alias("confidence"), F.coalesce("entity", F.left("content", F.lit(40))).alias("label"))
