"""Text, extraction, source and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup
from ..operators import extract as op
from ..operators import retrieve as rt
from ..shared import shared_folder
from ..sources import io
from ..streaming import gate, jobs
from . import views as v
from .registry import query

_TECHS = "['Redis','Kafka','PostgreSQL','Flask','Heroku','Docker']"


@query("turns", "+ t as (select conv_id, turn_no, lower(trim(role)) as role, trim(regexp_replace(regexp_replace(text, '```\\w*\\n?|```', ' ', 'g'), '\\s+', ' ', 'g')) as text from turns) select conv_id, turn_no, role, length(text) as n_chars, md5(text) as text_md5 from t where text <> ''")
def x1_normalized_turns(spark, sf):
    """X1, F1."""
    return op.normalized_turns(v.turns(spark, sf)).select("conv_id", "turn_no", "role", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("said", f"""+ k as (select c.o_orderkey as k, o_custkey as conv_id, {_TECHS}[o_orderkey % 6 + 1] as tech, (o_orderkey % 9 + 1) || '.' || (o_custkey % 5) as version, (o_custkey % 8000 + 1000)::varchar as port, ['MySQL','Jenkins','Rails'][o_orderkey % 3 + 1] as old, 'ops' || (o_custkey % 100) || '@example.com' as email from orders c)
 select category, count(*) as n, count(distinct value) as n_values from (select 'technology' as category, tech as value from k union all select 'version', version from k union all select 'port', port from k union all select 'retraction', old from k union all select 'person', 'Priya' from k union all select 'email', email from k) group by 1""")
def x3_categorical_extraction(spark, sf):
    """Categories and values of the templated turns, where the right answer is known by construction."""
    units = op.extracted(v.said(spark, sf), statements=False).filter("category not in ('statement', 'url')")
    return units.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("said", f"select o_orderkey as turn_no, {_TECHS}[o_orderkey % 6 + 1] as entity, (o_orderkey % 9 + 1) || '.' || (o_custkey % 5) as value, {_TECHS}[o_orderkey % 6 + 1] || ' version is ' || (o_orderkey % 9 + 1) || '.' || (o_custkey % 5) || '.' as content, 0.7::double as importance, 1.0::double as confidence from orders")
def x3_versions(spark, sf):
    """Versions paired with the technology before them, scored."""
    units = op.extracted(v.said(spark, sf), statements=False).filter("category = 'version'")
    return units.select("turn_no", "entity", "value", "content", "importance", "confidence")


@query()
def x7_statements(spark, sf):
    """Statements beyond what the categories cover; golden tests fix the rule."""
    return op.extracted(v.said(spark, sf)).filter("category = 'statement'").groupBy("conv_id", "supersedes_hint").agg(F.count("*").alias("n"))


@query()
def x15_claims_from_turns(spark, sf):
    """X15 over X1-X12: claims with ids, ready for the gate."""
    units = op.extracted(v.said(spark, sf))
    return op.claim_rows(units, (F.col("conv_id") % 8).cast("string")).select("id", "user_id", "content", "entity", "attribute", "value", "authority", "supersedes_hint")


@query("said", f"select o_orderkey as turn_no, 'billing-svc' as source, 'uses' as relation, t as target, 0.5::double as confidence from (select o_orderkey, unnest([{_TECHS}[o_orderkey % 6 + 1], ['MySQL','Jenkins','Rails'][o_orderkey % 3 + 1]]) as t from orders) union all select o_orderkey, {_TECHS}[o_orderkey % 6 + 1], 'version', (o_orderkey % 9 + 1) || '.' || (o_custkey % 5), 0.85 from orders union all select o_orderkey, 'We', 'uses', {_TECHS}[o_orderkey % 6 + 1], 0.8 from orders")
def x14_relationships(spark, sf):
    """X13, X14."""
    return op.relationship_edges(v.said(spark, sf)).select("turn_no", "source", "relation", "target", "confidence")


@query()
def x16_chunks(spark, sf):
    """Long documents as chunks of whole sentences; a property test holds their sizes and words."""
    docs = v.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return op.chunked(docs, 128).select("id", "parent_id", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


@query("turns", "select * from (select conv_id, turn_no as first_turn, lead(turn_no, 2) over w as last_turn, role || ': ' || text || ' | ' || lead(role || ': ' || text, 1) over w || ' | ' || lead(role || ': ' || text, 2) over w as content, 'message-window' as source, 0.65::double as authority from turns window w as (partition by conv_id order by turn_no)) where last_turn is not null")
def w2_message_windows(spark, sf):
    return op.message_windows(v.turns(spark, sf))


@query("turns", "+ n as (select conv_id, text, row_number() over (partition by conv_id order by turn_no) - 1 as n from turns), p as (select conv_id, n // 2 as pair, max(case when n % 2 = 0 then text end) as first, max(case when n % 2 = 1 then text end) as second from n group by 1, 2) select conv_id, pair, coalesce(nullif(left(trim(coalesce(first, '')), 70), ''), nullif(left(trim(coalesce(second, '')), 70), ''), 'Conversation') as title, left(coalesce(second, ''), 280) as summary from p")
def x21_cards(spark, sf):
    """W3, X21, F29."""
    return op.cards(op.paired(v.turns(spark, sf)))


@query("turns", "select conv_id, turn_no, list(text) over (partition by conv_id order by turn_no rows between 5 preceding and 1 preceding) as history from turns")
def w9_history(spark, sf):
    """The five turns before each."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn_no").rowsBetween(-5, -1)
    h = v.turns(spark, sf).select("conv_id", "turn_no", F.collect_list("text").over(w).alias("history"))
    return h.withColumn("history", F.when(F.size("history") > 0, F.col("history")))


@query()
def x20_near_duplicates(spark, sf):
    """X20 over all documents; tested against all pairs on a fixture."""
    docs = v.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    return dedup.near_duplicates(docs)


@query(sql="select doc_id, least(length(s), 160) as n_chars, left(s, 50) as beginning from (select doc_id, trim(regexp_extract(trim(text), '^((?s:.)*?[.!?])(\\s|$)', 1)) as a, case when regexp_matches(trim(text), '[.!?]\\s') then trim(regexp_extract(trim(text), '^((?s:.)*?[.!?])\\s', 1)) else trim(text) end as s from documents)")
def f4_summaries(spark, sf):
    s = tx.first_sentence_summary(F.col("text"))
    return v.read(spark, sf, "documents").select("doc_id", F.when(s.endswith("…"), 160).otherwise(F.length(s)).alias("n_chars"), F.left(s, F.lit(50)).alias("beginning"))


@query()
def f6_entities_and_dates(spark, sf):
    """F5-F9 over all documents: names, dates, signals, resolved days; golden tests fix the rules."""
    d, c = v.read(spark, sf, "documents"), F.col("text")
    return d.select("doc_id", F.size(tx.extract_entities(c)).alias("n_entities"), F.size(tx.extract_dates(c)).alias("n_dates"), F.size(tx.signal_tokens(c)).alias("n_signals"), F.size(tx.resolve_dates(c, F.expr("timestamp'2024-03-15 00:00:00'"))).alias("n_days"))


@query()
def f11_question_hints(spark, sf):
    """F10-F15, PF9-PF11: hints, intent, as-of, polarity of every turn."""
    c = F.col("text")
    h = tx.classify_query(c)
    return v.turns(spark, sf).select("conv_id", "turn_no", h["category"].alias("category"), h["top_k_multiplier"].alias("multiplier"), tx.classify_intent(c).alias("intent"), tx.is_list_question(c).alias("is_list"), tx.is_negated(c).alias("negated"), tx.parse_as_of(c, F.expr("timestamp'2024-03-15 00:00:00'")).alias("as_of"), F.size(tx.decompose(c)).alias("parts"), tx.matches(c, tx.PLEASANTRY).alias("pleasantry"), tx.looks_like_denial(c).alias("denial"), tx.is_pure_question(c).alias("pure_question"))


@query("passages", "+ i as (select distinct id, entity from (select id, lower(trim(entity)) as entity from passages)) select entity, count(distinct id) as n_claims from i group by 1")
def a9_entity_index(spark, sf):
    """The inverted index, counted for the claims' own entities, which SQL can state; a9_entity_counts has all of it."""
    p = v.passages(spark, sf)
    index = rt.entity_postings(p)
    own = p.select(F.lower(F.trim("entity")).alias("entity")).distinct()
    return index.join(own, "entity").groupBy("entity").agg(F.count_distinct("id").alias("n_claims"))


@query()
def a9_entity_counts(spark, sf):
    """The whole inverted index, counted: the claims' own entities and the names and dates in their texts; tested against a plain loop."""
    return rt.entity_postings(v.passages(spark, sf)).groupBy("entity").agg(F.count_distinct("id").alias("n_claims"))


@query()
def a10_entity_synthesis(spark, sf):
    p = v.passages(spark, sf)
    return op.synthesized(p, rt.entity_postings(p)).select("id", "entity", F.md5("content").alias("content_md5"), "ts")


@query("turns", "select conv_id, turn_no, role, text from turns")
def src1_json_lines(spark, sf):
    """SRC1: turns written as JSON lines, read back tolerantly; broken lines go to the rejected output."""
    path = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    v.turns(spark, sf).select(F.to_json(F.struct("conv_id", "turn_no", "role", "text")).alias("value")).unionByName(spark.range(3).select(F.lit("{broken").alias("value"))).write.text(path)
    good, _ = io.read_json_lines(spark, path, "conv_id long, turn_no long, role string, text string")
    return good


@query("turns", "select conv_id, 'session_' || (turn_no // 4 + 1) as session_id, turn_no % 4 as position, role as speaker, text as content from turns")
def src7_nested_sessions(spark, sf):
    """SRC7: conversations nested by session and read back as rows."""
    t = v.turns(spark, sf)
    nested = t.groupBy("conv_id", F.concat(F.lit("session_"), (F.floor(F.col("turn_no") / 4) + 1).cast("string")).alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn_no").alias("n"), F.col("role").alias("speaker"), "text"))).alias("m"))
    dump = nested.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", F.transform("m", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"))))))).alias("conversation"))
    return io.unnested_sessions(dump).select("conv_id", "session_id", F.col("position").cast("long").alias("position"), "speaker", "content")


@query("activity", "select date_trunc('hour', ts)::timestamp as hour, count(*) as events from activity group by 1")
def ss1_stream_hourly(spark, sf):
    """SS1: tumbling counts of a file stream, run to its end; late rows are within the watermark by the closing row."""
    return jobs.drained(spark, jobs.hourly(jobs.activity_stream(spark, sf)), "hourly", complete=True).select("hour", "events")


@query()
def ss2_stream_presence(spark, sf):
    """SS2: users of sliding five minutes."""
    return jobs.drained(spark, jobs.presence(jobs.activity_stream(spark, sf)), "presence", complete=True)


@query("activity", "+ t as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minutes then 1 else 0 end as fresh from activity window w as (partition by user_id order by ts)), n as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as s from t) select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_events from n group by user_id, s")
def ss3_stream_sessions(spark, sf):
    """SS3: session windows of 30 minutes; a gap of exactly 30 minutes stays in one session."""
    return jobs.drained(spark, jobs.sessions(jobs.activity_stream(spark, sf)), "sessions", complete=True)


@query("activity", "select method, count(*) as n, count(*) filter (value <= 10) as le_10 from activity group by 1")
def ss9_stream_telemetry(spark, sf):
    return jobs.drained(spark, jobs.telemetry(jobs.activity_stream(spark, sf)), "telemetry", complete=True)


@query("claims", "select id, ts from claims")
def ss5_stream_upsert(spark, sf):
    """SS5, SS6: claims streamed twice into a snapshot table; redelivery inserts nothing."""
    return jobs.ingested(spark, v.claims(spark, sf).select("id", "ts")).select("id", "ts")


def gated(spark, sf):
    """The folder of beliefs and ledger after all turns were streamed through extraction and gate."""
    at = f"{shared_folder(spark)}/gate-{uuid.uuid4().hex}"
    gate.ingest(spark, v.turns(spark, sf, stream=True), at, F.col("conv_id") % 4)
    return at


@query()
def ss5_stream_gate(spark, sf):
    """SS5, SS6: turns streamed through extraction and gate to the belief table; tests hold it under stops and redelivery."""
    return gate.beliefs(spark, gated(spark, sf)).select("user_id", "id", "content", "ts", "valid_to", "superseded_by", "conflict_with")


@query()
def ss8_decision_feed(spark, sf):
    """SS8: the newest decisions of the ledger that the streamed gate wrote with its beliefs."""
    decisions = gate.ledger(spark, gated(spark, sf))
    return gate.feed(decisions, limit=500).select("user_id", "id", "decision", "nearest_id", F.round("similarity", 6).alias("similarity"), "reason", "created_at")
