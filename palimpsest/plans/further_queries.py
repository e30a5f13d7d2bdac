"""Sources and sinks round trips, backfills, pairs, ranks of stale hits, session dates, graph nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import beliefs as bl
from ..operators import entities as en
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import retrieve as rt
from ..shared import shared_folder
from ..sources import io
from . import recall_queries as rq
from . import views as v
from .activity_queries import mentions_of_parts, resolved_parts
from .belief_queries import _RIVALS
from .registry import ORACLES, query


@query("passages", "select source, count(*) as n from passages where user_id = 1 and embedding is not null group by 1")
def src3_append_and_scan(spark, sf):
    """SRC2, SRC3: claims appended in two parts, then one tenant's claims with vectors."""
    c = v.passages(spark, sf)
    path = f"{shared_folder(spark)}/claims-{uuid.uuid4().hex}"
    for rest in (0, 1):
        io.append_claims(c.filter(F.col("id") % 2 == rest), path)
    return io.read_claims(spark, path, user_id=1, with_vectors=True).groupBy("source").agg(F.count("*").alias("n"))


@query(sql="select event_type as event, count(*) as n, count(distinct user_id) as users from events where event_type is not null group by 1")
def src9_event_log(spark, sf):
    """SRC9: events written as structured log lines, then scanned."""
    e = v.read(spark, sf, "events")
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    line = F.struct(F.col("ts").cast("string").alias("timestamp"), F.lit("info").alias("level"), F.lit("api").alias("component"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("trace_id"), F.col("user_id").cast("string").alias("user_id"))
    e.select(F.to_json(line).alias("value")).write.text(path)
    return io.event_log(spark, path).groupBy("event").agg(F.count("*").alias("n"), F.count_distinct(F.col("extras")["user_id"]).alias("users"))


@query("turns", "select distinct conv_id, text as positive from turns where role = 'assistant' and conv_id in (select conv_id from turns where role = 'user')")
def st5_distinct_pairs(spark, sf):
    return ev.distinct_pairs(ev.triples(v.turns(spark, sf), 2), "conv_id")


@query("passages questions", rq._DENSE + " select qid, min(rank) filter (where valid_to is not null) as first_stale, min(rank) filter (where valid_to is null) as first_fresh from dense d join passages p on p.id = claim_id where rank <= 20 group by 1")
def w12_stale_and_fresh(spark, sf):
    """Ranks of the first hit that was closed later and of the first that never was."""
    p, q = rq._base(spark, sf)
    return ev.first_ranks(rq.dense(p, q, 20), p.filter("valid_to is not null").select(F.col("id").alias("claim_id")))


@query(sql="select source, count(*) as n, count(*) filter (vec_id is null and text is not null) as filled, count(*) filter (vec_id is null and text is null) as still_null, min(case when vec_id is null then 64 else len(embedding) end)::int as least_dims from documents left join embeddings on doc_id = vec_id group by 1")
def b12_vector_backfill(spark, sf):
    """Every document without a vector gets one, with counts by source."""
    d, e = v.read(spark, sf, "documents"), v.read(spark, sf, "embeddings")
    c = d.join(e, d.doc_id == e.vec_id, "left").select("source", F.col("text").alias("content"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("vec_id").isNull().alias("missing"))
    out = bl.with_vectors(c)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("missing") & F.col("embedding").isNotNull()).alias("filled"), F.count_if(F.col("embedding").isNull()).alias("still_null"), F.min(F.size("embedding")).alias("least_dims"))


@query(sql="select p_partkey as id, p_name as norm, first_value(p_name) over (partition by split_part(p_name, ' ', 1) order by p_partkey) as canonical from part")
def e3_batch_links(spark, sf):
    """Mentions of one batch that share a first word are one entity, named by the earliest."""
    m = v.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("norm"), F.col("p_partkey").alias("first_seen"), F.split("p_name", " ")[0].alias("word"))
    earliest = m.groupBy("word").agg(F.min("id").alias("a"))
    return en.linked_in_batch(m.drop("word"), m.join(earliest, "word").select("a", F.col("id").alias("b")))


@query(sql="select count(*) as n, count(*) filter (p_partkey % 3 = 0) as known, 0 as open from part")
def e6_entity_backfill(spark, sf):
    """Claims whose mention has no entity yet are resolved; none stays open, as no mention is generic."""
    p = v.read(spark, sf, "part")
    claims = p.select(F.col("p_partkey").alias("id"), mentions_of_parts().alias("entity"), F.when(F.col("p_partkey") % 3 == 0, "known").alias("entity_id"))
    out = en.backfilled(claims, p.select(F.col("p_name").alias("entity")).distinct())
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("entity_id") == "known").alias("known"), F.count_if(F.col("entity_id").isNull()).cast("int").alias("open"))


_SPOKEN = "(o_orderkey % 12 + 1) || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') || case when o_orderkey % 2 = 0 then ' am' else ' pm' end || ' on ' || day(o_orderdate) || ' ' || monthname(o_orderdate) || ', ' || year(o_orderdate)"


@query(sql="select o_orderkey as id, " + _SPOKEN + " as spoken, date_trunc('day', o_orderdate) + to_hours(((o_orderkey % 12 + 1) % 12 + case when o_orderkey % 2 = 0 then 0 else 12 end)::int) + to_minutes((o_orderkey % 60)::int) as at, case when o_orderkey % 5 = 0 then timestamp '2024-01-01' else date_trunc('day', o_orderdate) end as stated from orders")
def f31_session_dates(spark, sf):
    """session dates as they are spoken, and timestamps that are dates or else now."""
    o = v.read(spark, sf, "orders")
    now, key, day = F.expr("timestamp'2024-01-01 00:00:00'"), F.col("o_orderkey"), F.col("o_orderdate")
    spoken = F.concat((key % 12 + 1).cast("string"), F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0"), F.when(key % 2 == 0, " am").otherwise(" pm"), F.lit(" on "), F.day(day).cast("string"), F.lit(" "), F.date_format(day, "MMMM"), F.lit(", "), F.year(day).cast("string"))
    stated = F.when(key % 5 == 0, "some day").otherwise(F.date_format(day, "yyyy-MM-dd"))
    return o.select(key.alias("id"), spoken.alias("spoken")).withColumn("at", tx.parse_session_date(F.col("spoken"), now)).join(o.select(key.alias("id"), tx.normalize_ts(stated, now).alias("stated")), "id")


@query()
def j11_entity_lookup(spark, sf):
    """Claims indexed under an entity or date that a question names; a large name's claims are its postings."""
    p, q = rq._base(spark, sf)
    return rt.entity_lookup(q, rt.entity_postings(p)).groupBy("qid").agg(F.count("*").alias("n_claims"))


@query()
def g5_nodes(spark, sf):
    """A display row for every claim with a vector, from a seeded model."""
    p, _ = rq._base(spark, sf)
    return gr.nodes(gr.projected(p), p).select("id", "label", "cluster", F.round("size", 6).alias("size"))


@query("claims", _RIVALS + f""", w as (select id as a, first(other order by bts desc, other) as b from p group by 1),
 shown as (select user_id, entity as qid, id from claims qualify row_number() over (partition by user_id, entity order by ts desc, id) <= 10),
 sides as (select s.qid, w.a, w.b from shown s join w on s.id = w.a or s.id = w.b group by all having count(*) = 1),
 named as (select norm from ({ORACLES["e1_mention_resolution"]}) group by 1 having count(distinct entity) > 1)
 select 'both_conflict_sides' as probe, count(*) = 0 as passed, count(*)::double as evidence from sides union all select 'alias_names_one_entity', count(*) = 0, count(*)::double from named""")
def ev10_identity_audit(spark, sf):
    """EV10: of each customer the ten newest claims are surfaced; a conflict of which they hold one side only is a fault, as is an alias of two entities."""
    c = v.claims(spark, sf)
    newest = F.row_number().over(Window.partitionBy("user_id", "entity").orderBy(F.desc("ts"), "id"))
    surfaced = c.withColumn("nth", newest).filter("nth <= 10").select(F.col("entity").alias("qid"), "id")
    return ev.identity_audit(surfaced, bl.conflicts(c).select(F.col("id").alias("a"), F.col("winner").alias("b")), resolved_parts(spark, sf))
