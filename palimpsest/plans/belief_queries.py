"""Belief queries over the structured claims (orders) and the text claims (documents with vectors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import beliefs as op
from ..operators import retrieve as rt
from ..operators import vectors as vec
from . import views as v
from .registry import query

_SIG = "list_sort(list_distinct(list_transform(regexp_extract_all(content, '\\b\\d+(?:[.:]\\d+)*%?\\b'), lambda x: lower(x))))"


def _as_of():
    return F.expr("timestamp'1996-06-30 00:00:00'")


@query("claims", "select user_id, count(*) as claims, count(*) filter (valid_to is null) as current_claims, count(*) filter (valid_from <= timestamp '1996-06-30' and (valid_to is null or valid_to > timestamp '1996-06-30')) as at_instant from claims group by 1")
def pf2_validity_counts(spark, sf):
    """PF1-PF4: tenant, current and as-of views of the belief table."""
    c = op.with_latest(v.claims(spark, sf))
    parts = [c.groupBy("user_id").agg(F.count("*").alias("claims"), F.count_if("is_latest").alias("current_claims")), op.as_of(c, _as_of()).groupBy("user_id").agg(F.count("*").alias("at_instant"))]
    return parts[0].join(parts[1], "user_id", "left").select("user_id", "claims", "current_claims", F.coalesce("at_instant", F.lit(0)).alias("at_instant"))


@query("claims", "select id, entity, value, valid_from from claims where valid_from <= timestamp '1996-06-30' and (valid_to is null or valid_to > timestamp '1996-06-30')")
def pf3_as_of(spark, sf):
    return op.as_of(v.claims(spark, sf), _as_of()).select("id", "entity", "value", "valid_from")


@query("claims", "+ q as (select c_custkey as qid, c_custkey % 8 as user_id, 'customer ' || c_custkey as entity, timestamp '1995-01-01' + to_days((c_custkey % 1000)::int) as as_of from customer) select qid, id, entity, attribute, value from q join claims using (user_id, entity) where valid_from <= as_of and (valid_to is null or valid_to > as_of)")
def j9_beliefs_at_own_instant(spark, sf):
    return op.beliefs_at(_instants(spark, sf), v.claims(spark, sf))


def _instants(spark, sf):
    """Each customer asks at an instant of its own."""
    c = v.read(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.select(key.alias("qid"), (key % 8).alias("user_id"), F.concat(F.lit("customer "), key.cast("string")).alias("entity"), (F.expr("timestamp'1995-01-01 00:00:00'") + F.make_dt_interval((key % 1000).cast("int"))).alias("as_of"))


@query("claims", "+ q as (select o_orderkey as qid, o_custkey % 8 as user_id, 'customer ' || o_custkey as entity, o_orderdate + to_days((o_orderkey % 90)::int) as as_of from orders) select qid, id, entity, attribute, value from q join claims using (user_id, entity) where valid_from <= as_of and (valid_to is null or valid_to > as_of)")
def j9_binned(spark, sf):
    """J9 over time bins: each order asks what was believed of its customer some days later."""
    o = v.read(spark, sf, "orders")
    key = F.col("o_custkey")
    as_of = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((F.col("o_orderkey") % 90).cast("int"))
    q = o.select(F.col("o_orderkey").alias("qid"), (key % 8).alias("user_id"), F.concat(F.lit("customer "), key.cast("string")).alias("entity"), as_of.alias("as_of"))
    return op.beliefs_at_binned(q, v.claims(spark, sf))


@query("claims", "select id, user_id, entity, valid_to, superseded_by from claims")
def j4_close_by_link(spark, sf):
    """Intervals closed again from the forward links alone."""
    return op.backfilled_times(v.claims(spark, sf).withColumn("valid_from", F.lit(None).cast("timestamp"))).select("id", "user_id", "entity", "valid_to", "superseded_by")


_RIVALS = """+ r as (select user_id, entity, attribute, id, ts, lower(trim(coalesce(value, ''))) as val from claims),
 p as (select a.user_id, a.entity, a.attribute, a.id, b.id as other, b.ts as bts, least(1.0, epoch_us(b.ts - a.ts) / 86400e6 / 90.0) as penalty from r a join r b on a.user_id = b.user_id and a.entity = b.entity and a.attribute = b.attribute and a.ts < b.ts and a.val <> b.val)"""


@query("claims", _RIVALS + """
 select user_id, entity, attribute, id, round(max(penalty), 6) as penalty, first(other order by bts desc, other) as winner, max(penalty) >= 0.8 as dropped from p group by 1, 2, 3, 4""")
def b6_conflicts(spark, sf):
    """Older claims with a newer one of another value."""
    return op.conflicts(v.claims(spark, sf)).withColumn("penalty", F.round("penalty", 6))


@query("claims", _RIVALS + ", d as (select id from p group by 1 having max(penalty) >= 0.8) select user_id, count(*) as n, count(*) filter (id not in (from d)) as n_kept from claims group by 1")
def u3_resolvers(spark, sf):
    """Claims left by a resolver that keeps all, and by the rule of B6."""
    c = v.claims(spark, sf)
    every = op.resolved(c, resolver=op.keep_all).groupBy("user_id").agg(F.count("*").alias("n"))
    kept = op.resolved(c).groupBy("user_id").agg(F.count("*").alias("n_kept"))
    return every.join(kept, "user_id")


@query("claims", "select user_id, lower(entity) as entity, lower(attribute) as attribute, count(distinct lower(trim(value))) as n_values, 'unresolved_values:' || lower(entity) || '/' || lower(attribute) as reason from claims group by 1, 2, 3 having count(distinct lower(trim(value))) > 1")
def a11_unresolved(spark, sf):
    return op.unresolved(v.claims(spark, sf), ["user_id"])


@query("claims", "select c.id, c.user_id, c.valid_from, c.valid_to, c.superseded_by, s.supersedes from claims c left join (select user_id, superseded_by as id, list_sort(list(id)) as supersedes from claims where superseded_by is not null group by 1, 2) s using (user_id, id)")
def b9_lineage(spark, sf):
    """B9 and J15."""
    return op.lineage(v.claims(spark, sf)).select("id", "user_id", "valid_from", "valid_to", "superseded_by", "supersedes")


_LEDGER = """+ d as (select c.user_id, c.id, p.id as nearest_id, case when p.id is null then 'insert' when c.value = p.value then 'touch' when c.authority >= p.authority then 'supersede' else 'conflict' end as decision, c.ts as created_at from claims c left join claims p on p.user_id = c.user_id and p.superseded_by = c.id),
 e as (select user_id, id, d.id as new_id, nearest_id, decision, created_at from d union all select user_id, nearest_id, d.id, nearest_id, decision, created_at from d where nearest_id is not null),
 l as (select user_id, id, list(strftime(created_at, '%Y-%m-%d') || '|' || new_id || '|' || decision || '|' || coalesce(nearest_id::varchar, '') order by created_at, new_id) as ledger,
  list_sort(list(distinct case when new_id = id then nearest_id else new_id end) filter (decision = 'conflict')) as conflict_with from e group by 1, 2)"""


@query("claims", _LEDGER + ", s as (select user_id, superseded_by as id, list_sort(list(id)) as supersedes from claims where superseded_by is not null group by 1, 2) select user_id, id, valid_from, valid_to, superseded_by, supersedes, ledger, conflict_with from claims left join s using (user_id, id) left join l using (user_id, id)")
def b9_full_lineage(spark, sf):
    """B9 in full: intervals, links both ways, conflict partners and the ledger; a claim is decided against the one that it follows."""
    c = v.claims(spark, sf)
    before = c.filter("superseded_by is not null").select("user_id", F.col("id").alias("nearest_id"), F.col("superseded_by").alias("id"), F.col("value").alias("old"), F.col("authority").alias("rank"))
    decision = F.when(F.col("nearest_id").isNull(), "insert").when(F.col("value") == F.col("old"), "touch").when(F.col("authority") >= F.col("rank"), "supersede").otherwise("conflict")
    d = c.join(before, ["user_id", "id"], "left").select("user_id", "id", "nearest_id", decision.alias("decision"), F.lit("order").alias("reason"), F.col("ts").alias("created_at"))
    line = F.transform("ledger", lambda e: F.concat_ws("|", F.date_format(e["created_at"], "yyyy-MM-dd"), e["new_id"].cast("string"), e["decision"], F.coalesce(e["nearest_id"].cast("string"), F.lit(""))))
    return op.full_lineage(c, d).withColumn("ledger", line)


@query("claims", "select user_id, id, last_value(id) over w as head, count(*) over w - row_number() over (partition by user_id, entity order by ts, id) as ahead, count(*) over w as length from claims window w as (partition by user_id, entity order by ts, id rows between unbounded preceding and unbounded following)")
def b9_chains(spark, sf):
    """The chain of supersessions that each claim is part of, by pointer doubling along the links."""
    return op.chains(v.claims(spark, sf))


def _batch(spark, sf):
    c = v.claims(spark, sf)
    new = c.filter("valid_to is null").withColumn("id", F.col("id") + 100_000_000).withColumn("ts", F.expr("ts + interval 30 days"))
    return c, new


@query("claims", """+ b as (select user_id, entity, attribute, max({'ts': ts, 'id': id + 100000000}) as top from claims where valid_to is null group by 1, 2, 3)
 select id, b.top.id as superseded_by from claims join b using (user_id, entity, attribute) where valid_to is null and not pinned""")
def b5_same_key_supersession(spark, sf):
    c, new = _batch(spark, sf)
    return op.superseded_by_key(c, new)


@query("claims", "+ d as (select distinct c_custkey % 8 as user_id, 'customer ' || c_custkey as departed, c_custkey as by_id from customer where c_custkey % 3 = 0) select user_id, id, min(by_id) as by_id from claims join d using (user_id) where valid_to is null and not pinned and (lower(entity) = lower(departed) or lower(value) = lower(departed)) group by 1, 2")
def j13_retraction(spark, sf):
    key = F.col("c_custkey")
    gone = v.read(spark, sf, "customer").filter(key % 3 == 0).select((key % 8).alias("user_id"), F.concat(F.lit("customer "), key.cast("string")).alias("departed"), key.alias("by_id"))
    return op.retracted(v.claims(spark, sf), gone)


@query("claims", """+ n as (select id, greatest(ts, timestamp '1997-01-01') as ts from claims where id % 2 = 0 union all select id + 100000000, ts from claims where id % 2 = 1)
 select coalesce(c.id, n.id) as id, greatest(c.ts, n.ts) as ts, case when n.id is not null then timestamp '1999-01-01' else c.tx_time end as tx_time, c.valid_to from claims c full join n on c.id = n.id""")
def src4_upsert(spark, sf):
    """SRC4 and SS6: known ids get the later time and never reopen; new ids are added."""
    c = v.claims(spark, sf).select("id", "ts", "tx_time", "valid_to", F.lit(None).cast("string").alias("entity_id"))
    even = c.filter("id % 2 = 0").withColumn("ts", F.greatest("ts", F.expr("timestamp'1997-01-01 00:00:00'")))
    odd = c.filter("id % 2 = 1").withColumn("id", F.col("id") + 100_000_000)
    batch = even.unionByName(odd).withColumn("valid_to", F.lit(None).cast("timestamp"))
    return op.upserted(c, batch, F.expr("timestamp'1999-01-01 00:00:00'")).drop("entity_id")


@query("claims", "+ s as (select * from claims where id % 4 <> 0), i as (select * from claims) select count(*) as seen, count(*) filter (id not in (select id from s)) as inserted, count(*) filter (id in (select id from s)) as skipped from i")
def src6_import_counts(spark, sf):
    """SRC6 and J12: insert-ignore by id, counted."""
    c = v.claims(spark, sf)
    stored = c.filter("id % 4 <> 0").select("id", F.lit(1).alias("known"))
    return c.join(stored, "id", "left").agg(F.count("*").alias("seen"), F.count_if(F.col("known").isNull()).alias("inserted"), F.count("known").alias("skipped"))


@query("claims", "select user_id, count(*) as n from claims where id not in (select id from claims where id % 5 = 0) and user_id <> 3 group by 1")
def src5_deletes(spark, sf):
    """SRC5: deletion by id and purge of a tenant, as anti-joins."""
    c = v.claims(spark, sf)
    left = c.join(c.filter("id % 5 = 0").select("id"), "id", "left_anti").join(v.users(spark, sf).filter("user_id = 3").select("user_id"), "user_id", "left_anti")
    return left.groupBy("user_id").agg(F.count("*").alias("n"))


@query("passages questions", """+ sims as (select q.qid, p.id as nearest_id, greatest(-1, least(1, list_cosine_similarity(q.vector::double[], p.embedding::double[]))) as s from questions q join passages p on q.user_id = p.user_id and p.id <> q.qid where p.id % 50 <> 0 and p.valid_to is null and not p.pinned),
 top as (select qid as id, first(nearest_id order by s desc, nearest_id) as nearest_id, max(s) as s from sims group by 1)
 select p.id, case when t.nearest_id is null or s < 0.8 then 'insert' when s >= 0.97 then 'touch' else 'related' end as decision, t.nearest_id, round(t.s, 6) as similarity from passages p left join top t using (id) where p.id % 50 = 0""")
def j7_nearest_belief(spark, sf):
    """The nearest active unpinned belief outside the batch, with the gate's thresholds on similarity."""
    p = v.passages(spark, sf)
    q = p.filter("id % 50 = 0").select("id", "user_id", F.col("embedding").alias("vector"))
    near = vec.nearest(q, p.filter("id % 50 <> 0 and valid_to is null and not pinned"), 1)
    rows = q.join(near.withColumnRenamed("qid", "id"), "id", "left")
    decision = F.when(F.col("claim_id").isNull() | (F.col("similarity") < op.RELATED), "insert").when(F.col("similarity") >= op.TOUCH, "touch").otherwise("related")
    return rows.select("id", decision.alias("decision"), F.col("claim_id").alias("nearest_id"), F.round("similarity", 6).alias("similarity"))


def decisions(spark, sf):
    """The gate over the passages whose id is divisible by 50, against all others."""
    p = v.passages(spark, sf)
    new = p.filter("id % 50 = 0")
    near = vec.nearest(new.select("id", "user_id", F.col("embedding").alias("vector")), p.filter("id % 50 <> 0 and valid_to is null and not pinned"), 1)
    known = near.join(p.select(F.col("id").alias("claim_id"), F.col("content").alias("nearest_content")), "claim_id").select(F.col("qid").alias("id"), F.col("claim_id").alias("nearest_id"), "similarity", "nearest_content", F.lit(False).alias("nearest_is_retraction"))
    return op.gate(new.select("id", "content", F.lit(True).alias("has_vector"), F.lit(None).cast("string").alias("retraction")), known)


@query()
def b1_write_gate(spark, sf):
    """Signals need Java's look-ahead, which the oracle's engine lacks; golden tests fix the rules."""
    return decisions(spark, sf).withColumn("similarity", F.round("similarity", 6))


@query()
def a14_gate_statistics(spark, sf):
    return decisions(spark, sf).groupBy("decision", "reason").agg(F.count("*").alias("n"))


@query("claims", "select user_id, entity, id, next_value from (select user_id, entity, id, value, lead(value) over (partition by user_id, entity order by ts, id) as next_value from claims) where next_value is not null and next_value <> value")
def b2_value_changes(spark, sf):
    """B2: where a belief closes because its value changes."""
    c = v.claims(spark, sf)
    nxt = c.select(F.col("id").alias("superseded_by"), F.col("value").alias("next_value"))
    return c.join(nxt, "superseded_by").filter("next_value <> value").select("user_id", "entity", "id", "next_value")


@query("claims", "select a.id, list_sort(list(distinct b.id)) as conflict_with from claims a join claims b on a.user_id = b.user_id and a.entity = b.entity and a.id <> b.id and (a.superseded_by = b.id or b.superseded_by = a.id) and a.value <> b.value group by 1")
def b4_cross_links(spark, sf):
    """Symmetric, sorted partner lists of neighbours in time with different values."""
    c = v.claims(spark, sf)
    nxt = c.select(F.col("id").alias("superseded_by"), F.col("value").alias("other"))
    pairs = c.join(nxt, "superseded_by").filter("other <> value").select("id", F.lit("conflict").alias("decision"), F.col("superseded_by").alias("nearest_id"))
    return op.cross_links(pairs)


@query("claims", "+ n as (select nearest_id as id, max(ts) as new_ts from (select superseded_by as nearest_id, ts + interval 10 days as ts from claims where superseded_by is not null) group by 1) select id, greatest(ts, coalesce(new_ts, ts)) as ts from claims left join n using (id)")
def b3_touch(spark, sf):
    c = v.claims(spark, sf)
    d = c.filter("superseded_by is not null").select("id", F.lit("touch").alias("decision"), F.col("superseded_by").alias("nearest_id"))
    return op.touch_times(c, d, c.select("id", F.expr("ts + interval 10 days").alias("ts"))).select("id", "ts")


@query("claims", "select 'customer' as kind, round(avg(len), 6) as mean_chain, max(len) as longest, count(*) as entities from (select entity, count(*) as len from claims group by 1)")
def b9_chain_lengths(spark, sf):
    c = v.claims(spark, sf).groupBy("entity").agg(F.count("*").alias("len"))
    return c.agg(F.round(F.avg("len"), 6).alias("mean_chain"), F.max("len").alias("longest"), F.count("*").alias("entities")).select(F.lit("customer").alias("kind"), "*")


@query("claims", "select entity, count(distinct id) as n_claims from claims group by 1 order by n_claims desc, entity limit 20")
def a8_top_entities(spark, sf):
    return rt.top_entities(v.claims(spark, sf).select("entity", "id"), 20)


@query("claims", "select id, 'conv-' || substr(sha1(user_id || chr(31) || lower(content) || chr(31) || lower(entity) || chr(31) || lower(attribute) || chr(31) || lower(value)), 1, 12) as dedupe_id, 'ent_' || substr(sha1(user_id || chr(31) || entity), 1, 12) as entity_id, length(content) // 4 as tokens, strlen(content) + strlen(entity) as bytes from claims")
def f21_ids(spark, sf):
    """F21, F22, F28."""
    c = v.claims(spark, sf)
    user = F.col("user_id").cast("string")
    return c.select("id", tx.dedupe_id(user, F.col("content"), F.col("entity"), F.col("attribute"), F.col("value")).alias("dedupe_id"), tx.entity_id(user, F.col("entity")).alias("entity_id"), tx.estimate_tokens(F.col("content")).alias("tokens"), tx.byte_size(F.col("content"), F.col("entity")).alias("bytes"))


@query("claims", "select id, user_id, content, ts from claims where user_id = 5 and entity = 'customer 37' or content ilike '%urgent%' and valid_to is null order by ts desc, id limit 50")
def pf7_browse(spark, sf):
    """PF7, PF8 and K2: an entity's newest claims and a case-insensitive search, paged."""
    c = v.claims(spark, sf)
    hit = (F.col("user_id") == 5) & (F.col("entity") == "customer 37") | F.col("content").ilike("%urgent%") & F.col("valid_to").isNull()
    return c.filter(hit).orderBy(F.desc("ts"), "id").limit(50).select("id", "user_id", "content", "ts")


@query("claims", "select id, case when authority not between 0 and 1 then 1 else 0 end + case when valid_to < valid_from then 1 else 0 end as n_faults from claims")
def validate_claims(spark, sf):
    return op.validated(v.claims(spark, sf)).select("id", F.size("faults").alias("n_faults"))
