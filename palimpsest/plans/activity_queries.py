"""Activity, quota, source and telemetry queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import activity as op
from ..operators import entities as en
from ..operators import sketches as sk
from ..shared import written
from . import views as v
from .registry import query



def _now():
    return F.expr("timestamp'2024-01-31 00:00:00'")

_NOW = "timestamp '2024-01-31'"
_SESSIONS = """+ touched as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) is null or ts - lag(ts) over (partition by user_id order by ts) > interval 30 minutes then 1 else 0 end as fresh from activity),
 numbered as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as session_no from touched),
 sessions as (select user_id, session_no::bigint as session_no, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts, epoch_us(max(ts) - min(ts)) / 1e6 as seconds from numbered group by 1, 2)"""
_ROLLUP = _SESSIONS + f""", stats as (select user_id, count(*) as sessions, sum(seconds) as total_seconds, sum(case when last_ts > {_NOW} - interval 24 hours then seconds else 0 end) as seconds_24h, sum(n_events)::bigint as events, max(last_ts) as last_seen from sessions group by 1),
 rollup_ as (select user_id, email, plan, coalesce(sessions, 0) as sessions, round(coalesce(total_seconds, 0), 2) as total_seconds, round(coalesce(seconds_24h, 0), 2) as seconds_24h, coalesce(events, 0) as events, last_seen from users left join stats using (user_id))"""


def _rollup(spark, sf):
    return op.user_rollup(v.activity(spark, sf), v.users(spark, sf), _now()).withColumn("total_seconds", F.round("total_seconds", 2)).withColumn("seconds_24h", F.round("seconds_24h", 2))


@query("activity users", f"select count(*) as total_users, count(*) filter (is_active) as active_users, count(*) filter (created_at > {_NOW} - interval 7 days) as new_7d, (select count(distinct user_id) from activity where ts > {_NOW} - interval 5 minutes) as active_5m, (select count(distinct user_id) from activity where ts > {_NOW} - interval 24 hours) as dau, (select count(distinct user_id) from activity where ts > {_NOW} - interval 7 days) as wau, (select count(distinct user_id) from activity where ts > {_NOW} - interval 30 days) as mau, (select count(*) from activity where ts > {_NOW} - interval 24 hours) as events_24h from users")
def a1_activity_overview(spark, sf):
    return op.overview(v.activity(spark, sf), v.users(spark, sf), _now())


@query("activity", _SESSIONS + " select * replace (round(seconds, 3) as seconds) from sessions")
def w1_sessions(spark, sf):
    return op.sessions(v.activity(spark, sf)).withColumn("seconds", F.round("seconds", 3))


@query("activity users", _ROLLUP + " select * from rollup_")
def a2_user_rollup(spark, sf):
    """Users without activity appear with zeros."""
    return _rollup(spark, sf)


@query("activity", f"select date_trunc('hour', ts)::timestamp as hour, count(*) as events, count(distinct user_id) as users from activity where ts > {_NOW} - interval 24 hours group by 1")
def a3_hourly(spark, sf):
    return op.hourly(v.activity(spark, sf), _now())


@query("activity users claims", "select user_id, email, coalesce(n_events, 0) as events, coalesce(n_claims, 0) as claims from users left join (select user_id, count(*) as n_events from activity group by 1) using (user_id) left join (select user_id, count(*) as n_claims from claims group by 1) using (user_id)")
def a4_profile_counts(spark, sf):
    return op.profile_counts(v.users(spark, sf), events=v.activity(spark, sf), claims=v.claims(spark, sf))


@query("activity users", _ROLLUP + " select user_id, email, total_seconds, round(total_seconds / sessions, 3) as mean_session from rollup_ where total_seconds > 0 order by total_seconds desc, user_id limit 10")
def a5_time_leaderboard(spark, sf):
    return op.leaderboard(_rollup(spark, sf)).withColumn("mean_session", F.round("mean_session", 3))


@query("claims", "select user_id, sum(strlen(content) + strlen(entity) + strlen(attribute) + strlen(value))::bigint as bytes_used, count(*) as n_claims from claims group by 1")
def a6_storage(spark, sf):
    return op.storage(v.claims(spark, sf), ["content", "entity", "attribute", "value"])


@query("claims users", "+ usage as (select user_id, sum(strlen(content))::bigint as bytes_used, count(*) as n_claims from claims group by 1) select user_id, plan, quota_bytes::bigint as quota_bytes, coalesce(bytes_used, 0) as bytes_used, coalesce(n_claims, 0) as n_claims, round(case when quota_bytes > 0 then least(1.0, coalesce(bytes_used, 0) / quota_bytes) else 0 end, 6) as share from users left join usage using (user_id)")
def src10_quota_status(spark, sf):
    return op.quota_status(v.users(spark, sf), op.storage(v.claims(spark, sf), ["content"])).withColumn("share", F.round("share", 6))


@query("claims users", "+ usage as (select user_id, sum(strlen(content))::bigint as used from claims where valid_to is not null group by 1), more as (select user_id, sum(strlen(content))::bigint as incoming from claims where valid_to is null group by 1), t as (select user_id, coalesce(used, 0) as used, coalesce(incoming, 0) as incoming, quota_bytes::bigint as quota_bytes from users left join usage using (user_id) left join more using (user_id)) select *, case when quota_bytes <= 0 then 'unlimited' when used + incoming > 1.1 * quota_bytes then 'blocked' when used + incoming > 0.9 * quota_bytes then 'warned' else 'ok' end as decision from t")
def a7_quota_decision(spark, sf):
    c = v.claims(spark, sf)
    used = op.storage(c.filter("valid_to is not null"), ["content"]).select("user_id", F.col("bytes_used").alias("used"))
    incoming = op.storage(c.filter("valid_to is null"), ["content"]).select("user_id", F.col("bytes_used").alias("incoming"))
    rows = v.users(spark, sf).join(used, "user_id", "left").join(incoming, "user_id", "left")
    return rows.select("user_id", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("incoming", F.lit(0)).alias("incoming"), "quota_bytes", op.quota_decision(F.col("used"), F.col("incoming"), F.col("quota_bytes")).alias("decision"))


@query("claims users", "+ usage as (select user_id, sum(strlen(content))::bigint as bytes_used from claims where valid_to is not null group by 1) select id, user_id, running::bigint as running, coalesce(coalesce(quota_bytes <= 0, true) or running + coalesce(bytes_used, 0) <= 1.1 * quota_bytes, true) as admitted from (select id, user_id, sum(strlen(content)) over (partition by user_id order by ts, id) as running from claims where valid_to is null) left join usage using (user_id) left join users using (user_id)")
def w8_running_admission(spark, sf):
    c = v.claims(spark, sf)
    usage = op.storage(c.filter("valid_to is not null"), ["content"])
    incoming = c.filter("valid_to is null").withColumn("size", F.octet_length("content"))
    return op.admitted(incoming, usage, v.users(spark, sf), "size").select("id", "user_id", "running", "admitted")


@query("activity users", "select user_id, email, ts, method, path from (select * from activity order by ts desc, user_id, path limit 50) left join users using (user_id)")
def j2_recent_feed(spark, sf):
    return op.recent_feed(v.activity(spark, sf), v.users(spark, sf))


@query("activity", "select method, b.le as le, b.c as count, n, total from (select method, count(*) as n, round(sum(value), 2) as total, unnest([{'le': 1.0::double, 'c': count(*) filter (value <= 1)}, {'le': 5.0, 'c': count(*) filter (value <= 5)}, {'le': 10.0, 'c': count(*) filter (value <= 10)}, {'le': 50.0, 'c': count(*) filter (value <= 50)}]) as b from activity group by method)")
def a16_histogram(spark, sf):
    return op.histogram(v.activity(spark, sf), "method", "value", [1, 5, 10, 50]).withColumn("total", F.round("total", 2))


@query("activity", "select method, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, max(value) as max_value from activity group by 1")
def a13_latency_percentiles(spark, sf):
    out = op.percentiles(v.activity(spark, sf), "method", "value")
    return out.select("method", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "max_value")


@query()
def a1_sketched(spark, sf):
    """A1, approximate: distinct users of four spans from sketches that are stored for each five minutes; a test holds their error."""
    return sk.active_users(written(sk.user_sketches(v.activity(spark, sf)), "user-sketches"), _now())


_GAMMA = (1 + sk.ERROR) / (1 - sk.ERROR)


@query("activity", f"""+ b as (select method, sign(value)::int as s, case when value = 0 then 0 else ceil(ln(abs(value)) / {math.log(_GAMMA)!r})::int end as k, count(*) as n, max(value) as top from activity where value is not null and ts >= {_NOW} - interval 7 days group by 1, 2, 3),
 c as (select *, sum(n) over (partition by method order by s, s * k) as upto, sum(n) over (partition by method) as total, s * 2 * pow({_GAMMA!r}, k) / ({_GAMMA!r} + 1) as mid from b)
 select method, sum(n)::bigint as n, round(arg_min(mid, upto) filter (upto * 100 >= total * 50), 6) as p50, round(arg_min(mid, upto) filter (upto * 100 >= total * 95), 6) as p95, round(arg_min(mid, upto) filter (upto * 100 >= total * 99), 6) as p99, max(top) as max_value from c group by 1""")
def a13_sketched(spark, sf):
    """A13, approximate: percentiles of the last seven days from buckets that are stored for each five minutes."""
    stored = written(sk.value_buckets(v.activity(spark, sf), "method", "value"), "value-buckets")
    out = sk.quantiles(stored, "method", _now() - F.expr("interval 7 days"))
    return out.select("method", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "max_value")


@query("activity", """select user_id, max(n) as recorded, max(t) as last_recorded from (with recursive r as (select user_id, min(ts) as t, 1::bigint as n from activity where ts is not null group by 1
 union all select a.user_id, min(a.ts), r.n + 1 from r join activity a on a.user_id = r.user_id and a.ts >= r.t + interval 3600 seconds group by a.user_id, r.n) select * from r) group by 1""")
def ss4_throttle(spark, sf):
    """SS4: at most one recorded touch an hour, counted from the last recorded one."""
    return op.throttled(v.activity(spark, sf), 3600)


_EN = """+ trio as (select a.ps as a, b.ps as b, round(list_unique(list_intersect(a.g, b.g)) / list_unique(list_concat(a.g, b.g))::double, 6) as similarity
 from e a join e b on a.ps < b.ps where list_unique(list_intersect(a.g, b.g)) / list_unique(list_concat(a.g, b.g))::double >= 0.45)"""
_TRI = "with e as (select ps, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(ps), '[^\\w]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::int, 3))))) as g from (select distinct p_name as ps from part)) "


@query(sql=_TRI + ", " + _EN.lstrip("+ ") + " select * from trio")
def f19_trigram_pairs(spark, sf):
    """Pairs of different part names with pg_trgm similarity of 0.45 or more, through an inverted index."""
    names = v.read(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return en.trigram_pairs(names, names, "name", 0.45).filter("a < b").withColumn("similarity", F.round("similarity", 6))


@query(sql=_TRI + """, m as (select distinct case p_partkey % 4 when 0 then upper(p_name) when 1 then 'The ' || p_name || '!' when 2 then split_part(p_name, ' ', 1) else left(p_name, length(p_name) - 1) end as mention from part),
 n as (select mention, lower(trim(regexp_replace(regexp_replace(trim(mention), '^(?:the|a|an)\\s+', '', 'i'), '\\s+', ' ', 'g'), ' .,:;!?"''')) as norm from m),
 exact_ as (select mention, norm, ps as entity, 'alias' as rule, 1.0::double as similarity from n join e on norm = lower(ps)),
 first_ as (select mention, norm, min(ps) as entity, 'first_token' as rule, 1.0::double as similarity from n join e on norm = split_part(lower(ps), ' ', 1) where norm not in (select norm from exact_) group by 1, 2 having count(distinct ps) = 1),
 g as (select mention, norm, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(norm, '[^\\w]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::int, 3))))) as h from n where norm not in (select norm from exact_) and norm not in (select norm from first_)),
 scored as (select mention, norm, ps, list_unique(list_intersect(h, e.g)) / list_unique(list_concat(h, e.g))::double as s from g join e on true),
 best as (select mention, norm, first(ps order by s desc, ps) as ps, max(s) as s from scored group by 1, 2)
 select * from exact_ union all select * from first_ union all
 select mention, norm, case when s >= 0.45 then ps end as entity, case when s >= 0.65 then 'similar' when s >= 0.45 then 'candidate' else 'new' end as rule, round(case when s >= 0.45 then s end, 6) as similarity from best""")
def e1_mention_resolution(spark, sf):
    return resolved_parts(spark, sf).select("mention", "norm", "entity", "rule", F.round("similarity", 6).alias("similarity"))


def mentions_of_parts():
    """How a part is mentioned: in capitals, with an article, by its first word, or cut short."""
    name = F.col("p_name")
    return F.when(F.col("p_partkey") % 4 == 0, F.upper(name)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("The "), name, F.lit("!"))).when(F.col("p_partkey") % 4 == 2, F.split(name, " ")[0]).otherwise(F.left(name, F.length(name) - 1))


def resolved_parts(spark, sf):
    parts = v.read(spark, sf, "part")
    return en.resolved(parts.select(mentions_of_parts().alias("mention")).distinct(), parts.select(F.col("p_name").alias("entity")).distinct())


@query(sql=_TRI + """, n as (select p_name as name, min(p_partkey) as created, min(p_size) > 2 as provisional from part group by 1),
 t as (select a.ps as a, b.ps as b, list_unique(list_intersect(a.g, b.g)) / list_unique(list_concat(a.g, b.g))::double as s from e a join e b on a.ps < b.ps),
 j as (select a, b, s, (x.provisional, x.created, x.name) < (y.provisional, y.created, y.name) as first from t join n x on x.name = a join n y on y.name = b where s >= 0.3)
 select a, b, round(s, 6) as similarity, case when s >= 0.6 then 'merge' when s < 0.4 then 'reject' else 'pending' end as verdict, case when first then a else b end as survivor, case when first then b else a end as loser from j""")
def e4_merge_candidates(spark, sf):
    """Candidate pairs with the policy's verdict and the survivor."""
    names = v.read(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("created"), (F.min("p_size") > 2).alias("provisional"))
    pairs = en.trigram_pairs(names.select("name"), names.select("name"), "name", 0.3).filter("a < b")
    return en.merge_policy(pairs, names)
