"""Belief maintenance over bitemporal claims: validity, conflicts, the write gate and its effects.

Claims have (user_id, id, entity, attribute, value, content, ts, valid_from, valid_to, pinned, ...).
A batch is decided against the belief table as it was before the batch, so the result does not depend on
the order of rows; where several rows close one belief, the link goes to the smallest (ts, id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.embed import hash_vector
from ..shared import written

TOUCH, RELATED = 0.97, 0.80
FULL_PENALTY_DAYS, DROP_PENALTY = 90.0, 0.8
CUE = r"(?i)\b(no longer|not anymore|moved (?:off|away from)|moved to|migrat(?:ed|ing)|switch(?:ed|ing)?\s+(?:to|from)|instead of|chang(?:ed|ing)\s+(?:to|from)|renamed|deprecated|replaced (?:by|with)|now (?:runs?|uses?|lives?|on|at)|used to (?:be|run|use|live))\b"


def scope(claims: DataFrame, user_id, admin: bool = False) -> DataFrame:
    return claims if admin else claims.filter(F.col("user_id") == user_id)


def current(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("valid_to").isNull())


def as_of(claims: DataFrame, instant: Column) -> DataFrame:
    return claims.filter((F.col("valid_from") <= instant) & (F.col("valid_to").isNull() | (F.col("valid_to") > instant)))


def with_latest(claims: DataFrame) -> DataFrame:
    return claims.withColumn("is_latest", F.col("valid_to").isNull())


def beliefs_at(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """Each question (qid, user_id, entity, as_of) with the claims on its entity that were valid at its own instant."""
    c = claims.select("user_id", "entity", "attribute", "id", "value", "valid_from", "valid_to")
    hit = (F.col("valid_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("as_of")))
    return questions.join(c, ["user_id", "entity"]).filter(hit).select("qid", "id", "entity", "attribute", "value")


def beliefs_at_binned(questions: DataFrame, claims: DataFrame, fine: int = 20) -> DataFrame:
    """``beliefs_at`` for entities of very many versions: an instant meets only the intervals that lie in its bins.

    An interval goes to the level whose bins are as long as it, or up to twice, so that it lies in one or two of them; an instant goes
    to its bin of each level that any interval has. The finest bins are 2^-fine of the time asked about. An open interval
    ends after the last instant; intervals without a beginning, empty ones and questions without an instant have no hits.
    """
    first, last = questions.agg(F.min(F.unix_micros("as_of")), F.max(F.unix_micros("as_of"))).first()
    if first is None:
        return beliefs_at(questions.limit(0), claims)
    lowest = max(0, (last - first).bit_length() - fine)
    c = claims.select("user_id", "entity", "attribute", "id", "value", "valid_from", "valid_to")
    # cut to the time asked about, which changes no hit
    c = c.withColumn("lo", F.greatest(F.unix_micros("valid_from"), F.lit(first)) - first).withColumn("hi", F.least(F.coalesce(F.unix_micros("valid_to"), F.lit(last + 1)), F.lit(last + 1)) - first)
    c = c.filter("valid_from is not null and lo < hi").withColumn("level", F.greatest(F.lit(lowest), F.length(F.bin(F.col("hi") - F.col("lo") - 1))))
    c = written(c, "intervals")
    slots = F.array_distinct(F.array(F.expr("shiftright(lo, level)"), F.expr("shiftright(hi - 1, level)")))
    binned = c.withColumn("slot", F.explode(slots)).drop("lo", "hi")
    # at most ``fine`` + 2
    levels = F.array(*(F.lit(r.level) for r in c.select("level").distinct().orderBy("level").collect())).cast("array<int>")
    q = questions.filter("as_of is not null").withColumn("level", F.explode(levels)).withColumn("slot", F.expr(f"shiftright(unix_micros(as_of) - {first}L, level)"))
    hit = (F.col("valid_from") <= F.col("as_of")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("as_of")))
    # a shuffle of both sides: Spark's estimates count a question's copies and an interval's slots once, so that it would broadcast too much
    return q.join(binned.hint("merge"), ["user_id", "entity", "level", "slot"]).filter(hit).select("qid", "id", "entity", "attribute", "value")


def closed_by_link(claims: DataFrame) -> DataFrame:
    """Superseded rows get valid_to from the row that superseded them, or their own time where that is gone."""
    by = claims.select(F.col("user_id"), F.col("id").alias("superseded_by"), F.col("ts").alias("closing_ts"))
    closed = F.when(F.col("superseded_by").isNotNull(), F.coalesce("closing_ts", "ts"))
    return claims.drop("valid_to").join(by, ["user_id", "superseded_by"], "left").withColumn("valid_to", closed).drop("closing_ts")


def conflicts(claims: DataFrame, group: list[str] | None = None, drop: float = DROP_PENALTY) -> DataFrame:
    """Older claims with a differing newer one on the same (entity, attribute): id, penalty, winner, dropped.

    A claim's largest age gap is to the newest claim of another value. That is the group's newest claim,
    or, for claims of that value, the newest of the other values: two aggregates instead of all pairs.
    """
    keys = [*(group or ["user_id"]), "entity", "attribute"]
    rows = claims.filter("entity is not null and attribute is not null").select(*keys, "id", "ts", F.lower(F.trim(F.coalesce("value", F.lit("")))).alias("v"))
    newest = F.max(F.struct("ts", (-F.col("id")).alias("order"), "v"))
    top = rows.groupBy(*keys).agg(newest.alias("first"))
    second = rows.join(top, keys).filter(F.col("v") != F.col("first.v")).groupBy(*keys).agg(newest.alias("second"))
    rival = F.when(F.col("v") != F.col("first.v"), F.col("first")).otherwise(F.col("second"))
    found = rows.join(top, keys).join(second, keys).withColumn("rival", rival).filter(F.col("rival.ts") > F.col("ts"))
    age = (F.unix_micros("rival.ts") - F.unix_micros("ts")) / 86400e6
    return found.select(*keys, "id", F.least(F.lit(1.0), age / FULL_PENALTY_DAYS).alias("penalty"), (-F.col("rival.order")).alias("winner")).withColumn("dropped", F.col("penalty") >= drop)


def keep_all(claims: DataFrame, group: list[str] | None = None) -> DataFrame:
    """A resolver that drops nothing."""
    return conflicts(claims, group).filter(F.lit(False))


def resolved(claims: DataFrame, group: list[str] | None = None, resolver: Callable[[DataFrame, list[str] | None], DataFrame] = conflicts) -> DataFrame:
    """claims without those that the resolver drops. A resolver maps (claims, group) to (the group's columns, id, dropped, ...)."""
    keys = [*(group or ["user_id"]), "id"]
    return claims.join(resolver(claims, group).filter("dropped").select(*keys), keys, "left_anti")


def unresolved(claims: DataFrame, group: list[str]) -> DataFrame:
    """Groups (entity, attribute) that still hold more than one value."""
    value = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    return claims.filter("entity is not null and attribute is not null").groupBy(*group, F.lower(F.trim("entity")).alias("entity"), F.lower(F.trim("attribute")).alias("attribute")).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1").withColumn("reason", F.concat(F.lit("unresolved_values:"), "entity", F.lit("/"), "attribute"))


def gate(incoming: DataFrame, nearest: DataFrame, touch: float = TOUCH, related: float = RELATED) -> DataFrame:
    """Decision for each incoming claim.

    incoming: (id, content, has_vector, retraction of null or the departed value); nearest: (id, nearest_id,
    similarity, nearest_content, nearest_is_retraction), at most one row for an id.
    """
    rows = incoming.join(nearest, "id", "left")
    new, old = tx.signal_tokens(F.col("content")), tx.signal_tokens(F.coalesce("nearest_content", F.lit("")))
    rows = rows.withColumn("new", F.array_sort(new)).withColumn("old", F.array_sort(old))
    equal = (F.col("new") == F.col("old")) & (F.size("new") > 0)
    same = (F.col("similarity") >= touch) | equal
    guard = F.coalesce(same & F.coalesce("nearest_is_retraction", F.lit(False)), F.lit(False))
    cue = F.col("content").rlike(CUE)
    decision = F.when(F.col("retraction").isNotNull(), "retract").when(~F.col("has_vector") | F.col("nearest_id").isNull() | (F.col("similarity") < related), "insert").when(same & ~guard, "touch").when(cue, "supersede").otherwise("conflict")
    reason = (
        F.when(F.col("retraction").isNotNull(), "retraction").when(~F.col("has_vector"), "no_embedding").when(F.col("nearest_id").isNull(), "no_neighbour").when(F.col("similarity") < related, "below_related")
        .when(same & ~guard, F.when(F.col("similarity") >= touch, "sim>=touch").otherwise("signals_equal")).when(cue, F.when(guard, "cue+polarity_guard").otherwise("cue")).otherwise(F.when(guard, "polarity_guard").otherwise("no_cue"))
    )
    matched = F.when(decision == "retract", F.array("retraction")).when(decision == "touch", F.col("new")).when(decision.isin("supersede", "conflict"), F.array_intersect("new", "old"))
    return rows.select("id", decision.alias("decision"), "nearest_id", "similarity", reason.alias("reason"), matched.alias("matched_signals"))


def retracted(claims: DataFrame, departures: DataFrame) -> DataFrame:
    """Active unpinned claims whose value or entity is a departed one (user_id, departed, by_id): two equi-joins, no nested loop."""
    d = departures.select("user_id", F.lower("departed").alias("gone"), "by_id")
    open_ = claims.filter("valid_to is null and not pinned")
    hits = [open_.withColumn("gone", F.lower(c)).join(d, ["user_id", "gone"]).select("user_id", "id", "by_id") for c in ("value", "entity")]
    return hits[0].unionByName(hits[1]).groupBy("user_id", "id").agg(F.min("by_id").alias("by_id"))


def close_intervals(claims: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """claims after the batch's supersessions: valid_to = now and superseded_by, the smallest closing id."""
    by = decisions.filter("decision = 'supersede'").groupBy(F.col("nearest_id").alias("id")).agg(F.min("id").alias("closer"))
    out = claims.join(by, "id", "left")
    return out.withColumn("valid_to", F.when(F.col("closer").isNotNull(), F.coalesce("valid_to", now)).otherwise(F.col("valid_to"))).withColumn("superseded_by", F.coalesce("superseded_by", "closer")).drop("closer")


def touch_times(claims: DataFrame, decisions: DataFrame, incoming: DataFrame) -> DataFrame:
    """claims with ts raised to the latest claim that touched them."""
    latest = decisions.filter("decision = 'touch'").join(incoming.select("id", F.col("ts").alias("new_ts")), "id").groupBy(F.col("nearest_id").alias("id")).agg(F.max("new_ts").alias("new_ts"))
    return claims.join(latest, "id", "left").withColumn("ts", F.greatest("ts", "new_ts")).drop("new_ts")


def cross_links(decisions: DataFrame) -> DataFrame:
    """(id, conflict_with): partners of both sides of each conflict, sorted."""
    pairs = decisions.filter("decision = 'conflict'").select("id", F.col("nearest_id").alias("other"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("conflict_with"))


def superseded_by_key(claims: DataFrame, batch: DataFrame) -> DataFrame:
    """Active unpinned claims outside the batch that a batch row with the same (user, entity, attribute) closes: (id, superseded_by)."""
    keys = ["user_id", "entity", "attribute"]
    newest = batch.filter("entity is not null and attribute is not null").groupBy(*keys).agg(F.max(F.struct("ts", "id")).alias("top")).select(*keys, F.col("top.id").alias("superseded_by"))
    open_ = claims.drop("superseded_by").filter("valid_to is null and not pinned").join(batch.select("id"), "id", "left_anti")
    return open_.join(newest, keys).select("id", "superseded_by")


def valid_drops(proposed: DataFrame, kept: DataFrame) -> DataFrame:
    """Proposed drops (qid, id) that stand: none for a question if over half of its rows are proposed; each needs a newer kept peer.

    kept: (qid, id, entity, attribute, ts, final_score). The winner is the best scored undropped newer peer.
    """
    sizes = kept.groupBy("qid").agg(F.count("*").alias("n"))
    counts = proposed.join(kept, ["qid", "id"], "left_semi").groupBy("qid").agg(F.count_distinct("id").alias("m"))
    fair = proposed.join(counts.join(sizes, "qid").filter("2 * m <= n").select("qid"), "qid", "left_semi").distinct()
    losers = kept.join(fair, ["qid", "id"], "left_semi").select("qid", "entity", "attribute", "id", "ts")
    peers = kept.join(fair, ["qid", "id"], "left_anti").select("qid", "entity", "attribute", F.col("id").alias("peer"), F.col("ts").alias("peer_ts"), "final_score")
    found = losers.join(peers, ["qid", "entity", "attribute"]).filter("peer_ts > ts")
    return found.groupBy("qid", "id").agg(F.max(F.struct("final_score", (-F.col("peer")).alias("p"))).alias("top")).select("qid", "id", (-F.col("top.p")).alias("winner"))


def lineage(claims: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Of each claim: its validity, what it supersedes, what superseded it, and its decisions in order."""
    back = claims.filter("superseded_by is not null").groupBy("user_id", F.col("superseded_by").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("supersedes"))
    out = claims.select("user_id", "id", "valid_from", "valid_to", "superseded_by").join(back, ["user_id", "id"], "left")
    if decisions is not None:
        ledger = decisions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("created_at", "decision", "reason"))).alias("decisions"))
        out = out.join(ledger, "id", "left")
    return out


def full_lineage(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """``lineage`` with each claim's conflict partners and the ledger of decisions on either side of which it stood, oldest first.

    decisions: (user_id, id, nearest_id, decision, reason, created_at). A claim without any has nulls.
    """
    d = decisions.select("user_id", "id", "nearest_id", "decision", "reason", "created_at")
    entry = F.struct("created_at", F.col("id").alias("new_id"), "decision", "reason", "nearest_id")
    own = d.select("user_id", "id", entry.alias("entry"))
    other = d.filter("nearest_id is not null and nearest_id <> id").select("user_id", F.col("nearest_id").alias("id"), entry.alias("entry"))
    partner = F.when(F.col("entry.decision") == "conflict", F.when(F.col("entry.new_id") == F.col("id"), F.col("entry.nearest_id")).otherwise(F.col("entry.new_id")))
    both = own.unionByName(other).groupBy("user_id", "id").agg(F.array_sort(F.collect_list("entry")).alias("ledger"), F.array_sort(F.collect_set(partner)).alias("conflict_with"))
    return lineage(claims).join(both.withColumn("conflict_with", F.when(F.size("conflict_with") > 0, F.col("conflict_with"))), ["user_id", "id"], "left")


def chains(claims: DataFrame) -> DataFrame:
    """Of each claim (user_id, id): the head of its chain of supersessions, how many are ahead of it, and the chain's greatest length.

    List ranking by pointer doubling: each round every unfinished claim jumps over what its pointer has jumped over, so a chain of n
    takes log2(n) rounds, each written to the shared folder. A link to a claim that isn't there ends the chain. Claims whose links
    run in a circle have nulls. Of rows with one (user_id, id), one counts.
    """
    c = claims.select("user_id", "id", "superseded_by").dropDuplicates(["user_id", "id"])
    there = c.select("user_id", F.col("id").alias("superseded_by"), F.lit(True).alias("there"))
    known = F.col("there").isNotNull()
    start = c.join(there, ["user_id", "superseded_by"], "left").select("user_id", "id", F.when(known, F.col("superseded_by")).otherwise(F.col("id")).alias("at"), F.when(known, 1).otherwise(0).cast("long").alias("ahead"), (~known).alias("done"))
    now = written(start, "chains")
    for _ in range(now.filter("not done").count().bit_length() + 1):
        # what is done stays out of the join: a long chain's claims would all meet at its head
        jump = now.select("user_id", F.col("id").alias("at"), F.col("at").alias("far"), F.col("ahead").alias("more"), F.col("done").alias("ends"))
        moved = now.filter("not done").drop("done").join(jump, ["user_id", "at"]).select("user_id", "id", F.col("far").alias("at"), (F.col("ahead") + F.col("more")).alias("ahead"), F.col("ends").alias("done"))
        now = written(now.filter("done").unionByName(moved), "chains")
        if now.filter("not done").isEmpty():
            break
    ranked = now.select("user_id", "id", F.when(F.col("done"), F.col("at")).alias("head"), F.when(F.col("done"), F.col("ahead")).alias("ahead"))
    length = ranked.filter("head is not null").groupBy("user_id", "head").agg((F.max("ahead") + 1).alias("length"))
    return ranked.join(length, ["user_id", "head"], "left").select("user_id", "id", "head", "ahead", "length")


def backfilled_times(claims: DataFrame) -> DataFrame:
    """Bitemporal columns of rows from before they existed."""
    return closed_by_link(claims).withColumn("tx_time", F.coalesce("tx_time", "ts")).withColumn("valid_from", F.coalesce("valid_from", "ts"))


def promoted_session(claims: DataFrame, meta: str = "raw_metadata") -> DataFrame:
    return claims.withColumn("session_id", F.coalesce("session_id", F.nullif(F.col(meta)["session_id"], F.lit(""))))


def upserted(stored: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """stored after the batch: new ids are added; known ones get the later ts, tx_time and a missing entity_id. valid_to stays."""
    b = batch.select(*(F.col(c).alias(f"new_{c}") for c in batch.columns))
    both = stored.join(b, stored.id == F.col("new_id"), "full")
    special = {"ts": F.greatest("ts", "new_ts"), "tx_time": F.when(F.col("new_id").isNotNull(), now).otherwise(F.col("tx_time")), "entity_id": F.coalesce("new_entity_id", "entity_id")}
    new = F.col("id").isNull()
    return both.select(*(special.get(c, F.when(new, F.col(f"new_{c}")).otherwise(F.col(c)) if f"new_{c}" in b.columns else F.col(c)).alias(c) for c in stored.columns))


def validated(claims: DataFrame) -> DataFrame:
    """claims with ``faults``: the integrity rules that each row breaks."""
    rules = {"authority": ~F.col("authority").between(0, 1), "validity": F.col("valid_to") < F.col("valid_from"), "id": F.col("id").isNull(), "user": F.col("user_id").isNull()}
    return claims.withColumn("faults", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items()))))


def with_vectors(claims: DataFrame, embed=hash_vector, text: str = "content", vector: str = "embedding") -> DataFrame:
    """claims with missing vectors filled by ``embed`` (a function of a text column); without text they stay null. No shuffle."""
    return claims.withColumn(vector, F.coalesce(F.col(vector), F.when(F.col(text).isNotNull(), embed(F.col(text)))))
