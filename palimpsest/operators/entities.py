"""Entity resolution: mentions to canonical entities by rules in order, trigram similarity, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..shared import written
from .components import components

STRONG, GRAY, MERGE, REJECT = 0.65, 0.45, 0.60, 0.40


def trigram_pairs(left: DataFrame, right: DataFrame, column: str, floor: float) -> DataFrame:
    """(a, b, similarity) of different texts whose trigram sets have a Jaccard of at least floor.

    An inverted index: a text's rarest trigrams only, as many as a partner must share one of (prefix
    filter), so frequent trigrams join nothing; candidates are checked exactly.
    """
    def grams(df: DataFrame) -> DataFrame:
        return df.select(F.col(column).alias("t")).distinct().withColumn("g", tx.trigrams(F.col("t"))).filter(F.size("g") > 0)

    a, b = grams(left), grams(right)
    frequency = a.unionByName(b).select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("t", F.size("g").alias("size"), F.explode("g").alias("gram")).join(frequency, "gram")
        nth = F.row_number().over(Window.partitionBy("t").orderBy("n", "gram"))
        return rows.withColumn("nth", nth).filter(F.col("nth") <= F.col("size") - F.ceil(F.col("size") * floor) + 1).select("gram", F.col("t").alias(name))

    pairs = prefixes(a, "a").join(prefixes(b, "b"), "gram").filter("a <> b").select("a", "b").distinct()
    checked = pairs.join(a.select(F.col("t").alias("a"), F.col("g").alias("ga")), "a").join(b.select(F.col("t").alias("b"), F.col("g").alias("gb")), "b")
    similarity = F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb"))
    return checked.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= floor)


def resolved(mentions: DataFrame, entities: DataFrame, strong: float = STRONG, gray: float = GRAY) -> DataFrame:
    """(mention, norm, entity, rule, similarity) of mentions against entities, by the first rule that finds one entity.

    Rules: generic words name nothing; alias; acronym either way; first token; similarity of at least
    ``strong``; of at least ``gray`` (a candidate to be merged); else a new entity.
    """
    e = entities.select("entity", F.lower("entity").alias("alias"))
    m = mentions.select("mention", tx.normalize_mention(F.col("mention")).alias("norm")).distinct()
    generic = m.filter(F.col("norm").isin(tx.GENERIC))
    open_ = m.filter(~F.col("norm").isin(tx.GENERIC))
    found = [generic.select("mention", "norm", F.lit(None).cast("string").alias("entity"), F.lit("generic").alias("rule"), F.lit(None).cast("double").alias("similarity"))]

    def unique(hits: DataFrame, rule: str) -> DataFrame:
        one = hits.groupBy("norm").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")).filter("n = 1")
        return one.select("norm", "entity", F.lit(rule).alias("rule"), F.lit(1.0).alias("similarity"))

    rules = [
        ("alias", lambda o: o.join(e, o.norm == e["alias"])),
        ("acronym", lambda o: o.join(e.withColumn("initials", tx.acronym(F.col("alias"))), F.col("norm") == F.col("initials")).select("norm", "entity").unionByName(o.withColumn("short", tx.acronym(F.col("norm"))).join(e, F.col("short") == F.col("alias")).select("norm", "entity"))),
        ("first_token", lambda o: o.filter(F.instr("norm", " ") == 0).join(e.withColumn("token", F.split("alias", " ")[0]), F.col("norm") == F.col("token")).select("norm", "entity").unionByName(o.filter(F.instr("norm", " ") > 0).withColumn("token", F.split("norm", " ")[0]).join(e.filter(F.instr("alias", " ") == 0), F.col("token") == F.col("alias")).select("norm", "entity"))),
    ]
    for rule, hit in rules:
        decided = written(open_.join(unique(hit(open_), rule), "norm", "left"), "mentions")  # cuts the plan, which would double with each rule
        found.append(decided.filter("rule is not null").select("mention", "norm", "entity", "rule", "similarity"))
        open_ = decided.filter("rule is null").select("mention", "norm")
    near = trigram_pairs(open_.select(F.col("norm").alias("t")), e.select(F.col("alias").alias("t")), "t", gray)
    best = near.groupBy(F.col("a").alias("norm")).agg(F.max(F.struct("similarity")).alias("top"), F.min_by("b", F.struct(-F.col("similarity"), "b")).alias("alias")).join(e, "alias").select("norm", "entity", F.col("top.similarity").alias("similarity"))
    rest = open_.join(best, "norm", "left")
    found.append(rest.select("mention", "norm", "entity", F.when(F.col("similarity") >= strong, "similar").when(F.col("similarity") >= gray, "candidate").otherwise("new").alias("rule"), "similarity"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def created(resolutions: DataFrame, user) -> DataFrame:
    """New entities of a tenant's resolutions: id, alias, and the acronym as a further alias."""
    new = resolutions.filter("rule in ('new', 'candidate')").select("norm").distinct()
    ids = new.select(tx.entity_id(F.lit(user), F.col("norm")).alias("entity_id"), F.col("norm").alias("canonical"), F.explode(F.array_compact(F.array("norm", tx.acronym(F.col("norm"))))).alias("alias"))
    return ids


def linked_in_batch(mentions: DataFrame, rules: DataFrame) -> DataFrame:
    """New mentions (id, norm, first_seen) of one batch that the rule links (a, b by id) join: the earliest of a group is canonical."""
    groups = components(rules)
    named = mentions.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    canonical = named.groupBy("component").agg(F.min_by("norm", F.struct("first_seen", "id")).alias("canonical"))
    return named.join(canonical, "component").select("id", "norm", "canonical")


def merge_policy(pairs: DataFrame, entities: DataFrame, merge: float = MERGE, reject: float = REJECT) -> DataFrame:
    """(a, b, similarity, verdict, survivor, loser): settled entities beat provisional ones, then the older."""
    x = entities.select(F.col("name").alias("a"), F.struct("provisional", "created", "name").alias("xa"))
    y = entities.select(F.col("name").alias("b"), F.struct("provisional", "created", "name").alias("xb"))
    verdict = F.when(F.col("similarity") >= merge, "merge").when(F.col("similarity") < reject, "reject").otherwise("pending")
    rows = pairs.join(x, "a").join(y, "b")
    return rows.select("a", "b", F.round("similarity", 6).alias("similarity"), verdict.alias("verdict"), F.least("xa", "xb")["name"].alias("survivor"), F.greatest("xa", "xb")["name"].alias("loser"))


def merged(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """claims with entity_id repointed to the survivor (loser, survivor)."""
    return claims.join(mapping.select(F.col("loser").alias("entity_id"), "survivor"), "entity_id", "left").withColumn("entity_id", F.coalesce("survivor", "entity_id")).drop("survivor")


def backfilled(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """claims with an entity_id for those that have an entity and none yet: the entity that the mention resolves to, else the mention itself in normal form. Each mention is resolved once."""
    open_ = claims.filter("entity is not null and entity_id is null").select(F.col("entity").alias("mention")).distinct()
    found = resolved(open_, entities).filter("rule <> 'generic'").select(F.col("mention").alias("entity"), F.when(F.col("rule").isin("new", "candidate"), F.col("norm")).otherwise(F.col("entity")).alias("found"))
    return claims.join(found, "entity", "left").withColumn("entity_id", F.coalesce("entity_id", "found")).select(claims.columns)
