"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key -ln(u) / weight, u a hash of its id and its text, so heavier (better) documents
come early, and documents without an id, or with the same one, are sampled one by one. The weight is the chance that the document is good, by the weak-label model of the quality
classifier fitted on the votes on all documents, unless the caller gives weights. A source's target is met by complete epochs of the source first; the rest is a prefix of the
documents by key, up to the word budget, the last of them in part.

The prefix sums need no sort of a whole source: keys fall into BUCKETS ranges, the ranges' sums are
accumulated, and only the range in which the budget ends is ordered. So a source with a third of all
rows costs no task more than a few ranges.

Defined results: null texts have size 0, texts of any length are counted whole; a null source is a source of its own, after all others;
rows with equal id and text tie, and ties are ordered by id, size and text hash; a source without words takes
none; an empty table gives no rows. Extra columns are ignored (or carried by ``mixed_documents``).
Words and votes are counted in Arrow batches; all else is DataFrame functions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import chunks, table, with_columns, word_table, written
from .quality_classifier import label_model, patterns, shape, votes

WORD = "[^\\x20\\x09-\\x0D]+"
SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST = 2
BUCKETS = 4096
SEED = 8
LEAST = 0.05  # weight of a document that is surely bad

COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("count_words", "vote_pattern")])


def counted(docs: DataFrame, voted: bool = True) -> DataFrame:
    """docs (doc_id, source, text) with the words of each text and the pattern of the quality labellers' votes on it (0 if not ``voted``). In Arrow batches, as regular expressions would copy every text several times."""

    def make():
        def work(column):
            out = [[np.zeros(0, np.int64)] for _ in COUNTS]
            for _, _, data, offsets in chunks(column):
                words = np.diff(word_table(data, offsets)[2])
                for o, v in zip(out, (words, patterns(votes(shape(data, offsets))) if voted else 0 * words), strict=True):
                    o.append(v)
            return [np.concatenate(o) for o in out]

        return work

    return with_columns(docs, ["text"], COUNTS, make)


def pattern_weights(sized: DataFrame) -> DataFrame:
    """(vote_pattern, weight): the weak-label model's P(good), at least LEAST, of the patterns that occur among all documents (at most 3^10, however many documents)."""
    counts = {r.vote_pattern: r.n for r in sized.groupBy("vote_pattern").agg(F.count("*").alias("n")).collect()}
    good, _ = label_model(counts)
    return sized.sparkSession.createDataFrame([(p, round(max(LEAST, float(good[p])), 6)) for p in sorted(counts)], "vote_pattern long, weight double")


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of sources (source, source_size).

    Sources are numbered in order of code points by range partitions and their counts, not in one task.
    The level at which size * most caps a source rises until no further source is capped; each step is
    one aggregate.
    """
    null_last = F.col("source").isNull()
    dealt = written(sources.repartitionByRange(null_last, F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("part").orderBy(null_last, "source")) - 1
    numbered = dealt.withColumn("local", number).join(F.broadcast(before.select("part", "before")), "part")  # a row for each partition
    weight = F.element_at(F.lit(list(weights)), ((F.col("before") + F.col("local")) % len(weights) + 1).cast("int"))
    weighed = written(numbered.select("source", "source_size", weight.cast("double").alias("weight")), "weights")
    top = weighed.select("weight", (F.col("source_size") * most).alias("top"))
    level, capped = 0.0, -1
    while True:
        over = F.col("top") <= level * F.col("weight")
        r = top.agg(F.sum("top").alias("all"), F.sum(F.when(over, F.col("top"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("n")).first()
        if r["n"] == capped or not r["open"]:
            break
        level, capped = (share / most * (r["all"] or 0) - (r["full"] or 0)) / r["open"], r["n"]
    return weighed.select("source", "source_size", F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(float(level))).alias("target"))


def mixed(docs: DataFrame, weight: Column | None = None, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, h (hash of the text), size, source, source_size, target, epochs, taken of every document."""
    h = F.xxhash64("text")
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text", *([] if weight is None else [weight.alias("weight")]))
    sized = written(counted(rows, weight is None).select("doc_id", "source", h.alias("h"), F.col("count_words").alias("size"), "vote_pattern", (-F.log(u)).alias("key"), *([] if weight is None else ["weight"])), "sizes")
    if weight is None:
        sized = sized.join(F.broadcast(pattern_weights(sized)), "vote_pattern")
    sized = sized.withColumn("key", F.col("key") / F.col("weight")).withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")).drop("weight", "vote_pattern")
    sums = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    goal = written(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "targets")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).withColumnRenamed("source", "s")
    ranges = ranges.join(goal, F.col("s").eqNullSafe(F.col("source"))).select("s", F.col("bucket").alias("b"), "words", "before", "source_size", "target", "epochs", "budget")
    placed = sized.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    whole, none = F.col("before") + F.col("words") <= F.col("budget"), F.col("before") >= F.col("budget")
    clear = placed.filter(whole | none).withColumn("part", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    edge = placed.filter(~(whole | none)).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0)))))
    columns = ["doc_id", "h", "size", "source", "source_size", "target", "epochs", "part"]
    return clear.select(columns).unionByName(edge.select(columns)).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with their columns: one row for each epoch, and the part of the last epoch with the text cut after its words."""
    names = {n: f"in_{i}" for i, n in enumerate(docs.columns)}
    takes = mixed(docs, **options).filter("taken > 0").groupBy("doc_id", "h", "size").agg(F.count("*").alias("rows"), F.max("epochs").alias("epochs"), F.sum("part").alias("parts"))
    rows = docs.withColumnsRenamed(names)
    text = F.col(names["text"])
    # hashing the narrow side spares a sort of the texts
    rows = rows.join(takes.hint("shuffle_hash"), F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("h")))
    rows = rows.withColumn("part", F.floor(F.col("parts") / F.col("rows")))  # repeated rows take equal shares
    takes = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("words", F.explode(takes))
    split = F.split(text, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    leading = text.rlike("^[\\x20\\x09-\\x0D]").cast("int")
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(split, F.lit(1), (F.col("words") + leading).cast("int")), "")).otherwise(text)
    out = [cut.alias(k) if k == "text" else F.when(F.col("words") < F.col("size"), F.length(cut)).otherwise(F.col(v)).cast(docs.schema[k].dataType).alias(k) if k == "n_chars" else F.col(v).alias(k) for k, v in names.items()]
    return rows.select(out)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
