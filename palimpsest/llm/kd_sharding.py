"""Sharding by a k-d tree over document metadata, in DataFrame functions only.

Each node of the tree holds a number of leaves to make. It is split along its widest dimension (the
range of the node's values over the range of all values) at the weighted median: the point at which the
bytes to the left are the left leaves' share. Nodes with one leaf, the target bytes, are shards.

Weighted medians are found for all nodes of a level at once by histogram descent: each step sums bytes
by (node, bin) on the executors, and only those sums (at most DRIVER_ROWS a step) reach the driver, which
narrows each node's range to the bin that holds its median; steps end when that bin holds less than
TOLERANCE of the node. A dimension's value is scaled to 30 bits and followed by 32 bits of a hash.

Dimensions: size in bytes, source and lang as their ranks among all values, and the id. Rows of equal
texts take the smallest source, lang and id of their group and the hash of the text, so they have equal
keys and stay together, unless the group has more than GROUP_SHARE of a shard's bytes: then its rows have
keys of their own, and the group is split like anything else (a text may be a third of all rows).

Defined results: null texts have no bytes (size 1) and are equal to empty ones; null values of a dimension
are the smallest; an empty table gives no rows. Extra columns are ignored. Law ``bytes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

SHARDS = 8
BINS = 4096
DRIVER_ROWS = 262_144
NODES = 4096  # whose medians are looked for at once
TOLERANCE = 0.0005
GROUP_SHARE = 0.05
POPULAR = 2048  # groups with more than this part of all rows are broadcast, the others joined
LITERALS = 64  # nodes in a literal map; more are a broadcast table
CODES = 65_536  # values of a dimension that are broadcast; more are joined
LEVELS = 1  # levels of the tree after which rows are written again: a node looked up in a node would be worked out several times
SLOT_GROUPS = 1024


def ranks(values: DataFrame) -> DataFrame:
    """(value, rank from 1) of the different values, in order of code points: numbered by range partitions and their counts, not in one task."""
    dealt = written(values.filter("value is not null").distinct().repartitionByRange("value").withColumn("part", F.spark_partition_id()), "values")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return dealt.withColumn("nth", nth).join(F.broadcast(before), "part").select("value", (F.col("before") + F.col("nth")).alias("rank"))  # a row for each partition


def keyed(docs: DataFrame, shards: int | None, target_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """(doc_id, size, text_crc32 and one 62-bit key for each dimension (array k), as a table in the shared folder; bytes; number of leaves)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"))
    raw = written(raw, "metadata")
    own = ("source", "lang", "id")
    groups = written(raw.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *(F.min(c).alias(f"g_{c}") for c in own)), "groups")
    all_ = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    leaves = max(1, shards if target_bytes is None else -(-all_["bytes"] // target_bytes))
    groups = groups.withColumn("whole", F.col("bytes") <= GROUP_SHARE * all_["bytes"] / leaves).drop("bytes")
    popular = F.broadcast(groups.filter(F.col("n") > all_["n"] / POPULAR))  # fewer than POPULAR rows
    rows = raw.join(popular, "h").unionByName(raw.join(popular.select("h"), "h", "left_anti").join(groups, "h"))
    rows = rows.select("doc_id", "size", "text_crc32", F.when(F.col("whole"), F.xxhash64("h")).otherwise(F.xxhash64("id", "h")).alias("tie"), *(F.when(F.col("whole"), F.col(f"g_{c}")).otherwise(F.col(c)).alias(c) for c in own))
    for c in ("source", "lang"):
        found = written(ranks(raw.select(F.col(c).alias("value"))), "ranks")
        found = found if found.count() > CODES else F.broadcast(found)
        rows = rows.join(found, F.col(c) == F.col("value"), "left").withColumn(c, F.coalesce("rank", F.lit(0))).drop("value", "rank")
    rows = written(rows, "dimensions")
    dims = ("size", *own)
    ends = rows.agg(*(f(c).alias(f"{n}{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()
    keys = []
    for c in dims:
        lo, hi = ends[f"lo{c}"] or 0, ends[f"hi{c}"] or 0
        scaled = F.floor((F.coalesce(F.col(c), F.lit(lo)).cast("double") - float(lo)) / float(max(hi - lo, 1)) * float((1 << 30) - 1)).cast("long")
        keys.append(F.shiftleft(scaled, 32).bitwiseOR(F.shiftrightunsigned("tie", 32)))
    return rows.select("doc_id", "size", "text_crc32", F.array(keys).alias("k")), all_["bytes"], leaves


def looked_up(rows: DataFrame, **values: dict[int, int]) -> DataFrame:
    """rows with a column for each of ``values``: the number that belongs to the row's node, null where none does.

    Few nodes are a literal map, more a broadcast table with at most a row for each leaf.
    """
    nodes = sorted(set().union(*values.values()))
    if len(nodes) <= LITERALS:
        maps = {c: F.map_from_arrays(F.lit(list(v)).cast("array<bigint>"), F.lit(list(v.values())).cast("array<bigint>")) for c, v in values.items() if v}
        return rows.withColumns({c: F.try_element_at(maps[c], F.col("node")) if c in maps else F.lit(None).cast("long") for c in values})
    table_ = rows.sparkSession.createDataFrame([(n, *(v.get(n) for v in values.values())) for n in nodes], ", ".join(f"{c} long" for c in ("node", *values)))
    return rows.join(F.broadcast(table_), "node", "left")


def medians(rows: DataFrame, nodes: dict[int, tuple[int, int, int, float]], total: dict[int, int]) -> dict[int, int]:
    """By node: the key from which on its rows go right. nodes: (dimension, lowest and highest key, the left side's share of bytes)."""
    open_ = {n: (lo, hi, share * total[n]) for n, (_, lo, hi, share) in nodes.items()}
    out: dict[int, int] = {}
    while open_:
        now = dict(sorted(open_.items())[:NODES])
        bins = max(2, min(BINS, DRIVER_ROWS // len(now)))  # bounds what the driver receives
        width = {n: max(1, -(-(hi - lo + 1) // bins)) for n, (lo, hi, _) in now.items()}
        inside = looked_up(rows.select("node", "size", "k"), d={n: nodes[n][0] + 1 for n in now}, lo={n: x[0] for n, x in now.items()}, hi={n: x[1] for n, x in now.items()}, w=width)
        inside = inside.filter("d is not null").select("node", "size", "lo", "hi", "w", F.expr("element_at(k, cast(d as int))").alias("key")).filter("key between lo and hi")
        sums: dict[int, dict[int, int]] = {}
        for r in inside.groupBy("node", F.expr("(key - lo) div w").alias("bin")).agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r["node"], {})[r["bin"]] = r["bytes"]
        for n, (lo, hi, want) in now.items():
            for b in sorted(sums.get(n, {})):
                held = sums[n][b]
                if held >= want or b == max(sums[n]):
                    begin, end = lo + b * width[n], min(hi, lo + (b + 1) * width[n] - 1)
                    if width[n] == 1 or held <= TOLERANCE * total[n]:
                        out[n] = begin if want < held / 2 else end + 1
                        del open_[n]
                    else:
                        open_[n] = (begin, end, want)
                    break
                want -= held
            else:
                out[n] = lo
                del open_[n]
    return out


def kd_shards(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard of every document: ``shards`` leaves, or as many as ``target_bytes`` asks for."""
    rows, bytes_, wanted = keyed(docs, shards, target_bytes)
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    leaves = {0: wanted}  # leaves still to make, by node; a node's number is its first leaf
    dims, level = 4, 0
    while any(k > 1 for k in leaves.values()) and bytes_:
        big = {n: k for n, k in leaves.items() if k > 1}
        spans = looked_up(rows, big=big).filter("big is not null").groupBy("node").agg(F.sum("size").alias("bytes"), *(f(F.col("k")[i]).alias(f"{a}{i}") for i in range(dims) for a, f in (("lo", F.min), ("hi", F.max)))).collect()
        nodes, total = {}, {}
        for r in spans:
            n = r["node"]
            d = max(range(dims), key=lambda i: ((r[f"hi{i}"] >> 32) - (r[f"lo{i}"] >> 32), -i))
            nodes[n], total[n] = (d, r[f"lo{d}"], r[f"hi{d}"], (big[n] // 2) / big[n]), r["bytes"]
        cuts = medians(rows, nodes, total)
        right = {n: n + big[n] // 2 for n in nodes}
        placed = looked_up(rows, d={n: x[0] + 1 for n, x in nodes.items()}, cut=cuts, right=right)
        value = F.element_at("k", F.coalesce("d", F.lit(1)).cast("int"))
        rows = placed.withColumn("node", F.when(value >= F.col("cut"), F.col("right")).otherwise(F.col("node"))).drop("d", "cut", "right")
        leaves = {n: k for n, k in leaves.items() if k == 1} | {n: big[n] // 2 for n in nodes} | {right[n]: big[n] - big[n] // 2 for n in nodes}
        level += 1
        if level % LEVELS == 0 and any(k > 1 for k in leaves.values()):
            rows = written(rows, "nodes")
    return rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"))


def with_slots(rows: DataFrame, groups: int = SLOT_GROUPS) -> DataFrame:
    """rows with slot: gapless numbers from 0 within each shard, given by groups of a hash and the groups' counts, so no task numbers a whole shard, nor all rows of one id."""
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "shards").withColumn("g", F.pmod(F.xxhash64("doc_id", F.pmod("place", F.lit(groups))), F.lit(groups)).cast("int"))
    counts = rows.groupBy("shard", "g").agg(F.count("*").alias("n"))
    before = counts.select("shard", "g", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "g").orderBy("place"))
    return rows.withColumn("nth", nth).join(before, ["shard", "g"]).withColumn("slot", (F.col("before") + F.col("nth") - 1).cast("long")).drop("g", "nth", "before", "place")


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_slots(kd_shards(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
