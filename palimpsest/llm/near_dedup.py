"""MinHash near-dedup with Order MinHash, verified by banded alignment.

For the sketch a text is the sequence of its five-word shingles, each labelled with how often it has occurred before
(fewer than five words: one shingle). For each of TABLES hash functions the ORDER smallest labelled
shingles are sampled and kept in text order; their hash is a bucket key, so a shared bucket needs equal
shingles in equal order, which makes the sketch sensitive to edit similarity and not only to sets.
Texts of at most SHORT shingles have further keys, so that any two of them with a similarity of 0.8 by shingles
share one with certainty.

Candidates are aligned word by word. Two texts are near duplicates if their edit similarity 2m / (a + b) is 0.8 or
more, where a and b are their numbers of words and m is the longest common subsequence of words within a
diagonal band: what one insertion or deletion of a word costs is one word, not the five shingles around it. A
similarity of 0.8 bounds what is left over on either side, so the band of that width loses nothing. Whatever shares
0.8 of its labelled shingles in order is similar by words too. Groups are the connected components.

Hot groups: equal texts are first collapsed to one representative. In a bucket not every pair is
compared: first each text with the best connected member of its buckets and with a neighbour in order of length;
then components are formed, and only pairs of different components in one bucket are still compared,
each with at least one member outside the bucket's largest component. These are counted and aligned by
blocks of members inside tasks, and only links that join two components leave a task. So a bucket of
near copies costs its size in rows, and no pair of a bucket that could still join two components is left out.

Defined results: null texts count as empty; texts without words are near duplicates only of equal
texts; repeated rows are equal texts; ties go to the smallest doc_id; an empty table gives no rows.
Rows with a null doc_id take part, and come last in their group. Different texts under one doc_id, or
under none, are different documents; equal ids alone never join groups. Extra columns are ignored or carried.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.components import components
from .common import chunks, mix, small, table, windows, word_hashes, word_table, written

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 40
ORDER = 3
SHORT = 20  # up to so many shingles, pairs are found with certainty
SHARED = 3  # shingles in a key of a short text
BLOCK = 256  # members of a block
BLOCK_WORDS = 1 << 18  # and their words, at about 8 bytes each
COLUMNS = 4096  # words counted at once
NEIGHBOURS = 1024  # members of a bucket that are put in order of length together
NO_ID = (1 << 63) - 1  # stands for a null doc_id
_SEEDS = np.random.default_rng(4).integers(1, 1 << 63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled_shingles(hashes: np.ndarray, ranges: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Of each row, in text order, its shingles' hashes, each mixed with the number of equal ones before it."""
    keys, room = windows(hashes, ranges, width)
    out = []
    for a, b in zip(ranges[:-1], ranges[1:], strict=True):
        if b - a >= width:
            k = keys[a : b - width + 1]
        elif b > a:
            k = mix(np.array([np.sum(mix(hashes[a:b]) * np.arange(1, 2 * (b - a), 2, dtype=np.uint64))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
            continue
        order = np.argsort(k, kind="stable")
        first = np.concatenate(([True], k[order][1:] != k[order][:-1]))
        begin = np.flatnonzero(first)
        nth = np.empty(len(k), np.uint64)
        nth[order] = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))
        out.append(mix(k + nth * np.uint64(0x9E3779B97F4A7C15)))
    return out


def sketch(shingles: np.ndarray, order: int = ORDER) -> list[int]:
    """Bucket keys of one text: per table, the hash of its smallest labelled shingles in text order.

    Shingles are mixed hashes, so a product with the table's odd number orders them anew.
    """
    n = len(shingles)
    if not n:
        return []
    take = min(order, n)
    weights = np.arange(1, 2 * take, 2, dtype=np.uint64)
    keys, step = [], max(1, (1 << 21) // n)  # bounds the memory of very long texts
    for at in range(0, TABLES, step):
        seeds = _SEEDS[at : at + step, None]
        places = np.sort(np.argpartition(shingles[None, :] * seeds, take - 1, axis=1)[:, :take], axis=1)
        keys.append(mix((mix(shingles[places] + seeds) * weights).sum(axis=1, dtype=np.uint64) ^ seeds[:, 0]))
    return np.concatenate(keys).view(np.int64).tolist()


@lru_cache
def _choices(n: int, take: int) -> np.ndarray:
    return np.array(list(combinations(range(n), take)), np.int64).reshape(-1, take)


def short_keys(shingles: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """Bucket keys of one short text, of which any two similar texts share one.

    Both texts hold the m common shingles, and m is at least need = similarity * n for either n. Of all shingles,
    the SHARED smallest common ones are among the n - need + SHARED smallest of each text, in the same
    text order; so each choice of SHARED of those is a key. Where need is smaller, fewer are chosen as well.
    """
    n = len(shingles)
    if not n:
        return []
    need = max(1, math.ceil(similarity * n - 1e-9))
    keys = []
    for take in range(min(need, SHARED), SHARED + 1):
        places = np.sort(np.argsort(shingles)[: n - need + take])
        chosen = shingles[places[_choices(len(places), take)]]
        keys.append(mix((mix(chosen) * np.arange(1, 2 * take, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)))
    return np.unique(np.concatenate(keys)).view(np.int64).tolist()


def bucket_keys(shingles: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """All bucket keys of one text: certain ones of a short text, sketches of one that may be similar to a longer one."""
    n = len(shingles)
    keys = short_keys(shingles, similarity) if n <= SHORT else []
    return keys + sketch(shingles) if n + 1e-9 >= similarity * (SHORT + 1) else keys


def alignment(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """2m / (len a + len b), m the longest common subsequence of words in the band; 0 where it can't reach ``similarity``.

    One row of the dynamic programme is one integer, a bit for each word of a inside the band: a bit is 0 where the
    subsequence gets longer. A word of b costs a few operations on the band's bits.
    """
    n, k = len(a), len(b)
    need = math.ceil(similarity * (n + k) / 2 - 1e-9)
    if not n or not k or min(n, k) < need or common_words(a, b) < need:
        return 0.0
    # a matched pair has lost at most n - need of a, or k - need of b, before it
    over, under = n - need, k - need
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    row = low = high = found = 0
    for j, word in enumerate(b.tolist()):
        if (to := min(n, j + over + 1)) > high:
            row |= ((1 << to - high) - 1) << (high - low)
            high = to
        if (to := min(n, j - under)) > low:
            found += (to - low) - (row & (1 << to - low) - 1).bit_count()
            row, low = row >> (to - low), to
        if hits := row & places.get(word, 0) >> low:
            row = (row + hits | row - hits) & (1 << high - low) - 1
    found += (high - low) - row.bit_count()
    return 2 * found / (n + k) if found >= need else 0.0


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two texts have in common, however they are ordered."""
    values, counts = np.unique(a, return_counts=True)
    others, more = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[x], more[y]).sum())


def sketches(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, h, n words, bucket keys) of texts (doc_id, h, text)."""

    def run(batches):
        for batch in batches:
            for part in small(batch, "text"):
                for at, to, data, offsets in chunks(part.column("text")):
                    starts, ends, ranges = word_table(data, offsets)
                    rows = labelled_shingles(word_hashes(data, starts, ends), ranges)
                    own = part.slice(at, to - at)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("h"), pa.array(np.diff(ranges), pa.int64()), pa.array([bucket_keys(r, similarity) for r in rows], pa.list_(pa.int64()))], names=["doc_id", "h", "n", "keys"])

    return texts.mapInArrow(run, "doc_id long, h binary, n long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of representatives whose texts align well enough. Texts travel only for the pairs asked."""

    def run(batches):
        for batch in batches:
            for part in small(batch, "text_a"):
                found = []
                left: dict = {}
                for i, (a, s, t) in enumerate(zip(part.column("a").to_pylist(), part.column("text_a"), part.column("text_b"), strict=True)):
                    if a not in left:  # pairs are sorted by a
                        left = {a: _words(s)}
                    found.append(alignment(left[a], _words(t), similarity) >= similarity)
                yield part.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def fingerprints(texts: DataFrame) -> DataFrame:
    """(rep, fp): the words of each text in text order, as 64-bit hashes."""

    def run(batches):
        for batch in batches:
            for part in small(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([_words(t).tobytes() for t in part.column("text")], pa.binary())], names=["rep", "fp"])

    return texts.mapInArrow(run, "rep long, fp binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each row of one block has in common with each of another, values being unique in a row: products of their incidence with the values that both blocks hold."""
    sides = [(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side) if side else np.zeros(0, np.uint64)) for side in (left, right)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    entries = []
    for row, value in sides:
        at = np.searchsorted(both, value)
        held = both[np.minimum(at, len(both) - 1)] == value if len(both) else np.zeros(len(value), bool)
        order = np.argsort(at[held], kind="stable")
        entries.append((row[held][order], at[held][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(both), COLUMNS):
        incidence = []
        for side, (row, at) in zip((left, right), entries, strict=True):
            a, b = np.searchsorted(at, [c, c + COLUMNS])
            x = np.zeros((len(side), min(COLUMNS, len(both) - c)), np.float32)
            x[row[a:b], at[a:b] - c] = 1
            incidence.append(x)
        out += incidence[0] @ incidence[1].T
    return out.astype(np.int64)


def joining_links(left: list[tuple], right: list[tuple], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (a, b) between two blocks (or within one: ``left is right``) that join components, at most one less than there are.

    Members are (rep, component, outside, words). Of every pair of different components with a member outside
    the words in common are counted (each labelled with its occurrence); of those with enough, most first, a pair is aligned unless links found
    before have joined its components already. So what leaves a task is bounded by its members.
    """
    x = [m[3] for m in left]
    y = x if left is right else [m[3] for m in right]
    n, m = np.array([len(s) for s in x], np.int64)[:, None], np.array([len(s) for s in y], np.int64)[None, :]
    low = similarity - 1e-9
    field = lambda rows, k: np.array([r[k] for r in rows])
    ok = (field(left, 1)[:, None] != field(right, 1)[None, :]) & (field(left, 2)[:, None] | field(right, 2)[None, :]) & (np.minimum(n, m) >= low / (2 - low) * np.maximum(n, m))
    if left is right:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    if not ok.any():
        return []
    labelled = [_labelled(w) for w in x]
    common = common_counts(labelled, labelled if left is right else [_labelled(w) for w in y])
    at, to = np.nonzero(ok & (2 * common >= low * (n + m)))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for k in np.argsort(-common[at, to], kind="stable").tolist():
        one, two = left[at[k]], right[to[k]]
        a, b = find(one[1]), find(two[1])
        if a != b and alignment(one[3], two[3], similarity) >= low:
            root[a] = b
            out.append((min(one[0], two[0]), max(one[0], two[0])))
    return out


def block_links(named: DataFrame, prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of similar texts of one bucket and of different components: enough of them to join all such components.

    named: (key, rep, n, component, outside). The members of a bucket are packed in blocks of about BLOCK
    members or BLOCK_WORDS shingles, those outside the bucket's largest component apart from the others.
    A block is copied once for each block it is compared with, and pairs of blocks, not buckets, are dealt
    to tasks; blocks without a member outside are never paired with each other.
    """
    parts = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_WORDS)).cast("int")
    sizes = named.groupBy("key").agg(parts(F.col("outside")).alias("outs"), parts(~F.col("outside")).alias("ins"), parts(F.lit(True)).alias("whole"))
    part = F.when(F.col("whole") == 1, 0).when(F.col("outside"), F.pmod(F.xxhash64("rep"), F.col("outs"))).otherwise(F.col("outs") + F.pmod(F.xxhash64("rep"), F.col("ins")))
    others = F.when(F.col("whole") == 1, 1).when(F.col("outside"), F.col("outs") + F.col("ins")).otherwise(F.col("outs"))
    dealt = named.join(sizes, "key").select("key", "rep", "component", "outside", part.cast("int").alias("part"), others.cast("int").alias("others"))
    blocks = dealt.join(prints, "rep").groupBy("key", "part").agg(F.max("others").alias("others"), F.collect_list(F.struct("rep", "component", "outside", "fp")).alias("rows"))
    copies = blocks.select("key", "part", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "rows")
    pairs = copies.groupBy("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).agg(F.collect_list("rows").alias("blocks"))

    def run(batches):
        for batch in batches:
            for both in batch.column("blocks"):
                sides = []
                for rows in both.values:
                    v = rows.values
                    fp = v.field("fp")
                    columns = (v.field(f).to_pylist() for f in ("rep", "component", "outside"))
                    sides.append(list(zip(*columns, (np.frombuffer(x.as_buffer(), np.uint64) for x in fp), strict=True)))
                links = joining_links(sides[0], sides[-1], similarity)
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.select("blocks").mapInArrow(run, "a long, b long").distinct()


def _words(text) -> np.ndarray:
    data = np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)
    starts, ends, _ = word_table(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def _labelled(words: np.ndarray) -> np.ndarray:
    return labelled_shingles(words, np.array([0, len(words)]), 1)[0]


def near_links(signs: DataFrame, hashed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the representatives that have a near duplicate.

    signs: (rep, id, h, n, keys), one row for each different text: rep is its number, id its smallest doc_id
    (NO_ID for null); hashed: all documents (doc_id, h, text).
    """
    low = similarity - 1e-9
    members = signs.select("rep", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(members.join(shared, "key").select("key", "rep", "n", "size"), "members")
    # the leader of a bucket is its best connected member: of a text and its edited copies, the text
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "rep")
    leads = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("order"), "n")).alias("top")).select("key", F.col("top.degree").alias("weight"), (-F.col("top.order")).alias("other"), F.col("top.n").alias("m"))
    # the texts of members only, once; both rounds of verification read them here
    wanted = members.select("rep").distinct().join(signs.select("rep", "id", "h"), "rep")
    texts = written(hashed.join(wanted.withColumnRenamed("h", "own"), (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id")) & (F.col("h") == F.col("own"))).select("rep", "text").dropDuplicates(["rep"]), "texts")
    # a text is compared with the best of its leaders and with one neighbour in order of length, in its largest bucket;
    # a large bucket is put in order in parts
    by_length = Window.partitionBy("key", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / NEIGHBOURS))).orderBy("n", "rep")
    to_lead = members.join(leads, "key").select("rep", "n", "weight", "other", "m")
    to_next = members.select("rep", "n", F.col("size").alias("weight"), F.lead("rep").over(by_length).alias("other"), F.lead("n").over(by_length).alias("m"))
    fits = (F.least("n", "m") >= low / (2 - low) * F.greatest("n", "m")) & F.col("other").isNotNull() & (F.col("rep") != F.col("other"))
    best = [side.filter(fits).groupBy("rep").agg(F.max(F.struct("weight", "other")).alias("best")).select(F.least("rep", "best.other").alias("a"), F.greatest("rep", "best.other").alias("b")) for side in (to_lead, to_next)]
    first = written(best[0].unionByName(best[1]).distinct(), "pairs")
    links = written(verified(first, texts, similarity), "verified")
    grouped = components(links)

    # Pairs that could still join two components: one member outside the bucket's largest component.
    named = members.select("key", "rep", "n").join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counted = named.groupBy("key", "component").agg(F.count("*").alias("size"))
    top = counted.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("top")).filter("parts > 1")
    named = written(named.join(top, "key").select("key", "rep", "n", "component", (F.col("component") != F.col("top.component")).alias("outside")), "named")
    more = written(block_links(named, fingerprints(texts), similarity), "more")
    if more.isEmpty():
        return grouped
    return components(links.unionByName(more))


def _grouped(docs: DataFrame, text: str, key: str, similarity: float) -> DataFrame:
    """Of every document: doc_id, h, class_id, and the (id, h) of its group's first text as group_id, group_h; kept marks that text's documents of that id."""
    hashed = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.unhex(F.sha2("text", 256)))
    # one row of sketch for each class: combined before the shuffle, so a hot text costs one row a task
    signs = sketches(hashed.select("doc_id", "h", "text"), similarity)
    signs = written(signs, "sketches")
    classes = signs.groupBy("h").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    # ids may be null or repeated, so each text has a number of its own, which holds once it is written
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "id", "h", "n", "keys"), "classes")
    named = classes.select("rep", "id", "h")
    grouped = near_links(classes.filter("n > 0"), hashed, similarity).select(F.col("node").alias("rep"), "component")
    first = grouped.join(named, "rep").groupBy("component").agg(F.min(F.struct("id", "h")).alias("first"))
    grouped = grouped.join(first, "component").select("rep", "first")
    named = named.join(grouped, "rep", "left").select("h", F.col("id").alias("class_id"), F.coalesce("first.id", "id").alias("group_id"), F.coalesce("first.h", "h").alias("group_h"))
    return signs.select("doc_id", "h").join(named, "h").withColumn("kept", (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("group_id")) & (F.col("h") == F.col("group_h")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """Of every document: doc_id, class_id (smallest doc_id with an equal text), group_id (smallest doc_id of the near-duplicate group), kept (the group's first document), group_hash (SHA-256 of that document's text: tells groups apart whose ids are null or repeated)."""
    return _grouped(docs, text, key, similarity).select("doc_id", "class_id", "group_id", "kept", F.lower(F.hex("group_h")).alias("group_hash"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each near-duplicate group, with its columns; of rows with that id and text, one."""
    kept = _grouped(docs, text, key, similarity).filter("kept").select(F.col("group_id").alias("id"), F.col("group_h").alias("h")).distinct()
    rows = docs.withColumnsRenamed(names := {n: f"in_{i}" for i, n in enumerate(docs.columns)})
    rows = rows.withColumns({"id": F.coalesce(F.col(names[key]).cast("long"), F.lit(NO_ID)), "h": F.unhex(F.sha2(F.coalesce(F.col(names[text]), F.lit("")), 256))})
    # rows of one id and text are combined before the shuffle, however many they are
    rows = rows.dropDuplicates(["id", "h"]).join(kept, ["id", "h"], "left_semi")
    return rows.select([F.col(v).alias(k) for k, v in names.items()])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
