"""Spelling variant grouping with a trie-node pair dictionary.

Words are the runs of letters of all texts, counted. Every node of the trie of all words (a prefix) and of the trie
of all reversed words (a suffix) has a number. A word of length L holds the pairs of nodes

- *skipped* at i: (prefix of the i letters before, suffix of the letters after i), for each of its L letters;
- *split* at i: (prefix of i letters, suffix of the others), for each of its L + 1 gaps.

Two words share a skipped pair exactly if they differ by a replaced letter there, and a word's skipped pair equals
another's split pair exactly if it has one letter more there. So joining on two integers gives all words at edit
distance one and no others; no candidate is compared. Of equal neighbouring letters the first alone is skipped towards
split pairs, so that each pair of words meets once.

Scale: a text's runs are counted in the task, and counts are summed before and after the shuffle, so a frequent word is
one row a task. Nodes are numbered in one pass over the words in order, in range partitions: a node is new where a
word leaves the path of the word before. The path that two neighbouring partitions share is told by one row a partition. A pair of
nodes is held by at most one word for each letter of the alphabet and one split word, so no group is large; a group
gives each of its members the number of its neighbours and the best of them, never pairs of words. Forms are followed to
their last by pointer doubling: as a form is at least ``RATIO`` times as frequent, a chain has at most log(n) links.

Defined results: null texts have no words; texts of any length are read whole, in blocks; a null doc_id is written as an
empty string where letters are deleted; repeated rows count as often as they are there; ties of frequency go to the
smallest word in code-point order; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

RUN = re.compile("[a-zÀ-ÿ]+")
LENGTH = 6  # code points of a word, at least
COUNT = 5  # occurrences of a word, at least
RATIO = 5  # a form is so many times as frequent as its variant
DAMAGE = 199
BLOCK = 1 << 16  # runs of a text at once
HELD = 1 << 19  # distinct words that a task counts before it hands them on
TASK_BITS = 40  # nodes of a task


def runs(text: bytes):
    """Counters of the lower-cased runs of a UTF-8 text, a block of runs at a time; only A-Z have another case."""
    lowered = text.lower().decode()
    if len(lowered) < BLOCK:
        yield Counter(RUN.findall(lowered))
        return
    found = (m.group() for m in RUN.finditer(lowered))
    while block := list(islice(found, BLOCK)):
        yield Counter(block)


def damaged(doc_id, run: str) -> str:
    """The run without one letter, if the checksum of id and run says so. (Its place and whether depend on both only.)"""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = COUNT, length: int = LENGTH) -> DataFrame:
    """(word, n): the words of all texts with ``length`` letters and ``least`` occurrences or more."""

    def run(batches):
        held: Counter = Counter()

        def batch_of():
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for part in small(batch, "text"):
                for doc_id, t in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    if not t.is_valid:
                        continue
                    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for counts in runs(t.as_buffer().to_pybytes()):
                        for r, n in counts.items():
                            if len(r) >= length:
                                if crc32(r.encode(), start) % DAMAGE == 0:
                                    r = damaged(doc_id, r)
                                    if len(r) < length:
                                        continue
                                held[r] += n
                        if len(held) > HELD:
                            yield batch_of()
        yield batch_of()

    counted = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Path:
    """Node numbers of the prefixes of words that come in order."""

    def __init__(self, task: int):
        self.next, self.word, self.nodes = (task + 1) << TASK_BITS, None, []

    def number(self, word: str) -> list[int]:
        """The nodes of the word's prefixes, from the empty one to the word itself; what it shares with the word before is not numbered anew."""
        shared = 0 if self.word is None else common(self.word, word) + 1
        new = len(word) + 1 - shared
        self.nodes = self.nodes[:shared] + list(range(self.next, self.next + new))
        self.next += new
        self.word = word
        return self.nodes


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a[:low] agrees, a[:n] doesn't
        half = (low + n) // 2
        low, n = (half, n) if a[:half] == b[:half] else (low, half)
    return low


def same_nodes(edges: list[tuple[int, str, list[int], str, list[int]]]) -> dict[int, dict[int, int]]:
    """task -> node -> the number that an earlier task gave it.

    edges: for each task its number, first word and nodes, last word and nodes. Only nodes on the path of a task's first word
    can have been met before, and those lie on the path of the last word before the task.
    """
    out, word, nodes = {}, None, []
    for task, first, first_nodes, last, last_nodes in sorted(edges):
        known = {} if word is None else dict(zip(first_nodes[: common(word, first) + 1], nodes, strict=False))
        out[task], word, nodes = known, last, [known.get(n, n) for n in last_nodes]
    return out


def numbered(vocabulary: DataFrame, column: str, name: str) -> DataFrame:
    """(word, nodes) of the trie of ``column``, from the empty prefix on. Numbers of whole words ascend in code-point order.

    The driver sees one row for each partition: the first and the last word.
    """

    def run(batches):
        path = Path(TaskContext.get().partitionId())
        for batch in batches:
            for part in small(batch, "path", 1 << 18):
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("path"), pa.array([path.number(p) for p in part.column("path").to_pylist()], pa.list_(pa.int64()))], names=["word", "path", "nodes"])

    ordered = vocabulary.select("word", F.col(column).alias("path")).repartitionByRange("path").sortWithinPartitions("path")
    found = written(ordered.mapInArrow(run, "word string, path string, nodes array<long>").withColumn("task", F.shiftright(F.element_at("nodes", -1), TASK_BITS)), name)
    edge = lambda of: of(F.struct(F.element_at("nodes", -1).alias("leaf"), "path", "nodes"))
    edges = [(r["task"], r["first"]["path"], r["first"]["nodes"], r["last"]["path"], r["last"]["nodes"]) for r in found.groupBy("task").agg(edge(F.min).alias("first"), edge(F.max).alias("last")).collect()]
    same = {t: k for t, k in same_nodes(edges).items() if k}

    def rename(batches):
        for batch in batches:
            for part in small(batch, "path"):
                flat = part.column("nodes").flatten().to_numpy().copy()
                for task in np.unique(part.column("task").to_numpy()).tolist():
                    if known := same.get(task):
                        old = np.array(sorted(known), np.int64)
                        new = np.array([known[k] for k in old.tolist()], np.int64)
                        at = np.minimum(np.searchsorted(old, flat), len(old) - 1)
                        flat = np.where(old[at] == flat, new[at], flat)
                stops = np.concatenate(([0], np.cumsum(part.column("nodes").value_lengths().to_numpy()))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.ListArray.from_arrays(stops, flat)], names=["word", "nodes"])

    return found.mapInArrow(rename, "word string, nodes array<long>")


def pair_dictionary(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of words (word, n): (prefix, suffix, id, n, skipped, first), their pairs of nodes, and (id, word, n).

    id is the node of the whole word; first is true for split pairs, and for skipped ones whose letter differs from the one before.
    """
    back = vocabulary.withColumn("back", F.reverse("word"))
    prefixes = written(numbered(back, "word", "prefixes"), "prefix_nodes")
    suffixes = written(numbered(back, "back", "suffixes"), "suffix_nodes")
    both = vocabulary.join(prefixes.withColumnRenamed("nodes", "p"), "word").join(suffixes.withColumnRenamed("nodes", "s"), "word")

    def run(batches):
        for batch in batches:
            for part in small(batch, "word", 1 << 16):
                columns = [[] for _ in range(6)]
                for word, n, p, s in zip(*(part.column(c).to_pylist() for c in ("word", "n", "p", "s")), strict=True):
                    size, s = len(word), s[::-1]  # s[i]: suffix from letter i on
                    both = (p[:-1] + p, s[1:] + s, [p[-1]] * (2 * size + 1), [n] * (2 * size + 1), [True] * size + [False] * (size + 1))
                    first = [a != b for a, b in zip(word, "\n" + word, strict=False)] + [True] * (size + 1)
                    for column, values in zip(columns, (*both, first), strict=True):
                        column.extend(values)
                kinds = [pa.int64()] * 4 + [pa.bool_()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["prefix", "suffix", "id", "n", "skipped", "first"])

    pairs = both.mapInArrow(run, "prefix long, suffix long, id long, n long, skipped boolean, first boolean")
    return pairs, prefixes.select(F.element_at("nodes", -1).alias("id"), "word").join(vocabulary, "word").select("id", "word", "n")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word with a neighbour, how many it has and the best of them, as (n, -id)."""
    member = F.struct("n", (-F.col("id")).alias("minus"), "first")
    groups = pairs.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(F.when(F.col("skipped"), member)), asc=False).alias("skipped"), F.max(F.when(~F.col("skipped"), F.struct("n", (-F.col("id")).alias("minus")))).alias("split"))
    groups = groups.filter((F.size("skipped") > 1) | ((F.size("skipped") == 1) & F.col("split").isNotNull()))
    plain = lambda m: F.struct(m["n"].alias("n"), m["minus"].alias("minus"))
    top = lambda k: F.when(F.size("skipped") > k, plain(F.col("skipped")[k]))
    firsts = F.filter("skipped", lambda m: m["first"])
    groups = groups.select("skipped", "split", top(0).alias("one"), top(1).alias("two"), firsts.alias("firsts"))
    # replaced letters: each skipped word with the others; the first of them is its own best, so it has the second
    longer = lambda m: F.when(m["first"] & F.col("split").isNotNull(), F.col("split"))
    of_skipped = F.transform(
        "skipped",
        lambda m: F.struct(
            (-m["minus"]).alias("id"),
            (F.size("skipped") - 1 + F.when(longer(m).isNotNull(), 1).otherwise(0)).cast("long").alias("near"),
            F.greatest(F.when(plain(m) == F.col("one"), F.col("two")).otherwise(F.col("one")), longer(m)).alias("best"),
        ),
    )
    of_split = F.array(F.struct((-F.col("split.minus")).alias("id"), F.size("firsts").cast("long").alias("near"), F.when(F.size("firsts") > 0, plain(F.col("firsts")[0])).alias("best")))
    rows = groups.select(F.explode(F.when(F.col("split").isNull(), of_skipped).otherwise(F.concat(of_skipped, of_split))).alias("m")).select("m.*")
    return rows.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): forms followed to the last, twice as far in each round."""
    links = written(forms.select("id", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = written(links.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = step.drop("moved")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of words (word, n): form (the most frequent word at edit distance one, null if it is not ``ratio`` times as frequent), root (the last of its forms), n, n_near (words at distance one), form_n."""
    vocabulary = written(vocabulary.select("word", "n"), "vocabulary")
    pairs, ids = pair_dictionary(vocabulary)
    ids, near = written(ids, "ids"), neighbours(pairs)
    chosen = ids.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    chosen = written(chosen.select("id", "word", "n", "n_near", (-F.col("best.minus")).alias("form"), F.col("best.n").alias("form_n")), "chosen")
    forms = chosen.filter("form IS NOT NULL").select("id", "form")
    named = lambda side: ids.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"))
    forms = forms.join(roots(forms), "id").join(named("form"), "form").join(named("root"), "root").select("id", "form_word", "root_word")
    return chosen.drop("form").join(forms, "id", "left").select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(words(table(spark, sf_dir, "documents")))
