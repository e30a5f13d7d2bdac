"""Spelling variants against all pairs of words, and the numbering of nodes against sets of prefixes."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from palimpsest.llm import spelling_variants as variants
from palimpsest.llm.spelling_variants import Path, common, numbered, op11_spelling_variants, runs, same_nodes, spelling_variants, words

from .helpers import edge_docs, edge_rows, empty_docs


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    held = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\\u00C0-\\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            held[run] += 1
    return {w: n for w, n in held.items() if len(w) >= 6 and n >= 5}


def plain(counts):
    out, form = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (n, len(close))
    rows = set()
    for w, (n, close) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, close, None if form[w] is None else counts[form[w]]))
    return rows


def some_words(rng, letters, n, low, high):
    seeds = ["".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)]
    for w in seeds[:]:
        for _ in range(3):
            at, c = rng.randrange(len(w)), rng.choice(letters)
            seeds.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]]))
    return {w: rng.choice([5, 6, 25, 30, 125, 700, 4000]) for w in seeds if w}


def test_runs_and_letters():
    text = "Ähre ÀB-ÿz×÷ KK İx o'Neil9 ĀB"
    got = Counter()
    for counts in runs(text.encode()):
        got += counts
    assert got == Counter(r.translate({c: c + 32 for c in range(65, 91)}) for r in re.findall("[A-Za-z\\u00C0-\\u00FF]+", text))


def test_long_texts_in_blocks(monkeypatch):
    whole = sum(runs(b"one two two three " * 50), Counter())
    monkeypatch.setattr(variants, "BLOCK", 7)
    assert sum(runs(b"one two two three " * 50), Counter()) == whole == Counter({"one": 50, "two": 100, "three": 50})


def test_common_prefix():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 9))) for _ in range(2))
        assert common(a, b) == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_nodes_over_partitions():
    """However the ordered words are cut, equal prefixes get equal numbers and different ones different numbers."""
    rng = random.Random(2)
    for _ in range(30):
        vocabulary = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)})
        cuts = sorted(rng.sample(range(1, len(vocabulary)), 9))
        nodes, edges = [], []
        for task, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(vocabulary)], strict=True)):
            path = Path(task)
            own = [(task, w, path.number(w)) for w in vocabulary[a:b]]
            nodes += own
            edges.append((task, own[0][1], own[0][2], own[-1][1], own[-1][2]))
        same = same_nodes(edges)
        number = {}
        for task, w, ns in nodes:
            for i, node in enumerate(ns):
                number.setdefault(w[:i], set()).add(same[task].get(node, node))
        assert all(len(v) == 1 for v in number.values()) and len(set.union(*number.values())) == len(number)


@pytest.mark.parametrize("letters, n, low, high", [("ab", 60, 1, 7), ("aéz", 120, 2, 6), ("abcdefghijklmnopqrstuvwxyzàÿ", 250, 5, 12)])
def test_against_all_pairs(spark, letters, n, low, high):
    counts = some_words(random.Random(n), letters, n, low, high)
    rows = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(rows) == len(counts) and {tuple(r) for r in rows} == plain(counts)


def test_numbered_in_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = some_words(random.Random(9), "abc", 150, 3, 9)
        vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
        number = {}
        for r in numbered(vocabulary, "word", "test").collect():
            for i, node in enumerate(r["nodes"]):
                number.setdefault(r["word"][:i], set()).add(node)
        assert all(len(v) == 1 for v in number.values()) and len(set.union(*number.values())) == len(number)
        ids = sorted((number[w].copy().pop(), w) for w in counts)
        assert [w for _, w in ids] == sorted(counts)
        assert {tuple(r) for r in spelling_variants(vocabulary).collect()} == plain(counts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_chains_of_forms(spark):
    counts = {"a" * 6 + "b" * i: 5 * 6**i for i in range(9)}
    rows = {r["word"]: r for r in spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {r["root"] for r in rows.values()} == {"a" * 6 + "b" * 8} and rows["aaaaaab"]["form"] == "aaaaaabb" and rows["aaaaaab"]["n_near"] == 2


def test_odd_rows_and_empty_tables(spark, monkeypatch):
    assert {tuple(r) for r in words(edge_docs(spark), least=1, length=1).collect()} >= {("é", 1), ("ü", 1), ("x" * 3000, 1)}
    rows = edge_rows()
    got = {r["word"]: r["n"] for r in words(edge_docs(spark)).collect()}
    assert got == plain_words([(r[0], r[1]) for r in rows])
    assert words(empty_docs(spark)).collect() == [] and spelling_variants(words(empty_docs(spark))).collect() == []


def test_query(spark, tmp_path):
    out = op11_spelling_variants(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    docs = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = out.collect()
    assert {tuple(r) for r in rows} == plain(plain_words(docs)) and len({r["word"] for r in rows}) == len(rows) > 100
