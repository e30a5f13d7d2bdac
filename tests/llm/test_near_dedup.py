"""op4 against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import near_dedup as nd

from .helpers import WORDS, docs, edge_docs, edge_rows, empty_docs


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        at = rnd.randrange(len(out))
        out[at : at + rnd.randrange(2)] = [rnd.choice(WORDS)]
    return out


def corpus():
    rnd = random.Random(4)
    texts = []
    for _ in range(12):
        base = rnd.choices(WORDS, k=rnd.randrange(30, 200))
        texts += [" ".join(base)] * rnd.randrange(1, 4) + [" ".join(edited(rnd, base, rnd.randrange(1, 5))) for _ in range(6)]
    hot = rnd.choices(WORDS, k=120)
    texts += [" ".join(edited(rnd, hot, 1)) for _ in range(60)]
    shared = " ".join(rnd.choices(WORDS, k=60))
    texts += [shared + " " + " ".join(rnd.choices(WORDS, k=60)) for _ in range(40)]  # a passage alone makes no duplicate
    rnd.shuffle(texts)
    return texts


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def lcs_similarity(a, b):
    return (m := lcs(a, b)) / (len(a) + len(b) - m)


def words(text):
    return nd._words(pa.scalar(text))


def shingles(text):
    return nd.labelled_shingles(w := words(text), np.array([0, len(w)]))[0]


def test_alignment_equals_full_dynamic_programming():
    rnd = random.Random(5)
    for _ in range(400):
        a = rnd.choices(WORDS[: rnd.choice([2, 6, 400])], k=rnd.randrange(1, 60))
        b = edited(rnd, a, rnd.randrange(12))
        similarity = rnd.choice([0.3, 0.5, nd.SIMILARITY, 0.9, 1.0])
        want, got = 2 * lcs(a, b) / (len(a) + len(b)) if b else 0.0, nd.alignment(words(" ".join(a)), words(" ".join(b)), similarity)
        assert got == pytest.approx(want if want >= similarity - 1e-9 else 0.0)


def test_similar_by_shingles_is_similar_by_words():
    rnd = random.Random(15)
    for _ in range(200):
        a = rnd.choices(WORDS[: rnd.choice([3, 40])], k=rnd.randrange(5, 60))
        b = edited(rnd, a, rnd.randrange(3))
        x, y = " ".join(a), " ".join(b)
        if lcs_similarity(shingles(x).tolist(), shingles(y).tolist()) >= nd.SIMILARITY:
            assert nd.alignment(words(x), words(y)) >= nd.SIMILARITY


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_given_tables(spark, folder):
    """Pairs of different texts with 0.3 of their labelled shingles in common, by counts over all pairs: 0.9 of them or more end in one group; pairs under 0.2 are no near duplicates."""
    path = f"/root/testdata/{folder}"
    texts = sorted({r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("text").collect() if r.text and r.text.split()})
    rows = [shingles(t) for t in texts]
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(flat, kind="stable")
    runs = np.split(owner[order], np.flatnonzero(np.diff(flat[order])) + 1)
    common = {}
    for run in runs:
        if 1 < len(run) <= 300:
            for i, a in enumerate(run.tolist()):
                for b in run[:i].tolist():
                    common[b, a] = common.get((b, a), 0) + 1
    share = {(a, b): c / (len(rows[a]) + len(rows[b]) - c) for (a, b), c in common.items()}
    near = [p for p, s in share.items() if s >= 0.3]
    far = [p for p, s in share.items() if s < 0.2 and len(rows[p[0]]) + len(rows[p[1]]) < 2000][:: 1 if folder == "sf0.01" else 40]
    group = {r.text: r.group_id for r in nd.op4_near_dedup(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), "doc_id").select("text", "group_id").collect()}
    found = sum(group[texts[a]] == group[texts[b]] for a, b in near) / len(near)
    print(folder, len(near), found)
    assert len(near) > 60 and found >= 0.95
    assert not any(nd.alignment(words(texts[a]), words(texts[b])) >= nd.SIMILARITY for a, b in far)


def test_groups_equal_components_of_all_pairs(spark):
    texts = corpus()
    s = [words(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or nd.alignment(s[i], s[j]) >= nd.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = nd.near_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: r.group_id for r in rows} == {i: find(i) for i in range(len(texts))}
    assert {r.doc_id: r.class_id for r in rows} == {i: texts.index(t) for i, t in enumerate(texts)}
    assert all(r.kept == (r.doc_id == r.group_id) for r in rows)


def test_block_counts_equal_sets():
    rng = np.random.default_rng(6)
    a, b = ([np.unique(rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert nd.common_counts(a, b).tolist() == want


def union(links, root):
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return find


@pytest.mark.parametrize("block", [3, 16, 256])
def test_block_links_join_what_all_pairs_join(spark, monkeypatch, block):
    rnd = random.Random(block)
    monkeypatch.setattr(nd, "BLOCK", block)
    base = rnd.choices(WORDS, k=60)
    texts = [" ".join(edited(rnd, base, rnd.randrange(1, 4))) for _ in range(50)] + [" ".join(rnd.choices(WORDS, k=40)) for _ in range(5)]
    s = [words(t) for t in texts]
    component = {i: i // 3 * 3 for i in range(len(texts))}  # some are joined already, and the largest component is inside
    named = spark.createDataFrame([(1, i, len(s[i]), component[i], component[i] != 0) for i in component], "key long, rep long, n int, component long, outside boolean")
    rows = [(r.a, r.b) for r in nd.block_links(named, nd.fingerprints(spark.createDataFrame(list(enumerate(texts)), "rep long, text string"))).collect()]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if nd.alignment(s[i], s[j]) >= nd.SIMILARITY]
    assert set(rows) <= set(pairs) and (block < 256 or len(rows) < len(texts))
    old = [(i, c) for i, c in component.items()]
    mine, whole = union(old + rows, {}), union(old + [p for p in pairs if component[p[0]] != component[p[1]]], {})
    assert [mine(i) for i in component] == [whole(i) for i in component]


def test_order_matters(spark):
    halves = [" ".join(WORDS[:60]), " ".join(WORDS[60:120])]
    rows = nd.near_duplicates(docs(spark, [" ".join(halves), " ".join(halves[::-1])])).collect()
    assert len({r.group_id for r in rows}) == 2


def test_odd_rows(spark):
    d = edge_docs(spark)
    rows = nd.near_duplicates(d).collect()
    assert len(rows) == len(edge_rows())
    assert {r.class_id for r in rows if r.doc_id in (2, 3)} == {2}
    kept = nd.drop_near_duplicates(d)
    assert kept.schema == d.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "6", "7", "8", "None"]
    assert nd.near_duplicates(empty_docs(spark)).count() == 0
    assert nd.drop_near_duplicates(empty_docs(spark)).count() == 0


def test_short_pairs_share_a_key_with_certainty(spark):
    rnd = random.Random(8)
    texts = []
    for n in range(1, 27):
        for _ in range(40 if n < 13 else 8):
            base = rnd.choices(WORDS, k=n)
            texts += [" ".join(base), " ".join([*base, rnd.choice(WORDS)]), " ".join([rnd.choice(WORDS), *base]), " ".join(edited(rnd, base, 1)), " ".join([*base, *rnd.choices(WORDS, k=2)])]
    s = [shingles(t) for t in texts]
    keys = [set(nd.bucket_keys(x)) for x in s]
    near = {(i, j) for i in range(len(s)) for j in range(i) if len(s[i]) <= nd.SHORT and len(s[j]) <= nd.SHORT and lcs_similarity(s[i].tolist(), s[j].tolist()) >= nd.SIMILARITY}
    assert {(len(s[i]), len(s[j])) for i, j in near} >= {(5, 4), (6, 5), (7, 6), (9, 8)}
    assert all(keys[i] & keys[j] for i, j in near)
    eight, nine = " ".join(WORDS[:8]), " ".join(WORDS[:9])
    ten = " ".join(WORDS[20:30])
    rows = nd.near_duplicates(docs(spark, [eight, nine, ten, "first " + ten, "another text of just a few words here"])).collect()
    assert {r.doc_id: r.group_id for r in rows} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.9])
def test_short_pairs_share_a_key_at_other_similarities(similarity):
    rnd = random.Random(9)
    texts = [rnd.choices(range(12), k=rnd.randrange(1, 9)) for _ in range(150)]
    s = [np.unique(nd.mix(np.array(t, np.uint64))) for t in texts]
    keys = [set(nd.short_keys(x, similarity)) for x in s]
    assert all(keys[i] & keys[j] for i in range(len(s)) for j in range(i) if lcs_similarity(s[i].tolist(), s[j].tolist()) >= similarity)


def test_null_and_repeated_ids_dont_merge_texts(spark):
    text = [" ".join(WORDS[i : i + 40]) for i in (0, 50, 100, 150, 200)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[3] + " more"), (None, text[4]), (9, text[4] + " more")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_duplicates(d).collect()
    assert len(got) == len(rows) and len({r.group_hash for r in got}) == 5
    assert sorted((str(r.doc_id), r.text) for r in nd.drop_near_duplicates(d).collect()) == sorted([("None", text[0]), ("None", text[1]), ("7", text[2]), ("7", text[3]), ("9", text[4] + " more")])
