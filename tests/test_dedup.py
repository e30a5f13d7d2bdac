"""Near duplicates against all pairs of each band, with bands of many components."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import dedup


def texts(seed, n):
    """Half of each text is shared by all, so that bands hold texts that aren't similar; with near copies, equal copies and lengths of all kinds."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    core = [word() for _ in range(12)]
    out = [None, "", "a", "ab"]
    for _ in range(n):
        own = [word() for _ in range(rng.choice([4, 7, 9]))]
        out.append(" ".join([*core, *own]))
        if rng.random() < 0.4:
            out.append(" ".join([*core, *own[:-1], word()]))
        if rng.random() < 0.2:
            out.append(out[-1])
    return out


def groups_of_all_pairs(spark, rows, threshold):
    """Components of texts that share a band and are similar, by a plain loop."""
    signed = dedup.sketched(rows.select(F.col("id").alias("rep"), "content")).collect()
    root = {r.rep: r.rep for r in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    met = 0
    for x in signed:
        for y in signed:
            if x.rep < y.rep and x.g and y.g and any(p == q for p, q in zip(x.bands, y.bands)):
                met += 1
                common = len(set(x.g) & set(y.g))
                if common >= threshold * (len(x.g) + len(y.g) - common):
                    root[max(find(x.rep), find(y.rep))] = min(find(x.rep), find(y.rep))
    return {x: find(x) for x in root}, met


@pytest.mark.parametrize("block", [3, 256])
def test_same_groups_as_all_pairs_of_a_band(spark, monkeypatch, block):
    monkeypatch.setattr(dedup.block_links, "__defaults__", (block,))
    monkeypatch.setattr(dedup, "PART", 5 if block == 3 else 4096)
    rows = spark.createDataFrame(list(enumerate(texts(block, 60))), "id long, content string").withColumn("extra", F.lit(1))
    got = {r.id: (r.component, r.keep) for r in dedup.near_duplicates(rows.withColumn("content", F.coalesce("content", F.lit("")))).collect()}
    want, met = groups_of_all_pairs(spark, rows.withColumn("content", F.coalesce("content", F.lit(""))), dedup.THRESHOLD)
    empty = {0, 1}  # equal texts without shingles are one group too
    assert {i: c for i, (c, _) in got.items() if i not in empty} == {i: c for i, c in want.items() if i not in empty}
    assert got[0][0] == got[1][0] == 0
    assert met > 500 and len({c for c, _ in got.values()}) > 30
    assert sum(keep for _, keep in got.values()) == len({c for c, _ in got.values()})


def test_empty_table(spark):
    assert dedup.near_duplicates(spark.createDataFrame([], "id long, content string")).collect() == []


def test_blocks_are_compared_by_products():
    """Shared shingles of all pairs of two blocks, over several runs of columns, with nothing in common and with an empty side; no pair is compared by itself."""
    import numpy as np

    rng = np.random.default_rng(5)
    left, right = ([np.sort(rng.choice(4000, rng.integers(1, 900), replace=False)) for _ in range(n)] for n in (23, 17))
    right[3] = right[3] + 10_000
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert dedup._common(left, right, columns=64).tolist() == want
    assert dedup._common(left, [right[3]]).tolist() == [[0]] * 23 and dedup._common([], right).shape == (0, 17)
    assert [dedup._both(x, y) for x, y in zip(left, right)] == [want[i][i] for i in range(17)]


def shuffled_bytes(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    run()
    tracker, store, out = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        out += store.lastStageAttempt(stage).shuffleWriteBytes()
    spark.sparkContext.setJobGroup("", "")
    return out


def test_shingles_are_not_copied_for_pairs_and_bands(spark):
    """Texts that share bands and aren't near: what is shuffled is in line with the texts, not with their pairs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, content string").cache()
    signed = dedup.sketched(df.select(F.col("id").alias("rep"), "content")).collect()
    met = sum(any(p == q for p, q in zip(x.bands, y.bands)) for x in signed for y in signed if x.rep < y.rep)
    got = []
    moved = shuffled_bytes(spark, "near duplicates", lambda: got.extend(dedup.near_duplicates(df).collect()))
    assert met > 1000 and len(got) == len({r.component for r in got}) == 240
    assert moved < 3 * sum(len(text) for _, text in rows)


def test_a_null_text_is_an_empty_one(spark):
    got = dedup.near_duplicates(spark.createDataFrame([(1, None), (2, ""), (3, "some words of a text")], "id long, content string")).collect()
    assert sorted((r.id, r.component, r.keep) for r in got) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_bitmaps_rule_out_no_near_pair():
    """At each level a text's bits and its loss make up its shingles, and a pair's common bits and the lesser loss are no less than what it has in common."""
    import numpy as np

    rng = np.random.default_rng(11)
    sets = [np.sort(rng.choice(3000, n, replace=False)) for n in rng.integers(200, 700, 30)]
    n = np.array([len(s) for s in sets], np.int32)
    side = dedup.SimpleNamespace(n=n, end=np.cumsum(n), g=np.concatenate(sets).astype(np.uint16))
    for bits, lost in dedup._bitmaps(side, rng.permutation(3000), 2048):
        assert (np.bitwise_count(bits).sum(axis=1) + lost == n).all()
        for x in range(30):
            for y in range(30):
                most = int(np.bitwise_count(bits[x] & bits[y]).sum()) + min(lost[x], lost[y])
                assert most >= len(np.intersect1d(sets[x], sets[y]))
