"""op5, op7, op8 and the pipeline: laws of the results, exact round trips, odd rows."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import kd_sharding, mixing, packing

from .helpers import docs, edge_docs, edge_rows, empty_docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check_packing(rows, texts):
    own = tokenizer()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    for doc, text in texts.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == packing.SEQUENCE for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == crc32(ids[p.start : p.start + p.length].tobytes())
    return len(by_sequence)


def test_packing_round_trip(spark, corpus):
    rows = packing.pack(corpus).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in corpus.collect()})
    least = -(-sum(r.length for r in rows) // packing.SEQUENCE)
    assert n <= 1.08 * least + 1


def test_ids_are_the_library_s(spark):
    n = 2_000_000
    texts = [" " * n, "\n" * n, "a" * n, "a<|endoftext|>b", "<|endoftext|>", " \t" * 3000 + "x", "x" + "\u3000" * 5000, "a" + " " * 4095 + "b", "a" + " " * 4096 + "b", ("ab " + " " * 60) * 500]
    encode, own = packing.encoder(packing.default_tokenizer()), tokenizer()
    for text in texts:
        assert encode(text) == own.encode(text, add_special_tokens=False).ids
    rows = packing.pack(docs(spark, [texts[0], texts[1], texts[3]])).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2} and sum(r.length for r in rows if r.doc_id == 2) == 4


def test_packing_odd_rows(spark):
    rows = packing.pack(edge_docs(spark)).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(r[0] for r in edge_rows())
    check_packing(rows, {})
    assert packing.pack(empty_docs(spark)).count() == 0


def test_plan_uses_each_piece_once_and_fills_exactly():
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 400, 20_000).tolist()) | Counter({512: 5001, 1024: 3})
    plan = packing.plan(dict(counts))
    left = np.zeros(packing.SEQUENCE + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    exact = packing.exact_patterns(left.copy(), packing.SEQUENCE)
    assert all(sum(p) == packing.SEQUENCE for p, _ in exact)
    assert set(plan) == set(counts)
    patterns = [*packing.exact_patterns(left, packing.SEQUENCE), *packing.best_fit(left, packing.SEQUENCE)]
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= packing.SEQUENCE
        for k in p:
            used[k] += n
    assert used == counts
    assert sum(n for _, n in patterns) <= -(-sum(k * n for k, n in counts.items()) // packing.SEQUENCE) + 2


def reference_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / total >= most * sizes[s]}
        if not over:
            return target | {s: rest * w[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def check_mix(rows):
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    for s, t in reference_targets(dict(sizes)).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1


def test_mix(spark, corpus):
    rows = mixing.mixed(corpus).collect()
    check_mix(rows)
    assert len(rows) == corpus.count()
    again = mixing.mixed(corpus.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mixed_documents_hold_the_words_taken(spark, corpus):
    words = F.regexp_count("text", F.lit(mixing.WORD))
    out = mixing.mixed_documents(corpus)
    assert out.schema.names == corpus.schema.names
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}
    assert got == {r.doc_id: r.taken for r in mixing.mixed(corpus).collect() if r.taken}
    assert out.filter("n_chars <> length(text)").count() == 0


def test_better_documents_come_first(spark):
    larger = SF.replace("sf0.001", "sf0.01")
    rows = mixing.mixed(spark.read.parquet(f"{larger}/documents.parquet")).filter("target < source_size").join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.taken / max(r.size, 1) for r in rows if r.quality == k] for k in (1, 0))
    assert sum(good) / len(good) > 2 * sum(bad) / len(bad)


def test_given_weights_order_documents(spark):
    table = docs(spark, ["four words are here"] * 600, ["a", "b", "c"]).withColumn("light", F.col("doc_id") >= 300)
    rows = mixing.mixed(table, weight=F.when(F.col("light"), 0.05).otherwise(1.0)).filter("target < source_size").collect()
    heavy, light = ([r.taken for r in rows if (r.doc_id < 300) == k] for k in (True, False))
    assert sum(heavy) / max(len(heavy), 1) > sum(light) / max(len(light), 1)


def test_rows_without_id_are_sampled_one_by_one(spark):
    """30 000 texts without an id: the budget's end is one of many places, and heavier rows come first as their weights say."""
    rows = [(None, f"{'good' if i % 2 else 'bad'} {i} " + "w " * 8, "s") for i in range(30_000)] + [(5, f"x {i}", "t") for i in range(10_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(d, F.when(F.col("text").startswith("good"), 3.0).otherwise(1.0), share=0.25, weights=(1,)).filter("source = 's'")
    good = out.join(d.select(F.xxhash64("text").alias("h"), F.col("text").startswith("good").alias("good")), "h").groupBy("good").agg(F.count_if(F.expr("taken > 0")).alias("n"), F.count_if(F.expr("part > 0 AND part < size")).alias("cut")).collect()
    n = {r.good: r.n for r in good}
    # P(-ln(u)/w < x): of the heavy ones 1 - exp(-3x), of the light ones 1 - exp(-x), for the x that meets the budget
    x = next(x / 10_000 for x in range(1, 50_000) if (2 - math.exp(-3 * x / 10_000) - math.exp(-x / 10_000)) * 15_000 >= sum(n.values()))
    assert sum(r.cut for r in good) <= 1 and n[True] == pytest.approx(15_000 * (1 - math.exp(-3 * x)), rel=0.05)
    assert out.filter("part > 0 AND part < size").count() <= 1


def test_mix_odd_rows(spark):
    d = edge_docs(spark)
    rows = mixing.mixed(d).collect()
    assert len(rows) == len(edge_rows())
    check_mix(rows)
    out = mixing.mixed_documents(d)
    assert out.schema == d.schema and out.count() > 0
    assert mixing.mixed(empty_docs(spark)).count() == 0 and mixing.mixed_documents(empty_docs(spark)).count() == 0


def test_shards_are_even_and_slots_gapless(spark, corpus):
    rows = kd_sharding.with_slots(kd_sharding.kd_shards(corpus)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in corpus.select("doc_id").collect())
    texts = {r.doc_id: r.text for r in corpus.collect()}
    sizes = Counter()
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == crc32((texts[r.doc_id] or "").encode())
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_a_hot_source_is_split(spark):
    rows = kd_sharding.kd_shards(docs(spark, ["same text of one size"] * 800, ["hot"])).groupBy("shard").count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) - min(r["count"] for r in rows) <= 8


def test_equal_texts_stay_together_unless_they_weigh_too_much(spark):
    rnd = np.random.default_rng(5)
    texts = [f"text {i} " + "w" * int(rnd.integers(10, 60)) for i in range(3000) for _ in range(1 + 9 * (i % 10 == 0))] + ["the hot text"] * 4000
    table = spark.createDataFrame([(i, t, ["en", None][i % 2], f"https://a.source/{i % 13}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = kd_sharding.kd_shards(table).collect()
    sizes, at = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(at.pop("the hot text")) > 1 and all(len(x) == 1 for x in at.values())
    assert len(sizes) == 8 and max(sizes.values()) <= 1.03 * min(sizes.values())


def test_ranks_follow_whole_values(spark):
    values = ["https://a/1", "https://a/10", "https://a/2", "é", "z", "\U0001f600", None, "z"]
    got = {r.value: r["rank"] for r in kd_sharding.ranks(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted({v for v in values if v}))}


def test_many_leaves_are_cut_by_batches(spark, corpus, monkeypatch):
    for name, value in (("LITERALS", 2), ("NODES", 3), ("DRIVER_ROWS", 64), ("LEVELS", 2), ("CODES", 1)):
        monkeypatch.setattr(kd_sharding, name, value)
    got = {r.shard: r.n for r in kd_sharding.kd_shards(corpus, shards=6).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    monkeypatch.undo()
    want = {r.shard: r.n for r in kd_sharding.kd_shards(corpus, shards=6).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert set(got) == set(want) == set(range(6)) and sum(got.values()) == sum(want.values())


def test_target_bytes_decide_the_number_of_leaves(spark, corpus):
    total = corpus.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    rows = kd_sharding.kd_shards(corpus, target_bytes=-(-total // 5)).select("shard").distinct().collect()
    assert {r.shard for r in rows} == set(range(5))


def test_native_plan(spark, corpus):
    plan = kd_sharding.with_slots(kd_sharding.kd_shards(corpus))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shard_odd_rows(spark):
    rows = kd_sharding.with_slots(kd_sharding.kd_shards(edge_docs(spark))).collect()
    assert len(rows) == len(edge_rows()) and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert kd_sharding.with_slots(kd_sharding.kd_shards(empty_docs(spark))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    first = spark.read.parquet(f"{SF}/documents.parquet")
    packed = corpus_pipeline.run(spark, SF).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "near_dedup", "mixing", "packing"]
    assert {r.doc_id for r in packed} <= {r.doc_id for r in first.collect()} and packed
    at = Counter()
    for r in packed:
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 1024


def test_pipeline_odd_rows(spark):
    import corpus_pipeline

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/odd"
    more = [(100 + i, f"A plain sentence about the river and the hill number {i} " * 8, "en", "abc"[i % 3], 1, 0.5, 3, "yes") for i in range(30)]
    table = edge_docs(spark)
    for rows, name in ((table.unionByName(spark.createDataFrame(more, table.schema)), "some"), (table.limit(0), "none")):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/documents.parquet")
        spark.createDataFrame([(100, 1, 0), (101, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/{name}/labels.parquet")
        docs_ = spark.read.parquet(f"{folder}/{name}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs_, f"{folder}/{name}")
            assert out.columns == docs_.columns, stage_name
        packed = corpus_pipeline.run(spark, f"{folder}/{name}").collect()
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and bool(packed) == (name == "some")
