"""Operators against plain loops, golden fixtures and properties."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import activity, beliefs, components, context, dedup, entities, evaluate, extract, graph, rerank, retrieve
from palimpsest.streaming import jobs

DAY = dt.datetime(2024, 1, 1)


def test_sessions_keep_a_gap_of_exactly_half_an_hour(spark):
    ts = [DAY, DAY + dt.timedelta(minutes=30), DAY + dt.timedelta(hours=1, microseconds=1)]
    rows = spark.createDataFrame([(1, t) for t in ts], "user_id long, ts timestamp")
    assert sorted(r.n_events for r in activity.sessions(rows).collect()) == [1, 2]


def test_throttle_equals_a_loop(spark):
    rnd = random.Random(1)
    touches = sorted((u, DAY + dt.timedelta(seconds=rnd.randrange(2000))) for u in range(5) for _ in range(50))
    want = {}
    for u, t in touches:
        if u not in want or (t - want[u][1]).total_seconds() >= 60:
            want[u] = (want.get(u, (0,))[0] + 1, t)
    got = activity.throttled(spark.createDataFrame(touches, "user_id long, ts timestamp"), 60).collect()
    assert {r.user_id: (r.recorded, r.last_recorded) for r in got} == want


def test_conflicts_equal_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, 1, f"e{rnd.randrange(4)}", "a", rnd.choice("xyz"), DAY + dt.timedelta(days=rnd.randrange(200))) for i in range(60)]
    want = {}
    for i, _, e, _, v, t in rows:
        newer = [(u, -j) for j, _, f, _, w, u in rows if f == e and w != v and u > t]
        if newer:
            u, j = max(newer)
            want[i] = (round(min(1, (u - t).total_seconds() / 86400 / 90), 6), -j)
    got = beliefs.conflicts(spark.createDataFrame(rows, "id long, user_id long, entity string, attribute string, value string, ts timestamp")).collect()
    assert {r.id: (round(r.penalty, 6), r.winner) for r in got} == want


def test_gate(spark):
    incoming = [(1, "Uses Redis 7.", True, None), (2, "No longer on Heroku, moved to GCP 2.", True, None), (3, "rate limit 500", True, None), (4, "x", False, None), (5, "No longer uses Heroku.", True, "Heroku"), (6, "Uses Heroku.", True, None), (7, "new", True, None)]
    near = [(1, 10, 0.98, "Uses Redis 7.", False), (2, 11, 0.85, "Heroku 1", False), (3, 12, 0.9, "rate limit 100", False), (6, 13, 0.99, "No longer uses Heroku.", True), (7, 14, 0.5, "other", False)]
    a = spark.createDataFrame(incoming, "id long, content string, has_vector boolean, retraction string")
    b = spark.createDataFrame(near, "id long, nearest_id long, similarity double, nearest_content string, nearest_is_retraction boolean")
    got = {r.id: (r.decision, r.reason) for r in beliefs.gate(a, b).collect()}
    assert got == {1: ("touch", "sim>=touch"), 2: ("supersede", "cue"), 3: ("conflict", "no_cue"), 4: ("insert", "no_embedding"), 5: ("retract", "retraction"), 6: ("conflict", "polarity_guard"), 7: ("insert", "below_related")}
    assert {r.id: (r.decision, r.reason) for r in beliefs.gate(a.orderBy(F.desc("id")), b).collect()} == got


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert all(r.component == find(r.node) for r in got)
    assert {r.node for r in got} == {x for a, b in links if a != b for x in (a, b)}


def test_near_duplicates_keep_one_of_each_group(spark):
    texts = ["the quick brown fox jumps over the lazy dog today", "the quick brown fox jumps over the lazy dog today!", "something else entirely is written here", "", "", "something else entirely is written here"]
    got = {r.id: (r.component, r.keep) for r in dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, content string")).collect()}
    assert got[0][0] == got[1][0] and got[1][1] and not got[0][1]
    assert got[2] == (2, True) and got[5] == (2, False) and got[3][1] != got[4][1]


def test_mentions(spark):
    m = spark.createDataFrame([("PostgreSQL",), ("the Billing Service",), ("BS",), ("system",), ("Postgresql db",), ("unheard of",)], "mention string")
    e = spark.createDataFrame([("postgresql",), ("billing service",)], "entity string")
    got = {r.mention: (r.entity, r.rule) for r in entities.resolved(m, e).collect()}
    assert got == {"PostgreSQL": ("postgresql", "alias"), "the Billing Service": ("billing service", "alias"), "BS": ("billing service", "acronym"), "system": (None, "generic"), "Postgresql db": ("postgresql", "first_token"), "unheard of": (None, "new")}


def test_trigram_pairs_equal_all_pairs(spark):
    def grams(t):
        return {x for w in t.split() for x in [("  " + w + " ")[i : i + 3] for i in range(len(w) + 1)]}

    names = ["red plate", "rod plate", "plate red", "blue bolt", "blue bolts", "bolt", "green nut"]
    want = {(a, b) for a in names for b in names if a != b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.45}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {(r.a, r.b) for r in entities.trigram_pairs(df, df, "n", 0.45).collect()} == want


def test_fusion_golden(spark):
    legs = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "qid long, claim_id long, rank int") for x in ([10, 11], [11, 12])]
    got = retrieve.fused(legs, 10).orderBy("rank").collect()
    assert got[0].claim_id == 11 and got[0].similarity == 1.0 and {r.claim_id for r in got} == {10, 11, 12}


def test_packing_equals_a_loop_and_keeps_the_budget(spark):
    rnd = random.Random(5)
    claims = [(i, "x" * rnd.randrange(20, 900), "m" * 60 if i % 2 else None, "s" * 20 if i % 3 else None, "src", None, None, i == 7) for i in range(20)]
    ranked = [(1, i, 1 - i / 50, DAY + dt.timedelta(days=rnd.randrange(100)), i + 1) for i in range(20)]
    c = spark.createDataFrame(claims, "id long, content string, summary_medium string, summary_short string, source string, entity string, attribute string, pinned boolean")
    r = spark.createDataFrame(ranked, "qid long, claim_id long, final_score double, ts timestamp, rank int")
    got = context.packed(r, spark.createDataFrame([(1, 500)], "qid long, budget_total int"), c).first()
    newest = {i for _, i, _, _, _ in sorted(ranked, key=lambda x: (-x[3].timestamp(), x[1]))[:3]}
    safe = newest | {7}
    pool = sorted(safe | set(range(10)))
    left, picked, dropped = 500, [], []
    for i in [p for p in pool if p in safe] + [p for p in pool if p not in safe]:
        for text in claims[i][1:4]:
            if text is not None and len(text) // 4 <= left:
                left -= len(text) // 4
                picked.append(i)
                break
        else:
            dropped.append(i)
    picked.sort()
    if len(picked) > 10:
        free = [p for p in picked if p != 7]
        keep = 10 - (7 in picked)
        dropped += free[keep:]
        picked = sorted(([7] if 7 in picked else []) + free[:keep])
    assert [s["claim_id"] for s in got.selected] == picked and sorted(got.dropped) == sorted(dropped) and got.budget_remaining == left >= 0


def test_extraction(spark):
    t = spark.createDataFrame([(1, 1, "User", "We use Redis 7.2 on port 6379. I'm a data engineer. We no longer use Heroku. Priya leads it. Is Kafka used?", DAY)], "conv_id long, turn_no long, role string, text string, ts timestamp")
    got = {(r.category, r.value): r for r in extract.extracted(t).collect()}
    assert got["version", "7.2"].entity == "Redis" and got["version", "7.2"].content == "Redis version is 7.2."
    assert ("port", "6379") in got and ("role", "data engineer") in got and got["retraction", "Heroku"].supersedes_hint
    assert got["person", "Priya"].claim_value == "lead"


def test_extraction_works_a_turn_out_once(spark):
    rows = [
        (1, 1, "User", "We use Redis 7.2. The API runs on redis 7.2 and port 80 in Zurich-West since 2021, says Ann.", DAY),
        (1, 2, None, "Spring Boot replaced Spring and we no longer use PostgreSQL in node.js; mail a.b@c.org", DAY),
        (1, 2, "user", "We use node.js and Kafka 3.1 now.", DAY),
        (None, 3, "user", "We use Redis and Redis on port 6379 in production.", DAY),
        (None, 3, "user", "We use redis.", DAY),
        (1, 4, "user", " ", DAY),
    ]
    t = spark.createDataFrame(rows, "conv_id long, turn_no long, role string, text string, ts timestamp")
    out = extract.extracted(t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Aggregate") == 1
    got = sorted((r.turn_no, r.category, r.value) for r in out.filter("category in ('technology', 'version', 'port', 'retraction', 'email')").collect())
    assert got == [
        (1, "port", "80"), (1, "technology", "Redis"), (1, "version", "7.2"), (2, "email", "a.b@c.org"), (2, "retraction", "PostgreSQL"), (2, "retraction", "Spring"), (2, "technology", "Kafka"),
        (2, "technology", "Node.js"), (2, "technology", "Spring Boot"), (2, "version", "3.1"), (3, "port", "6379"), (3, "technology", "Redis"),
    ]
    only = extract.extracted(t, statements=False)
    assert sorted(only.collect(), key=str) == sorted(out.filter("category <> 'statement'").collect(), key=str)


def test_every_technology_is_found_whole(spark):
    said = [x for t in extract.TECHNOLOGIES if t[-1].isalnum() for x in (t, t.upper(), f"x {t.lower()}")]
    got = spark.createDataFrame([(x,) for x in said], "text string").select("text", extract.tx.find_all(F.col("text"), extract.TECHNOLOGY, 1).alias("found")).collect()
    assert all(r.found == [r.text.removeprefix("x ")] for r in got)


def test_chunks_keep_words_and_sizes(spark):
    long = " ".join(f"Sentence number {i} is here." for i in range(40))
    one = "word " * 500
    got = extract.chunked(spark.createDataFrame([(1, long), (2, one.strip()), (3, "short.")], "id long, content string"), 20).collect()
    assert all(len(r.content) <= 80 for r in got if r.parent_id)
    assert " ".join(r.content for r in sorted((r for r in got if r.parent_id == "1"), key=lambda r: int(r.id.split("chunk")[1]))) == long
    assert [r.id for r in got if r.content == "short."] == ["3"]


def test_votes(spark):
    rows = [(1, 0, "Paris."), (1, 1, "paris"), (1, 2, "Rome"), (2, 0, "the red car"), (2, 1, "the red bus"), (2, 2, "a boat")]
    got = {r.qid: r.answer for r in evaluate.voted(spark.createDataFrame(rows, "qid long, n int, answer string")).collect()}
    assert got == {1: "Paris.", 2: "the red car"}


def test_answer_scores(spark):
    c = evaluate.scores(F.lit("the cat sat on mats"), F.lit("a cat sat"))
    r = spark.range(1).select(*(v.alias(k) for k, v in c.items())).first()
    assert r.context_recall == 1.0 and r.f1_set == pytest.approx(0.8) and r.f1_bag == pytest.approx(2 * 2 / (4 + 2)) and r.exact == 0.0


def test_order_repair(spark):
    hits = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate([5, 6, 7])], "qid long, claim_id long, rank int")
    order = spark.createDataFrame([(1, 7, 1), (1, 99, 2), (1, 7, 3)], "qid long, claim_id long, position int")
    assert [r.claim_id for r in rerank.order_repaired(hits, order).orderBy("position").collect()] == [7, 5, 6]


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        rerank.weighted(None, None, None, weights={"semantic": 0.5, "recency": 0.1, "authority": 0.1, "pin": 0.1})


def test_streamed_throttle_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(u, DAY + dt.timedelta(seconds=s)) for u in (1, 2) for s in (0, 30, 59, 60, 200)], "user_id long, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    stream = jobs.throttled_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user_id, (r.ts - DAY).seconds) for r in out) == [(u, s) for u in (1, 2) for s in (0, 60, 200)]


def test_relationships_count_what_related_lists(spark):
    claims = spark.createDataFrame([(i, 1, "ab"[i % 2] if i < 8 else None) for i in range(10)], "id long, user_id long, entity string")
    edges = spark.createDataFrame([(0, 2), (0, 1), (3, 9)], "src long, dst long")
    listed = graph.related(claims, claims, edges).groupBy("id").pivot("kind", ["similar", "entity"]).count().na.fill(0).collect()
    counts = {r.id: (r.n_similar, r.n_same) for r in graph.relationships(claims, edges).collect()}
    assert counts[0] == (2, 2) and counts[9] == (1, 0)
    assert {r.id: (r.similar, r.entity) for r in listed} == {k: n for k, n in counts.items() if any(n)}


def test_equal_vectors_keep_the_smallest_ids(spark):
    from palimpsest.operators import vectors

    rng = random.Random(11)
    ids = list(range(1, 61))
    rng.shuffle(ids)
    same = [0.3, 0.5, 0.7]
    rows = [(i, 0, same) for i in ids] + [(i, 0, [0.5, 0.3, 0.7]) for i in (90, 80, 70)]
    claims = spark.createDataFrame(rows, "id long, user_id long, embedding array<double>")
    asked = spark.createDataFrame([(5, 0, same), (100, 0, same), (101, 0, [0.5, 0.3, 0.7])], "id long, user_id long, vector array<double>")
    got = {}
    for r in vectors.nearest(asked, claims, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.claim_id)
    assert got == {5: [1, 2, 3, 4], 100: [1, 2, 3, 4], 101: [70, 80, 90, 1]}


def test_entity_counts_hold_names_and_dates_of_the_texts(spark, tmp_path):
    from palimpsest.catalog import QUERIES

    texts = ["Maria Lopez met John Smith on 2024-03-05 in the office.", "Then we met Maria Lopez at noon.", "The review of 2024-03-05 was short."]
    spark.createDataFrame([(i, t, "en", "Web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(3)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.entity: r.n_claims for r in QUERIES["a9_entity_counts"](spark, str(tmp_path)).collect()}
    want = {e: sum(e in t.lower() for t in texts) for e in ("maria lopez", "john smith", "2024-03-05")} | {"web": 3}
    assert {e: got.get(e) for e in want} == want


def test_hash_vector_by_its_rule(spark):
    import hashlib
    import struct

    from palimpsest.functions.embed import hash_vector

    texts = ["", "a text", "é😀"]
    for dim in (8, 20, 64):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hash_vector(F.col("t"), dim).alias("v")).collect()
        for r in rows:
            raw = b"".join(hashlib.sha256(f"{r.t}|{i}".encode()).digest() for i in range(8))
            want = [x / 2147483647 for x in struct.unpack(f"<{dim}i", raw[: 4 * dim])]
            size = sum(x * x for x in want) ** 0.5
            assert r.v == pytest.approx([x / size for x in want], abs=1e-6)


def test_entity_backfill(spark):
    claims = spark.createDataFrame([(1, "PRIYA SHARMA", None), (2, "the team", "x"), (3, None, None), (4, "Oslo office", None)], "id int, entity string, entity_id string")
    got = {r.id: r.entity_id for r in entities.backfilled(claims, spark.createDataFrame([("Priya Sharma",)], "entity string")).collect()}
    assert got == {1: "Priya Sharma", 2: "x", 3: None, 4: "oslo office"}


def test_containing_equals_all_pairs(spark):
    texts = ["alpha beta gamma delta", "xalpha betax", "a", "", None, "one two three four five six seven eight nine ten eleven", "café über naïve", "gamma  delta", "alpha beta gamma delta " * 50]
    needles = ["", "a", "ha be", "beta", "beta gamma delta", "pha beta gam", "two three four five six seven eight nine ten", "é ü", "nothing here", "missing words in it", "gamma  delta"]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "qid long, text string")
    got = sorted(tuple(r) for r in evaluate.containing(n, t).select("qid", "id").collect())
    assert got == sorted((q, i) for q, needle in enumerate(needles) for i, text in enumerate(texts) if text is not None and needle in text)


def test_entity_lookup_has_no_key_for_a_name(spark, monkeypatch):
    from palimpsest.operators import retrieve

    names = ["Alba", "Bern", "Cadiz", "Delft"]
    claims = spark.createDataFrame([(i, None if i % 9 else "Ghent", f"in {names[i % 2]} and {names[i % 4]} or {names[i % 3]}") for i in range(200)], "id long, entity string, content string")
    asked = spark.createDataFrame([(i, f"of {names[i % 4]}, of {names[(i + i // 4) % 4]} on Friday or in Ghent" if i % 5 else "nothing") for i in range(30)], "qid long, text string")
    index = retrieve.entity_postings(claims).persist()
    monkeypatch.setattr(retrieve, "CLAIM_BLOCK", 50)
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 20)
    found = retrieve.entity_lookup(asked, index)
    under = {}
    for r in index.collect():
        under.setdefault(r.entity, set()).add(r.id)
    named = {r.qid: r.e for r in asked.select("qid", retrieve.tx.extract_entities(F.col("text")).alias("e")).collect()}
    want = sorted((q, i) for q, es in named.items() for i in set().union(*(under.get(e, set()) for e in es)))
    assert sorted((r.qid, r.claim_id) for r in found.collect()) == want and len(want) > 1000
    assert "Aggregate [qid" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_blocks_come_in_parts():
    from palimpsest.operators import retrieve

    rng = np.random.default_rng(9)
    one, two = (rng.integers(0, 40, 300), rng.integers(0, 30, 300)), (rng.integers(0, 50, 400), rng.integers(0, 30, 400))
    want = sorted({(int(a), int(b)) for a, s in zip(*one, strict=True) for b, t in zip(*two, strict=True) if s == t})
    parts = [list(zip(left.tolist(), right.tolist(), strict=True)) for left, right in retrieve.block_pairs(one, two, 50, 500)]
    assert sorted(x for part in parts for x in part) == want and len(parts) > 3


def test_similarities_are_held_a_slice_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from palimpsest.operators import vectors

    n, rng = 2048, np.random.default_rng(3)
    points = rng.normal(size=(n, 8))
    side = lambda name, rest: pa.array([[{"id": i, name: points[i].tolist(), **rest} for i in range(n)]])
    batch = pa.RecordBatch.from_arrays([side("vector", {"at": 0}), side("embedding", {"lo": 0, "hi": 1})], names=["q", "c"])
    tracemalloc.start()
    got = [r for out in vectors.products(4, -1.0)([batch]) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all similarities of the two blocks at once are 32 MB, and several such arrays are needed
    assert len(got) == 4 * n and peak < 48 << 20
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for i in (0, 255, 256, 2047):
        order = [j for j in np.argsort(-(unit @ unit[i])) if j != i][:4]
        assert sorted(r["claim_id"] for r in got if r["qid"] == i) == sorted(order)


def test_hot_tenant_has_a_key_for_each_block(spark, monkeypatch):
    from palimpsest.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 4))
    rows = [(i, 1 if i % 6 else 2, [float(x) for x in points[i]]) for i in range(60)]
    claims = spark.createDataFrame(rows, "id long, user_id long, embedding array<double>")
    asked = claims.withColumnRenamed("embedding", "vector")
    got = {(r.qid, r["rank"]): r.claim_id for r in vectors.nearest(asked, claims, 3).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for i, tenant, _ in rows:
        others = sorted((j for j, u, _ in rows if u == tenant and j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))
        assert [got[i, k] for k in (1, 2, 3)] == others[:3]


def _lexical_tables(spark, n, seed=3):
    """Claims of two tenants with frequent and rare words, copies, an empty text; every tenth asks with its whole text."""
    import random

    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(n)]
    texts[7:12] = [texts[0]] * 5
    texts[20] = ""
    claims = spark.createDataFrame([(i, i % 2, t, rng.choice(["red", "w1"]), "x") for i, t in enumerate(texts)], "id long, user_id long, content string, entity string, value string").withColumn("attribute", F.lit("en"))
    return claims, claims.filter("id % 10 = 0").select(F.col("id").alias("qid"), "user_id", F.col("content").alias("text"))


def test_bm25_shuffles_no_pairs(spark, monkeypatch):
    """Over many blocks: the rows of a plain loop. Pairs of question and claim are made inside tasks, at most k a question and block."""
    import math
    from collections import Counter

    monkeypatch.setattr(retrieve, "CLAIM_BLOCK", 300)
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 100)
    claims, questions = _lexical_tables(spark, 240)
    held = {r.id: (r.user_id, Counter(f"{r.content} {r.entity} {r.attribute}".split())) for r in claims.collect()}
    size = {i: sum(c.values()) for i, (_, c) in held.items()}
    mean_size, df = sum(size.values()) / len(size), Counter(t for _, c in held.values() for t in c)
    raw = {t: math.log((len(held) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}
    want = {}
    for q in questions.collect():
        score = {i: sum(n * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * size[i] / mean_size)) for t, n in Counter(q.text.split()).items() if t in c) for i, (u, c) in held.items() if u == q.user_id and i != q.qid}
        best = max(score.values(), default=0)
        ranked = sorted((-round(min(1.0, s / best), 9), i) for i, s in score.items() if s > 0)
        want |= {(q.qid, i): (rank, -s) for rank, (s, i) in enumerate(ranked[:7], 1)}
    hits = retrieve.bm25(questions, claims, ["content", "entity", "attribute"], 7)
    got = {(r.qid, r.claim_id): (r["rank"], r.similarity) for r in hits.collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-9 for x in want)
    assert "MapInArrow" in hits._jdf.queryExecution().toString()


def test_all_terms_looks_under_the_rarest_term(spark):
    from collections import Counter

    claims, questions = _lexical_tables(spark, 240)
    questions = questions.unionByName(spark.createDataFrame([(1000, 0, "w1"), (1001, 1, "w1 red"), (1002, 1, "w1 nowhere")], questions.schema))
    rows, want = claims.collect(), {}
    for q in questions.collect():
        asked, found = set(q.text.split()), {}
        for r in rows:
            w = Counter()
            for field, weight in retrieve.FIELD_WEIGHTS.items():
                for t in r[field].split():
                    w[t] += weight
            if r.user_id == q.user_id and asked and asked <= w.keys():
                found[r.id] = sum(w[t] for t in asked)
        low, high = min(found.values(), default=0), max(found.values(), default=0)
        want |= {(q.qid, i): round(1.0 if high - low < 1e-12 else (s - low) / (high - low), 6) for i, s in found.items()}
    got = {(r.qid, r.claim_id): round(r.similarity, 6) for r in retrieve.all_terms(questions, claims, 1000).collect()}
    assert got == want and len({q for q, _ in got}) > 20
    pairs = retrieve.candidates(questions.filter("qid >= 1000"), retrieve.term_weights(claims))[0].count()
    assert pairs < sum(len({"w1", "red"} & set(f"{r.content} {r.entity}".split())) for r in rows)


def test_answer_scores_of_long_texts(spark):
    """Against plain counts; in time in line with the words: tokens are found once, not once for each word."""
    import random
    import time
    from collections import Counter

    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["", "the ", "Not-"]) + f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    pairs = [(some(rng.randint(0, 60)), some(rng.randint(0, 60))) for _ in range(40)] + [("", "a b"), ("", ""), (None, "x y"), (some(12000), some(12000))]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, g string")
    tokens = rows.select("i", *(t(F.col(c)).alias(f"{n}{c}") for c in "pg" for n, t in (("s", retrieve.tx.scored_tokens), ("q", retrieve.tx.squad_tokens)))).collect()
    began = time.perf_counter()
    got = {r.i: r for r in rows.select("i", *(c.alias(n) for n, c in evaluate.scores(F.col("p"), F.col("g")).items())).collect()}
    assert time.perf_counter() - began < 30
    for r in tokens:
        recall = sum(t in set(r.sp) for t in r.sg) / len(r.sg) if r.sg else 1.0
        f1 = lambda both, n, m: 1.0 if n == m == 0 else 2 * both / (n + m) if both else 0.0
        want = (recall, f1(len({*r.sp} & {*r.sg}), len({*r.sp}), len({*r.sg})), f1((Counter(r.qp) & Counter(r.qg)).total(), len(r.qp), len(r.qg)), float(r.qp == r.qg))
        assert tuple(got[r.i][n] for n in ("context_recall", "f1_set", "f1_bag", "exact")) == pytest.approx(want)


def test_bm25_holds_some_questions_at_a_time(spark, monkeypatch):
    """A block of many short questions: their sums with a block of claims are held some at a time, with the same rows."""
    claims, _ = _lexical_tables(spark, 240)
    short = claims.filter("content <> ''").select(F.col("id").alias("qid"), "user_id", F.substring_index("content", " ", 1).alias("text"))
    found = lambda: sorted((r.qid, r.claim_id, r["rank"], round(r.similarity, 8)) for r in retrieve.bm25(short, claims, ["content"], 5).collect())
    whole = found()
    cells = 1000
    monkeypatch.setattr(retrieve, "CELLS", cells)
    plain = retrieve.block_scores

    def bounded(one, two, shape, *rest):
        assert shape[0] == 1 or shape[0] * shape[1] <= cells
        return plain(one, two, shape, *rest)

    monkeypatch.setattr(retrieve, "block_scores", bounded)
    assert found() == whole and len(whole) > 500


def test_blocks_are_dealt_out_before_they_are_collected(spark):
    """No task collects parts of all blocks from the rows that it happens to read."""
    claims, questions = _lexical_tables(spark, 60)
    plan = retrieve.bm25(questions, claims, ["content"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == plan.count("partial_collect_list") == 2
