"""Conversation repair against all edits of short conversations, and a left-to-right search of long ones."""

import hashlib
import random
import re
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import conversation_repair as repair_module
from palimpsest.llm.conversation_repair import DELETE, INSERT, KEEP, REROLE, TRUNCATED, Parser, bottom_up, cheapest, combined, diagnosed, faults, leaf, op12_conversation_repair, prepared, repair

SCHEMA = "conv_id long, turn long, role string, text string, fault int, audit string, source string"
GOOD = re.compile(r"(s?(ua)+)?\Z")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def all_edits(kinds):
    """The cheapest audit by trying every edit with up to two insertions in each gap."""
    gaps = [("", "")] + [("I" * n, r) for n in (1, 2) for r in map("".join, product("ua", repeat=n))]
    choices = []
    for initial, fault in kinds:
        own = [("D", "", DELETE)]
        if fault not in "bd":
            more = TRUNCATED if fault == "t" else 0
            own += [("K", initial, KEEP + more), ("R", "u", REROLE + more), ("R", "a", REROLE + more)]
        choices.append(own)
    best = None
    for first in gaps:
        for picks in product(*(product(own, gaps) for own in choices)):
            roles = first[1] + "".join(o[1] + g[1] for o, g in picks)
            if GOOD.match(roles):
                found = (len(first[0]) * INSERT + sum(o[2] + INSERT * len(g[0]) for o, g in picks), first[0] + "".join(o[0] + g[0] for o, g in picks))
                best = found if best is None else min(best, found)
    return best


def left_to_right(kinds):
    """The same by the least (cost, audit) of each state, turn by turn."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    reached = {"": (0, "")}

    def better(into, state, found):
        if state not in into or found < into[state]:
            into[state] = found

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                for r in "ua":
                    if (state, r) in steps:
                        better(states, steps[state, r], (cost + INSERT, audit + "I"))
        return states

    for initial, fault in kinds:
        new = {}
        for state, (cost, audit) in inserted(reached).items():
            better(new, state, (cost + DELETE, audit + "D"))
            if fault not in "bd":
                more = TRUNCATED if fault == "t" else 0
                for r, edit, price in [(initial, "K", KEEP), ("u", "R", REROLE), ("a", "R", REROLE)]:
                    if (state, r) in steps:
                        better(new, steps[state, r], (cost + price + more, audit + edit))
        reached = new
    inserted(reached)
    return min(reached[s] for s in ("", "a") if s in reached)


def plain(rows, hurt=True):
    """The contract over lists: conv_id -> the result row."""
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        case = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        kept.extend([(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1))
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        counts, kinds, seen = {"b": 0, "d": 0, "t": 0, "-": 0}, [], set()
        for _, role, text in turns:
            shown = text.strip(SPACE)
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-"
            seen.add((role, text))
            counts[fault] += 1
            kinds.append((role[:1] or "-", fault))
        numbers = [t[0] for t in turns if t[0] is not None]
        cost, audit = left_to_right(kinds)
        if len(kinds) <= 2:
            assert (cost, audit) == all_edits(kinds)
        total = len(audit) - audit.count("D")
        repaired, left = [], iter(turns)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit != "D":
                repaired.append(((("user", "assistant")[(len(repaired) + total % 2) % 2]) if edit in "RI" else role) + ":" + text)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def query(spark, rows, folder):
    spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    out = op12_conversation_repair(spark, str(folder)).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in out}


def some_rows(rng, convs, most):
    texts = ["Yes.", "No!", "Why?", "cut off", "cut. off  \n", "", " \t", None, "done.\x0b", "ü. é", "Thanks.", "x" * 300 + "."]
    return [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ä"]), rng.choice(texts)) for c in convs for t in range(rng.randint(1, most)) if rng.random() < 0.95]


def test_cells_are_all_edits():
    parser = Parser()
    kinds = [i + f for i in "sua-" for f in "-tbd"]
    for n in (0, 1, 2):
        for row in product(kinds, repeat=n):
            assert (cheapest(parser.cell("".join(row))) if n else (0, "")) == all_edits(row)
    rng = random.Random(2)
    for _ in range(60):
        row = [rng.choice(kinds) for _ in range(3)]
        assert cheapest(parser.cell("".join(row))) == all_edits(row) == left_to_right(row)


def test_every_split_gives_the_same_cell():
    rng, parser = random.Random(4), Parser()
    for _ in range(40):
        row = [rng.choice("sua-") + rng.choice("--tbdx") for _ in range(rng.randint(2, 24))]
        whole = parser.cell("".join(row))
        for at in range(1, len(row)):
            assert combined(parser.cell("".join(row[:at])), parser.cell("".join(row[at:]))) == whole
        assert cheapest(whole) == left_to_right([k for k in row if k[1] != "x"])
    assert leaf("ux") == {(x, x): (0, "") for x in range(4)}


def test_remembered_spans_are_bounded(monkeypatch):
    monkeypatch.setattr(repair_module, "REMEMBERED", 20)
    rng, parser = random.Random(5), Parser()
    for _ in range(50):
        row = [rng.choice("sua-") + rng.choice("--tbd") for _ in range(12)]
        assert cheapest(parser.cell("".join(row))) == left_to_right(row)
        assert len(parser.known) < 60


def test_bottom_up_keeps_order():
    one = {"low": 1, "high": 1, "turns": 1, "first": "u", "last": "u", "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "cells": leaf("u-")}
    parts = [{**one, "low": i // 2, "high": i // 2, "first": "ua"[i % 2], "last": "ua"[i % 2], "cells": leaf("ua"[i % 2] + "-")} for i in range(7)]
    whole = bottom_up(parts)
    assert (whole["low"], whole["high"], whole["turns"], whole["illegal"]) == (0, 3, 4, 0) and cheapest(whole["cells"]) == (2, "KKKKKKKI")


def test_query_against_plain_loops(spark, tmp_path):
    rng = random.Random(6)
    rows = some_rows(rng, [*range(-5, 120), 10**15, None], 9)
    rows += [(7, None, "user", "Unnumbered."), (7, None, "user", "Unnumbered."), (7, 2, "user", "Unnumbered."), (7, 2, "tool", "Tied."), (7, 2, "assistant", "Tied.")]
    rows += rng.sample(rows, 30)
    assert query(spark, rows, tmp_path) == plain(rows)


def test_conversation_without_rows_left(spark, tmp_path):
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert query(spark, [(gone, 0, "user", "Hi.")], tmp_path) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_long_conversation_over_many_spans(spark):
    """Spans of five turns, three cells at a time, several tasks: as one pass over the whole conversation."""
    rng = random.Random(8)
    rows = [(1, t // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", f"{t}.", f"{t}!", ""])) for t in range(700)] + some_rows(rng, range(2, 9), 6)
    turns = prepared(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA))
    marked = faults(turns).cache()
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS[:-1]) for r in diagnosed(marked, span=5, fan=3).collect()}
    assert got == {c: r[:-1] for c, r in plain(rows, hurt=False).items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi"), (2, 0, "user", "One."), (2, 1, "user", "Two."), (2, 2, "assistant", "Three.")]
    out = repair(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)).orderBy("conv_id", "place").collect()
    by_conv = {c: [(r["edit"], r["role"], r["text"]) for r in out if r["conv_id"] == c] for c in (1, 2)}
    want = plain(rows, hurt=False)
    for c, turns in by_conv.items():
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode()).hexdigest() == want[c][-1]
        assert GOOD.match("".join(r[0] for _, r, _ in turns)) and [r["place"] for r in out if r["conv_id"] == c] == list(range(len(turns)))


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == {}
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_given_tables(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = op12_conversation_repair(spark, folder)
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"] * 2 and out.columns == ["conv_id", *FIELDS]
    assert {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in out.select(F.col("*")).collect()} == plain(rows)
