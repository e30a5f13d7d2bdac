"""Conversation structure repair: weighted CYK interval parsing with a Chomsky-normal-form grammar.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Its turns may be kept (cost 0, K), given
the role user or assistant (2, R), deleted (3, D), and empty turns of user or assistant may be inserted anywhere
(2, I); a truncated turn that isn't deleted adds 1, a blank or duplicate one must be deleted. Of all cheapest
edits the one whose initials are least in ASCII order is taken.

Grammar: a nonterminal ``XY`` spans what leads from state X to state Y of the role pattern; its rules are
``XZ -> XY YZ``, a turn with its insertion closure (up to two inserted turns on either side: more come back to the
same state), and nothing. The cell of a span holds, for each nonterminal, the minimum (cost, audit). Cells of two
neighbouring spans combine to the cell of both, bottom-up by span length. As the language is regular, every way
to halve a span gives the same cell, so a span is halved once, not at each place: time is linear in the turns.
(Audits of one nonterminal, span and cost are never prefixes of each other, since insertions cost; so the least of
two stays the least whatever follows.)

Scale: turns are sorted by conversation and turn in range partitions, so one conversation may spread over many
tasks; each task parses spans of up to ``SPAN`` turns, and the cells of conversations with several spans are
combined ``FAN`` at a time, level by level. Only the repaired rows themselves are then read per conversation, in
order and one batch at a time.

Defined results: null role and text are one space; a role without an initial of the pattern (an empty one too) is never kept; turns are ordered by number, nulls first, then by role and
text; conversations with a null id are one conversation; repeated rows are duplicates; texts of any length are
taken whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPAN = 4096  # turns that one task parses to one cell
FAN = 32  # cells combined to one in a task
HALF = 8  # spans up to so many turns are remembered by their kinds
REMEMBERED = 1 << 16
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, after s, after u, after a
STEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (NOTHING, ASSISTANT)
ORDER = ["conv_id", "turn", "role", "text"]
GAP, BLANK, DUPLICATE, CUT = "xbdt"  # faults of a turn: no row (only marks its conversation), blank, duplicate, truncated

Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans together."""
    out: Cell = {}
    for (x, y), (cost, audit) in left.items():
        for z in range(4):
            if more := right.get((y, z)):
                found = (cost + more[0], audit + more[1])
                if (x, z) not in out or found < out[x, z]:
                    out[x, z] = found
    return out


def _closure() -> Cell:
    """Inserting nothing, one turn or two."""
    once: Cell = {(x, y): (INSERT, "I") for role in "ua" for x, y in STEPS[role].items()}
    none: Cell = {(x, x): (0, "") for x in range(4)}
    return {k: min(c[k] for c in (none, once, combined(once, once)) if k in c) for k in {**none, **once, **combined(once, once)}}


CLOSURE = _closure()
EMPTY: Cell = {(x, x): (0, "") for x in range(4)}


def leaf(kind: str) -> Cell:
    """The cell of one turn: kind is its role's initial ('-' for any other than s, u, a) and its fault ('-' for none)."""
    initial, fault = kind
    if fault == GAP:
        return EMPTY
    edits: Cell = {(x, x): (DELETE, "D") for x in range(4)}
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for role in "sua":
            for step in STEPS[role].items():
                for found in ([(KEEP + extra, "K")] if role == initial else []) + ([(REROLE + extra, "R")] if role != "s" else []):
                    edits[step] = min(edits.get(step, found), found)
    return combined(combined(CLOSURE, edits), CLOSURE)


class Parser:
    """Cells of spans; short spans are remembered by the kinds of their turns."""

    def __init__(self):
        self.known: dict[str, Cell] = {}

    def cell(self, kinds: str) -> Cell:
        """The cell of a span, two characters of ``kinds`` for each turn."""
        if kinds in self.known:
            return self.known[kinds]
        n = len(kinds) // 2
        if n == 1:
            found = leaf(kinds)
        else:
            half = 2 * (1 << (n - 1).bit_length() - 1)
            found = combined(self.cell(kinds[:half]), self.cell(kinds[half:]))
        if n <= HALF:
            if len(self.known) > REMEMBERED:
                self.known = {}
            self.known[kinds] = found
        return found


def cheapest(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) that leads from nothing to a well-formed end."""
    return min(cell[NOTHING, y] for y in FINAL if (NOTHING, y) in cell)


# A span's summary: what two neighbouring spans of one conversation need to become one.
SUMMARY = ["low", "high", "turns", "first", "last", "illegal", "blank", "duplicate", "truncated", "cells"]
_CELLS = "array<struct<x:int,y:int,cost:bigint,audit:string>>"
SPANS = f"conv_id long, task int, within long, low long, high long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, cells {_CELLS}"
LEGAL = ("su", "ua", "au")


def joined(one: dict, two: dict) -> dict:
    """The summary of two neighbouring spans; ``turns`` counts distinct numbers, which are in order, so only neighbours can be equal."""
    out = {f: one[f] + two[f] for f in ("turns", "illegal", "blank", "duplicate", "truncated")}
    if one["high"] is not None and one["high"] == two["low"]:
        out["turns"] -= 1
    if one["last"] is not None and two["first"] is not None and one["last"] + two["first"] not in LEGAL:
        out["illegal"] += 1
    out["low"] = two["low"] if one["low"] is None else one["low"]
    out["high"] = one["high"] if two["high"] is None else two["high"]
    out["first"] = two["first"] if one["first"] is None else one["first"]
    out["last"] = one["last"] if two["last"] is None else two["last"]
    out["cells"] = combined(one["cells"], two["cells"])
    return out


def bottom_up(summaries: list[dict]) -> dict:
    """Neighbouring spans are joined in pairs until one is left."""
    while len(summaries) > 1:
        pairs = [joined(a, b) for a, b in zip(summaries[::2], summaries[1::2], strict=False)]
        summaries = pairs + summaries[2 * len(pairs) :]
    return summaries[0]


def _packed(cell: Cell) -> list[dict]:
    return [{"x": x, "y": y, "cost": c, "audit": a} for (x, y), (c, a) in sorted(cell.items())]


def _unpacked(cells: list[dict]) -> Cell:
    return {(c["x"], c["y"]): (c["cost"], c["audit"]) for c in cells}


def faults(turns: DataFrame) -> DataFrame:
    """Of turns (conv_id, turn, role, text, gone), no nulls in role and text: each with its ``fault`` and ``initial``.

    A turn is a duplicate if its role and text were seen earlier in its conversation. The first place of each is an
    aggregate, combined before the shuffle, and joined to the turns. Of equal rows of one number the first one is found
    when they stand in order.
    """
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keyed = turns.withColumn("key", F.unhex(key))
    # only what is there twice needs its first place; gone rows are not seen
    again = keyed.filter(~F.col("gone")).groupBy("conv_id", "key").agg(F.count("*").alias("copies"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered")).filter("copies > 1")
    again = again.select(F.col("conv_id").alias("own_id"), F.col("key").alias("own_key"), "least", "unnumbered")
    found = keyed.join(again, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    # nulls come first: a numbered turn is late if there is an unnumbered one, or a smaller number
    late = F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("least"))), F.lit(False))
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(F.col("gone"), GAP).when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(late, DUPLICATE).when(~ends.isin(".", "!", "?"), CUT).otherwise("-")
    initial = F.substring("role", 1, 1)
    return found.select("conv_id", "turn", "role", "text", fault.alias("fault"), initial.alias("initial"))


def spans(marked: DataFrame, span: int = SPAN) -> DataFrame:
    """Summaries of spans of at most ``span`` turns of one conversation, each with the place of its first turn."""
    ordered = marked.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ORDER)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ORDER))

    def run(batches):
        parser = Parser()
        task, count = TaskContext.get().partitionId(), 0  # tasks follow each other in the order of turns
        at = kinds = None  # the first row of the open span; kinds of its turns
        state: dict = {}
        before = None  # the row before, to tell equal rows
        done: list[dict] = []

        def close():
            nonlocal count
            count += 1
            return {"conv_id": at[0], "task": task, "within": count, **state, "cells": _packed(parser.cell("".join(kinds)))}

        for batch in batches:
            for part in small(batch, "text"):
                for row in zip(*(part.column(c).to_pylist() for c in (*ORDER, "fault", "initial")), strict=True):
                    conv, turn, role, _, fault, initial = row
                    if at is None or conv != at[0] or len(kinds) >= span:
                        if at is not None:
                            done.append(close())
                        at, kinds = row[:4], []
                        state = {"low": None, "high": None, "turns": 0, "first": None, "last": None, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0}
                    if fault != GAP:
                        if before is not None and before[:4] == row[:4] and fault != BLANK:
                            fault = DUPLICATE  # equal rows are in one partition, side by side
                        before = row
                        state["blank"] += fault == BLANK
                        state["duplicate"] += fault == DUPLICATE
                        state["truncated"] += fault == CUT
                        if turn is not None:
                            state["low"] = turn if state["low"] is None else state["low"]
                            state["turns"] += turn != state["high"]
                            state["high"] = turn
                        if state["last"] is not None and state["last"] + initial not in LEGAL:
                            state["illegal"] += 1
                        state["first"] = initial if state["first"] is None else state["first"]
                        state["last"] = initial
                    kinds.append((initial if initial in STEPS else "-") + fault)
                if len(done) >= 1024:
                    yield _batch(done, SPANS)
                    done = []
        if at is not None:
            done.append(close())
        if done:
            yield _batch(done, SPANS)

    return ordered.mapInArrow(run, SPANS)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), _CELLS: pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))}


@lru_cache
def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _arrow(schema))


def parsed(found: DataFrame, fan: int = FAN) -> DataFrame:
    """One summary for each conversation: spans are numbered and combined ``fan`` at a time until each conversation has one.

    The spans of a conversation are its turns / SPAN, and each level divides them by ``fan``.
    """
    schema = SPANS.replace("task int, within long, ", "")
    by_place = Window.partitionBy("conv_id").orderBy("task", "within")
    found = found.withColumns({"nth": (F.row_number().over(by_place) - 1).cast("long"), "spans": F.count("*").over(Window.partitionBy("conv_id"))})
    found = written(found.drop("task", "within"), "spans")
    whole, numbered = found.filter("spans = 1").drop("nth", "spans"), found.filter("spans > 1").drop("spans")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one group of at most fan cells at a time
                row = batch.slice(i, 1).to_pylist()[0]
                parts = sorted(row["parts"], key=lambda p: p["nth"])
                whole = bottom_up([{**p, "cells": _unpacked(p["cells"])} for p in parts])
                yield _batch([{"conv_id": row["conv_id"], "nth": row["group"], **{f: whole[f] for f in SUMMARY}, "cells": _packed(whole["cells"])}], f"{schema}, nth long")

    def largest(level: DataFrame) -> int:
        return level.agg(F.max("nth")).first()[0] or 0

    while largest(numbered):
        groups = numbered.groupBy("conv_id", F.floor(F.col("nth") / fan).alias("group")).agg(F.collect_list(F.struct("nth", *SUMMARY)).alias("parts"))
        numbered = written(groups.mapInArrow(run, f"{schema}, nth long"), "spans")
    return whole.unionByName(numbered.drop("nth"))


CONVERSATION = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def diagnosed(marked: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """Of each conversation its gaps, counts of faults and of illegal neighbours, and its cheapest edits."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, audit = cheapest(_unpacked(row["cells"]))
                gaps = 0 if row["low"] is None else row["high"] - row["low"] + 1 - row["turns"]
                out.append({"conv_id": row["conv_id"], "gaps": gaps, **{f: row[f] for f in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit})
            yield _batch(out, CONVERSATION)

    return parsed(spans(marked, span), fan).mapInArrow(run, CONVERSATION)


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (conv_id, place, edit, turn, role, text) from turns in order, each conversation's audit before them.

    A conversation without a repaired turn gives one tuple without place. Only the audit and one batch are held.
    """
    conv, audit, at, place, odd = None, "", 0, 0, False

    def inserted() -> Iterator[tuple]:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield conv, place, "I", None, ("user", "assistant")[(place + odd) % 2], ""
            at, place = at + 1, place + 1

    opened = False
    for batch in batches:
        for part in small(batch, "text"):
            out: list[tuple] = []
            for c, own, turn, role, text, fault in zip(*(part.column(f).to_pylist() for f in ("conv_id", "audit", "turn", "role", "text", "fault")), strict=True):
                if own is not None:
                    if opened:
                        out.extend(inserted())
                    conv, audit, at, place, opened = c, own, 0, 0, True
                    odd = (len(audit) - audit.count("D")) % 2 == 1
                    out.append((conv, None, None, None, None, None))
                    continue
                if fault == GAP:
                    continue
                out.extend(inserted())
                edit, at = audit[at], at + 1
                if edit != "D":
                    out.append((conv, place, edit, turn, ("user", "assistant")[(place + odd) % 2] if edit == "R" else role, text))
                    place += 1
            yield out
    if opened:
        yield list(inserted())


def _in_order(marked: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """Turns by conversation in order, the conversation's audit before them."""
    heads = diagnosis.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"))
    rows = marked.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "fault")
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), *(F.col(c).asc_nulls_first() for c in ORDER[1:])]
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)


def repaired(marked: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: place from 0, edit (K, R or I), turn (null if inserted), role, text."""

    def run(batches):
        for rows in _edited(batches):
            yield _batch([dict(zip(("conv_id", "place", "edit", "turn", "role", "text"), r, strict=True)) for r in rows if r[1] is not None], REPAIRED)

    return _in_order(marked, diagnosis).mapInArrow(run, REPAIRED)


def digests(marked: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the ``role:text`` of repaired turns, joined by newlines; the hash is fed turn by turn."""
    schema = "conv_id long, repaired_sha256 string"

    def run(batches):
        conv, sha, opened = None, None, False
        for rows in _edited(batches):
            done = []
            for c, place, _, _, role, text in rows:
                if place is None:
                    if opened:
                        done.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                    conv, sha, opened = c, hashlib.sha256(), True
                else:
                    sha.update((("\n" if place else "") + role + ":" + text).encode())
            if done:
                yield _batch(done, schema)
        if opened:
            yield _batch([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], schema)

    return _in_order(marked, diagnosis).mapInArrow(run, schema)


def prepared(conversations: DataFrame) -> DataFrame:
    """Turns as the parser takes them: null role and text are one space, nothing gone."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns of conversations (conv_id, turn, role, text)."""
    marked = written(faults(prepared(conversations)), "turns")
    return repaired(marked, written(diagnosed(marked), "conversations"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with every twentieth dropped, emptied, cut, repeated or given to the user, by a checksum of id and number."""
    turns = prepared(conversations)
    shown = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(shown.cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (case == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = written(faults(damaged(table(spark, sf_dir, "conversations"))), "turns")
    diagnosis = written(diagnosed(marked), "conversations")
    named = digests(marked, diagnosis).withColumnRenamed("conv_id", "own_id")
    return diagnosis.join(named, F.col("conv_id").eqNullSafe(F.col("own_id"))).drop("own_id")
