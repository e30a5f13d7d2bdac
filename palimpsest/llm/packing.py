"""Best-fit packing by exact-complement hashing.

Each document becomes its token ids and an end id; longer ones than a sequence are cut so that only the
first piece is shorter. What is planned is not the pieces but their histogram by length, at most
``SEQUENCE`` numbers however many documents there are: for each length, from the longest, the gap to a
full sequence is looked up among single lengths, sums of two and sums of three that are still
available, and as many sequences as the counts allow are filled exactly; what is left goes to the best
fitting gap. The plan says, for each length, which run of its pieces goes to which run of sequences, so
every piece finds its place from its number within its length.

Pieces are numbered within their length without sorting or gathering them: each task counts as it
writes, and the tasks' counts are summed to offsets, so a length that a third of all pieces share
costs no task more than another.

Defined results: null and empty texts are the end id alone; a special token's string in a text is that
token, as the tokenizers library has it; repeated rows are packed each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import small, table, written

SEQUENCE = 1024
END_ID = 2
LONG_RUN = 4096  # characters of white space
PROBES = ("Don't  stop, 12345 é\n\t x_y", "  a\r\n\r\n b\u00a0\u3000c ", "naïve façade 日本語 \U0001f600 ½ don’t we'll I'D", "\n\n\n   x", "")
PIECES = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library(path: str):
    """text -> ids by the tokenizers library."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def merge_ranks(path: str):
    """(text -> ids by tiktoken, special tokens) of a byte-level BPE file; KeyError or ValueError where its ids aren't merge ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(visible)))}
    special = sorted(t["content"] for t in file["added_tokens"])
    ranks = {bytes(shown[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, special


def same_ids(path: str) -> bool:
    """Whether tiktoken gives the library's ids on PROBES; asked once, on the driver."""
    try:
        fast, _ = merge_ranks(path)
    except (KeyError, ValueError):
        return False
    own = library(path)
    return all(fast(probe) == own(probe) for probe in PROBES)


def encoder(path: str, fast: bool | None = None):
    """text -> ids of a byte-level BPE file: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    Where ``fast`` (by default: where the probes agree), tiktoken runs the same vocabulary, several times
    faster. Texts with the string of a special token, which has an id of its own, or with a run of white
    space that tiktoken's pattern would follow too deep still go to the library, which is loaded for the first of them.
    """
    if not (same_ids(path) if fast is None else fast):
        return library(path)
    quick, special = merge_ranks(path)
    runs = re.compile(r"\s{64,}")
    own = None

    def encode(text: str) -> list[int]:
        nonlocal own
        if any(t in text for t in special) or any(m.end() - m.start() >= LONG_RUN for m in runs.finditer(text)):
            own = own or library(path)
            return own(text)
        return quick(text)

    return encode


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with their number among the task's pieces of that length."""
    fast = same_ids(tokenizer)

    def run(batches):
        encode, task, seen = encoder(tokenizer, fast), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in small(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*(encode(text) if text else ()), END_ID], "<u4")
                    at, to = 0, (len(ids) - 1) % sequence + 1
                    piece = 0
                    while at < len(ids):
                        n = seen[to - at] = seen.get(to - at, -1) + 1
                        rows.append((task, n, doc, piece, at, to - at, crc32(ids[at:to].tobytes())))
                        at, to, piece = to, to + sequence, piece + 1
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def exact_patterns(left: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that fill a sequence exactly, how often), taken out of the counts ``left``."""
    out = []

    def take(lengths: tuple[int, ...]) -> None:
        need = {n: lengths.count(n) for n in lengths}
        times = int(min(left[n] // k for n, k in need.items()))
        if times > 0:
            for n, k in need.items():
                left[n] -= k * times
            out.append((lengths, times))

    for a in range(sequence, 0, -1):
        gap = sequence - a
        if left[a] and not gap:
            take((a,))
        if left[a] and gap and left[gap]:
            take((a, gap))
        for size in (2, 3):
            # the largest other lengths first: short ones stay for later gaps
            for b in range(min(a, gap - size + 1), (gap + size - 1) // size - 1, -1) if left[a] and gap >= size else ():
                if not left[b]:
                    continue
                rest = gap - b
                if size == 2:
                    if rest <= b and left[rest]:
                        take((a, b, rest))
                else:
                    c = np.arange(min(b, rest - 1), (rest + 1) // 2 - 1, -1)
                    for x in c[(left[c] > 0) & (left[rest - c] > 0)].tolist():
                        take((a, b, x, rest - x))
                        if not left[a] or not left[b]:
                            break
                if not left[a]:
                    break
    return out


def best_fit(left: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) of what is left: each length, from the longest, goes to the smallest gap that holds it."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap
    for a in range(sequence, 0, -1):
        n = int(left[a])
        while n:
            gap = next((g for g in range(a, sequence) if bins.get(g)), None)
            if gap is None:
                k = min(sequence // a, n)
                bins.setdefault(sequence - k * a, []).append(((a,) * k, n // k))
                n -= n // k * k
            else:
                held, times = bins[gap].pop()
                used = min(times, n)
                if used < times:
                    bins[gap].append((held, times - used))
                bins.setdefault(gap - a, []).append(((*held, a), used))
                n -= used
        left[a] = 0
    return [b for gap in sorted(bins) for b in bins[gap]]


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: where runs of its pieces begin, the first sequence of each run, and the place in those sequences."""
    left = np.zeros(sequence + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, times in [*exact_patterns(left, sequence), *best_fit(left, sequence)]:
        at = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), first, at))
            used[n] = used.get(n, 0) + times
            at += n
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of every document."""
    cut = written(pieces(docs, tokenizer or default_tokenizer(), sequence), "pieces")
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``sequence`` rows
    layout = plan(counts, sequence)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cut.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))

    def place(batches):
        for batch in batches:
            lengths, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence_id, offset = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                begin, first, at = layout[n]
                run = np.searchsorted(begin, number[rows], "right") - 1
                sequence_id[rows], offset[rows] = first[run] + number[rows] - begin[run], at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence_id), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, T.StructType([*numbered.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
