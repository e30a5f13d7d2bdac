"""Byte-level BPE encoding and decoding with numpy matrices.

A text is split by the pattern of the vocabulary, and each match is merged for itself. The distinct matches
that a task has not met yet become rows of matrices, one for each bucket of lengths, padded to the bucket's
width; a cell is the rank of a token. In each round every row merges its leftmost pair of minimum rank:
pairs are looked up in a hash table of integers, and as each row loses exactly one cell, the matrix is
compacted by one column. Rows without a pair left leave the matrix. A match that is a token as a whole is
that token. Matches of more than ``WIDEST`` bytes, for which a matrix would cost the square of their
length, are merged in the same order with a heap of pairs.

What a task keeps of the matches it has met is bounded by ``KNOWN_BYTES`` and then forgotten; long texts
are read in blocks of matches. Ids are stored as little-endian unsigned 32-bit integers in one binary.

Defined results: null texts count as empty and have no ids; texts of any length are encoded whole; equal
texts have equal ids, repeated rows each their own row; an empty table gives no rows. Extra columns are
carried, but a table that has a column of the result already is refused. A vocabulary without one of the
256 bytes is refused, and so is an id outside the vocabulary when decoding.
"""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, table, with_columns

WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
WIDEST = WIDTHS[-1]
ROWS = 1 << 15  # rows of one matrix
KNOWN_BYTES = 32 << 20
BLOCK = 1 << 16  # matches of a long text at once
LONG_TEXT = 1 << 20
NONE = np.int32((1 << 31) - 1)  # no token, or no pair


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """token -> rank of a file of base64 tokens and ranks."""
    return {b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Hash table of (left rank, right rank) -> rank of both together, by open addressing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(left)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        key, value = left.astype(np.int64) << 32 | right, merged.astype(np.int32)
        slot, self.probes = self._home(key), 0
        while len(key):  # of the keys that want a free slot one gets it, the others try the next
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.values[slot[free]] = key[free], value[free]
            left_over = self.keys[slot] != key
            key, value, slot = key[left_over], value[left_over], (slot[left_over] + 1) & (size - 1)
        won = self.keys != -1  # a slot's last writer holds both arrays; equal keys were written once
        assert int(won.sum()) == len(left)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no token."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        ask = np.flatnonzero((left != NONE) & (right != NONE))
        key = left[ask].astype(np.int64) << 32 | right[ask]
        slot = self._home(key)
        for _ in range(self.probes):
            if not len(ask):
                break
            held = self.keys[slot]
            hit = held == key
            out[ask[hit]] = self.values[slot[hit]]
            on = ~hit & (held != -1)
            ask, key, slot = ask[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Vocabulary:
    """Ranks as tables: tokens by rank for decoding, pairs of ranks for merging."""

    def __init__(self, ranks: dict[bytes, int]):
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking or len(set(ranks.values())) != len(ranks) or min(ranks.values(), default=0) < 0 or max(ranks.values(), default=0) >= NONE:
            raise ValueError(f"no byte-level vocabulary: {len(lacking)} bytes have no rank, or ranks are repeated or out of range")
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array(pairs, np.int64).reshape(-1, 3).T))
        size = max(ranks.values()) + 1
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        buckets = np.searchsorted(WIDTHS, lengths)
        for b in np.unique(buckets).tolist():
            rows = np.flatnonzero(buckets == b)
            if b == len(WIDTHS):
                for r in rows.tolist():
                    out[r] = self._long(pieces[r])
                continue
            for at in range(0, len(rows), ROWS):
                part = rows[at : at + ROWS]
                self._matrix([pieces[r] for r in part], lengths[part], WIDTHS[b], part, out)
        return out

    def _matrix(self, pieces: list[bytes], lengths: np.ndarray, width: int, rows: np.ndarray, out: list[bytes]) -> None:
        filled = np.arange(width) < lengths[:, None]
        cells = np.full((len(pieces), width), NONE, np.int32)
        cells[filled] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        pairs = self.pairs.get(cells[:, :-1], cells[:, 1:])
        while True:
            at = pairs.argmin(axis=1) if pairs.shape[1] else np.zeros(len(cells), np.int64)
            best = pairs[np.arange(len(cells)), at] if pairs.shape[1] else np.full(len(cells), NONE)
            done = best == NONE
            if done.any():
                ends = cells[done]
                held = ends != NONE
                flat, stops = ends[held].astype("<u4"), np.cumsum(held.sum(axis=1))
                for r, a, b in zip(rows[done].tolist(), np.concatenate(([0], stops[:-1])).tolist(), stops.tolist(), strict=True):
                    out[r] = flat[a:b].tobytes()
                go = ~done
                cells, pairs, rows, at, best = cells[go], pairs[go], rows[go], at[go], best[go]
            if not len(cells):
                return
            n, width = cells.shape
            row = np.arange(n)
            cells[row, at] = best
            keep = np.ones((n, width), bool)
            keep[row, at + 1] = False
            cells = cells[keep].reshape(n, width - 1)
            pairs = pairs[keep[:, 1:]].reshape(n, width - 2)
            # only the pairs beside the new token are looked up again
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            pairs[left, at[left] - 1] = self.pairs.get(cells[left, at[left] - 1], cells[left, at[left]])
            pairs[right, at[right]] = self.pairs.get(cells[right, at[right]], cells[right, at[right] + 1])

    def _long(self, piece: bytes) -> bytes:
        """The same merges of one long piece, in time n log n: a heap of (rank, place), stale entries skipped."""
        cells = self.bytes[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(cells[:-1], cells[1:])
        n, ids, rank = len(cells), cells.tolist(), [*first.tolist(), int(NONE)]
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapify(heap)
        tokens, data, starts = self.ranks, self.data, self.starts

        def look(i: int) -> None:
            j = after[i]
            found = NONE
            if j < n:
                both = data[starts[ids[i]] : starts[ids[i] + 1]].tobytes() + data[starts[ids[j]] : starts[ids[j] + 1]].tobytes()
                found = tokens.get(both, NONE)
            rank[i] = int(found)
            if found != NONE:
                heappush(heap, (rank[i], i))

        while heap:
            r, i = heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], rank[j] = r, -1  # j is gone
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, joined."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(at) and (at.max() >= len(self.known) or not self.known[at].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for k in range(0, len(at), BLOCK):
            a, b = self.starts[at[k : k + BLOCK]], self.starts[at[k : k + BLOCK] + 1]
            ends = np.cumsum(b - a)
            out.append(self.data[np.arange(ends[-1]) + np.repeat(a - (ends - (b - a)), b - a)].tobytes())
        return b"".join(out)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, once a worker process."""
    with open(path, "rb") as f:
        return Vocabulary(read_ranks(f))


class Encoder:
    """text -> ids; keeps the ids of matches it has met, up to KNOWN_BYTES."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.room = KNOWN_BYTES

    def learn(self, matches: Iterable[str]) -> None:
        """Merges the matches that are not known yet, all at once."""
        if self.room < 0:
            self.known, self.room = {}, KNOWN_BYTES
        ranks, known, new = self.vocabulary.ranks, self.known, []
        for m in dict.fromkeys(matches):
            if m not in known:
                b = m.encode()
                self.room -= 200 + 4 * len(b)
                whole = ranks.get(b)
                if whole is None:
                    new.append((m, b))
                else:
                    known[m] = whole.to_bytes(4, "little")
        if new:
            known.update(zip((m for m, _ in new), self.vocabulary.merged([b for _, b in new]), strict=True))

    def blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; short texts learn their matches together."""
        out: list[bytes] = []
        short = [self.pattern.findall(t) if len(t) <= LONG_TEXT else None for t in texts]
        self.learn(m for matches in short if matches for m in matches)
        known = self.known
        for text, matches in zip(texts, short, strict=True):
            if matches is not None:
                out.append(b"".join(map(known.__getitem__, matches)))
                continue
            parts = []
            for block in self.blocks(text):
                self.learn(block)
                parts.append(b"".join(map(self.known.__getitem__, block)))
            out.append(b"".join(parts))
            self.learn(m for later in short[len(out) :] if later for m in later)  # long texts may have cleared them
            known = self.known
        return out


def encoded(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with ``ids``, the text's tokens as little-endian unsigned 32-bit integers, and ``n_tokens``."""
    path, split = ranks or default_ranks(), pattern or default_pattern()

    def make():
        encode = Encoder(vocabulary(path), split)

        def work(column: pa.Array):
            ids = encode(column.fill_null("").to_pylist())
            return ids, [len(i) // 4 for i in ids]

        return work

    return with_columns(docs, [text], T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]), make)


def decoded(rows: DataFrame, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """rows with ``decoded``, the bytes of the tokens that the binary column ``ids`` lists; null ids decode to no bytes."""
    path = ranks or default_ranks()

    def make():
        own = vocabulary(path)
        return lambda column: [[own.decode(i or b"") for i in column.to_pylist()]]

    return with_columns(rows, [ids], T.StructType([T.StructField("decoded", T.BinaryType())]), make)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
