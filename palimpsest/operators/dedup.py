"""Near-duplicate claims: character 3-gram MinHash bands, exact Jaccard, connected components, longest kept."""

from __future__ import annotations

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written
from .components import components

HASHES, BAND, THRESHOLD, WIDTH = 64, 4, 0.7, 3
#: Texts of a block that are compared at once, texts and shingles of a block.
PART, BLOCK, BLOCK_GRAMS = 128, 8192, 1 << 22
#: Pairs whose shingles are counted at once; they are counted by products from one pair in so many cells on.
EXACT, DENSE = 1024, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(3).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, component, keep) of rows (id, content): pairs of a band with Jaccard of at least ``threshold`` are linked; a component's longest text is kept, of equal ones the smallest id.

    Equal texts are collapsed first. The others go to blocks by number of shingles, and pairs of blocks of like sizes are compared in tasks
    (``block_links``). A text's shingles are stored packed, and moved three times however many bands and pairs it is in: neither is shuffled.
    """
    hashed = rows.select("id", F.coalesce("content", F.lit("")).alias("content")).select("id", "content", F.xxhash64("content").alias("h1"), F.md5("content").alias("h2"))
    light = hashed.select("id", "h1", "h2", F.length("content").alias("length"))
    named = written(light.join(light.groupBy("h1", "h2").agg(F.min("id").alias("rep")), ["h1", "h2"]).select("id", "rep", "length"), "texts")
    signed = sketched(hashed.select(F.col("id").alias("rep"), "h1", "h2", "content"), packed=True).filter("n > 0")
    texts = written(signed.groupBy("h1", "h2").agg(F.min("rep").alias("rep"), *(F.first(c).alias(c) for c in ("n", "g", "bands"))).drop("h1", "h2"), "grams")
    groups = components(written(block_links(texts, threshold), "near"))
    out = named.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    best = out.groupBy("component").agg(F.max(F.struct("length", (-F.col("id")).alias("order"))).alias("top"))
    return out.join(best, "component").select("id", "component", (F.col("id") == -F.col("top.order")).alias("keep"))


def block_links(texts: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the texts (rep, n, g, bands) which share a band and have enough shingles in common: the smallest rep of a group of two blocks with each other one.

    Texts go to blocks of at most about ``block`` texts and BLOCK_GRAMS shingles, in order of their number of shingles. A block is one row and one file. Each task
    reads its two blocks from the shared folder (a join by pairs of partitions), so that blocks aren't copied for the pairs that they are in.
    """
    counts = sorted(tuple(r) for r in texts.groupBy("n").agg(F.count("*")).collect())
    places, first, held, grams = [], 0, 0, 0
    for n, count in counts:
        parts = max(-(-count // block), -(-count * n // BLOCK_GRAMS))
        if held and (held + count > block or grams + count * n > BLOCK_GRAMS):
            first, held, grams = first + 1, 0, 0
        places.append((n, first, parts))
        if parts > 1:
            first += parts
        else:
            held, grams = held + count, grams + count * n
    # a row for each number of shingles
    placed = texts.join(F.broadcast(texts.sparkSession.createDataFrame(places, "n int, first int, parts int")), "n")
    dealt = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # collected: the texts of one block
    rows = dealt.groupBy("block").agg(F.collect_list(F.struct("rep", "n", "g", "bands")).alias("rows"))

    def build(batches):
        for batch in batches:
            for number, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                v = rows.values
                n = v.field("n").to_numpy()
                order = np.argsort(n, kind="stable")
                packed, bands = v.field("g"), v.field("bands")
                grams = np.concatenate([_summed(zlib.decompress(packed[int(k)].as_buffer()), np.uint64) for k in order])
                known, at, held = np.unique(grams, return_inverse=True, return_counts=True)
                keys = b"".join(bands[int(k)].as_py() for k in order)
                yield pa.RecordBatch.from_pylist(
                    [{"block": number, "low": int(n.min()), "high": int(n.max()), "rep": v.field("rep").to_numpy()[order].tobytes(), "n": n[order].tobytes(), "bands": keys, "known": known.tobytes(), "held": held.tobytes(), "at": zlib.compress(_planes(at.astype(_narrow(len(known)))), 1)}],
                    pa.schema([("block", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), *((c, pa.binary()) for c in ("rep", "n", "bands", "known", "held", "at"))]),
                )

    blocks = written(rows.mapInArrow(build, "block int, low int, high int, rep binary, n binary, bands binary, known binary, held binary, at binary"), "blocks", maxRecordsPerFile=1)
    p, q = (blocks.select(F.struct("*").alias(side)) for side in "pq")
    pairs = p.join(q.hint("shuffle_replicate_nl"), (F.col("p.block") <= F.col("q.block")) & (F.col("p.high") + 1e-6 >= threshold * F.col("q.low")))

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column("p"), batch.column("q"), strict=True):
                x = _unpacked(left)
                links = _Pair(x, x if left["block"] == right["block"] else _unpacked(right), threshold).links()
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0], pa.int64()), pa.array(links[:, 1], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


class _Pair:
    """Two blocks, or one with itself: pairs that share a band and aren't joined yet are looked at until each is joined or too far apart.

    A pair is ruled out only by an upper bound on its common shingles. Shingles are columns of a bitmap, the rarer ones several to a column: a text has ``lost``
    as many shingles as it has more than bits, and two texts have at most their common bits and the lesser loss in common. What two bitmaps leave is counted.
    """

    def __init__(self, x: SimpleNamespace, y: SimpleNamespace, threshold: float) -> None:
        self.x, self.y, self.same, self.threshold = x, y, x is y, threshold
        known = np.union1d(x.known, y.known)
        sides = [x] if self.same else [x, y]
        counts = np.zeros(len(known), np.int64)
        for side in sides:
            place = np.searchsorted(known, side.known)
            counts[place] += side.held
            side.g = place.astype(_narrow(len(known)))[side.at]
            del side.at
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(known))
        mean = max(side.n.mean() for side in sides)
        bits = min(max(1 << int(10 * mean).bit_length() - 1, 1 << 10), 1 << 15)
        for side in sides:
            side.levels = [(rows, share := threshold / (1 + threshold) * side.n, share - lost) for rows, lost in _bitmaps(side, rank, bits)]
        self.root = list(range(len(x.n) + (0 if self.same else len(y.n))))
        self.shift = 0 if self.same else len(x.n)
        self._label()

    def links(self) -> np.ndarray:
        keys = [np.unique(np.concatenate((self.x.bands[:, b], self.y.bands[:, b])), return_inverse=True)[1] for b in range(self.x.bands.shape[1])]
        keys = [(k[: len(self.x.n)], k[len(self.x.n) :]) for k in keys]
        # the first, middle and last partner of a band: joins copies at the cost of the band's size
        for kx, ky in keys:
            order, low, high = self._ranges(kx, ky)
            for at in (low, (low + high) // 2, high - 1):
                some = np.flatnonzero(low < high)
                j = order[at[some]]
                apart = self.label_x[some] != self.label_y[j]
                self._join(*self._left(some[apart], j[apart]))
        ranges = [r for kx, ky in keys for r in self._rest(kx, ky)]
        for start in range(0, len(self.x.n), PART):
            self._join(*self._left(*self._met(ranges, start, min(start + PART, len(self.x.n)))))
        rep = self.x.rep if self.same else np.concatenate((self.x.rep, self.y.rep))
        label = self.label_x if self.same else np.concatenate((self.label_x, self.label_y))
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        out = np.stack((least[label], rep), axis=1)
        return out[out[:, 0] != out[:, 1]]

    def _ranges(self, kx: np.ndarray, ky: np.ndarray) -> tuple:
        """Texts of y in order of key and size, and where each text of x has those of its key and of like size."""
        most = int(max(self.x.n.max(), self.y.n.max())) + 1
        place = ky * most + self.y.n
        order = np.argsort(place)
        place = place[order]
        low = np.searchsorted(place, kx * most + np.ceil(self.x.n * self.threshold - 1e-6).astype(np.int64))
        high = np.searchsorted(place, kx * most + np.minimum(np.floor(self.x.n / self.threshold + 1e-6), most - 1).astype(np.int64), side="right")
        return order, low, high

    def _rest(self, kx: np.ndarray, ky: np.ndarray):
        """The same in two parts: of a key's texts in its largest component and of the others; two texts in it need no look."""
        labels = len(self.root)
        codes, held = np.unique(np.concatenate((kx * labels + self.label_x, ky * labels + self.label_y)), return_counts=True)
        key = codes // labels
        largest = np.zeros(key[-1] + 1, np.int64)
        by = np.argsort(held, kind="stable")
        largest[key[by]] = codes[by] % labels
        in_x, in_y = self.label_x == largest[kx], self.label_y == largest[ky]
        yield self._ranges(2 * kx, 2 * ky + in_y)
        order, low, high = self._ranges(2 * kx + 1, 2 * ky + in_y)
        yield order, low, np.where(in_x, low, high)

    def _met(self, ranges: list, start: int, end: int) -> tuple:
        """Pairs of some texts of x with those of y that share a band and aren't joined, each once."""
        seen = np.zeros((end - start, len(self.y.n)), bool)
        cells, firsts = seen.reshape(-1), np.arange(end - start) * len(self.y.n)
        for order, low, high in ranges:
            low, size = low[start:end], np.maximum(high[start:end] - low[start:end], 0)
            if total := int(size.sum()):
                cells[np.repeat(firsts, size) + order[np.arange(total) + np.repeat(low - np.cumsum(size) + size, size)]] = True
        seen &= self.label_x[start:end, None] != self.label_y[None, :]
        if self.same:
            seen &= np.arange(start, end)[:, None] < np.arange(len(self.y.n))[None, :]
        at = np.flatnonzero(cells)
        i = np.repeat(np.arange(end - start), np.count_nonzero(seen, axis=1))
        return i + start, at - firsts[i]

    def _left(self, i: np.ndarray, j: np.ndarray) -> tuple:
        """The pairs that the bitmaps don't rule out, some at a time: their shares of both sizes are no more than their common bits and either loss."""
        for (bits_x, share_x, less_x), (bits_y, share_y, less_y) in zip(self.x.levels, self.y.levels, strict=True):
            step, one = max(1, (1 << 16) // bits_x.shape[1]), np.ones(bits_x.shape[1], np.float32)
            keep = np.empty(len(i), bool)
            for k in range(0, len(i), step):
                a, b = i[k : k + step], j[k : k + step]
                both = bits_x.take(a, axis=0)
                both &= bits_y.take(b, axis=0)
                common = np.bitwise_count(both).astype(np.float32) @ one + 1e-3
                keep[k : k + step] = (common >= less_x.take(a) + share_y.take(b)) & (common >= share_x.take(a) + less_y.take(b))
            i, j = i[keep], j[keep]
        return i, j

    def _near(self, common: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return common >= self.threshold * (self.x.n[i].astype(np.float64) + self.y.n[j] - common)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Counts the common shingles of pairs, some at a time, and joins the near ones; pairs that are joined meanwhile need no look."""
        while len(i):
            near = self._near(self._counted(i[:EXACT], j[:EXACT]), i[:EXACT], j[:EXACT])
            for a, b in zip(i[:EXACT][near].tolist(), j[:EXACT][near].tolist(), strict=True):
                a, b = self._find(a), self._find(b + self.shift)
                self.root[max(a, b)] = min(a, b)
            i, j = i[EXACT:], j[EXACT:]
            if near.any():
                self._label()
                keep = self.label_x[i] != self.label_y[j]
                i, j = i[keep], j[keep]

    def _counted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (some_x, at_x), (some_y, at_y) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        left, right = [self.x.grams(k) for k in some_x], [self.y.grams(k) for k in some_y]
        if len(i) * DENSE > len(left) * len(right):
            return _common(left, right, 1 << 10)[at_x, at_y]
        return np.array([_both(left[a], right[b]) for a, b in zip(at_x, at_y, strict=True)], np.float64)

    def _find(self, c: int) -> int:
        root = self.root
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def _label(self) -> None:
        label = np.array(self.root)
        while (label[label] != label).any():
            label = label[label]
        self.root = label.tolist()
        self.label_x, self.label_y = label[: len(self.x.n)], label[self.shift :]


def _narrow(known: int) -> type:
    return np.uint16 if known <= 1 << 16 else np.uint32


def _planes(values: np.ndarray) -> bytes:
    """Differences of successive values, their first bytes first: few bytes when compressed."""
    change = values.copy()
    change[1:] -= values[:-1]
    return change.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _summed(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1).cumsum(dtype=kind)


def _unpacked(block) -> SimpleNamespace:
    """A block's texts in order of size; grams(k): the shingles of one, as their places among those of both blocks."""
    read = lambda c, kind: np.frombuffer(block[c].as_buffer(), kind)
    n, known = read("n", np.int32), read("known", np.uint64)
    at = _summed(zlib.decompress(block["at"].as_buffer()), _narrow(len(known)))
    out = SimpleNamespace(n=n, known=known, held=read("held", np.int64), rep=read("rep", np.int64), bands=read("bands", np.int64).reshape(len(n), -1), at=at)
    out.end = np.cumsum(n)
    out.grams = lambda k: out.g[out.end[k] - n[k] : out.end[k]]
    return out


def _bitmaps(side: SimpleNamespace, rank: np.ndarray, bits: int) -> list:
    """A row of bits for each text, and how many shingles a text has more than bits: for a quarter of the bits, half of them and all.

    The more frequent shingles have a bit of their own, in half of the bits, and the others share the other half by rank, so that the last three quarters of one
    level, laid over each other, are the second half of the level before.
    """
    half, rows = bits // 2, []
    column = np.where(rank < half, rank, half + rank % half)
    for start in range(0, len(side.n), 1024):
        n, end = side.n[start : start + 1024], side.end[start : start + 1024]
        m = np.zeros((len(n), bits), bool)
        m[np.repeat(np.arange(len(n)), n), column[side.g[end[0] - n[0] : end[-1]]]] = True
        rows.append(np.packbits(m, axis=1).view(np.uint64))
    levels = [np.concatenate(rows)]
    for _ in range(2):
        a, b, c, d = np.split(levels[0], 4, axis=1)
        levels.insert(0, np.concatenate((a, b | c | d), axis=1))
    return [(x, side.n - np.bitwise_count(x).sum(axis=1, dtype=np.int32)) for x in levels]


def _common(left: list, right: list, columns: int = 1 << 13) -> np.ndarray:
    """How many shingles each text of one block shares with each of another: products of 0/1 matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float64)
    if not left or not right:
        return out
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def cells(side):
        row, grams = np.repeat(np.arange(len(side)), [len(g) for g in side]), np.concatenate(side)
        column = np.searchsorted(both, grams)
        held = both.take(column, mode="clip") == grams if len(both) else np.zeros(len(grams), bool)
        order = np.argsort(column[held], kind="stable")
        return row[held][order], column[held][order]

    sides = [cells(left), cells(right)]
    for start in range(0, len(both), columns):
        parts = []
        for (row, column), n in zip(sides, out.shape, strict=True):
            some = slice(*np.searchsorted(column, [start, start + columns]))
            m = np.zeros((n, min(columns, len(both) - start)), np.float32)
            m[row[some], column[some] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def sketched(texts: DataFrame, packed: bool = False) -> DataFrame:
    """The columns of texts but content, with (g, bands): the distinct character 3-grams of each lower-case text, hashed, and the hashes of its bands of minima. packed: (n, g, bands), the number of 3-grams, and the others as bytes.

    In Arrow batches: 64 minima over thousands of shingles are a small matrix product there, and a slow interpreted loop as column lambdas.
    """
    kept = [f for f in texts.schema.fields if f.name != "content"]

    def run(batches):
        for batch in batches:
            n, grams, bands = [], [], []
            for text in batch.column("content").to_pylist():
                raw = _shingles(text or "")
                g = raw * _ODD
                g ^= g >> np.uint64(31)
                low = np.zeros(HASHES, np.uint64) if not len(g) else np.min([_least(g[k : k + 4096]) for k in range(0, len(g), 4096)], axis=0)
                keys = (low.reshape(-1, BAND) * np.arange(1, 2 * BAND, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                n.append(len(g))
                grams.append(zlib.compress(_planes(raw), 1) if packed else g.view(np.int64))
                bands.append(keys.tobytes() if packed else keys.view(np.int64))
            own = [batch.column(f.name) for f in kept]
            kind = pa.binary() if packed else pa.list_(pa.int64())
            counted = [pa.array(n, pa.int32())] if packed else []
            yield pa.RecordBatch.from_arrays([*own, *counted, pa.array(grams, kind), pa.array(bands, kind)], names=[*(f.name for f in kept), *["n"] * packed, "g", "bands"])

    added = [("n", T.IntegerType()), ("g", T.BinaryType()), ("bands", T.BinaryType())] if packed else [(c, T.ArrayType(T.LongType())) for c in ("g", "bands")]
    return texts.mapInArrow(run, T.StructType([*kept, *(T.StructField(*f) for f in added)]))


def _shingles(text: str) -> np.ndarray:
    """The distinct character 3-grams of a text, in order."""
    t = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(t) - WIDTH + 1
    if n < 1:
        return t[:1] if len(t) < 2 else (t[:1] << np.uint64(21)) + t[1:2]
    g = sum((t[k : n + k] << np.uint64(21 * k) for k in range(WIDTH)), np.zeros(n, np.uint64))
    g.sort()
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def _least(g: np.ndarray) -> np.ndarray:
    """The least value of each hash over some shingles."""
    v = _SEEDS[:, None] * g[None, :]
    v ^= v >> np.uint64(29)
    v *= _ODD
    return v.min(axis=1)


def _both(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays without repeats have in common."""
    z = np.concatenate((x, y))
    z.sort(kind="stable")
    return int(np.count_nonzero(z[1:] == z[:-1]))
