"""What the training-data operators share: shared-folder tables, Arrow batches of text, word tables.

A *word* is a maximal run of characters other than space and U+0009..U+000D, everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written  # noqa: F401

CHUNK_BYTES = 1 << 19
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, columns: list[str], new: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """df with the columns that ``make()(arrays of those columns)`` gives, batch by batch.

    ``make`` runs once per task. Names that df has already are refused, so that a caller's columns are never replaced.
    """
    clash = {f.name for f in new} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *new.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in small(batch, columns[0]):
                got = work(*(part.column(c) for c in columns))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, k) for v, k in zip(got, kinds, strict=True))], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def small(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most limit bytes of the column, or one row: bounds what a task holds, however long the texts."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each row begins and the last one ends; null counts as empty."""
    column = column.fill_null("") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most limit bytes, or of one row."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def range_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of integer values over the ranges between successive offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows of a chunk: where each begins, where each ends, and each row's range of words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _WS[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by value, equal in every run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, ranges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and where the row has so many left."""
    n = len(hashes)
    out, room = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(width):
        out[: n - k] += mix(hashes[k:] + np.uint64(k + 1)) if n > k else np.uint64(0)
    for a, b in zip(ranges[:-1], ranges[1:], strict=True):
        if b - a >= width:
            room[a : b - width + 1] = True
    return mix(out), room


def labelled_sample(labels: DataFrame, condition, limit: int) -> DataFrame:
    """doc_id, quality, toxic of at most ``limit`` labelled documents, by the order of a hash: bounded, so it can be broadcast."""
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.filter(F.col("doc_id").isNotNull() & condition).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(limit)
