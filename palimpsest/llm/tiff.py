"""Media columns: TIFF files in a binary column, one row for each page.

The reader walks the image directories in either byte order, gathers strips or tiles, decodes none,
PackBits, LZW or deflate, undoes the horizontal predictor, and emits a page's pixels. The writer makes
files that use all of these; which of them depends on the content alone, so equal payloads give equal files.

Defined results: a null or empty value has no pages; a value that isn't TIFF, or a page that can't be
decoded, gives one row with the reason in ``error`` and null pixels, and the pages before it stay; so does
a page that states more pixels than its strips could hold, or than PAGE_BYTES. Directories that point back end the walk. Null texts in ``text_media`` count as empty. Repeated rows
give equal rows; an empty table gives none. Other columns are carried.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table, with_columns

WIDTH = 64
# TIFF 6.0 tags, types' sizes and compression numbers.
W, H, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILES, TILE_BYTES = 284, 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
EXPANSION = {LZW: 2730, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}  # bytes that one can become, at most: 12 bits for a string of under 4096, ...
PAGE_BYTES = 1 << 30  # an Arrow value can't hold much more
BATCH_BYTES = 8 << 20
PAGES = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("compression", T.IntegerType()), T.StructField("predictor", T.IntegerType()), T.StructField("tiled", T.BooleanType()), T.StructField("pixels", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())])


# How many codes after a clear code have 9, 10, 11 and 12 bits in TIFF's LZW, a clear code at the end included.
LZW_RUNS = ((9, 254), (10, 512), (11, 1024), (12, 2050))
LZW_FULL = 3836  # codes between two clear codes of the writer
_LZW_BITS = np.repeat([w for w, _ in LZW_RUNS], [n for _, n in LZW_RUNS])[: LZW_FULL + 1]


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes from the highest bit, one code earlier wider than needed, 9 to 12 bits.

    A code's width follows from its place after the last clear code, so codes are listed first and packed at once.
    """
    codes: dict[int, int] = {}
    out, free, prefix = [256], 258, -1
    for byte in data:
        key = prefix << 8 | byte
        if key in codes:
            prefix = codes[key]
        elif prefix < 0:
            prefix = byte
        else:
            out.append(prefix)
            prefix = byte
            codes[key] = free
            free += 1
            if free == 258 + LZW_FULL:
                out.append(256)
                codes.clear()
                free = 258
    if prefix >= 0:
        out.append(prefix)
    out.append(257)
    widths = np.concatenate(([9], np.resize(_LZW_BITS, len(out) - 1)))
    shift = widths[:, None] - 1 - np.arange(12)
    return np.packbits((np.array(out)[:, None] >> np.maximum(shift, 0) & 1).astype(np.uint8)[shift >= 0]).tobytes()


def lzw_codes(data: np.ndarray, at: int, width: int, count: int) -> np.ndarray:
    """Up to ``count`` codes of ``width`` bits from bit ``at`` on. Two zero bytes follow the data."""
    place = at + width * np.arange(min(count, (8 * (len(data) - 2) - at) // width))
    byte = place >> 3
    return (data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]) >> 24 - width - (place & 7) & (1 << width) - 1


def lzw_decode(data: bytes, most: int) -> bytes:
    """At most about ``most`` bytes of LZW data."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    padded = np.frombuffer(data + b"\0\0", np.uint8).astype(np.int32)
    out, at, made, stop = [], 0, 0, 256
    while stop == 256 and made < most:
        known, last = list(first), b""
        for width, count in LZW_RUNS:
            codes = lzw_codes(padded, at, width, count)
            ends = np.flatnonzero((codes == 256) | (codes == 257))
            whole = not len(ends)
            stop = -1 if whole else int(codes[ends[0]])
            read = len(codes) if whole else int(ends[0])
            at += width * (read + (not whole))
            for code in codes[:read].tolist():
                if code < len(known):
                    now = known[code]
                elif code == len(known) and last:
                    now = last + last[:1]
                else:
                    raise ValueError("LZW code out of range")
                if last:
                    known.append(last + now[:1])
                elif code > 255:
                    raise ValueError("LZW code out of range")
                out.append(now)
                last = now
                made += len(now)
                if made >= most:
                    return b"".join(out)
            if not whole or read < count:
                break
        else:
            raise ValueError("LZW table is full")
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(row: bytes) -> bytes:
    out, at = bytearray(), 0
    for m in _RUN.finditer(row):
        for k in range(at, m.start(), 128):
            part = row[k : min(k + 128, m.start())]
            out += bytes((len(part) - 1,)) + part
        out += bytes((257 - len(m[0]), m[0][0]))
        at = m.end()
    for k in range(at, len(row), 128):
        out += bytes((len(row[k : k + 128]) - 1,)) + row[k : k + 128]
    return bytes(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    out, at, made = [], 0, 0
    while at < len(data) and made < most:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
            continue
        made += len(out[-1])
    return b"".join(out)


def decoded(data: bytes, compression: int, most: int) -> bytes:
    """The bytes of a strip or tile that should have ``most``; what it would expand to beyond them is never held."""
    if compression == NONE:
        return data[:most]
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most + 1)  # one more, so that the checksum after the last byte is read
    if compression == PACKBITS:
        return packbits_decode(data, most)
    raise ValueError(f"compression {compression}")


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """(byte order, values by tag) of each directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not TIFF")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        n = struct.unpack_from(f"{order}H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            place = at + 10 + 12 * k
            if TYPE_BYTES.get(kind, 0) * count > 4:
                place = struct.unpack_from(f"{order}I", data, place)[0]
            if letter := {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}.get(kind):
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
        yield order, tags
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def page_pixels(data: bytes, order: str, tags: dict[int, tuple[int, ...]], most: int = PAGE_BYTES) -> np.ndarray:
    """(height, width, samples) of a page of 8 or 16 bits a sample. Sizes are checked before anything is decoded or allocated."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = tags[W][0], tags[H][0], one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1 or samples > 1 and one(PLANAR, 1) != 1:
        raise ValueError(f"{bits} bits, planar configuration {one(PLANAR, 1)}")
    kind = np.dtype(f"{order}u{bits // 8}")
    predictor, compression = one(PREDICTOR, 1), one(COMPRESSION, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    tiled = TILES in tags
    if tiled:
        across, down = tags[TILE_W][0], tags[TILE_H][0]
        places, sizes = tags[TILES], tags[TILE_BYTES]
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        places, sizes = tags[STRIPS], tags.get(STRIP_BYTES) or (len(data),)
    if min(width, height, samples, across, down) < 1:
        raise ValueError("a size isn't positive")
    columns = -(-width // across)
    count, part_bytes = columns * -(-height // down), down * across * samples * kind.itemsize
    if len(places) < count or len(sizes) < count or min(*places, *sizes) < 0:
        raise ValueError("strips or tiles are missing")
    held = sum(min(size, max(0, len(data) - place)) for place, size in zip(places[:count], sizes, strict=False))
    if max(height * width * samples * kind.itemsize, part_bytes) > min(most, EXPANSION.get(compression, 1) * held + part_bytes * tiled):
        raise ValueError("more pixels than the strips or tiles can hold, or than a page may have")
    out = np.zeros((height, width, samples), kind)
    for k, (place, size) in enumerate(zip(places[:count], sizes, strict=False)):
        top, left = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - top)
        need = rows * across * samples
        raw = decoded(data[place : place + size], compression, need * kind.itemsize)
        if len(raw) < need * kind.itemsize:
            raise ValueError("a strip or tile is short")
        part = np.frombuffer(raw, kind, need).reshape(rows, across, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        out[top : top + rows, left : left + across] = part[: height - top, : width - left]
    return out


def picture_feature(pixels: np.ndarray) -> str:
    """Mean, spread and an 8 x 8 average hash of a page."""
    if not pixels.size:
        return "empty"
    flat = pixels.reshape(pixels.shape[0], -1).astype(np.float64)
    rows = np.add.reduceat(flat, np.arange(8) * flat.shape[0] // 8, axis=0)
    cells = np.add.reduceat(rows, np.arange(8) * flat.shape[1] // 8, axis=1)
    middle = np.sort(cells, axis=None)[31:33].mean()
    bits = int.from_bytes(np.packbits(cells > middle).tobytes(), "big")
    return f"{flat.mean():.4f}/{flat.std():.4f}/{bits:016x}"


def pages_of(data: bytes | None, most: int = PAGE_BYTES) -> Iterator[tuple]:
    """Values of PAGES for each page of at most ``most`` bytes."""
    if not data:
        return
    page = 0
    try:
        for order, tags in directories(data):
            pixels = page_pixels(data, order, tags, most)
            yield page, tags[W][0], tags[H][0], tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], TILES in tags, pixels.tobytes(), picture_feature(pixels), None
            page += 1
    except (ValueError, KeyError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
        yield page, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def tiff_pages(rows: DataFrame, column: str) -> DataFrame:
    """A row for each page of the files in a binary column: the other columns, and those of PAGES. No shuffle; tasks hold a page and a few MB at a time.

    A column of rows that is named like one of PAGES raises ValueError: rename it before.
    """
    others = [f for f in rows.schema.fields if f.name != column]
    if clash := {f.name for f in others} & set(PAGES.names):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kinds = [to_arrow_type(f.dataType) for f in PAGES]
    names = [*(f.name for f in others), *PAGES.names]

    def run(batches):
        for batch in batches:
            at, held, size = [], [], 0

            def flush(batch=batch):
                values = list(zip(*held, strict=True)) or [()] * len(kinds)
                return pa.RecordBatch.from_arrays([*(batch.column(f.name).take(pa.array(at, pa.int64())) for f in others), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=names)

            for i, file in enumerate(batch.column(column)):
                for page in pages_of(file.as_py()):
                    at.append(i)
                    held.append(page)
                    size += len(page[6] or b"")
                    if size >= BATCH_BYTES:
                        yield flush()
                        at, held, size = [], [], 0
            yield flush()

    return rows.mapInArrow(run, T.StructType([*others, *PAGES.fields]))


def tiff_bytes(payload: bytes) -> bytes:
    """A TIFF file whose first page has the payload (a multiple of WIDTH) as rows of 8-bit samples, and whose second page is a small preview.

    Byte order, compression, strips or tiles, and the predictor follow from the payload's checksum.
    """
    check = zlib.crc32(payload)
    order = "<>"[check & 1]
    compression = (LZW, DEFLATE, PACKBITS)[check // 2 % 3]
    tiled = check // 6 % 2 == 1
    predictor = 1 + (check // 12 % 2 if compression != PACKBITS else 0)
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    cells = np.add.reduceat(np.add.reduceat(image.astype(np.int64), np.arange(8) * len(image) // 8, axis=0), np.arange(8) * 8, axis=1)
    preview = (cells * 255 // max(1, int(cells.max()))).astype(np.uint8)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for pixels, method, in_tiles, delta in ((image, compression, tiled, predictor), (preview, NONE, False, 1)):
        height, width = pixels.shape
        down = 64 if in_tiles else 256
        places, sizes = [], []
        for top in range(0, height, down):
            part = pixels[top : top + down]
            if in_tiles:
                part = np.vstack([part, np.zeros((down - len(part), width), np.uint8)])
            if delta == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            raw = part.tobytes()
            if method == LZW:
                raw = lzw_encode(raw)
            elif method == DEFLATE:
                raw = zlib.compress(raw, 6)
            elif method == PACKBITS:
                raw = b"".join(packbits_encode(raw[k : k + width]) for k in range(0, len(raw), width))
            places.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) & 1)
        entries = [(W, 4, (width,)), (H, 4, (height,)), (BITS, 3, (8,)), (COMPRESSION, 3, (method,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (PREDICTOR, 3, (delta,))]
        entries += [(TILE_W, 4, (width,)), (TILE_H, 4, (down,)), (TILES, 4, places), (TILE_BYTES, 4, sizes)] if in_tiles else [(STRIPS, 4, places), (ROWS_PER_STRIP, 4, (down,)), (STRIP_BYTES, 4, sizes)]
        table_ = b""
        for tag, kind, values in sorted(entries):
            packed = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed
                packed = struct.pack(f"{order}I", place)
            table_ += struct.pack(f"{order}HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + table_
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with media: the UTF-8 bytes of each text, zero-padded to a positive multiple of 64, as a TIFF file."""

    def make():
        def work(column):
            rows = ((t or "").encode() for t in column.to_pylist())
            return [[tiff_bytes(b.ljust(max(WIDTH, -(-len(b) // WIDTH) * WIDTH), b"\0")) for b in rows]]

        return work

    return with_columns(docs, [text], T.StructType([T.StructField("media", T.BinaryType())]), make)


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff_pages(stored, "media").filter("page = 0")
    tail = F.expr("substring(pixels, octet_length(pixels) - 63, 64)")
    feature = F.concat_ws("/", F.format_string("%dx%d", "width", "height"), F.col("compression").cast("string"), F.col("predictor").cast("string"), F.when(F.col("tiled"), "tiles").otherwise("strips"), "feature")
    return pages.select("doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
