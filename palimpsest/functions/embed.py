"""Embedders: a column of text to a column of vectors. The caller plugs in a model; the default is deterministic and says nothing of meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "sha256-unit-1"


def hash_vector(text: Column, dim: int = 64) -> Column:
    """A unit vector from SHA-256: digests of ``text|0``, ``text|1``, ... read as little-endian signed 32-bit numbers, over their length. Stays in the JVM."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(-(-dim // 8) - 1)), lambda i: F.sha2(F.concat(text, F.lit("|"), i.cast("string")), 256))

    def numbers(d: Column) -> Column:
        word = lambda k: F.conv(F.concat(*(F.substring(d, 8 * k + 2 * b + 1, 2) for b in (3, 2, 1, 0))), 16, 10).cast("long")
        return F.array(*((word(k) - F.when(word(k) >= 1 << 31, 1 << 32).otherwise(0)) / 2147483647.0 for k in range(8)))

    values = F.slice(F.flatten(F.transform(digests, numbers)), 1, dim)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.array(values), lambda v: F.transform(v, lambda x: F.when(length(v) == 0, x).otherwise(x / length(v))))  # bound, so worked out once
    return unit[0].cast("array<float>")


def gram_vector(text: Column, dim: int = 64) -> Column:
    """Counts of the text's character trigrams by hash: texts that share wording are near each other. Stays in the JVM."""
    low = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(low, i, F.lit(3))), F.lit(dim)))
    return F.transform(F.array(grams), lambda g: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(g, lambda x: x == d)).cast("float")))[0]
