"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, kept string"


def edge_rows():
    """Nulls in each column, empty and long texts, repeated rows, ties; extra columns whose names operators use themselves."""
    base = [
        (1, "plain text of a few words that goes on for a little while and then stops.", "en", "a"), (1, "plain text of a few words that goes on for a little while and then stops.", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"),
        (None, "a text without id, but with enough words to be packed and counted", "de", None), (4, " \n\t ", "fr", "b"), (5, "x" * 3000, "en", None), (6, "*** $$$ ### %%% &&&", "en", "c"), (7, "word " * 30_000, "en", "c"), (8, "é😀\u0000ü", "es", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, 3, "yes") for r in base]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
