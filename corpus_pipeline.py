"""The corpus pipeline: toxicity filter, quality filter, near-duplicate removal, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, in their order; extra columns are
carried, whatever their names.

Defined results, in every stage: an empty table gives no rows; repeated rows, texts of any length and
nulls in any column are taken as they are, null texts as empty ones. Ids may be null or repeated: documents
are told apart by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import table, written
from palimpsest.llm.mixing import mixed_documents
from palimpsest.llm.near_dedup import drop_near_duplicates
from palimpsest.llm.packing import pack
from palimpsest.llm.quality_classifier import drop_bad
from palimpsest.llm.toxicity import drop_toxic

#: SQL can state none of the models, sketches and packings.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents graded as toxic go. Null, empty and wordless texts stay; without toxic labels, all do. Repeated rows go or stay together."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go: null and empty texts among them. Repeated rows go or stay together."""
    return drop_bad(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id (a null id is the largest), once however often its row is repeated. Texts without words are near duplicates of equal texts only."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: a document comes once for each epoch that takes it, so ids repeat from here on. The text at the end of a budget is cut; texts without words, which take no part of a budget, go."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens. A document that the mix took twice is packed twice, so (doc_id, piece) is not unique; (sequence_id, offset) is."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("quality_classifier", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
