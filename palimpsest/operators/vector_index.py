"""Inverted-file vector index: cells fitted on a bounded sample that hold every row, searched by the best cells of a question.

A row lies in the cell of its nearest centre. A question is compared only with the rows of the ``probes`` cells whose
centres are nearest to it, so its work follows those cells and not its tenant. That answer is approximate. How many cells
that takes is measured on the sample: as many as hold ``RECALL`` of the nearest neighbours of some of its rows; well
separated data need few, data without clusters many. The exact one goes on: each cell of a tenant knows how far its furthest row lies from the centre, so by the triangle
inequality of angles no row of it is more similar to the question than cos(angle to the centre - that angle).
Cells that this bound allows to hold a better row than the k-th found are searched too, all others can't change the answer.

The driver holds the sample of at most ``SAMPLE`` rows and the centres; tasks get the centres with their code. Rows
and questions meet as blocks of one cell, tenant and part, so a large cell is as many keys as it has blocks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written
from .vectors import BLOCK, products, unit

SAMPLE = 20_000  # rows that the cells are fitted on
CELLS = 4096  # at most
RECALL = 0.95
TRIED, NEIGHBOURS = 256, 10  # rows of the sample whose neighbours are looked up, and how many of them
ROUNDS = 12
QUESTIONS = 512  # questions that a task compares with centres at once
MARGIN = 1e-9  # similarities are rounded


class Index(NamedTuple):
    rows: DataFrame  # user_id, cell, b, c: blocks of rows
    cells: DataFrame  # user_id, cells: of each tenant, its cells with their number of blocks and least similarity to the centre
    centres: np.ndarray
    probes: int


def probes_for(vectors: np.ndarray, centres: np.ndarray, recall: float) -> int:
    """How many nearest cells hold this share of the nearest neighbours, among the sample, of its first rows."""
    asked = vectors[:TRIED]
    near = asked @ vectors.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    take = min(NEIGHBOURS, len(vectors) - 1)
    if take < 1:
        return 1
    found = np.argpartition(-near, take - 1, axis=1)[:, :take]
    cell = (vectors @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable").argsort(axis=1)
    place = np.take_along_axis(order, cell[found], axis=1)
    return int(np.quantile(place, recall, method="higher")) + 1


def fitted(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centres by spherical k-means, seeded with rows far from each other; equal input gives equal centres."""
    rows = vectors[np.linalg.norm(vectors, axis=1) > 0]
    if not len(rows):
        return np.zeros((1, vectors.shape[1] if vectors.ndim == 2 else 1))
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(cells, len(rows)) and near.min() < 1 - MARGIN:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(ROUNDS):
        cell = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.divide(sums, norm, out=centres.copy(), where=norm > 0)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def built(claims: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> Index:
    """The index of all claims (id, user_id, embedding, valid_from and valid_to if there) that have a vector.

    cells: by default the square root of the sample's rows, at most CELLS.
    """
    bounds = [F.unix_micros("valid_from").alias("lo"), F.coalesce(F.unix_micros("valid_to"), F.lit(1 << 62)).alias("hi")] if "valid_from" in claims.columns else [F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi")]
    rows = claims.filter("embedding is not null").select("user_id", "id", "embedding", *bounds)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()
    vectors = unit(some) if len(some) else np.zeros((0, 1))
    centres = fitted(vectors, min(cells or max(1, math.isqrt(len(vectors))), CELLS))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                close = unit(batch.column("embedding")) @ centres.T
                cell = close.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(close[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "close"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = written(rows.mapInArrow(place, f"{schema}, cell int, close double"), "placed")
    sizes = placed.groupBy("user_id", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("close").alias("low"))
    dealt = placed.join(sizes.select("user_id", "cell", "blocks"), ["user_id", "cell"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = dealt.groupBy("user_id", "cell", "b").agg(F.collect_list(F.struct("id", "embedding", "lo", "hi")).alias("c"))
    return Index(written(blocks, "cell_rows"), written(sizes.groupBy("user_id").agg(F.collect_list(F.struct("cell", "blocks", "low")).alias("cells")), "cells"), centres, probes_for(vectors, centres, recall))


def probed(questions: DataFrame, index: Index, probes: int, known: bool) -> DataFrame:
    """(qid, cell, blocks): the cells to search for each question (user_id, id, vector, least).

    Its ``probes`` nearest ones of its tenant; or with ``known`` all others that may hold a row of at least the similarity ``least``.
    """
    centres = index.centres

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = batch.column("q")[i].values, batch.column("cells")[i].values
                close = np.clip(unit(q.field("vector")) @ centres[c.field("cell").to_numpy()].T, -1, 1)
                order = np.argsort(-close, axis=1, kind="stable")
                ask = np.zeros(close.shape, bool)
                np.put_along_axis(ask, order[:, :probes], True, axis=1)
                if known:
                    bound = np.cos(np.maximum(0, np.arccos(close) - np.arccos(np.clip(c.field("low").to_numpy(), -1, 1))[None, :]))
                    ask = ~ask & (bound >= q.field("least").to_numpy()[:, None] - MARGIN)
                at, to = np.nonzero(ask)
                yield pa.RecordBatch.from_arrays([pa.array(q.field("id").to_numpy()[at]), pa.array(c.field("cell").to_numpy()[to]), pa.array(c.field("blocks").to_numpy()[to])], names=["qid", "cell", "blocks"])

    counts = questions.groupBy("user_id").agg(F.ceil(F.count("*") / QUESTIONS).alias("parts"))
    grouped = questions.join(counts, "user_id").groupBy("user_id", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("id", "vector", "least")).alias("q"))
    return grouped.join(index.cells, "user_id").select("q", "cells").mapInArrow(run, "qid long, cell int, blocks long")


def _hits(questions: DataFrame, asked: DataFrame, index: Index, k: int, floor: float) -> DataFrame:
    """(qid, claim_id, similarity): at most k of each question in each block of the cells that it asks."""
    rows = asked.join(questions.select(F.col("id").alias("qid"), "user_id", "vector", "at"), "qid")
    sizes = rows.groupBy("user_id", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = rows.join(sizes, ["user_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
    q = dealt.groupBy("user_id", "cell", "part").agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct(F.col("qid").alias("id"), "vector", "at")).alias("q"))
    q = q.select("user_id", "cell", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    return q.join(index.rows, ["user_id", "cell", "b"]).select("q", "c").mapInArrow(products(k, floor), "qid long, claim_id long, similarity double")


def search(questions: DataFrame, index: Index, k: int, floor: float = -1.0, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(qid, claim_id, similarity, rank) as ``vectors.nearest``, from the probed cells alone (by default as many as the index has measured), or with ``exact`` from all that can matter.

    questions: (id, user_id, vector, as_of if the claims' validity counts); ids are unique. Equal similarities go to the smallest claim_id.
    """
    probes = probes or index.probes
    at = F.unix_micros("as_of") if "as_of" in questions.columns else F.lit(0).cast("long")
    q = written(questions.filter("vector is not null").select("user_id", "id", "vector", at.alias("at"), F.lit(floor).cast("double").alias("least")), "questions")
    best = Window.partitionBy("qid").orderBy(F.desc("similarity"), "claim_id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = top(_hits(q, probed(q, index, probes, False), index, k, floor))
    if not exact:
        return found
    found = written(found, "hits")
    kth = found.filter(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("similarity").alias("kth"))
    least = q.join(kth, "id", "left").withColumn("least", F.greatest("least", "kth")).drop("kth")
    return top(found.drop("rank").unionByName(_hits(q, probed(least, index, probes, True), index, k, floor)))
