"""An index of a chunk collection: chunks in cells around centres, searched exactly.

Vectors of length 1 are as far apart as sqrt(2 * (1 - cosine)), which is a metric: a chunk in a cell is no
nearer to a question than the question's distance to the cell's centre less the cell's radius. Cells that
are too far away for a question's k nearest are not read, and no neighbour is lost.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nearest import Way, nearest, unit_rows

#: Vectors that the centres are made of, in so many rounds, and the number of centres at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4096
#: Distances are rounded to 6 decimals.
ROUNDING = 1e-6
SEED = 17


class Index(NamedTuple):
    """Where the cells are, their centres as rows of length 1, and the radius and number of chunks of each."""

    path: str
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def centres_of(chunks: DataFrame, cells: int) -> np.ndarray:
    """Centres from a sample of SAMPLE vectors at most: they decide how much a search skips, nothing else."""
    n = chunks.count()
    part = chunks.select("embedding").sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), seed=SEED).limit(SAMPLE).toArrow()
    if not part.num_rows:
        return np.zeros((0, 0))
    column = part.column("embedding").combine_chunks()
    size = max((len(x) for x in column.to_pylist() if x), default=0)
    _, points = unit_rows(column, size)
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(SEED)
    centres = points[rng.permutation(len(points))[: min(cells, MOST_CELLS)]]
    for _ in range(ROUNDS if len(centres) else 0):
        of = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        norm = np.sqrt((sums**2).sum(1))
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of length 1."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def build(chunks: DataFrame, path: str, cells: int = 64) -> Index:
    """Writes `chunks` (id, embedding, ...) below `path`, a folder for each cell, and returns the index.

    Every chunk with a vector of the centres' length that is not zero is in the cell of its nearest centre,
    with its distance to it; the others, which no search finds, are left out. Radii and sizes, two numbers
    a cell, are all that reaches the driver. An empty table gives an index that finds nothing.
    """
    centres = centres_of(chunks, cells)

    def assign(batches):
        for b in batches:
            rows, points = unit_rows(b.column("embedding"), centres.shape[1])
            if not len(rows) or not len(centres):
                continue
            far = apart(points, centres)
            of = far.argmin(1)
            columns = [c.take(pa.array(rows)) for c in b.columns]
            columns += [pa.array(of, pa.int32()), pa.array(far[np.arange(len(of)), of])]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "_cell", "_far"])

    schema = T.StructType([*chunks.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])
    dealt = chunks.mapInArrow(assign, schema)
    # A cell may hold a third of all rows, so Spark splits large ones over several files.
    dealt.hint("rebalance", "_cell").write.mode("overwrite").partitionBy("_cell").parquet(path)
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    if len(centres):
        table = chunks.sparkSession.read.schema(schema).parquet(path)
        for r in table.groupBy("_cell").agg(F.max("_far").alias("r"), F.count("*").alias("n")).collect():
            radius[r["_cell"]], sizes[r["_cell"]] = r["r"], r["n"]
    return Index(path, centres, radius, sizes)


def open_cells(spark: SparkSession, index: Index, schema: T.StructType, cells: list[int]) -> DataFrame:
    """The chunks of some cells: the others' folders are not listed among what is read."""
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("_cell", T.IntegerType())])).parquet(index.path)
    return table.where(F.col("_cell").isin([int(c) for c in cells]))


def search(spark: SparkSession, index: Index, schema: T.StructType, questions: DataFrame, k: int) -> tuple[DataFrame, float]:
    """The k nearest chunks of each question with distance and rank, as `nearest` finds them among all chunks, and
    the share of the pairs of a question and a non-empty cell that were read.

    `questions` (question_id, query) is the stated set of a batch and comes to the driver with its vectors.
    First each question looks into the nearest cells that hold k chunks; the k-th distance found there
    then tells which other cells can hold a nearer one (or one as near, as ties go by id).
    """
    asked = questions.select("question_id", "query").toArrow()
    column = asked.column("query").combine_chunks()
    rows, points = unit_rows(column, index.centres.shape[1]) if len(index.centres) and asked.num_rows else (np.empty(0, np.int64), None)
    ids = asked.column("question_id").take(pa.array(rows)).to_pylist()
    full = np.flatnonzero(index.sizes)
    make = spark.createDataFrame
    kind = T.StructType([T.StructField("question_id", questions.schema["question_id"].dataType), T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def looked(cells: list[list[int]]) -> DataFrame:
        wanted = sorted({c for x in cells for c in x})
        plan = make([(i, [int(c) for c in x]) for i, x in zip(ids, cells, strict=True)], kind)
        some = questions.select("question_id", "query").join(F.broadcast(plan), "question_id")
        return nearest(open_cells(spark, index, schema, wanted), some, [Way(0, "cells", k)]).drop("_way", "_cell", "_cells")

    if not len(rows) or not len(full):
        return looked([[] for _ in ids]), 0.0
    far = apart(points, index.centres[full])
    order = np.argsort(far, axis=1, kind="stable")
    enough = (np.cumsum(index.sizes[full][order], axis=1) < k).sum(1) + 1
    first = [full[o[:n]].tolist() for o, n in zip(order, enough, strict=True)]
    worst = looked(first).where(F.col("rank") == k).select("question_id", "distance").collect()
    limit = {r["question_id"]: np.sqrt(2 * (r["distance"] + 2 * ROUNDING)) for r in worst}
    least = far - index.radius[full]
    cells = [full[least[n] <= limit.get(i, np.inf) + 1e-9].tolist() for n, i in enumerate(ids)]
    return looked(cells), sum(map(len, cells)) / (len(ids) * len(full))
