"""Exact nearest chunks of a batch of questions, in memory that does not grow with the chunks.

A task multiplies blocks of its chunks' vectors with the questions' matrix and keeps, for each question and
way of finding chunks, the places of the k nearest so far, and each chunk among them once; what tasks keep
is merged in two steps. No pair of a question and a chunk becomes a row unless it is among a task's nearest.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Questions of one pass over the chunks: their matrix goes to every task.
QUESTIONS = 10_000
#: Products held at a time.
CELLS = 1 << 21
#: Rows that a task gives back at a time.
SLICE = 2_000
#: Tasks whose nearest are merged in the first step.
FAN = 64


class Way(NamedTuple):
    """A way of finding chunks: its number, which chunks it admits, and how many of the nearest it keeps.

    `kind`: `all`; `own`, readable chunks in the question's language; `language`, any in it; `foreign`, chunks in
    another language or in none; `named`, readable chunks whose source starts with the question's prefix, whatever
    the case; `cells`, chunks whose `_cell` is in the question's array `_cells`; `beside`, chunks of the question's
    `_source` whose page is in its array `_pages`, and `beside_language`, those of them in its language.
    `each`: columns of which only the nearest row of each value counts.
    """

    number: int
    kind: str
    k: int
    each: tuple[str, ...] = ()


def unit_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors in double precision scaled to length 1) of the vectors of `size` finite numbers and a length."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    values = pc.list_flatten(column.take(pa.array(rows)))
    matrix = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    fine = np.isfinite(norm) & (norm > 0)
    return rows[fine], matrix[fine] / norm[fine, None]


def _true(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False).astype(bool)


class Questions:
    """A block of questions in a task: matrix, languages and prefixes as columns of a mask."""

    def __init__(self, table: pa.Table):
        lengths = [len(x) for x in table.column("query").to_pylist() if x]
        self.size = max(lengths, default=0)
        self.rows, self.matrix = unit_rows(table.column("query").combine_chunks(), self.size)
        self.table = table.drop_columns(["query"])
        column = lambda c: self.table.column(c).to_pylist() if c in self.table.column_names else None
        self.languages, self.prefixes, self.cells, self.sources, self.pages = (column(c) for c in ("question_language", "prefix", "_cells", "_source", "_pages"))
        self.of_cell = None

    def admitted(self, kind: str, chunks: pa.RecordBatch) -> np.ndarray | None:
        """Which questions (columns) a chunk (row) may answer; None where every one."""
        if kind == "all":
            return None
        if kind == "cells":
            return self._in_cells(chunks.column("_cell").to_numpy(zero_copy_only=False))
        if kind == "foreign":
            return ~self._equal(self.languages, chunks.column("language"), nulls=True)
        if kind == "language":
            return self._equal(self.languages, chunks.column("language"))
        if kind.startswith("beside"):
            out = self._equal(self.sources, chunks.column("source")) & self._on_pages(chunks.column("page").to_pylist())
            return out & self._equal(self.languages, chunks.column("language")) if kind == "beside_language" else out
        readable = _true(chunks.column("readable"))[:, None]
        if kind == "own":
            return self._equal(self.languages, chunks.column("language")) & readable
        return self._equal(self.prefixes, chunks.column("_folded"), pc.starts_with) & readable

    def _equal(self, asked: list, column: pa.Array, test=pc.equal, nulls: bool = False) -> np.ndarray:
        """Where a chunk's value meets the question's; nulls meet only nulls, and only if `nulls`."""
        asked = [asked[k] for k in self.rows.tolist()]
        out = np.zeros((len(column), len(asked)), bool)
        for value in set(asked):
            if value is not None or nulls:
                meets = pc.is_null(column) if value is None else test(column, value)
                out[np.ix_(_true(meets), np.array([x == value for x in asked]))] = True
        return out

    def _on_pages(self, pages: list) -> np.ndarray:
        asked = [self.pages[k] or [] for k in self.rows.tolist()]
        out = np.zeros((len(pages), len(asked)), bool)
        known = {}
        for k, x in enumerate(pages):
            known.setdefault(x, []).append(k)
        for q, x in enumerate(asked):
            for page in x:
                out[known.get(page, []), q] = True
        return out

    def _in_cells(self, cell: np.ndarray) -> np.ndarray:
        if self.of_cell is None:
            asked = [self.cells[k] or [] for k in self.rows.tolist()]
            self.of_cell = np.zeros((max((max(x, default=-1) for x in asked), default=-1) + 2, len(asked)), bool)  # the last row: no question
            for k, x in enumerate(asked):
                self.of_cell[x, k] = True
        return self.of_cell[np.minimum(cell, len(self.of_cell) - 1)]


class Nearest:
    """The k nearest rows of each question so far.

    What is held for a pair is a place, a distance and an id; the rows themselves are held once each, however many
    questions they are near to, and only while a question has them.
    """

    def __init__(self, k: int, n: int, each: tuple[str, ...] = ()):
        self.k, self.limit, self.held, self.each = k, np.full(n, np.inf), [], each
        self.waiting = self.count = 0
        self.rows, self.keys = [], {}

    def offer(self, distance: np.ndarray, rows: pa.RecordBatch) -> None:
        """`distance` of rows and questions; infinite where a row is not admitted."""
        fits = np.isfinite(distance) & (distance <= self.limit)
        if not fits.any():
            return
        best, key = distance, None
        if self.each:
            values = zip(*(rows.column(c).to_pylist() for c in self.each), strict=True)
            key = np.fromiter((self.keys.setdefault(x, len(self.keys)) for x in values), np.int64, rows.num_rows)
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0])
            best = np.minimum.reduceat(distance[order], start, axis=0)
            place = np.empty(len(key), np.int64)
            place[order] = np.cumsum(np.r_[False, np.diff(key[order]) > 0])
            fits &= distance == best[place]
        if len(best) > self.k and np.count_nonzero(fits) > self.k * len(self.limit):
            fits &= distance <= np.partition(best, self.k - 1, axis=0)[self.k - 1]
        row, of = np.nonzero(fits)
        used, at = np.unique(row, return_inverse=True)
        self.rows.append(pa.Table.from_batches([rows]).take(pa.array(used)))
        columns = {"_of": of, "distance": distance[row, of], "_row": self.count + at, "id": rows.column("id").take(pa.array(row))}
        if self.each:
            columns["_key"] = key[row]
        self.count += len(used)
        self.held.append(pa.table({c: pa.array(x) if isinstance(x, np.ndarray) else x for c, x in columns.items()}))
        self.waiting += len(row)
        if self.waiting > 4 * self.k * len(self.limit):
            self.settle()

    def settle(self) -> pa.Table | None:
        """Keeps the k nearest by distance, then id."""
        if not self.held:
            return None
        table = pa.concat_tables(self.held)
        table = table.take(pc.sort_indices(table, sort_keys=[("_of", "ascending"), ("distance", "ascending"), ("id", "ascending")]))
        if self.each:
            pairs = table.column("_of").to_numpy() * len(self.keys) + table.column("_key").to_numpy()
            table = table.take(pa.array(np.sort(np.unique(pairs, return_index=True)[1])))
        of = table.column("_of").to_numpy()
        first = np.r_[True, of[1:] != of[:-1]]
        rank = np.arange(len(of)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        table = table.filter(pa.array(rank < self.k))
        last = np.flatnonzero(rank == self.k - 1)
        self.limit[of[last]] = pa.array(table.column("distance")).to_numpy()[np.flatnonzero(rank[rank < self.k] == self.k - 1)]
        used, at = np.unique(table.column("_row").to_numpy(), return_inverse=True)
        self.rows, self.count = [pa.concat_tables(self.rows).take(pa.array(used))], len(used)
        table = table.set_column(table.column_names.index("_row"), "_row", pa.array(at))
        self.held, self.waiting = [table], 0
        return table

    def slices(self):
        """The nearest with all columns of their rows, some at a time."""
        table = self.settle()
        for lo in range(0, table.num_rows if table else 0, SLICE):
            part = table.slice(lo, SLICE)
            found = self.rows[0].take(part.column("_row"))
            yield found.append_column("_of", part.column("_of")).append_column("distance", part.column("distance"))


def _distances(chunks: pa.RecordBatch, asked: Questions):
    """(rows of `chunks`, distances to all questions to 6 decimals), block by block."""
    rows, matrix = unit_rows(chunks.column("embedding"), asked.size)
    step = max(1, CELLS // max(1, len(asked.rows)))
    plain = chunks.drop_columns(["embedding"])
    for lo in range(0, len(rows), step):
        yield plain.take(pa.array(rows[lo : lo + step])), np.round(1 - matrix[lo : lo + step] @ asked.matrix.T, 6) + 0.0


def _passes(chunks: DataFrame, questions: DataFrame, work, extra: list[T.StructField], block: int) -> DataFrame:
    """Rows that `work(batches, Questions)` makes of all chunks and each block of questions.

    A block is collected, with its vectors, and sent to the tasks: `block` questions at most.
    """
    names = [c for c in questions.columns if c != "query"]
    carried = [c for c in chunks.columns if c not in ("embedding", *names)]
    taken = chunks.select("embedding", *carried, *[F.lower("source").alias("_folded")] * ("source" in chunks.columns))
    schema = T.StructType([*(chunks.schema[c] for c in carried), *(questions.schema[c] for c in names), *extra])
    n = -(-questions.count() // block) or 1
    blocks = F.pmod(F.xxhash64("question_id"), F.lit(n))
    out = []
    for part in range(n):
        here = questions.where(blocks == part) if n > 1 else questions
        table = here.withColumn("prefix", F.lower("prefix")).toArrow() if "prefix" in names else here.toArrow()

        def run(batches, table=table):
            asked = Questions(table)
            for found, extras in work(batches, asked):
                of = asked.table.take(pa.array(asked.rows[found.column("_of").to_numpy()]))
                arrays = [found.column(c) for c in carried] + [of.column(c) for c in names] + [extras(found, f.name) for f in extra]
                yield from pa.table(arrays, names=[f.name for f in schema]).combine_chunks().to_batches()

        found = taken.mapInArrow(run, schema)
        if "prefix" in names:  # in its own case again
            shown = here.select("question_id", F.col("prefix").alias("_shown"))
            found = found.drop("prefix").join(F.broadcast(shown), "question_id").withColumnRenamed("_shown", "prefix")
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def nearest(chunks: DataFrame, questions: DataFrame, ways: list[Way], block: int = QUESTIONS) -> DataFrame:
    """The way.k nearest chunks of each question and way, with `_way`, `distance` and `rank` (from 1).

    `chunks` has id, embedding, and what its ways need (source, language, readable, _cell); `questions` has
    question_id, query, and what they need (question_language, prefix, _cells). Distance is 1 - cosine in double precision to 6
    decimals; ties go by id. Vectors that are null, zero, not finite, or of another length than the
    longest question's are not found. All columns but the vectors come back.
    """

    def work(batches, asked):
        best = {w: Nearest(w.k, len(asked.rows), w.each) for w in ways}
        for b in batches:
            for rows, distance in _distances(b, asked):
                for w in ways:
                    admitted = asked.admitted(w.kind, rows)
                    best[w].offer(distance if admitted is None else np.where(admitted, distance, np.inf), rows)
        for w in ways:
            for found in best[w].slices():
                yield found, lambda t, c, w=w: t.column("distance") if c == "distance" else pa.array(np.full(t.num_rows, w.number, np.int32))

    extra = [T.StructField("_way", T.IntegerType()), T.StructField("distance", T.DoubleType())]
    rows = _passes(chunks, questions, work, extra, block)
    limit = F.create_map(*[F.lit(x) for w in ways for x in (w.number, w.k)])[F.col("_way")]
    first = lambda *by: F.row_number().over(Window.partitionBy("question_id", "_way", *by).orderBy("distance", "id"))
    rows = rows.withColumn("_part", F.floor(F.spark_partition_id() / FAN))
    keyed = reduce(lambda c, w: c.when(F.col("_way") == w.number, F.to_json(F.struct(*w.each))), [w for w in ways if w.each], F.when(F.lit(False), ""))
    rows = rows.withColumn("_key", keyed)

    def merged(rows, *by):
        if any(w.each for w in ways):
            rows = rows.withColumn("_n", first("_key", *by)).where("_key is null or _n = 1").drop("_n")
        return rows.withColumn("rank", first(*by)).where(F.col("rank") <= limit)

    return merged(merged(rows, "_part")).drop("_part", "_key")


def within(chunks: DataFrame, questions: DataFrame, most: float, block: int = QUESTIONS) -> DataFrame:
    """All pairs of a question and a chunk at a distance of `most` or less; see `nearest`."""

    def work(batches, asked):
        for b in batches:
            for rows, distance in _distances(b, asked):
                row, of = np.nonzero(distance <= most)
                found = pa.Table.from_batches([rows]).take(pa.array(row)).append_column("_of", pa.array(of)).append_column("distance", pa.array(distance[row, of]))
                yield found, lambda t, c: t.column(c)

    return _passes(chunks, questions, work, [T.StructField("distance", T.DoubleType())], block)
