"""Repeated byte strings by external induced suffix sorting of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from ._common import Scratch
from .suffix_sort import MEMORY, sorted_suffixes

WIDTH, GRAM = 100, 32
#: Windows at neighbouring places before an anchor that are judged by the bytes they share.
SPAN = 32
SYMBOLS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class Pieces:
    """Open runs cut where the place of the anchor passes a multiple of SPAN.

    All windows of a piece share WIDTH - SPAN + 1 bytes at one place; equal windows have pieces with
    equal shared bytes. So pieces are judged as runs are, with the shared bytes for an anchor.
    """

    def __init__(self, symbols: np.ndarray, runs: repeats.Runs, is_open: np.ndarray):
        starts = repeats.starts_in(runs, is_open)
        n = (runs.hi - runs.lo + 1)[is_open]
        run = np.repeat(np.arange(len(n)), n)
        place = (np.repeat(runs.anchor[is_open], n) - starts) // SPAN
        new = np.r_[True, (run[1:] != run[:-1]) | (place[1:] != place[:-1])][: len(starts)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(starts)][: len(first)] - 1
        self.lo, self.hi = starts[first], starts[last]
        self.doc = runs.doc[is_open][run[first]]
        shared = runs.anchor[is_open][run[first]] - place[first] * SPAN
        hashes = repeats.Hashes(symbols)
        self.of_anchor = repeats.mixed(hashes.of(shared, shared + WIDTH - SPAN + 1) ^ (place[first].astype(np.uint64) << np.uint64(40)))
        self.content = hashes.of(self.lo, self.hi + WIDTH) ^ (shared - self.lo).astype(np.uint64)


class SortedWindows:
    """Windows of the pieces still open: grouped by a suffix array of their bytes.

    Each group of equal windows is a stretch of suffixes that share WIDTH bytes with the ones before them, as
    the prefixes carried through the sort tell; its first window in the shard is sent to the range of its
    hash, to be compared with the other shards' firsts.
    """

    def __init__(self, text: np.ndarray, symbols: np.ndarray, pieces: Pieces, is_open: np.ndarray, keys: np.ndarray, memory: int = MEMORY):
        self.starts = repeats.starts_in(pieces, is_open)
        sizes = (pieces.hi - pieces.lo + 1)[is_open]
        doc = np.repeat(pieces.doc[is_open], sizes)
        # Bytes of all pieces, each after a mark, are sorted together; 1 is the mark, bytes start at 2.
        spans = sizes + WIDTH
        cut = np.r_[0, np.cumsum(spans)[:-1]][: len(spans)].astype(np.int64)
        inside = np.arange(spans.sum()) - np.repeat(cut, spans)
        at = np.repeat(pieces.lo[is_open], spans) + inside - 1
        joined = np.where(inside == 0, 1, text[np.maximum(at, 0)].astype(np.uint16) + 2).astype(np.uint16)
        window_of = np.full(len(joined), -1, np.int64)
        window_of[np.repeat(cut + 1, sizes) + np.arange(len(self.starts)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]][: len(sizes)], sizes)] = np.arange(len(self.starts))
        order, shared = sorted_suffixes(joined, WIDTH, memory)
        number = np.cumsum(shared < WIDTH)
        window = window_of[order]
        group = np.empty(len(self.starts), np.int64)
        group[window[window >= 0]] = number[window >= 0]
        self.order = np.lexsort((self.starts, keys[doc], group))
        group = group[self.order]
        self.first = np.r_[True, group[1:] != group[:-1]][: len(group)]
        chosen = self.order[self.first]
        s = self.starts[chosen]
        one = repeats.Hashes(symbols).of(s, s + WIDTH)
        two = repeats.Hashes(repeats.mixed(symbols ^ np.uint64(0xA5A5A5A5A5A5A5A5))).of(s, s + WIDTH)
        self.send = np.argsort(one, kind="stable")
        self.one, self.two, self.key = one[self.send], two[self.send], keys[doc[chosen]][self.send]

    def lines(self, bits):
        return [(r, repeats.packed(self.one[s], self.two[s], self.key[s])) for r, s in repeats.by_range(self.one, bits)]

    def repeated(self, answers: np.ndarray) -> np.ndarray:
        """Starts of the windows that also start earlier."""
        if not len(self.starts):
            return self.starts
        told = np.empty(len(self.send), np.uint8)
        told[self.send] = answers
        return self.starts[self.order[~self.first | (told[np.cumsum(self.first) - 1] == 0)]]


def remove_repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, carry: list[str] | None = None, shard_bytes: int = repeats.SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) for every row of `docs`.

    `carry` names columns whose values come back with their row, as the fields of a struct `rest`.

    A byte goes if a string of WIDTH bytes that covers it also starts earlier; all strings are judged on
    the input. Anchors and shared bytes tell which strings may recur (see repeats); the rest, where one
    text leaves another, are sorted in each shard by induced suffix sorting, and the first of each group
    is compared between shards by a 128-bit hash. A cut inside a UTF-8 character leaves bytes that
    kept_text shows as U+FFFD; kept_sha256 is of the bytes themselves.

    Null text is empty; texts shorter than WIDTH are kept; rows tied in doc_id follow each other by shard
    and place in it; ids are whole numbers (a text id raises), null ids come first; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shards = repeats.deal_shards(docs, doc_id, text, scratch, total, shard_bytes, carry)
    bits = repeats.range_bits(total, shard_bytes)

    def prepared(row):
        shard = repeats.Shard(row["shard"], row["heads"], row["texts"])
        symbols = SYMBOLS[shard.text]
        runs = repeats.Runs(symbols, shard.bounds, WIDTH, GRAM)
        return shard, symbols, runs, repeats.Classes(runs, shard.keys)

    def refined(row):
        shard, symbols, runs, classes = prepared(row)
        repeated, is_open, _ = classes.judge(repeats.bits_of(row["classes"]))
        pieces = Pieces(symbols, runs, is_open)
        return shard, symbols, runs, repeated, pieces, repeats.Classes(pieces, shard.keys)

    def ask_classes(batches):
        for b in batches:
            for row in b.to_pylist():
                *_, classes = prepared(row)
                yield repeats.lines_of(row["shard"], classes.lines(bits))

    def ask_pieces(batches):
        for b in batches:
            for row in b.to_pylist():
                *_, classes = refined(row)
                yield repeats.lines_of(row["shard"], classes.lines(bits))

    def sort_windows(batches):
        # The sorted groups are kept, so that the last step does not sort again.
        for b in batches:
            for row in b.to_pylist():
                shard, symbols, runs, repeated, pieces, classes = refined(row)
                again, is_open, _ = classes.judge(repeats.bits_of(row["pieces"]))
                windows = SortedWindows(shard.text, symbols, pieces, is_open, shard.keys)
                whole = np.r_[runs.lo[repeated], pieces.lo[again]], np.r_[runs.hi[repeated], pieces.hi[again]]
                state = repeats.packed(*whole, windows.starts, windows.order, windows.first.astype(np.uint8), windows.send)
                found = [(r, x) for r, x in windows.lines(bits)]
                yield repeats.lines_of(row["shard"], [(-1, state), *found])

    def finish(batches):
        for b in batches:
            for row in b.to_pylist():
                yield kept_rows(row)

    def kept_rows(row):
        shard = repeats.Shard(row["shard"], row["heads"], row["texts"])
        windows = SortedWindows.__new__(SortedWindows)
        lo, hi, windows.starts, windows.order, first, windows.send = repeats.unpacked(row["state"])
        windows.first = first.astype(bool)
        whole = repeats.Runs.__new__(repeats.Runs)
        whole.lo, whole.hi = lo, hi
        gone = repeats.covered(len(shard.text), WIDTH, whole, np.ones(len(lo), bool), windows.repeated(repeats.bits_of(row["windows"])))
        out = [[], [], [], [], [], []]
        for k, (s, e) in enumerate(zip(shard.bounds, shard.bounds[1:], strict=False)):
            lost = gone[s:e]
            n = int(lost.sum())
            kept = (shard.text[s:e][~lost] if n else shard.text[s:e]).tobytes()
            spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if n else 0
            values = (None if shard.null[k] else int(shard.keys[k]), int(e - s), n, spans, hashlib.sha256(kept).hexdigest())
            for column, v in zip(out, (*values, kept.decode("utf-8", "replace") if with_text else None), strict=True):
                column.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 6 if with_text else 5]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(columns)]
        if carry:
            columns, names = [*columns, repeats.unpacked_rows(row["rest"])], [*names, "rest"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    try:
        classes = repeats.exchange(shards.mapInArrow(ask_classes, repeats.LINES), repeats.judge_classes, scratch, "classes")
        known = shards.join(classes, "shard", "left")
        pieces = repeats.exchange(known.mapInArrow(ask_pieces, repeats.LINES), repeats.judge_classes, scratch, "pieces")
        lines = scratch.write(known.join(pieces, "shard", "left").mapInArrow(sort_windows, repeats.LINES), "sorted", batch=1)
        windows = repeats.exchange(lines.where("r >= 0"), repeats.judge_windows, scratch, "windows")
        states = lines.where("r < 0").select("shard", F.col("blob").alias("state"))
        known = shards.join(states, "shard").join(windows, "shard", "left")
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
        schema = T._parse_datatype_string(schema)
        if carry:
            schema = schema.add("rest", docs.select(F.struct(*carry).alias("rest")).schema["rest"].dataType)
        return scratch.write(known.mapInArrow(finish, schema), "result", batch=1)
    finally:
        repeats.drop_shards(scratch, "classes_answers", "pieces_answers", "sorted", "windows_answers")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
win AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM n WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
isl AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM again)),
sp AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM isl GROUP BY doc_id, g),
kp AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS pe FROM sp),
ag AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, string_agg(substring(h, 2 * pe + 1, 2 * (s - pe)), '' ORDER BY s) AS body, max(e) AS last
  FROM kp JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(body || substring(h, 2 * last + 1), h))) AS kept_sha256
FROM n LEFT JOIN ag USING (doc_id)
"""
