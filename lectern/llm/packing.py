"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mixing
from ._common import Scratch, aside

CAPACITY = 2048
#: Slots of the mixed order (each a block of code points) that are packed together: some 500 sequences.
WINDOW_SLOTS = 64
#: Two white-space characters before a visible one: the only place where the vocabulary's look-ahead matters.
LOOKAHEAD = re.compile(r"\s\s\S")
PLAIN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
FULL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids of the byte-level BPE in a tokenizers JSON file.

    The file's own library encodes texts that hold the string of a special token. All others go through
    the same ranks in tiktoken, which gives the same ids several times faster (tests compare the two).
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model["added_tokens"]]
    # Byte-level alphabet: visible bytes stand for themselves, the others for the code points from 256 up.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    alphabet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(alphabet[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
    plain, full = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("plain", PLAIN_PATTERN), ("full", FULL_PATTERN)))
    own = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
        chosen = full if LOOKAHEAD.search(text) else plain
        return np.array(chosen.encode_ordinary(text), np.uint32)

    return encode


def pieces_of(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    names = [doc_id, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        encode = encoder(tokenizer)
        for b in batches:
            rows, out = [], [[], [], [], []]
            kept = []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(t), np.uint32(0)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(k)
                    for column, v in zip(out, (p, s, e - s, zlib.crc32(ids[s:e].tobytes())), strict=True):
                        column.append(v)
                    if with_ids:
                        kept.append(ids[s:e].astype(np.int32))
            columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    taken = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = taken.select(doc_id).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return taken.mapInArrow(run, schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema)


def best_two_fit(counts, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, repeats) that pack `counts[length]` pieces of each length.

    A bin takes the longest piece that fits until none does. Then its smallest piece gives way to the
    two unpacked pieces that fill the gap it leaves best, if they fill it better. Bins depend on lengths
    alone, so a bin is repeated for as long as its lengths last: a few thousand patterns at any size.
    """
    counts = np.array(counts, np.int64)
    out = []
    while counts.any():
        left, gap, chosen = counts.copy(), capacity, []
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            take = int(fitting[-1])
            n = min(int(left[take]), gap // take)
            chosen += [take] * n
            left[take] -= n
            gap -= n * take
        if gap and len(chosen) > 1:
            small = chosen[-1]
            left[small] += 1
            room = gap + small
            lengths = np.arange(room + 1)
            longest = np.maximum.accumulate(np.where(left[: room + 1] > 0, lengths, 0))  # available length up to each
            first = np.flatnonzero(left[: room + 1])
            first = first[first > 0]
            second = longest[room - first]
            same = (second == first) & (left[first] < 2)
            second = np.where(same, longest[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            best = int(np.argmax(total)) if len(total) else 0
            if len(total) and total[best] > small:
                pair = sorted((int(first[best]), int(second[best])), reverse=True)
                chosen = [*chosen[:-1], *pair]
                for x in pair:
                    left[x] -= 1
            else:
                left[small] -= 1
        chosen.sort(reverse=True)
        need = counts - left
        used = np.flatnonzero(need)
        times = int((counts[used] // need[used]).min())
        counts[used] -= times * need[used]
        out.append((chosen, times))
    return out


def pack(pieces: DataFrame, scratch: Scratch, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to every row of `pieces` (column length, 1 to capacity).

    Only a histogram of lengths (`capacity` counters) reaches the driver, and only the patterns made of
    it, at most a few thousand rows whatever the input, are broadcast. Rows get their place by their
    rank among the rows of their length; ranks come from counts by (length, bucket), so that a length
    which a third of all rows share is spread over buckets.
    """
    hist = [0] * (capacity + 1)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        hist[r["length"]] = r["n"]
    total = sum(hist)
    slots, done, sequence = [], [0] * (capacity + 1), 0
    for chosen, times in best_two_fit(hist, capacity):
        at = 0
        for length in sorted(set(chosen), reverse=True):
            n = chosen.count(length)
            slots.append((length, done[length], done[length] + n * times, sequence, n, at))
            done[length] += n * times
            at += n * length
        sequence += times
    plan = scratch.spark.createDataFrame(slots, "length long, lo long, hi long, first_sequence long, copies long, at long")

    buckets = max(64, total // 200_000)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    away, back = aside(names)
    key = [f"c{names.index(c)}" for c in key]
    rows = pieces.select(*away, "length").withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    within = Window.partitionBy("length", "bucket").orderBy(*key)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= lo and rank < hi")
    return placed.select(
        *back,
        F.expr("first_sequence + (rank - lo) div copies").alias("sequence_id"),
        F.expr("at + pmod(rank - lo, copies) * length").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenises `docs` and packs the pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and a closing 0; only one longer than `capacity` is cut, its first piece being
    the shorter. Null text is empty (one id, the 0); repeated ids and rows each keep their pieces; rows
    tied in every key get places of their own; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(pieces_of(docs, tokenizer, doc_id, text, capacity, with_ids), "pieces", batch=200)
    return pack(pieces, scratch, [doc_id, "piece"], capacity)


def pack_mixed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, window_slots: int = WINDOW_SLOTS, **how) -> DataFrame:
    """As pack_documents, but sequences are numbered in the order in which mix_sources (given `how`) mixes.

    Rows hold no order, so the places are computed from ids, sources and lengths again, with the mixing
    stage's own function. Documents that start in `window_slots` slots in turn are packed together, in a
    task of their own, and sequences stand in an order by chance inside their window: the first sequences,
    however many, hold the sources in their weights but for part of a window.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    of_doc = F.struct(
        F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(source).cast("string").alias("source"), F.coalesce(F.length(text), F.lit(0)).alias("chars")
    )
    pieces = scratch.write(pieces_of(docs.select(of_doc.alias("_doc"), text), tokenizer, "_doc", text, capacity), "pieces", batch=200)
    mixed = mixing.mix_sources(pieces.where("piece = 0").select("_doc.*"), doc_id="id", chars="chars", **how)
    windows = mixed.select("row", F.expr(f"slot div {int(window_slots)}").alias("window"))
    rows = pieces.select(F.col("_doc.id").alias(doc_id), F.col("_doc.row").alias("row"), *pieces.columns[1:]).join(windows, "row")
    rows = rows.select(doc_id, *pieces.columns[1:], "window", F.xxhash64(doc_id).alias("_key"))

    def packed(table):
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("_key").to_numpy(), length))
        counts = np.bincount(length, minlength=capacity + 1)
        at_length = np.r_[0, np.cumsum(counts)]
        sequence, offset, made = np.empty(len(length), np.int64), np.empty(len(length), np.int64), 0
        for chosen, times in best_two_fit(counts, capacity):
            at = 0
            for n_ids in sorted(set(chosen), reverse=True):
                n = chosen.count(n_ids)
                here = order[at_length[n_ids] : at_length[n_ids] + n * times]
                at_length[n_ids] += n * times
                rank = np.arange(n * times)
                sequence[here], offset[here] = made + rank // n, at + rank % n * n_ids
                at += n * n_ids
            made += times
        sequence = np.random.default_rng(int(table.column("window")[0].as_py())).permutation(made)[sequence]
        return table.drop_columns(["_key"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = T.StructType(rows.drop("_key").schema.fields).add("sequence_id", "long").add("offset", "long")
    placed = scratch.write(rows.groupBy("window").applyInArrow(packed, schema), "placed")
    first = first_sequences(placed.groupBy("window").agg((F.max("sequence_id") + 1).alias("n")), scratch)
    out = placed.join(first, "window").withColumn("sequence_id", F.col("first") + F.col("sequence_id"))
    return out.select(doc_id, *pieces.columns[1:], "sequence_id", "offset")


def first_sequences(counts: DataFrame, scratch: Scratch, bucket: int = 1024) -> DataFrame:
    """(window, first): how many sequences the windows before it have, of (window, n).

    A running sum in two steps, inside buckets of windows and over the buckets, so that no task has all
    windows and none of them reaches the driver.
    """
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.write(counts.withColumn("bucket", F.expr(f"window div {int(bucket)}")), "windows")
    inside = counts.select("window", "bucket", before(Window.partitionBy("bucket").orderBy("window")).alias("inside"))
    over = counts.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", before(Window.orderBy("bucket")).alias("over"))
    return inside.join(over, "bucket").select("window", (F.col("inside") + F.col("over")).alias("first"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of documents with its sequence and offset."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, tokenizer_path())
