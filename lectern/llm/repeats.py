"""Windows of text that also start earlier: what the suffix-array and the automaton operators share.

Texts are dealt to shards. In a shard every window of `width` symbols is given an anchor, the place of
the least hash among its grams of `gram` symbols, so that equal windows have equal anchors at equal
places; neighbouring windows with one anchor are a run. Shards exchange one packed line for each range
of anchor hashes instead of a row for each window, and get back a few bits for each run.
"""

from __future__ import annotations

import pickle
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_batches

#: Windows that one pass of the arrays takes, few enough for a core's cache; places in it have to fit PLACE_BITS.
CHUNK = 1 << 16
PLACE_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    return _few_powers(base)[:n] if n <= FEW else _powers(base, n)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


#: Powers that a process keeps, enough for a pass.
FEW = 1 << 17


@lru_cache(maxsize=2)
def _few_powers(base: np.uint64) -> np.ndarray:
    return _powers(base, FEW)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a polynomial hash spread over the word."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Hashes:
    """Hash of any stretch of a symbol array in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.inverse = powers(BASE_INVERSE, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * powers(BASE, len(symbols)), dtype=np.uint64, out=self.sums[1:])

    def of(self, starts, ends):
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


class Runs:
    """Runs of a shard: first and last window start, anchor, anchor hash, hash of the covered stretch."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int):
        """`bounds`: where each document starts, and the end of the last."""
        self.width = width
        lo, hi, anchor, of_anchor, content = [], [], [], [], []
        ends = np.repeat(bounds[1:], np.diff(bounds)) if len(symbols) else np.empty(0, np.int64)
        for at in range(0, max(len(symbols) - width + 1, 0), CHUNK):
            part = symbols[at : at + CHUNK + width - 1]
            hashes = Hashes(part)
            grams = np.arange(len(part) - gram + 1)
            least = mixed((hashes.sums[gram:] - hashes.sums[: len(grams)]) * hashes.inverse[: len(grams)])
            least = (least & ~np.uint64((1 << PLACE_BITS) - 1)) | grams.astype(np.uint64)
            span, want = 1, width - gram + 1
            while span < want:  # least of the next `span` grams
                step = min(span, want - span)
                least = np.minimum(least[:-step], least[step:])
                span += step
            place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
            starts = np.arange(len(place))
            place, starts = (x[at + starts + width <= ends[at : at + len(starts)]] for x in (place, starts))
            if not len(starts):
                continue
            new = np.flatnonzero((place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
            first, last = np.r_[0, new], np.r_[new, len(starts)] - 1
            a, b, p = starts[first], starts[last], place[first]
            lo.append(a + at)
            hi.append(b + at)
            anchor.append(p + at)
            # Anchors are least hashes, so they are mixed again before ranges are made of them.
            of_anchor.append(mixed(hashes.of(p, p + gram) ^ BASE))
            content.append(hashes.of(a, b + width) ^ (p - a).astype(np.uint64))
        none = [np.empty(0, np.int64)]
        self.lo, self.hi, self.anchor = (np.concatenate(x or none) for x in (lo, hi, anchor))
        self.of_anchor, self.content = (np.concatenate(x or none).astype(np.uint64) for x in (of_anchor, content))
        self.doc = np.searchsorted(bounds, self.lo, "right") - 1


# Shards -------------------------------------------------------------------------------------------

SHARD_BYTES = 4 << 20
#: Bytes of text for each bucket of the shard table.
BUCKET_BYTES = 16 << 20
NULL_ID = -(1 << 63)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string; bytes of equal weight are put together first."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append((a.dtype.str, len(a), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""))
    raw = pickle.dumps(parts)
    return struct.pack("<q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], struct.unpack("<q", data[:8])[0], "zstd", asbytes=True)
    out = []
    for kind, n, body in pickle.loads(raw):
        kind = np.dtype(kind)
        out.append(np.frombuffer(body, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.empty(0, kind))
    return out


class Shard:
    """Documents of a shard: their keys (ids; the least long for null), null marks, lengths and bytes."""

    def __init__(self, number: int, heads: bytes, texts: bytes):
        self.number = number
        self.keys, null, self.sizes = unpacked(heads)
        self.null = null.astype(bool)
        (self.text,) = unpacked(texts)
        self.bounds = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)


def shard_table(scratch: Scratch) -> str:
    return "lectern_shards_" + scratch.root.rpartition("-")[2]


def drop_shards(scratch: Scratch, *more: str) -> None:
    """Deletes the shards and other tables of an operator whose result is written."""
    scratch.spark.sql(f"DROP TABLE IF EXISTS {shard_table(scratch)}")
    for name in ("shards", *more):
        scratch.drop(name)


def packed_rows(rows: list[pa.Array]) -> bytes:
    """Arrow rows in one compressed string."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(rows)], names=["rest"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked_rows(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def deal_shards(docs: DataFrame, doc_id: str, text: str, scratch: Scratch, total: int, shard_bytes: int = SHARD_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Whole texts in shards of about `shard_bytes` (a longer text is a shard of its own), written bucketed.

    (shard long, heads binary, texts binary); later joins on the shard's number leave the texts in place.
    `total`: the bytes of all texts. With `carry`, names of columns, each row's values of them travel with it in `rest` (binary).
    """
    spark = docs.sparkSession
    taken = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"), *([F.struct(*carry).alias("rest")] if carry else []))

    def run(batches):
        from pyspark import TaskContext

        number, keys, held, size, rests = TaskContext.get().partitionId() << 33, [], [], 0, []

        def made():
            null = np.array([k is None for k in keys], np.uint8)
            ids = np.array([NULL_ID if k is None else k for k in keys], np.int64)
            heads = packed(ids, null, np.array([len(x) for x in held], np.int64))
            columns = [pa.array([number]), pa.array([heads], pa.binary()), pa.array([packed(np.frombuffer(b"".join(held), np.uint8))], pa.binary())]
            if carry:
                columns.append(pa.array([packed_rows(rests)], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=["shard", "heads", "texts", "rest"][: len(columns)])

        for b in batches:
            for k, (key, body) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                if carry:
                    rests.append(b.column(2).slice(k, 1))
                body = body.as_buffer().to_pybytes()
                keys.append(key)
                held.append(body)
                size += len(body)
                if size >= shard_bytes:
                    yield made()
                    number, keys, held, size, rests = number + 1, [], [], 0, []
        if keys:
            yield made()

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    name = shard_table(scratch)
    with arrow_batches(spark, 500):
        shards = taken.mapInArrow(run, "shard long, heads binary, texts binary" + ", rest binary" * bool(carry))
        shards.write.format("parquet").option("path", scratch.path("shards")).option("compression", "none").bucketBy(buckets, "shard").saveAsTable(name)
    return spark.table(name)


def range_bits(total_windows: int, shard_bytes: int = SHARD_BYTES) -> int:
    """Bits of a hash that number the ranges: about a million runs of 32 windows to each, 64 ranges at least.

    Larger shards get as much larger ranges. A shard's line for a range holds shard_bytes * 2^20 / total_windows
    runs: hundreds of them up to tens of gigabytes with the shards given, some up to terabytes; beyond, callers
    pass larger shards to keep the lines from getting short.
    """
    total_windows = total_windows * SHARD_BYTES // max(shard_bytes, SHARD_BYTES)
    return max(6, (total_windows >> 25).bit_length())


def by_range(hashes: np.ndarray, bits: int):
    """(range, slice) of a sorted hash array."""
    of = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else [0]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(of[s]), slice(int(s), int(e))


LINES = "r long, shard long, blob binary"
ANSWERS = "shard long, r long, bits binary"


def lines_of(number: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r for r, _ in found], pa.int64()), pa.array([number] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())],
        names=["r", "shard", "blob"],
    )


def answered(table: pa.Table, sizes: list[int], *columns: np.ndarray) -> pa.Table:
    """The answers of a range (bits, and owners where asked for), cut into what each line gets."""
    cuts = np.r_[0, np.cumsum(sizes)].astype(int)
    blobs = [packed(*(x[s:e] for x in columns)) for s, e in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"shard": table.column("shard"), "r": table.column("r"), "bits": pa.array(blobs, pa.binary())})


def exchange(lines: DataFrame, answer, scratch: Scratch, name: str) -> DataFrame:
    """Sends each range's lines to `answer` and gathers, for each shard, its answers in order of ranges."""
    sent = scratch.write(lines, f"{name}_lines", batch=1)
    back = scratch.write(sent.groupBy("r").applyInArrow(answer, ANSWERS), f"{name}_answers")
    scratch.drop(f"{name}_lines")
    return back.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("r", "bits"))).alias(name))


def answers_of(cell, kinds=(np.uint8, np.int64, np.int64)) -> list[np.ndarray]:
    """The answers of one shard, one after another: bits, keys and shards of owners (empty where not asked for)."""
    parts = [unpacked(x["bits"]) for x in cell or []]
    return [np.concatenate([x[k] for x in parts if k < len(x)] or [np.empty(0, kind)]) for k, kind in enumerate(kinds)]


def bits_of(cell) -> np.ndarray:
    return answers_of(cell)[0]


def owners_of(order: np.ndarray, new: np.ndarray, key: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """Key and shard of the first row of each row's group; zeros for the first rows themselves. `order` sorts the groups."""
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = [np.empty(len(order), np.int64) for _ in range(2)]
    for column, values in zip(out, (key, shard), strict=True):
        column[order] = np.where(new, 0, values[first])
    return out


#: Contents under one anchor hash that a shard tells apart before it leaves them to the windows.
CLASSES = 4
FIRST, MIXED, RECURRING = 1, 2, 4


class Classes:
    """Runs of a shard by anchor and content: what is asked of the ranges, and what the answers say.

    Runs of equal anchor and content hold equal windows, so all but the first are repeats. A first run is
    new as a whole unless another content goes with its anchor; then its windows are open. Where a shard
    has more than CLASSES contents with an anchor it sends one line saying so, and all of them are open:
    an anchor in a passage that a third of all documents hold costs a few entries for each shard.
    """

    def __init__(self, runs: Runs, keys: np.ndarray):
        g, c = runs.of_anchor, runs.content
        order = np.lexsort((runs.lo, keys[runs.doc], c, g))
        new_g = np.r_[True, g[order][1:] != g[order][:-1]][: len(order)]
        new_c = new_g | np.r_[True, c[order][1:] != c[order][:-1]][: len(order)]
        of_g = np.cumsum(new_g) - 1
        many = (np.bincount(of_g, new_c) > CLASSES)[of_g] if len(order) else np.empty(0, bool)
        self.order, self.first_here, self.many = order, new_c, many
        sent = new_g | new_c & ~many
        self.entry = np.cumsum(sent) - 1
        at = order[sent]
        self.g, self.c, self.flag = g[at], np.where(many[sent], np.uint64(0), c[at]), many[sent].astype(np.uint8)
        self.key = np.where(many[sent], 0, keys[runs.doc[at]])
        self.repeated_here = (np.bincount(of_g) > 1)[of_g] if len(order) else np.empty(0, bool)

    def lines(self, bits: int):
        return [(r, packed(self.g[s], self.c[s], self.key[s], self.flag[s])) for r, s in by_range(self.g, bits)]

    def judge(self, answers: np.ndarray):
        """For each run: repeated, open, recurring (booleans in the order of the runs)."""
        told = answers[self.entry] if len(self.entry) else np.empty(0, np.uint8)
        repeated = ~self.first_here | ~self.many & (told & FIRST == 0)
        is_open = ~repeated & (self.many | (told & MIXED > 0))
        out = np.zeros((3, len(self.order)), bool)
        out[:, self.order] = repeated, is_open, self.repeated_here | (told & RECURRING > 0)
        return out


def judge_classes(table: pa.Table, *, owners: bool = False) -> pa.Table:
    """Answers for one range of anchor hashes: bits, and with `owners` who holds the first of each content."""
    blobs = [unpacked(x) for x in table.column("blob").to_pylist()]
    sizes = [len(x[0]) for x in blobs]
    g, c, key, many = (np.concatenate([x[k] for x in blobs]) for k in range(4))
    shard = np.repeat(table.column("shard").to_numpy(), sizes)
    order = np.lexsort((shard, key, c, many, g))
    g, c, many = g[order], c[order], many[order]
    new_g = np.r_[True, g[1:] != g[:-1]]
    new_c = new_g | np.r_[True, c[1:] != c[:-1]] | np.r_[True, many[1:] != many[:-1]]
    of_g = np.cumsum(new_g) - 1
    told = np.where(new_c & (many == 0), FIRST, 0) | np.where((np.bincount(of_g, new_c) > 1)[of_g] | (np.bincount(of_g, many) > 0)[of_g], MIXED, 0)
    told |= np.where((np.bincount(of_g) > 1)[of_g], RECURRING, 0)
    bits = np.empty(len(order), np.uint8)
    bits[order] = told
    return answered(table, sizes, bits, *(owners_of(order, new_c, key, shard) if owners else ()))


def judge_windows(table: pa.Table, *, owners: bool = False) -> pa.Table:
    """For one range of window hashes: 1 for the first of each content, and with `owners` who holds it."""
    blobs = [unpacked(x) for x in table.column("blob").to_pylist()]
    sizes = [len(x[0]) for x in blobs]
    one, two, key = (np.concatenate([x[k] for x in blobs]) for k in range(3))
    shard = np.repeat(table.column("shard").to_numpy(), sizes)
    order = np.lexsort((shard, key, two, one))
    one, two = one[order], two[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    bits = np.empty(len(order), np.uint8)
    bits[order] = new
    return answered(table, sizes, bits, *(owners_of(order, new, key, shard) if owners else ()))


def covered(n: int, width: int, runs: Runs, repeated: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Symbols in a window of a repeated run, or in one of `windows` (their starts)."""
    edge = np.bincount(runs.lo[repeated], minlength=n + 1) - np.bincount(runs.hi[repeated] + width, minlength=n + 1)
    edge += np.bincount(windows, minlength=n + 1) - np.bincount(windows + width, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def starts_in(runs: Runs, chosen: np.ndarray) -> np.ndarray:
    """All window starts of the chosen runs."""
    lo, n = runs.lo[chosen], (runs.hi - runs.lo + 1)[chosen]
    return np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n) + np.arange(n.sum())
