"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, aside, connected_components

SEED = 42
BITS = 64
#: Reference fingerprints; the first are as many as a block has bits at most, seeded.
N_PIVOTS = 32
MAX_BITS = 3


def fingerprint_of(data: bytes, words: int = 3) -> int:
    """64-bit SimHash of UTF-8 bytes: lower-cased A-Z, shingles of `words` words with repeats."""
    flat = b" ".join(data.lower().split())
    if not flat:
        return 0
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(spaces) < words - 1:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        starts = [0, *(spaces[: len(spaces) + 1 - words] + 1).tolist()]
        ends = [*spaces[words - 1 :].tolist(), len(flat)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[s:e], SEED) for s, e in zip(starts, ends, strict=True)]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 15):  # a very long text is counted piece by piece
        ones += np.unpackbits(h[k : k + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """The columns of `docs` but its text, and fp (the 64 bits as a signed long). Null text is empty."""
    names = [c for c in docs.columns if c not in (text, "fp")]
    away, back = aside(names)
    kept = [f"c{k}" for k in range(len(names))]

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            fps = np.fromiter((fingerprint_of(t.as_buffer().to_pybytes(), words) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    taken = docs.select(*away, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    schema = taken.drop("bytes").schema.add("fp", "long")
    return taken.mapInArrow(run, schema).select(*back, "fp")


class PivotTables:
    """Hamming distances of every block value to every pivot, and what follows from them.

    The 64 bits are cut into `blocks` blocks. Distances restricted to a block are 1-Lipschitz too, so
    two fingerprints at distance 3 or less have, in at least blocks - 3 blocks, a coordinate difference
    of 0 to every pivot. Each choice of blocks - 3 blocks is a table; rows with equal coordinates in it
    meet. Whole distances are sums over the blocks, and a pair whose coordinates differ by more than 3
    for any pivot is discarded before its bits are compared.

    A block has few enough bits for its pivot distances to determine them, so rows with equal coordinates in a
    block have equal bits there; the discard by whole distances is what keeps unlike rows from being compared.
    """

    def __init__(self, blocks: int, max_bits: int = MAX_BITS):
        self.max_bits = max_bits
        cuts = [BITS * k // blocks for k in range(blocks + 1)]
        self.ranges = list(zip(cuts, cuts[1:], strict=False))
        self.choices = list(combinations(range(blocks), blocks - max_bits))
        rng = np.random.default_rng(SEED)
        pivots = rng.integers(0, 1 << 63, N_PIVOTS, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, N_PIVOTS, dtype=np.uint64)
        mixes = rng.integers(1 << 62, (1 << 63) - 1, N_PIVOTS, dtype=np.uint64) | np.uint64(1)
        self.distance, self.signature = [], []
        for lo, hi in self.ranges:
            values = np.arange(1 << (hi - lo), dtype=np.uint64)
            part = (pivots >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            table = np.bitwise_count(values[:, None] ^ part[None, :]).astype(np.uint8)
            self.distance.append(table)
            self.signature.append((table.astype(np.uint64) * mixes).sum(1))

    def _values(self, fps):
        return [((fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64) for lo, hi in self.ranges]

    def keys(self, fps):
        """For each table, a 64-bit mix of the coordinates in its blocks; equal coordinates give equal keys."""
        sig = [s[v] for s, v in zip(self.signature, self._values(fps), strict=True)]
        out = []
        for t, chosen in enumerate(self.choices):
            x = np.full(len(fps), (t * 0x9E3779B97F4A7C15 + 1) % (1 << 64), np.uint64)
            for b in chosen:
                x = (x ^ sig[b]) * np.uint64(0xFF51AFD7ED558CCD)
                x ^= x >> np.uint64(32)
            out.append(x)
        return out

    def coordinates(self, fps):
        """Distances of every fingerprint to every pivot."""
        return sum(t[v] for t, v in zip(self.distance, self._values(fps), strict=True))

    def spanning_links(self, groups, fps):
        """Links (i, j) that join what links join inside equal `groups` (sorted): no more than rows."""
        n = len(fps)
        coords = self.coordinates(fps)
        parent = np.arange(n)
        out = []
        near = np.flatnonzero(groups[1:] == groups[:-1])
        step = 1
        while len(near):
            far = near + step
            apart = near[parent[near] != parent[far]]
            mates = apart + step
            close = np.abs(coords[apart].astype(np.int8) - coords[mates].astype(np.int8)).max(1, initial=0) <= self.max_bits
            apart, mates = apart[close], mates[close]
            linked = np.bitwise_count(fps[apart] ^ fps[mates]) <= self.max_bits
            for i, j in zip(apart[linked].tolist(), mates[linked].tolist(), strict=True):
                a, b = int(parent[i]), int(parent[j])
                if a != b:
                    parent[parent == max(a, b)] = min(a, b)
                    out.append((i, j))
            step += 1
            near = near[near + step < n]
            near = near[groups[near] == groups[near + step]]
        return out


def blocks_for(distinct: int) -> int:
    """Blocks so that unlike fingerprints seldom meet: 25 bits to a key up to 2^25 of them, then 32, 36, 40."""
    return next((b for b, limit in ((5, 1 << 25), (6, 1 << 31), (7, 1 << 36)) if distinct <= limit), 8)


def near_duplicate_fingerprints(fps: DataFrame, scratch: Scratch, chunk: int = 4096, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component): the least fingerprint, as a signed long, that each distinct `fp` reaches by links.

    Fingerprints without links are left out. A key that more than `chunk` fingerprints share is cut into
    chunks by hash, and every pair of chunks meets in a group of its own, so no task holds more than two
    chunks of one key; inside a group only a spanning set of links leaves the task.
    """
    tables = PivotTables(blocks_for(fps.count()), max_bits)

    def keyed(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for k in tables.keys(own.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(own)], names=["key", "fp"])

    rows = scratch.write(fps.select("fp").mapInArrow(keyed, "key long, fp long"), "keys")
    heavy = scratch.write(
        rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts")),
        "heavy",
    )
    if heavy.isEmpty():
        dealt = rows.select(F.col("key").alias("grp"), "fp")
    else:
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        split = rows.join(heavy, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
        other = F.explode(F.expr("sequence(0, parts - 1)")).alias("other")
        split = split.select("key", "fp", "part", other)
        dealt = split.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("grp"), "fp")

    def links(batches):
        held_g, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def done(g, f):
            pairs = tables.spanning_links(g, f.view(np.uint64))
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(f[i]), pa.array(f[j])], names=["a", "b"])

        for b in batches:
            held_g = np.concatenate([held_g, b.column(0).to_numpy(zero_copy_only=False)])
            held_f = np.concatenate([held_f, b.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(held_g, held_g[-1])) if len(held_g) else 0  # the last group may go on
            if cut >= 8192:
                yield from done(held_g[:cut], held_f[:cut])
                held_g, held_f = held_g[cut:], held_f[cut:]
        yield from done(held_g, held_f)

    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    edges = scratch.write(dealt.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(links, "a long, b long"), "links")
    scratch.drop("keys")
    return connected_components(edges, scratch).select(F.col("vertex").alias("fp"), F.col("component"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for every row of `docs`.

    Fingerprints link at `max_bits` or fewer differing bits; equal ones are collapsed first, so copies
    cost one row. Null and blank texts have fingerprint zero and link like any other; texts of fewer
    words than a shingle count whole; rows with a null id join components but never name one; repeated
    ids keep their rows; an empty table gives an empty result. A text of any length is hashed whole in its
    row's task (some 20 times its bytes meanwhile). Columns other than the id and the text are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs.select(F.col(doc_id), F.col(text).alias("_text")), "_text", words), "marked", batch=500)
    reps = scratch.write(marked.groupBy("fp").agg(F.min(doc_id).alias("least_id")), "reps")
    comps = near_duplicate_fingerprints(reps, scratch, max_bits=max_bits)
    joined = reps.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Written first: a join with an aggregate on its own key could not be split where one component is large.
    names = scratch.write(joined.groupBy("component").agg(F.min("least_id").alias("component_id")), "names")
    of_fp = scratch.write(joined.join(names, "component").select("fp", "component_id"), "of_fp")
    return marked.join(of_fp, "fp").select(doc_id, "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = simhash_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
