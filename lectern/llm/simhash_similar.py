"""Groups of texts at a similarity of their shingle sets: proposed by SimHash and by prefixes, verified on the sets."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, aside, connected_components

LANES = 4
BITS = 64 * LANES
SEED = 42
N_PIVOTS = 32
LANE_SEEDS = [np.uint64(x) for x in np.random.default_rng(SEED).integers(1, 1 << 63, LANES)]


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """Hashes of the shingles of `words` words, repeats included; fewer words are one shingle, none give none."""
    flat = b" ".join(data.lower().split())
    if not flat:
        return np.empty(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    if len(spaces) < words - 1:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    starts = [0, *(spaces[: len(spaces) + 1 - words] + 1).tolist()]
    ends = [*spaces[words - 1 :].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of BITS bits over shingle hashes, repeats included; none give zeros."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 13):
        part = h[k : k + (1 << 13), None] * np.array(LANE_SEEDS)[None, :] | np.uint64(0)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(32)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).view(np.uint64)


class Overlaps:
    """What Jaccard similarity of `similarity` or more demands of two sets, in whole numbers.

    All sets are ordered alike: shingles that a sample shows to be frequent come last, by their counts,
    the others by hash. Two similar sets share a shingle in their prefixes, and for the first one they
    share what follows it in either set has to hold the rest of the overlap. Any order gives the same pairs;
    this one keeps frequent shingles out of the prefixes.
    """

    def __init__(self, similarity: float, frequent: np.ndarray, counts: np.ndarray):
        t = Fraction(similarity).limit_denominator(1000)
        self.num, self.den = t.numerator, t.denominator
        order = np.argsort(frequent)
        self.frequent, self.counts = frequent[order], counts[order]

    def prefix(self, tokens: np.ndarray) -> np.ndarray:
        """The first n - ceil(similarity * n) + 1 of a set's n shingles."""
        n = len(tokens)
        if len(self.frequent) and n:
            at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
            tokens = tokens[np.lexsort((tokens, np.where(self.frequent[at] == tokens, self.counts[at], 0)))]
        return tokens[: n + 1 + -self.num * n // self.den] if n else tokens

    def needed(self, sizes):
        """Shingles that two sets have to share, from the sum of their sizes."""
        return -(-self.num * sizes // (self.num + self.den))

    def candidates(self, rows: np.ndarray, all_pairs: bool):
        """Pairs (i, j) inside equal groups that may be similar; only neighbours unless `all_pairs`.

        Columns of `rows`: group (sorted), rep, size, place in the prefix and, with `all_pairs`, component,
        whose members are not paired, and the parities of the shingles in 256 classes, which differ in no
        more classes than the sets do in shingles.
        """
        groups, sizes, places = rows[:, 0], rows[:, 2], rows[:, 3]
        near, step = np.flatnonzero(groups[1:] == groups[:-1]), 1
        while len(near):
            i, j = near, near + step
            if all_pairs:
                apart = rows[i, 4] != rows[j, 4]
                i, j = i[apart], j[apart]
            both = sizes[i] + sizes[j]
            need = self.needed(both)
            may = np.minimum(sizes[i] - places[i], sizes[j] - places[j]) >= need
            i, j = i[may], j[may]
            if all_pairs:
                differ = np.bitwise_count((rows[i, 5:] ^ rows[j, 5:]).view(np.uint64)).sum(1, dtype=np.int64)
                close = differ <= (both - 2 * need)[may]
                i, j = i[close], j[close]
            yield i, j
            if not all_pairs:
                return
            step += 1
            near = near[near + step < len(rows)]
            near = near[groups[near] == groups[near + step]]

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        return len(np.intersect1d(a, b, assume_unique=True)) >= self.needed(len(a) + len(b))


class SampledTables:
    """Tables of pivot distances over samples of the bits.

    A pair whose fingerprints differ in a share p of their bits has equal distances to all pivots over a
    sample of b bits with probability (1 - p)^b. Distances to the pivots over all bits discard what differs
    by more than the limit. The tables propose links early, so that large groups need not be compared pair
    by pair; what they miss or propose wrongly changes no result (see similar_components).
    """

    def __init__(self, distinct: int, similarity: float, tables: int = 8):
        # Pairs whose shingle sets have this similarity differ in about this share of the bits.
        share = math.acos(2 * similarity / (1 + similarity)) / math.pi
        self.limit = math.ceil(share * BITS)
        self.sample = max(12, min(48, distinct.bit_length() - 2))
        self.tables = tables
        rng = np.random.default_rng(SEED)
        self.bits = [np.sort(rng.choice(BITS, self.sample, replace=False)) for _ in range(self.tables)]
        self.pivots = rng.integers(0, 256, (N_PIVOTS, BITS // 8), dtype=np.uint8)
        # Over single bits a pivot's distance is 0 or 1, so equal distances to it mean equal bits.
        self.weights = np.uint64(1) << np.arange(self.sample, dtype=np.uint64)

    def keys(self, fps: np.ndarray):
        flat = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1)
        reference = np.unpackbits(self.pivots[0])
        for t, chosen in enumerate(self.bits):
            apart = (flat[:, chosen] ^ reference[chosen]).astype(np.uint64)
            key = apart @ self.weights
            yield (key << np.uint64(12) | np.uint64(t % 4096)) * np.uint64(0x9E3779B97F4A7C15)

    def spanning_links(self, groups: np.ndarray, fps: np.ndarray):
        """Links (i, j) that join what links join inside equal `groups` (sorted): no more than rows."""
        n = len(groups)
        pivots = self.pivots.view(np.uint64)
        coords = np.stack([np.bitwise_count(fps ^ p).sum(1, dtype=np.int16) for p in pivots[:8]], 1)
        parent, out, step = np.arange(n), [], 1
        near = np.flatnonzero(groups[1:] == groups[:-1])
        while len(near):
            apart = near[parent[near] != parent[near + step]]
            mates = apart + step
            close = np.abs(coords[apart] - coords[mates]).max(1, initial=0) <= self.limit
            apart, mates = apart[close], mates[close]
            linked = np.bitwise_count(fps[apart] ^ fps[mates]).sum(1, dtype=np.int64) <= self.limit
            for i, j in zip(apart[linked].tolist(), mates[linked].tolist(), strict=True):
                a, b = int(parent[i]), int(parent[j])
                if a != b:
                    parent[parent == max(a, b)] = min(a, b)
                    out.append((i, j))
            step += 1
            near = near[near + step < n]
            near = near[groups[near] == groups[near + step]]
        return out


def _in_chunks(dealt: DataFrame, scratch: Scratch, name: str, chunk: int) -> DataFrame:
    """`dealt` (grp, rep, ...) with groups of more than `chunk` rows cut into chunks that meet pair by pair."""
    rest = [c for c in dealt.columns if c != "grp"]
    heavy = scratch.write(dealt.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > chunk), name)
    if heavy.isEmpty():
        return dealt
    dealt = dealt.join(heavy, "grp", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return dealt.select(F.xxhash64("grp", F.least("part", "other"), F.greatest("part", "other")).alias("grp"), *rest)


def _whole_groups(batches):
    """Sorted rows of longs in matrices that never part a group."""
    held = None
    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
        held = rows if held is None else np.concatenate([held, rows])
        cut = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0
        if cut >= 8192:
            yield held[:cut]
            held = held[cut:]
    if held is not None and len(held):
        yield held


def _pairs(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _frequent(numbered: DataFrame, text: Column, words: int, scratch: Scratch, least: int = 3, most: int = 500_000):
    """Shingles that at least `least` of some 20,000 texts (a thirty-second of all, if more) hold, and their counts."""
    every = min(32, max(1, numbered.count() // 20_000))

    def tokens(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_buffer().to_pybytes(), words)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64))], names=["token"])

    taken = numbered.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select(text)
    counted = taken.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = scratch.write(counted, "sampled", batch=500).orderBy(F.desc("n"), "token").limit(most).toArrow()
    return found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()


def similar_components(docs: DataFrame, doc_id: str, text: str, words: int = 5, similarity: float = 0.8, chunk: int = 4096) -> DataFrame:
    """`docs` with component_id (smallest doc_id reachable by links, itself included) and leader.

    Texts link when the Jaccard similarity of their sets of shingles of `words` words is `similarity` or
    more; leader marks one row of each component, the first with its smallest id. Equal sets are collapsed
    first. SimHash tables and neighbours in equal prefix shingles propose links, which are verified on the
    sets; then every pair that prefixes allow and that is not yet in one component is verified too, so no
    link between components is missed. Keys that more than `chunk` sets share are cut into chunks that
    meet pair by pair. Null and blank texts have the empty set and are one group; rows without an id name
    no component unless all its rows lack one; an empty table gives an empty result. A text of any length is
    hashed whole in its row's task (some 30 times its bytes meanwhile). Columns named as a result replace the
    input's; all others come back, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    kept = [c for c in docs.columns if c not in ("component_id", "leader")]
    lanes, parities, whole = ([f"_{x}{k}" for k in range(n)] for x, n in (("f", LANES), ("b", LANES), ("s", 2)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    away, back = aside(kept)
    numbered = scratch.write(docs.select(*away, F.monotonically_increasing_id().alias("row")), "rows")
    body = F.coalesce(F.col(f"c{kept.index(text)}"), F.lit("")).cast("binary").alias("bytes")
    overlaps = Overlaps(similarity, *_frequent(numbered, body, words, scratch))

    def fingerprint(batches):
        for b in batches:
            longs, prefixes = np.empty((b.num_rows, 2 * LANES + 3), np.uint64), []
            for k, t in enumerate(b.column(b.num_columns - 1)):
                h = shingle_hashes(t.as_buffer().to_pybytes(), words)
                tokens = np.unique(h)
                odd = np.packbits(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1)
                digest = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes(), SEED), np.uint64)
                longs[k] = [*digest, len(tokens), *wide_fingerprint(h), *odd.view(np.uint64)]
                prefixes.append(overlaps.prefix(tokens).view(np.int64))
            offsets = np.r_[0, np.cumsum([len(x) for x in prefixes])].astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
            made = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in longs.T]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made, prefix], names=["id", "row", *whole, "_size", *lanes, *parities, "_prefix"])

    taken = numbered.select(F.col(f"c{kept.index(doc_id)}").alias("id"), "row", body)
    schema = taken.drop("bytes").schema
    for name in (*whole, "_size", *lanes, *parities):
        schema = schema.add(name, "long")
    marked = scratch.write(taken.mapInArrow(fingerprint, schema.add("_prefix", T.ArrayType(T.LongType()))), "marked", batch=500)
    least = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")
    first = F.first(F.struct("_size", *lanes, *parities, "_prefix")).alias("_of")
    reps = marked.groupBy(*whole).agg(least, first).select(*whole, "least", "_of.*").withColumn("rep", F.monotonically_increasing_id())
    reps = scratch.write(reps, "reps")
    of_row = scratch.write(marked.select("row", *whole), "of_row")
    scratch.drop("marked")
    tables = SampledTables(reps.count(), similarity)

    def keyed(batches):
        for b in batches:
            fps = np.stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(LANES)], 1).view(np.uint64)
            for k in tables.keys(fps):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *b.columns], names=["grp", "rep", *lanes])

    def links(batches):
        for rows in _whole_groups(batches):
            pairs = tables.spanning_links(rows[:, 0], np.ascontiguousarray(rows[:, 2:]).view(np.uint64))
            if pairs:
                i, j = np.array(pairs).T
                yield _pairs(rows[i, 1], rows[j, 1])

    def shared(batches):
        for rows in _whole_groups(batches):
            same = rows[1:, 0] == rows[:-1, 0]
            rows = rows[np.r_[False, same] | np.r_[same, False]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["grp", "rep", "size", "place"])

    def candidates(all_pairs):
        def run(batches):
            for rows in _whole_groups(batches):
                for i, j in overlaps.candidates(rows, all_pairs):
                    yield _pairs(rows[i, 1], rows[j, 1])

        return run

    def sorted_groups(df):
        return df.repartition(parts, "grp").sortWithinPartitions("grp", "rep")

    columns = "grp long, rep long, " + ", ".join(f"{x} long" for x in lanes)
    dealt = _in_chunks(reps.select("rep", *lanes).mapInArrow(keyed, columns), scratch, "heavy", chunk)
    likely = scratch.write(sorted_groups(dealt).mapInArrow(links, "a long, b long").distinct(), "likely")
    dealt = reps.select("rep", F.col("_size").alias("size"), F.posexplode("_prefix").alias("place", "grp"))
    dealt = dealt.select("grp", "rep", "size", F.col("place").cast("long").alias("place"))
    dealt = sorted_groups(_in_chunks(dealt, scratch, "frequent", chunk))
    met = scratch.write(dealt.mapInArrow(shared, "grp long, rep long, size long, place long"), "met")
    scratch.free_shuffles()
    likely = scratch.write(likely.unionByName(sorted_groups(met).mapInArrow(candidates(False), "a long, b long")).distinct(), "proposed")

    reps = scratch.write(reps.drop("_prefix"), "slim_reps")
    scratch.drop("reps")
    scratch.free_shuffles()

    def set_of(body):
        return np.unique(shingle_hashes(body.as_buffer().to_pybytes(), words))

    def verify(batches):
        last, tokens = None, None
        for b in batches:
            ok = []
            for key, one, two in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if key != last:
                    last, tokens = key, set_of(two)
                ok.append(overlaps.similar(set_of(one), tokens))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs, name):
        some = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(reps.select("rep", "least.row"), "rep")
        texts = numbered.select("row", body).join(some, "row").select("rep", "bytes")
        texts = scratch.write(texts, f"{name}_texts")
        scratch.free_shuffles()
        both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("bytes").alias("one")), "a")
        both = both.join(texts.select(F.col("rep").alias("b"), F.col("bytes").alias("two")), "b")
        found = scratch.write(both.select("a", "b", "one", "two").mapInArrow(verify, "a long, b long"), name, batch=500)
        scratch.drop(f"{name}_texts")
        scratch.free_shuffles()
        return found

    edges = verified(likely, "links")
    comps = connected_components(edges, scratch).withColumnRenamed("vertex", "rep")
    comps = scratch.write(comps, "components")
    # Pairs that prefixes allow between components: all of them are verified.
    open_rows = met.join(comps, "rep", "left").join(reps.select("rep", *parities), "rep")
    open_rows = open_rows.select("grp", "rep", "size", "place", F.coalesce("component", "rep").alias("component"), *parities)
    open_pairs = scratch.write(sorted_groups(open_rows).mapInArrow(candidates(True), "a long, b long").distinct(), "open")
    scratch.drop("met")
    scratch.free_shuffles()
    more = verified(scratch.write(open_pairs.join(likely, ["a", "b"], "left_anti"), "untried"), "more_links")
    if not more.isEmpty():
        comps = connected_components(edges.unionByName(more), scratch).withColumnRenamed("vertex", "rep")

    joined = reps.select(*whole, "least", "rep").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # Written first: a join with an aggregate on its own key could not be split where one component is large.
    names = scratch.write(joined.groupBy("component").agg(F.min("least").alias("first")), "names")
    of_set = scratch.write(joined.join(names, "component").select(*whole, "first"), "of_set")
    told = of_row.join(of_set, whole).select("row", F.col("first.id").alias("component_id"), (F.col("first.row") == F.col("row")).alias("leader"))
    return numbered.join(told, "row").select(*back, "component_id", "leader")


def leaders(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The columns of `docs`, one row of each component of similar texts."""
    away, back = aside(docs.columns)
    of_id, of_text = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    return similar_components(docs.select(*away), of_id, of_text, **how).where("leader").select(*back)
