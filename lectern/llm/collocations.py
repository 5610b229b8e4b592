"""Collocations: phrases whose parts go together more often than chance, from exact counts."""

from __future__ import annotations

import tempfile
from collections import Counter
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from ._common import Scratch, arrow_batches

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: A-Z in lower case, separators of pieces as line feeds, tabs as spaces.
PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
#: Distinct pieces that a task counts before they are sent on.
HELD = 100_000
#: Bytes of distinct pieces in a shard, and of text for each bucket of the shards' table.
SHARD_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Memory of duckdb in a task; beyond it duckdb goes to the task's own spool.
DUCKDB_MB = 512
PIECES = "shard long, lang string, piece binary, n long"
PHRASES = "lang string, phrase binary, size int, n long"


@contextmanager
def spooling(memory_mb: int = DUCKDB_MB):
    """A duckdb connection of one thread whose spool is the task's own and goes with it."""
    with tempfile.TemporaryDirectory() as spool:
        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spool, "preserve_insertion_order": False})
        try:
            yield con
        finally:
            con.close()


def deal_pieces(texts: DataFrame, scratch: Scratch, total: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Distinct pieces of (lang, text as bytes) with their multiplicities, in shards by hash, written bucketed.

    (shard long, langs array<string>, blob binary). Equal pieces collapse in each task and then in their
    shard, so a piece that many texts hold is one row for each task and one piece in the end.
    """
    shards = total // shard_bytes + 1

    def split(batches):
        def rows(counts):
            keys = list(counts)
            at = [xxhash.xxh64_intdigest(p, 7) % shards for _, p in keys]
            columns = [pa.array(at, pa.int64()), pa.array([x for x, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.binary()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "piece", "n"])

        counts = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pieces = (p.strip(b" ") for p in text.translate(PIECE_BYTES).split(b"\n"))
                counts.update((lang, b" ".join(p.split(b" ")) if b"  " not in p else b" ".join(filter(None, p.split(b" ")))) for p in pieces if p)
                if len(counts) > HELD:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    def packed(table):
        table = table.group_by(["shard", "lang", "piece"]).aggregate([("n", "sum")])
        langs = sorted(set(table.column("lang").to_pylist()))
        number = {x: k for k, x in enumerate(langs)}
        of_lang = np.fromiter((number[x] for x in table.column("lang").to_pylist()), np.int32, table.num_rows)
        text = b"".join(p + b"\n" for p in table.column("piece").to_pylist())
        blob = repeats.packed(np.frombuffer(text, np.uint8), of_lang, table.column("n_sum").to_numpy().astype(np.int64))
        return pa.table({"shard": table.column("shard").slice(0, 1), "langs": pa.array([langs], pa.list_(pa.string())), "blob": pa.array([blob], pa.binary())})

    buckets = int(max(8, min(100_000, total // BUCKET_BYTES)))
    found = texts.mapInArrow(split, PIECES).repartition(buckets, "shard")
    dealt = found.groupBy("shard").applyInArrow(lambda _, t: packed(t), "shard long, langs array<string>, blob binary")
    table = repeats.shard_table(scratch)
    with arrow_batches(scratch.spark, 200):
        dealt.write.bucketBy(buckets, "shard").option("compression", "none").option("path", scratch.path("shards")).mode("overwrite").saveAsTable(table)
    return scratch.spark.table(table)


class Grams:
    """Word sequences of a shard as stretches of bytes, with two hashes for any of them."""

    def __init__(self, langs: list[str], blob: bytes):
        self.text, of_lang, weight = repeats.unpacked(blob)
        self.langs, self.of_lang = langs, of_lang
        self.ends = np.flatnonzero((self.text == 10) | (self.text == 32))
        self.starts = np.r_[0, self.ends[:-1] + 1][: len(self.ends)]
        last = self.text[self.ends] == 10
        self.piece = np.cumsum(last) - last
        self.weight = weight[self.piece]
        self.salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[of_lang][self.piece]
        symbols = self.text.astype(np.uint64) + np.uint64(1)
        self.hash = repeats.Hashes(symbols)
        self.more = np.zeros(len(symbols) + 1, np.uint64)  # sums of other symbols, for a second hash
        np.cumsum(repeats.mixed(symbols) * repeats.powers(repeats.BASE, len(symbols)), dtype=np.uint64, out=self.more[1:])

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
        s, e = self.starts[at], self.ends[at + size - 1]
        two = repeats.mixed((self.more[e] - self.more[s]) * self.hash.inverse[s]) + self.salt[at]
        return [self.hash.of(s, e) ^ self.salt[at], (two >> np.uint64(32)).astype(np.uint32)]

    def phrase(self, at: int, size: int) -> tuple[str, bytes]:
        return self.langs[self.of_lang[self.piece[at]]], self.text[self.starts[at] : self.ends[at + size - 1]].tobytes()

    def pairs(self) -> np.ndarray:
        """Where sequences of two words begin."""
        return np.flatnonzero(self.piece[1:] == self.piece[:-1])

    def longer(self, frequent: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of sequences of 3 to `most` words, all of whose pairs are `frequent` (begins of pairs)."""
        marked = np.zeros(len(self.starts) + most, bool)
        marked[frequent] = True
        at, begins, sizes = frequent, [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size in range(3, most + 1):
            at = at[marked[at + size - 2]]
            begins.append(at)
            sizes.append(np.full(len(at), size))
        return np.concatenate(begins), np.concatenate(sizes)


class Asked:
    """Distinct sequences of a shard by 96 bits of hash, with their summed weights."""

    def __init__(self, grams: Grams, at: np.ndarray, size: np.ndarray):
        self.grams, self.at, self.size = grams, at, size
        one, two = grams.hashes(at, size)
        order = np.argsort(one, kind="stable")
        new = np.r_[True, one[order][1:] != one[order][:-1]][: len(one)]
        unlike = np.r_[False, two[order][1:] != two[order][:-1]][: len(one)]
        if (unlike & ~new).any():
            order = np.lexsort((two, one))
            new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        self.first = order[new]
        self.one, self.two = one[self.first], two[self.first]
        self.weight = np.add.reduceat(grams.weight[at][order], np.flatnonzero(new)) if len(one) else np.empty(0, np.int64)
        self.of = np.empty(len(one), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def lines(self, bits: int):
        return [(r, repeats.packed(self.one[s], self.two[s], self.weight[s])) for r, s in repeats.by_range(self.one, bits)]

    def frequent(self, cell) -> np.ndarray:
        """Marks of the sequences that are frequent over all shards."""
        return self._told(cell)[self.of] != 0

    def owned(self, cell):
        """(lang, phrase, size, count over all shards) of the frequent sequences that this shard tells."""
        told = self._told(cell)
        for k in np.flatnonzero(told > 0).tolist():
            size = int(self.size[self.first[k]])
            yield *self.grams.phrase(int(self.at[self.first[k]]), size), size, int(told[k])

    def _told(self, cell) -> np.ndarray:
        return repeats.answers_of(cell, (np.int64,))[0]


def judge(table: pa.Table, min_count: int) -> pa.Table:
    """For one range of hashes, counted in duckdb: 0 where a sequence has fewer than `min_count` over all shards,
    its count for one of the shards that have it, and -1 for the others."""
    blobs = [repeats.unpacked(x) for x in table.column("blob").to_pylist()]
    sizes = [len(x[0]) for x in blobs]
    one, two, n = (np.concatenate([x[k] for x in blobs]) for k in range(3))
    told = np.zeros(len(one), np.int64)
    asked = pa.table({"i": np.arange(len(one)), "one": one, "two": two, "n": n})  # noqa: F841
    with spooling() as con:
        con.execute("CREATE TABLE many AS SELECT one, two, min(i) AS first, sum(n) AS n FROM asked GROUP BY one, two HAVING sum(n) >= ?", [min_count])
        found = con.execute("SELECT i, CAST(if(i = first, many.n, -1) AS BIGINT) AS told FROM asked JOIN many USING (one, two)").fetchnumpy()
        told[found["i"]] = found["told"]
    return repeats.answered(table, sizes, told)


def exchange(lines: DataFrame, answer, scratch: Scratch, name: str) -> DataFrame:
    """As repeats.exchange, but lines, which are most of the data here, go straight into the shuffle."""
    back = scratch.write(lines.groupBy("r").applyInArrow(answer, repeats.ANSWERS), f"{name}_answers", batch=1)
    scratch.free_shuffles()
    return back.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("r", "bits"))).alias(name))


def phrase_counts(texts: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT, most: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all sequences of up to `most` words with f >= min_count, and (lang, n)."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = deal_pieces(texts, scratch, total, shard_bytes)
    bits = max(6, (total // 6 >> 21).bit_length())

    def short_of(row):
        """Single words and pairs."""
        grams = Grams(row["langs"], row["blob"])
        words, pairs = np.arange(len(grams.starts)), grams.pairs()
        return Asked(grams, np.r_[words, pairs], np.repeat([1, 2], [len(words), len(pairs)]))

    def longer_of(short, cell):
        pairs = short.at[short.frequent(cell) & (short.size == 2)]
        return Asked(short.grams, *short.grams.longer(pairs, most))

    def ask_short(batches):
        for b in batches:
            for row in b.to_pylist():
                yield repeats.lines_of(row["shard"], short_of(row).lines(bits))

    def ask_longer(batches):
        for b in batches:
            for row in b.to_pylist():
                yield repeats.lines_of(row["shard"], longer_of(short_of(row), row["short"]).lines(bits))

    def tell(batches):
        for b in batches:
            for row in b.to_pylist():
                short = short_of(row)
                grams = short.grams
                found = [*short.owned(row["short"]), *longer_of(short, row["short"]).owned(row["longer"])]
                words = np.bincount(grams.of_lang[grams.piece], grams.weight, len(grams.langs))
                found += [(x, b"", 0, int(n)) for x, n in zip(grams.langs, words, strict=True)]
                columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.binary(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "n"])

    try:
        answer = lambda _, t: judge(t, min_count)
        scratch.free_shuffles()
        short = exchange(shards.mapInArrow(ask_short, repeats.LINES), answer, scratch, "short")
        known = shards.join(short, "shard", "left")
        longer = exchange(known.mapInArrow(ask_longer, repeats.LINES), answer, scratch, "longer")
        found = scratch.write(known.join(longer, "shard", "left").mapInArrow(tell, PHRASES), "phrases", batch=1)
    finally:
        repeats.drop_shards(scratch, "short_answers", "longer_answers")
    counts = found.where("size > 0").select("lang", F.col("phrase").cast("string").alias("phrase"), "size", F.col("n").alias("f"))
    return counts, found.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _scores(cuts: DataFrame) -> DataFrame:
    """Adds score = floor(1000 * a * n / (l * r)), in whole numbers of any size."""

    def run(batches):
        for b in batches:
            columns = {c: b.column(c).to_pylist() for c in ("a", "n", "l", "r")}
            score = [1000 * a * n // (x * y) for a, n, x, y in zip(*columns.values(), strict=True)]
            yield b.append_column("score", pa.array(score, pa.int64()))

    return cuts.mapInArrow(run, "lang string, phrase string, a long, k int, l long, r long, n long, score long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces, equal pieces collapse into one with a multiplicity, and shards of them ask,
    by hash range, which of their words and word pairs are frequent over all shards, then which longer
    sequences made of frequent pairs are. Each range, a hash bucket, is counted in duckdb, out of core,
    and sends counts back: one of the shards that hold a frequent sequence gets its count, and tells its
    words. Sequences are told apart by 96 bits of hash. For every cut of a candidate the counts of its two
    parts are looked up by shuffled requests.

    Null text is empty, a null language `und`; texts and pieces of any length are taken whole; repeated
    rows count each; ties go by count, then by the phrase's bytes; a language without candidates has no
    rows; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    counts, totals = phrase_counts(texts, scratch, min_count, most, shard_bytes)
    candidates = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    joined = lambda x: F.array_join(F.expr(x), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined("slice(words, 1, k)").alias("first"), joined("slice(words, k + 1, size(words))").alias("rest"))
    of = counts.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(of.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(of.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = _scores(cuts.join(totals, "lang").select("lang", "phrase", "a", "k", "l", "r", "n"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = candidates.where("size > 2").select("lang", "words", "size", "f", F.explode(F.expr("sequence(1, size - 1)")).alias("s"))
    inner = inner.select("lang", "words", "s", "f", F.explode(F.expr("sequence(2, least(size - 1, size - s + 1))")).alias("m"))
    inner = inner.select("lang", joined("slice(words, s, m)").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    held = scored.join(inner, ["lang", "phrase"], "left").where("f is null or f < a")
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = held.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The foremost collocations of each language over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS size FROM p))),
c AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c WHERE size > 1)),
s AS (SELECT cuts.*, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN c AS x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN c AS y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN n ON n.lang = cuts.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
longer AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)) GROUP BY ALL),
r AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase WHERE o = 1 AND NOT coalesce(100 * longer.f >= 100 * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
