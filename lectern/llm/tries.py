"""Source divergence audit over mergeable radix tries of terms."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats
from ._common import Scratch

#: Bytes of a term: letters of ASCII, A-Z in lower case, and all bytes of longer UTF-8 sequences.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIN_DOCS, TOP = 10, 10
#: Counters, one for each distinct term of a document, that a task holds before its tries are sent on.
HELD_TERMS = 4_000_000
#: Bytes of text for each prefix range, and the number of ranges at most.
RANGE_BYTES, MAX_RANGES = 16 << 20, 4096
#: Rows whose terms tell where prefix ranges begin.
PILOT_ROWS = 2000
#: Tries of a prefix range that one task merges; more are merged in several rounds.
MERGE_FAN = 256
#: Cells (terms times sources) held as a matrix at a time.
CELLS = 1 << 20
SCALE = 1_000_000_000
TRIES = "lang string, range int, sources array<string>, blob binary"


class RadixTrie:
    """Byte strings in a tree whose edges are labelled with stretches of bytes; leaves are numbered as they come.

    A node is a pair: its edges by first byte, each [label, node], or None; and its leaf's number, or -1.
    The counters of a leaf stand in arrays under its number.
    """

    def __init__(self):
        self.root = [None, -1]
        self.size = 0

    def number(self, term: bytes) -> int:
        """The number of a term's leaf; the next one if it is new."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            edges = node[0]
            if edges is None:
                edges = node[0] = {}
            edge = edges.get(term[at])
            if edge is None:
                edges[term[at]] = edge = [term[at:], [None, -1]]
            label = edge[0]
            if not term.startswith(label, at):
                n = next(k for k in range(len(label)) if label[k : k + 1] != term[at + k : at + k + 1])
                edge[:] = label[:n], [{label[n]: [label[n:], edge[1]]}, -1]
                label = edge[0]
            at, node = at + len(label), edge[1]
        if node[1] < 0:
            node[1] = self.size
            self.size += 1
        return node[1]

    def walk(self):
        """(term, bytes that it shares with the term before, number) in the order of bytes, which is that of code points.

        Two neighbours share the path down to the lowest node between them.
        """
        stack, lowest = [(b"", self.root, 0)], 0
        while stack:
            term, (edges, number), above = stack.pop()
            if above < lowest:
                lowest = above
            depth = len(term)
            if number >= 0:
                yield term, lowest, number
                lowest = depth
            if edges:
                stack.extend([(term + label, node, depth) for _, (label, node) in sorted(edges.items(), reverse=True)])


#: The counter of a term's documents, beside those of its sources.
DOCS = -1


def summed(at: np.ndarray, of: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Counters (number of a leaf, source or DOCS, count) in order, equal ones added up."""
    if not len(at):
        return [at, of, counts]
    wide = int(of.max()) + 2
    key = at.astype(np.int64) * wide + of + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return [key[first] // wide, key[first] % wide - 1, np.add.reduceat(counts[order], first)]


def written(trie: RadixTrie, counters: list[np.ndarray], cuts: list[bytes] = ()):
    """(range, blob) of each stretch of a trie's walk between two of `cuts`: what each term adds to what it shares
    with the one before, and its counters (see `summed`)."""
    leaves = list(trie.walk())
    terms, order = [x[0] for x in leaves], np.array([x[2] for x in leaves], np.int64)
    at, of, counts = counters
    kinds = np.bincount(at, minlength=trie.size)
    starts = np.cumsum(kinds) - kinds
    ends = [0, *(bisect_left(terms, c) for c in cuts), len(terms)]
    for r, (lo, hi) in enumerate(pairwise(ends)):
        if lo == hi:
            continue
        shared = [0, *(x[1] for x in leaves[lo + 1 : hi])]
        tails = [t[n:] for t, n in zip(terms[lo:hi], shared, strict=True)]
        here, n = order[lo:hi], kinds[order[lo:hi]]
        rows = np.repeat(starts[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
        small = [np.array(x, np.int32) for x in (shared, list(map(len, tails)), n, of[rows])]
        yield r, repeats.packed(*small[:2], np.frombuffer(b"".join(tails), np.uint8), *small[2:], counts[rows].astype(np.int64))


def read(blob: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    """The terms of a written stretch, and their counters under the terms' places."""
    shared, lengths, tails, kinds, of, counts = repeats.unpacked(blob)
    tails, terms, before, at = tails.tobytes(), [], b"", 0
    for n, m in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:n] + tails[at : at + m]
        at += m
        terms.append(before)
    return terms, [np.repeat(np.arange(len(terms)), kinds), of, counts]


class Numbers(dict):
    """Term -> its number, the next one if it is new."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Counted:
    """What a task has counted of a language: its terms' numbers, and counters of each document."""

    def __init__(self):
        self.numbers, self.sources, self.parts, self.held = Numbers(), Numbers(), [], 0

    def add(self, source: str, terms: list[bytes]) -> None:
        of = self.sources[source]
        at, n = np.unique(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)), return_counts=True)
        self.parts.append((at, np.full(len(at), of, np.int32), n))
        self.held += len(at)

    def counters(self) -> list[np.ndarray]:
        at, of, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        docs = np.bincount(at, minlength=len(self.numbers))
        every = np.arange(len(docs))
        return summed(np.r_[every, at], np.r_[np.full(len(docs), DOCS), of], np.r_[docs, n])


def tries_of_texts(texts: DataFrame, cuts: list[bytes]) -> DataFrame:
    """Tries of (lang, source, text as bytes), a row for each language and prefix range of a task's share."""

    def flushed(counted):
        while counted:
            lang, own = counted.popitem()
            trie = RadixTrie()
            for term in own.numbers:  # numbered in the same order
                trie.number(term)
            for r, blob in written(trie, own.counters(), cuts):
                yield row_of(lang, r, list(own.sources), blob)

    def run(batches):
        counted = defaultdict(Counted)
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counted[lang].add(source, text.translate(TERM_BYTES).split())
            if sum(x.held for x in counted.values()) > HELD_TERMS:
                yield from flushed(counted)
        yield from flushed(counted)

    return texts.mapInArrow(run, TRIES)


def row_of(lang: str, r: int, sources: list[str], blob: bytes) -> pa.RecordBatch:
    columns = [pa.array([lang], pa.string()), pa.array([r], pa.int32()), pa.array([sources], pa.list_(pa.string())), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "range", "sources", "blob"])


def merge(table: pa.Table, min_docs: int = 0) -> pa.Table:
    """One trie of the tries of a prefix range; terms in fewer than `min_docs` documents are left out."""
    numbers, sources, parts = Numbers(), Numbers(), []
    for names, blob in zip(table.column("sources").to_pylist(), table.column("blob").to_pylist(), strict=True):
        here = np.array([sources[x] for x in names] + [DOCS], np.int64)  # DOCS is -1, the last place
        terms, (at, of, counts) = read(blob)
        own = np.fromiter(map(numbers.__getitem__, terms), np.int64, len(terms))
        parts.append((own[at], here[of], counts))
    at, of, counts = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    kept = np.zeros(len(numbers), bool)
    kept[at[(of == DOCS) & (counts >= min_docs)]] = True
    trie, place = RadixTrie(), np.cumsum(kept) - 1
    for term, stays in zip(numbers, kept.tolist(), strict=True):
        if stays:
            trie.number(term)
    stays = kept[at]
    blob = next((x for _, x in written(trie, [place[at[stays]], of[stays], counts[stays]])), None)
    rows = [row_of(table.column("lang")[0].as_py(), table.column("range")[0].as_py(), list(sources), blob)] if blob else []
    return pa.Table.from_batches(rows, row_of("", 0, [], b"").schema)


def merged_tries(tries: DataFrame, scratch: Scratch, min_docs: int) -> DataFrame:
    """One row for each language and prefix range. No task holds more than some MERGE_FAN tries of one range."""
    level = 0
    while (most := tries.groupBy("lang", "range").count().agg(F.max("count")).first()[0] or 0) > MERGE_FAN:
        salt = F.pmod(F.xxhash64("blob"), F.lit(most // MERGE_FAN + 1))
        tries = scratch.write(tries.groupBy("lang", "range", salt).applyInArrow(lambda _, t: merge(t), TRIES), f"merged{level}")
        level += 1
    return scratch.write(tries.groupBy("lang", "range").applyInArrow(lambda _, t: merge(t, min_docs), TRIES), "kept")


def prefix_cuts(texts: DataFrame, total: int) -> list[bytes]:
    """First terms of the prefix ranges, from the terms of some rows: they decide how even ranges are, nothing else."""
    ranges = min(MAX_RANGES, total // RANGE_BYTES + 8)

    def run(batches):
        for b in batches:
            found = set()
            for t in b.column(0).to_pylist():
                found.update(t.translate(TERM_BYTES).split())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], names=["term"])

    terms = texts.select(F.substring("text", 1, 20_000)).limit(PILOT_ROWS).mapInArrow(run, "term binary").distinct()
    order = Window.orderBy("term")
    placed = terms.select("term", F.ntile(ranges).over(order).alias("part"))
    firsts = placed.groupBy("part").agg(F.min("term").alias("term")).where("part > 1")
    return sorted(bytes(r["term"]) for r in firsts.collect())


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for totals up to 9 * 10^15: long division by thousands."""
    of, left, out = np.int64(total + 2 * kept), counts + np.int64(2), np.zeros(counts.shape, np.int64)
    for _ in range(3):
        left *= 1000
        digit = left // of
        left -= digit * of
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def audited(tries: DataFrame, top: int = TOP) -> DataFrame:
    """Sums over pairs of sources and the foremost terms of every source, of each prefix range.

    `tries` has the columns of a merged trie, and `totals` (an array of source and n) and `vocabulary` of its
    language. (lang, source, item binary, other string, value): `item` for a term, `other` for a pair.
    """

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                terms, (at, of, counts) = read(row["blob"])
                at, of, counts = at[of >= 0], of[of >= 0], counts[of >= 0]
                names = [x["source"] for x in row["totals"]]
                place = {x: k for k, x in enumerate(names)}
                of = np.array([place[x] for x in row["sources"]], np.int64)[of] if len(of) else of
                totals, kept = [x["n"] for x in row["totals"]], row["vocabulary"]
                sums = np.zeros((len(names), len(names)), np.int64)
                best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(names)
                step = max(1, CELLS // max(1, len(names)))
                for lo in range(0, len(terms), step):
                    hi = min(lo + step, len(terms))
                    here = slice(*np.searchsorted(at, [lo, hi]))
                    cells = np.zeros((len(names), hi - lo), np.int64)
                    cells[of[here], at[here] - lo] = counts[here]
                    whole = shares(cells.sum(0), sum(totals), kept)
                    p = np.stack([shares(cells[k], totals[k], kept) for k in range(len(names))])
                    for k in range(len(names)):
                        sums[k, k + 1 :] += distance(p[k], p[k + 1 :]).sum(1)
                        more = np.flatnonzero((cells[k] > 0) & (p[k] > whole))
                        value, number = np.r_[best[k][0], distance(p[k][more], whole[more])], np.r_[best[k][1], more + lo]
                        first = np.argsort(-value, kind="stable")[:top]  # terms come in order, so ties keep it
                        best[k] = value[first], number[first]
                for k, name in enumerate(names):
                    value, number = best[k]
                    others = names[k + 1 :]
                    items = [terms[x] for x in number.tolist()] + [None] * len(others)
                    n = len(items)
                    columns = [pa.array([row["lang"]] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(items, pa.binary())]
                    columns += [pa.array([None] * len(number) + others, pa.string()), pa.array(np.r_[value, sums[k, k + 1 :]], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "other", "value"])

    return tries.mapInArrow(run, "lang string, source string, item binary, other string, value long")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """How far apart the sources of each language are in their terms: lang, source, part, item, value, rank.

    Tasks count the terms of their rows in a byte trie for each language, whose leaves have a counter for
    each source. Tries are cut at the same terms everywhere and merged range by range, in rounds where a
    range has many. What stays (terms in at least `min_docs` documents of the language) is walked in byte
    order, in which sums over pairs of sources and the foremost terms of each are taken.

    Part `pair` has a row for every other source of the language, part `term` the `top` terms that a
    source has more of than its language. Null text, language and source read as ''. A group whose rows
    have no terms still has its pairs; a language without kept terms has pairs of value 0; ties go by the
    item's bytes; an empty table gives an empty result. Texts of any length are counted whole. The output
    is quadratic in the sources of a language.
    """
    scratch = Scratch(docs.sparkSession, "tries")
    read_as = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)]
    texts = docs.select(read_as[0].alias("lang"), read_as[1].alias("source"), read_as[2].cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tries = scratch.write(tries_of_texts(texts, prefix_cuts(texts, total)), "tries", batch=500)
    kept = merged_tries(tries, scratch, min_docs)
    scratch.drop("tries")

    def counted(batches):
        for b in batches:
            for row in b.to_pylist():
                terms, (_, of, counts) = read(row["blob"])
                n = np.zeros(len(row["sources"]), np.int64)
                np.add.at(n, of[of >= 0], counts[of >= 0])
                names = [*row["sources"], None]
                columns = [pa.array([row["lang"]] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([*n.tolist(), len(terms)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "n"])

    counts = scratch.write(kept.mapInArrow(counted, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n")), "counts")
    groups = texts.select("lang", "source", F.lit(0).cast("long").alias("n")).distinct().unionByName(counts.where("source is not null"))
    groups = groups.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("totals"))
    totals = totals.join(counts.where("source is null").select("lang", F.col("n").alias("vocabulary")), "lang", "left")
    totals = scratch.write(totals, "totals")

    found = scratch.write(audited(kept.join(totals.where("vocabulary > 0"), "lang"), top), "found", batch=1)
    sums = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pairs = totals.select("lang", F.col("totals.source").alias("names")).select("lang", "names", F.explode("names").alias("source"))
    pairs = pairs.select("lang", "source", F.explode("names").alias("other")).where("source <> other").join(both, ["lang", "source", "other"], "left")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = found.where("item is not null").select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    ranked = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(ranked)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Every pair of sources of a language, and each source's foremost terms, over all documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT doc_id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS big FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(big) AS big FROM gn GROUP BY lang),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.big + 2 * v.v) AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (s + 2)) // (ln.big + 2 * v.v) AS q FROM (SELECT lang, term, sum(n) AS s FROM c GROUP BY lang, term) JOIN ln USING (lang) JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
