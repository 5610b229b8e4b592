"""Repeated passages by phrase automata."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from ._common import Scratch

#: Words in a window, and in the phrases whose hashes anchor windows.
WINDOW, PHRASE = 20, 5


#: Letters of the alphabet in which words are spelled; the automaton looks through a node's children one by one.
LETTERS = 1000


class Words:
    """Words of a shard: bytes, hashes, and where each document's begin."""

    def __init__(self, shard: repeats.Shard):
        body = shard.text.tobytes()
        lists = [body[s:e].split() for s, e in zip(shard.bounds, shard.bounds[1:], strict=False)]
        self.words = [w for x in lists for w in x]
        self.bounds = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        self.symbols = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

    def stream(self, letters: int = LETTERS) -> tuple[str, int]:
        """All words, each spelled with the same number of letters (which is returned): equal words alike, unlike ones not."""
        numbers = dict.fromkeys(self.words)
        numbers = dict(zip(numbers, range(len(numbers)), strict=True))
        of_word = np.fromiter(map(numbers.__getitem__, self.words), np.int64, len(self.words))
        width = 1
        while letters**width < len(numbers):
            width += 1
        spelled = np.stack([of_word // letters**k % letters for k in range(width)], 1)
        return (spelled.reshape(-1) + 1).astype("<u4").tobytes().decode("utf-32-le"), width


def window_hashes(symbols: np.ndarray, starts: np.ndarray, width: int):
    """Two independent hashes of each window: 128 bits together."""
    one = repeats.Hashes(symbols).of(starts, starts + width)
    two = repeats.Hashes(repeats.mixed(symbols ^ np.uint64(0xA5A5A5A5A5A5A5A5))).of(starts, starts + width)
    return one, two


class OpenWindows:
    """Windows of open runs, each content once with its first place in the shard."""

    def __init__(self, symbols, runs, is_open, keys, width):
        self.starts = repeats.starts_in(runs, is_open)
        doc = np.repeat(runs.doc[is_open], (runs.hi - runs.lo + 1)[is_open])
        one, two = window_hashes(symbols, self.starts, width)
        self.order = np.lexsort((self.starts, keys[doc], two, one))
        one, two = one[self.order], two[self.order]
        self.first = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
        self.keys = keys[doc]
        self.one, self.two, self.key = one[self.first], two[self.first], self.keys[self.order][self.first]

    def lines(self, bits):
        return [(r, repeats.packed(self.one[s], self.two[s], self.key[s])) for r, s in repeats.by_range(self.one, bits)]


class Passages:
    """Confirmed passages of a shard: stretches of words of which another occurrence may start earlier.

    Each has the place of an occurrence in the shard, its length in words, and its owner (document key, shard,
    start), the first occurrence that the exchange knows of. An owner in another shard needs no start.
    """

    def __init__(self):
        self.lo, self.n, self.owner = [], [], []

    def add(self, lo: np.ndarray, n: np.ndarray, key: np.ndarray, shard: np.ndarray, start: np.ndarray) -> None:
        self.lo.append(lo)
        self.n.append(n)
        self.owner.append(np.stack([key, shard, start], 1))

    def add_groups(self, number: int, first: np.ndarray, told, lo, n, key) -> None:
        """Groups of equal stretches (rows sorted, `first` marks each group's first) that more than one place has.

        `told`: for each group whether an earlier one is elsewhere, and the key and the shard of that one.
        """
        at = np.flatnonzero(first)
        elsewhere, of_key, of_shard = told
        chosen = elsewhere | (np.diff(np.r_[at, len(first)]) > 1)
        at, elsewhere = at[chosen], elsewhere[chosen]
        self.add(lo[at], n[at], np.where(elsewhere, of_key[chosen], key[at]), np.where(elsewhere, of_shard[chosen], number), lo[at])

    def located(self, words: Words, keys: np.ndarray, number: int, letters: int = LETTERS) -> np.ndarray:
        """Marks every word of an occurrence that starts after its passage's owner.

        The passages are compiled into one automaton over spelled words, and every document is streamed
        through it. What it finds, and nothing else, is marked.
        """
        gone = np.zeros(len(words.words), bool)
        lo, n = (np.concatenate(x) for x in (self.lo, self.n))
        if not len(lo):
            return gone
        owner = np.concatenate(self.owner)
        stream, width = words.stream(letters)
        # Of equal passages the one with the earliest owner counts, which is entered last.
        order = np.lexsort((*owner.T[::-1], n))[::-1]
        lo, n, owner = lo[order], n[order], owner[order]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (s, e) in enumerate(zip((lo * width).tolist(), ((lo + n) * width).tolist(), strict=True)):
            automaton.add_word(stream[s:e], k)
        automaton.make_automaton()
        ends, found = [], []
        for s, e in zip(words.bounds.tolist(), words.bounds[1:].tolist(), strict=False):
            for end, k in automaton.iter(stream[s * width : e * width]):
                ends.append(s * width + end + 1)
                found.append(k)
        ends, found = np.array(ends, np.int64), np.array(found, np.int64)
        whole = ends % width == 0
        ends, found = ends[whole] // width, found[whole]
        starts = ends - n[found]
        key, (of_key, of_shard, of_start) = keys[np.searchsorted(words.bounds, starts, "right") - 1], owner[found].T
        later = (key > of_key) | (key == of_key) & ((number > of_shard) | (number == of_shard) & (starts > of_start))
        edge = np.bincount(starts[later], minlength=len(gone) + 1) - np.bincount(ends[later], minlength=len(gone) + 1)
        return np.cumsum(edge)[: len(gone)] > 0


def remove_repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False, shard_bytes: int = repeats.SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row of `docs`.

    A word goes if a window of `window` words that covers it also starts earlier. Shards exchange hashes of
    runs of windows, and of the windows where runs part, which confirms the passages that recur and says
    where each occurs first. A passage is routed to the shards that hold it: each shard compiles its
    confirmed passages into an automaton, streams all its documents through it, and every occurrence found
    after the first one goes. No task holds more than one shard or one range of hashes, and every hash
    range has few entries for each shard, so hot passages stay small.

    Null text has no words; texts shorter than a window are kept; rows tied in doc_id follow each other by
    shard and place in it; ids are whole numbers (a text id raises), null ids come first; an empty table gives an empty result. A text longer than
    `shard_bytes` is a shard of its own, held whole in one task (about 40 times its bytes in arrays).
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    bits = repeats.range_bits(total // 6, shard_bytes)
    shards = repeats.deal_shards(docs, doc_id, text, scratch, total, shard_bytes)

    def prepared(number, heads, texts):
        shard = repeats.Shard(number, heads, texts)
        words = Words(shard)
        runs = repeats.Runs(words.symbols, words.bounds, window, PHRASE)
        return shard, words, runs, repeats.Classes(runs, shard.keys)

    def ask_classes(batches):
        for b in batches:
            for row in b.to_pylist():
                *_, classes = prepared(row["shard"], row["heads"], row["texts"])
                yield repeats.lines_of(row["shard"], classes.lines(bits))

    def ask_windows(batches):
        for b in batches:
            for row in b.to_pylist():
                shard, words, runs, classes = prepared(row["shard"], row["heads"], row["texts"])
                _, is_open, _ = classes.judge(repeats.bits_of(row["classes"]))
                yield repeats.lines_of(row["shard"], OpenWindows(words.symbols, runs, is_open, shard.keys, window).lines(bits))

    def confirmed(row, shard, words, runs, classes):
        passages, sizes = Passages(), runs.hi - runs.lo + window
        told, *owner = repeats.answers_of(row["classes"])
        entry = classes.entry[classes.first_here]
        elsewhere = ~classes.many[classes.first_here] & (told[entry] & repeats.FIRST == 0)
        of = classes.order
        passages.add_groups(shard.number, classes.first_here, (elsewhere, *(x[entry] for x in owner)), runs.lo[of], sizes[of], shard.keys[runs.doc[of]])
        _, is_open, _ = classes.judge(told)
        windows = OpenWindows(words.symbols, runs, is_open, shard.keys, window)
        told, *owner = repeats.answers_of(row["windows"])
        lo = windows.starts[windows.order]
        passages.add_groups(shard.number, windows.first, (told == 0, *owner), lo, np.full(len(lo), window), windows.keys[windows.order])
        return passages

    def finish(batches):
        for b in batches:
            for row in b.to_pylist():
                shard, words, runs, classes = prepared(row["shard"], row["heads"], row["texts"])
                gone = confirmed(row, shard, words, runs, classes).located(words, shard.keys, shard.number)
                out = [[], [], [], [], []]
                for k, (s, e) in enumerate(zip(words.bounds, words.bounds[1:], strict=False)):
                    lost = gone[s:e]
                    kept = words.words[s:e] if not lost.any() else [words.words[i] for i in (s + np.flatnonzero(~lost)).tolist()]
                    kept = b" ".join(kept)
                    values = (None if shard.null[k] else int(shard.keys[k]), int(e - s), int(lost.sum()), hashlib.sha256(kept).hexdigest())
                    for column, v in zip(out, (*values, kept.decode("utf-8", "replace") if with_text else None), strict=True):
                        column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 5 if with_text else 4]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    def judge_classes(table):
        return repeats.judge_classes(table, owners=True)

    def judge_windows(table):
        return repeats.judge_windows(table, owners=True)

    try:
        classes = repeats.exchange(shards.mapInArrow(ask_classes, repeats.LINES), judge_classes, scratch, "classes")
        known = shards.join(classes, "shard", "left")
        windows = repeats.exchange(known.mapInArrow(ask_windows, repeats.LINES), judge_windows, scratch, "windows")
        known = known.join(windows, "shard", "left")
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        return scratch.write(known.mapInArrow(finish, schema), "result", batch=1)
    finally:
        repeats.drop_shards(scratch, "classes_answers", "windows_answers")


def op7_phrase_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
