"""Collocations against brute force."""

import collections
import re

import pytest

from lectern.llm import collocations

from . import fixtures as fx


def brute_force(rows, min_count, top):
    """Rows are (text, lang)."""
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang in n:
        many = {w: a for (x, w), a in f.items() if x == lang and len(w) > 1 and a >= min_count}
        inside = collections.Counter()
        for w, a in many.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inside[w[i : i + m]] = max(inside[w[i : i + m]], a)
        found = []
        for w, a in many.items():
            cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, (left, right) = min((1000 * a * n[lang] // (x * y), k, (x, y)) for k, (x, y) in enumerate(cuts))
            if inside[w] < a:
                found.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("min_count", "top", "shard_bytes"), [(3, 2000, collocations.SHARD_BYTES), (2, 15, 700)])
def test_collocations(spark, min_count, top, shard_bytes):
    docs = fx.documents(spark)
    rng = fx.random.Random(6)
    more = [(k, f"New  York\t{rng.choice('abc')} a a a a, A a? new york; {fx.sentence(rng, 30)}\x0bnew york", None, None if k % 2 else "fr", 0, *["x"] * 12) for k in range(40)]
    docs = docs.unionByName(spark.createDataFrame(more, fx.DOCUMENTS))
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    got = collocations.collocations(docs, min_count=min_count, top=top, shard_bytes=shard_bytes).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_force(rows, min_count, top)


def test_without_rows(spark):
    assert collocations.collocations(fx.empty(spark)).count() == 0


def test_sequences_are_told_apart_by_their_bytes():
    text = b"aa b\na ab\naa b c\n"
    blob = collocations.repeats.packed(*(collocations.np.array(x, t) for x, t in ((list(text), "u1"), ([0, 0, 1], "i4"), ([5, 1, 2], "i8"))))
    grams = collocations.Grams(["de", "en"], blob)
    at = grams.pairs()
    assert at.tolist() == [0, 2, 4, 5] and grams.longer(at, 3)[0].tolist() == [4]
    asked = collocations.Asked(grams, at, collocations.np.full(4, 2))
    lines = [collocations.repeats.packed(asked.one, asked.two, asked.weight)] * 2
    table = collocations.pa.table({"shard": [1, 2], "r": [0, 0], "blob": lines})
    told = collocations.judge(table, 4)
    half = told.slice(0, 1).to_pylist()
    assert sorted(asked.owned(half)) == [("de", b"aa b", 2, 10), ("en", b"aa b", 2, 4), ("en", b"b c", 2, 4)]
    assert not list(asked.owned(told.slice(1).to_pylist()))
    assert asked.frequent(half).tolist() == [True, False, True, True]
