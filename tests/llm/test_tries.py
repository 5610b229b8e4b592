"""Radix tries and the source audit against brute force."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import tries

from . import fixtures as fx

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 3), st.integers(1, 9)), max_size=60), st.integers(0, 60))
def test_trie_counts_merges_and_keeps_order(added, cut):
    expected = collections.defaultdict(collections.Counter)
    for term, k, n in added:
        expected[term][k] += n
    rows = []
    for part in (added[:cut], added[cut:]):
        trie = tries.RadixTrie()
        at = np.array([trie.number(term) for term, _, _ in part], np.int64)
        counters = [np.r_[at, at], np.r_[np.array([k for _, k, _ in part], np.int64), np.full(len(part), tries.DOCS)], np.r_[np.array([n for *_, n in part], np.int64), np.ones(len(part), np.int64)]]
        assert [x[0] for x in trie.walk()] == sorted({t for t, *_ in part}) and trie.size == len({t for t, *_ in part})
        cuts = sorted({t for t, *_ in added})[1::3]
        for r, blob in tries.written(trie, tries.summed(*counters), cuts):
            rows.append(tries.row_of("x", r, ["a", "b", "c", "d"], blob))
    got, docs, order = collections.defaultdict(collections.Counter), 0, []
    for r in sorted({x.column(1)[0].as_py() for x in rows}):
        merged = tries.merge(tries.pa.Table.from_batches([x for x in rows if x.column(1)[0].as_py() == r])).to_pylist()[0]
        terms, counters = tries.read(merged["blob"])
        order += terms
        for k, s, n in zip(*counters, strict=True):
            if s == tries.DOCS:
                docs += n
            else:
                got[terms[k]]["abcd".index(merged["sources"][s])] += n
    assert order == sorted(expected) and docs == len(added) and got == expected


@given(st.lists(st.integers(0, 10**14), min_size=1, max_size=9), st.integers(0, 10**9))
def test_exact_shares(counts, more):
    total, kept = sum(counts), len(counts) + more
    expected = [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]
    assert tries.shares(np.array(counts, np.int64), total, kept).tolist() == expected


def audit(rows, min_docs, top):
    """Rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, *_ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(r[2], ts) for r, ts in zip(rows, found, strict=True) if r[1] == lang]
        in_docs = collections.Counter(t for _, ts in mine for t in set(ts))
        kept = {t for t, n in in_docs.items() if n >= min_docs}
        counts = {s: collections.Counter() for s, _ in mine}
        for s, ts in mine:
            counts[s].update(t for t in ts if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        whole, p = share(sum(counts.values(), collections.Counter())), {s: share(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(spark, monkeypatch, small):
    """Also with many prefix ranges, and tries merged in rounds."""
    if small:
        monkeypatch.setattr(tries, "RANGE_BYTES", 50)
        monkeypatch.setattr(tries, "MERGE_FAN", 2)
    docs = fx.documents(spark)
    rng = fx.random.Random(4)
    more = [(k, fx.sentence(rng, 40) + " Éa \x7f Éa", ["s", None, "t", "only"][k % 4], [None, "", "fr"][k % 3], 0, *["x"] * 12) for k in range(60)]
    more += [(99, None, "alone", "xx", 0, *["x"] * 12), (99, " . ", "other", "xx", 0, *["x"] * 12)]
    docs = docs.unionByName(spark.createDataFrame(more, fx.DOCUMENTS))
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = tries.source_divergence(docs, min_docs=4, top=7)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()) == audit(rows, 4, 7)


def test_without_rows(spark):
    assert tries.source_divergence(fx.empty(spark)).count() == 0
