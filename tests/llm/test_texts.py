"""Operators on documents against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import mixing, packing, phrase_dedup, quality, repeats, simhash, simhash_similar, suffix_dedup, suffix_sort

from . import fixtures as fx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def same_rows(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize("shard_bytes", [repeats.SHARD_BYTES, 1500])
def test_suffix_dedup(spark, shard_bytes):
    docs = fx.documents(spark).coalesce(1)
    rows = ordered(docs)
    bodies = [t.encode() for _, t in rows]
    expected = []
    for (key, _), body, starts in zip(rows, bodies, fx.repeated_starts(bodies, 100), strict=True):
        gone = fx.spans_of(len(body), starts, 100)
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        expected.append((key, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    same_rows([tuple(r) for r in suffix_dedup.remove_repeated_strings(docs, shard_bytes=shard_bytes).collect()], expected)
    assert suffix_dedup.remove_repeated_strings(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("shard_bytes", [repeats.SHARD_BYTES, 1500])
def test_phrase_dedup(spark, shard_bytes):
    docs = fx.documents(spark).coalesce(1)
    rows = ordered(docs)
    lists = [WORD.findall(t) for _, t in rows]
    expected = []
    for (key, _), words, starts in zip(rows, lists, fx.repeated_starts(lists, 20), strict=True):
        gone = fx.spans_of(len(words), starts, 20)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        expected.append((key, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    same_rows([tuple(r) for r in phrase_dedup.remove_repeated_passages(docs, shard_bytes=shard_bytes).collect()], expected)
    assert phrase_dedup.remove_repeated_passages(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("letters", [phrase_dedup.LETTERS, 7])
def test_automaton_locates_later_occurrences(letters):
    shard = repeats.Shard.__new__(repeats.Shard)
    texts = [b"z " * 3 + b"a b c d e f", b"a b c d x a b c d e", b"b c d", b""]
    shard.text = np.frombuffer(b"".join(texts), np.uint8)
    shard.bounds = np.cumsum([0, *map(len, texts)])
    words, keys = phrase_dedup.Words(shard), np.array([5, 3, 9, 9])
    whole = " ".join(w.decode() for w in words.words)

    def removed(*passages):
        found = phrase_dedup.Passages()
        for lo, n, *owner in passages:
            found.add(*(np.array([x]) for x in (lo, n, *owner)))
        return " ".join(w.decode() for w, g in zip(words.words, found.located(words, keys, 0, letters), strict=True) if not g)

    none = np.empty(0, np.int64)
    assert removed((3, 4, 5, 0, 3)) == whole  # all others stand in documents before the owner
    assert removed((3, 4, 3, 0, 9)) == "z z z e f a b c d x e b c d"  # the owner is in document 3
    assert removed((4, 3, 1, 7, 0)) == "z z z a e f a x a e"  # the owner is elsewhere, and earlier
    assert removed((4, 3, 5, 7, 0), (4, 3, 3, 7, 0)) == removed((4, 3, 3, 7, 0))
    assert removed((4, 3, 9, -1, 0)) == "z z z a b c d e f a b c d x a b c d e"
    empty = phrase_dedup.Passages()
    empty.add(none, none, none, none, none)
    assert not empty.located(words, keys, 0).any()


def sorted_by_brute_force(x, width):
    order = sorted(range(len(x)), key=lambda i: x[i:])
    shared = [0] * len(x)
    for k in range(1, len(x)):
        a, b = x[order[k - 1] :][:width], x[order[k] :][:width]
        shared[k] = next((j for j, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return order, shared


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 4), st.sampled_from([4, 1 << 20]), st.sampled_from([5, 1 << 16]))
def test_suffixes_and_shared_prefixes(x, times, memory, block):
    """In memory, and with queues, arrays and recursion beyond a memory of 4 elements."""
    x, held = x * times, suffix_sort.BLOCK
    suffix_sort.BLOCK = block
    try:
        order, shared = suffix_sort.sorted_suffixes(np.array(x, np.uint16), 1000, memory)
        assert (order.tolist(), shared.tolist()) == sorted_by_brute_force(x, 1000)
        order, shared = suffix_sort.sorted_suffixes(np.array(x, np.uint16), 6, memory)
        first = [x[i : i + 6] for i in order.tolist()]
        assert first == sorted(first) and sorted(order.tolist()) == list(range(len(x)))
        equal = [False, *(a == b and len(a) == 6 for a, b in zip(first, first[1:], strict=False))][: len(x)]
        assert [n == 6 for n in shared.tolist()] == equal
    finally:
        suffix_sort.BLOCK = held


def test_suffixes_beyond_memory_use_disk(monkeypatch):
    blocks = []
    put = suffix_sort.Disk.put
    monkeypatch.setattr(suffix_sort.Disk, "put", lambda self, a: blocks.append(len(a)) or put(self, a))
    monkeypatch.setattr(suffix_sort, "BLOCK", 256)
    x = np.random.default_rng(1).integers(1, 5, 20_000).astype(np.uint16)
    order, shared = suffix_sort.sorted_suffixes(x, 100, 500)
    assert sum(blocks) > 20_000 and isinstance(order.base, np.memmap)
    body = x.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(x)), key=lambda i: body[i:])


def test_windows_are_grouped_by_the_sort(spark, monkeypatch):
    """Where the sort says that no suffixes share a window, windows that only it can tell are no longer removed."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 122, 6000).astype(np.uint8))
    body = text[:1000] + b"#" + text[200:420] + b"!" + text[300:520]
    symbols, bounds = suffix_dedup.SYMBOLS[np.frombuffer(body, np.uint8)], np.array([0, len(body)])
    runs = repeats.Runs(symbols, bounds, 100, 32)
    pieces = suffix_dedup.Pieces(symbols, runs, np.ones(len(runs.lo), bool))

    def groups():
        w = suffix_dedup.SortedWindows(np.frombuffer(body, np.uint8), symbols, pieces, np.ones(len(pieces.lo), bool), np.zeros(1, np.int64), 50)
        return len(w.starts), int(w.first.sum())

    n, distinct = groups()
    assert distinct == len({body[s : s + 100] for s in range(len(body) - 99)}) < n == len(body) - 99
    real = suffix_dedup.sorted_suffixes
    monkeypatch.setattr(suffix_dedup, "sorted_suffixes", lambda x, w, m: (real(x, w, m)[0], np.zeros(len(x), np.uint8)))
    assert groups() == (n, n)


def test_runs_over_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    symbols = rng.integers(1, 4, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = repeats.Runs(symbols, np.array([0, 200, 500]), 20, 5)
    monkeypatch.setattr(repeats, "CHUNK", 64)
    cut = repeats.Runs(symbols, np.array([0, 200, 500]), 20, 5)
    every = np.ones(len(whole.lo), bool), np.ones(len(cut.lo), bool)
    assert repeats.starts_in(whole, every[0]).tolist() == repeats.starts_in(cut, every[1]).tolist() == [*range(181), *range(200, 481)]


def fingerprint(text, words=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or [" ".join(w)]
    ones = collections.Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def grouped(keys, linked):
    """Component of each index."""
    parent = list(range(len(keys)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if linked(keys[a], keys[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(len(keys))]


@pytest.mark.parametrize("chunk", [4096, 2])
def test_simhash(spark, monkeypatch, chunk):
    full = simhash.near_duplicate_fingerprints
    monkeypatch.setattr(simhash, "near_duplicate_fingerprints", lambda *a, **k: full(*a, chunk=chunk, **k))
    docs = fx.documents(spark)
    rows = ordered(docs)
    fps = [fingerprint(t) for _, t in rows]
    groups = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {g: min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None) for g in set(groups)}
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(docs).collect()]
    same_rows(got, [(rows[k][0], fps[k], least[groups[k]]) for k in range(len(rows))])
    assert simhash.simhash_components(fx.empty(spark)).count() == 0


def test_pivot_keys_meet():
    tables = simhash.PivotTables(5)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for bits in range(4):
        b = a.copy()
        for k in range(len(a)):
            for bit in rng.choice(64, bits, replace=False):
                b[k] ^= np.uint64(1) << np.uint64(bit)
        assert (np.stack([x == y for x, y in zip(tables.keys(a), tables.keys(b), strict=True)]).any(0)).all()
        assert np.abs(tables.coordinates(a).astype(int) - tables.coordinates(b).astype(int)).max() <= bits


def test_similar_groups(spark):
    rng = __import__("random").Random(9)
    rows, k = [], 0
    for g in range(25):
        words = fx.sentence(rng, 300).split()
        for copy in range(3):
            changed = list(words)
            for _ in range(0 if copy == 0 else 3):
                changed[rng.randrange(len(changed))] = f"new{rng.random()}"
            rows.append((k, g, " ".join(changed)))
            k += 1
    rows += [(None, 90, None), (500, 90, ""), (501, 91, fx.sentence(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, g int, text string").repartition(3)
    out = simhash_similar.similar_components(docs, "doc_id", "text").collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(set)
    for r in out:
        by[r["component_id"]].add(r["g"])
    assert all(len(x) == 1 for x in by.values()) and len(by) == 27
    assert sum(r["leader"] for r in out) == 27
    assert simhash_similar.leaders(docs).columns == docs.columns
    assert simhash_similar.leaders(docs.limit(0)).count() == 0


def shingle_set(text, words=5):
    w = WORD.findall(text.lower())
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("chunk", [4096, 3])
def test_similar_groups_against_brute_force(spark, chunk):
    rng = __import__("random").Random(4)
    notice = fx.sentence(rng, 30)
    texts = []
    for g in range(16):  # chains of copies around the limit, some with a notice or with lines repeated
        words = fx.sentence(rng, rng.choice([6, 30, 150, 400])).split()
        for copy in range(7):
            changed = list(words)
            for _ in range(round(len(words) * rng.choice([0, 0.01, 0.015, 0.02, 0.022, 0.025, 0.03, 0.06]))):
                changed[rng.randrange(len(changed))] = f"new{rng.random()}"
            texts.append(" ".join(changed) + rng.choice(["", " " + notice, " tail " * 40]))
    texts += [None, " ", "one", "One", "two words"]
    sets = [shingle_set(t or "") for t in texts]
    groups = grouped(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = simhash_similar.similar_components(docs, "doc_id", "text", chunk=chunk).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(enumerate(groups))
    assert 1 < sum(r["leader"] for r in out) == len(set(groups)) < len(texts)


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(8)
    for k in range(400):
        n = int(rng.integers(1, 300))
        base = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        frequent = base[:: max(1, int(rng.integers(1, 5)))]
        overlaps = simhash_similar.Overlaps(0.8, frequent, rng.integers(1, 9, len(frequent)))
        a = base[: max(1, len(base) // 2)]
        gone, more = int(rng.integers(0, len(a) // 6 + 1)), int(rng.integers(0, len(a) // 6 + 1))
        b = np.unique(np.r_[rng.permutation(a)[gone:], base[len(a) : len(a) + more]])
        both = len(np.intersect1d(a, b))
        assert overlaps.similar(a, b) == (5 * both >= 4 * (len(a) + len(b) - both))
        if not overlaps.similar(a, b):
            continue
        rows, bits = [], [np.packbits(np.bincount((x >> np.uint64(56)).astype(int), minlength=256) & 1).view(np.int64) for x in (a, b)]
        for rep, x in enumerate((a, b)):
            rows += [[int(g), rep, len(x), place, rep, *bits[rep].tolist()] for place, g in enumerate(overlaps.prefix(x))]
        found = [len(i) for all_pairs in (False, True) for i, _ in overlaps.candidates(np.array(sorted(rows)), all_pairs)]
        assert found[0] > 0 and found[1] > 0


def test_templates_are_not_copies(spark):
    rng = __import__("random").Random(6)
    template = fx.sentence(rng, 300)  # the texts share about 70 % of their shingles
    rows = [(k, template + " " + fx.sentence(rng, 64)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash_similar.leaders(docs).count() == 40


def statistics(text):
    w = WORD.findall(text)
    n, seen = len(w), collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(n - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    docs = fx.documents(spark)
    expected = []
    for key, text in ordered(docs):
        s = statistics(text)
        expected.append((key, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    out = quality.quality_rules(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same_rows([tuple(r) for r in out.select(*names).collect()], expected)
    assert quality.quality_rules(fx.empty(spark)).count() == 0


def test_frequent_lines(spark):
    rng = __import__("random").Random(3)
    line = "Read our notice on cookies and terms before you go on with this page of ours now please"
    rows = [(k, f"{line}\n{fx.sentence(rng, 200)}", "h") for k in range(30)]
    rows += [(100 + k, "\n".join([line.upper() + " "] * 4) + "\n" + fx.sentence(rng, 20), "h") for k in range(3)]
    copy = "\n".join(fx.sentence(rng, 40) for _ in range(8))
    rows += [(200 + k, copy, "h") for k in range(60)]
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_text=True).collect()}
    assert all(out[k]["kept"] and out[k]["removed_words"] == 18 and out[k]["kept_text"] == rows[k][1].split("\n")[1] for k in range(30))
    assert not any(out[100 + k]["kept"] for k in range(3))  # depleted
    assert all(out[200 + k]["kept"] and out[200 + k]["removed_words"] == 0 for k in range(60))  # copies count once


def test_several_frequent_lines(spark):
    rng = __import__("random").Random(7)
    common = [fx.sentence(rng, 12) for _ in range(6)]
    rows = [(k, "\n".join([*common, fx.sentence(rng, 200)]), "h") for k in range(30)]
    rows += [(100 + k, "\n".join(common[: k % 6 + 1]), "h") for k in range(30)]  # wholly of common lines, copies among them
    out = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_text=True).collect()}
    assert all(out[k]["kept"] and out[k]["removed_words"] == 72 and out[k]["kept_text"] == rows[k][1].split("\n")[-1] for k in range(30))
    assert all(out[100 + k]["removed_words"] == 12 * (k % 6 + 1) and not out[100 + k]["kept"] for k in range(30))


def test_packing(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    docs = fx.documents(spark)
    rows = packing.pack_documents(docs, packing.tokenizer_path(), with_ids=True).collect()
    expected = []
    for key, text in ordered(docs):
        ids = [*own.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected += [(key, p, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
    same_rows([tuple(r)[:5] for r in rows], expected)
    bins = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(e[3] for e in expected) // 2048) + 1
    assert packing.pack_documents(fx.empty(spark), packing.tokenizer_path()).count() == 0


def test_packing_in_mixed_order(spark):
    rng = __import__("random").Random(1)
    rows = [(None if k == 9 else k, fx.sentence(rng, rng.randint(20, 200)), "a" if k % 5 else "b") for k in range(600)]
    rows += [(7, "another text with an id of its neighbour", "b"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack_mixed(docs, packing.tokenizer_path(), capacity=256, weights={"a": 1, "b": 1}, block_chars=2000, window_slots=8).collect()
    plain = packing.pack_documents(docs, packing.tokenizer_path(), capacity=256)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same_rows([tuple(r[n] for n in names) for r in out], [tuple(r) for r in plain.select(*names).collect()])
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert sorted(bins) == list(range(len(bins)))
    # a fifth of the documents are of b; while it lasts, each prefix beyond a window holds half of b
    source, ids = {r[0]: r[2] for r in rows[:600]}, collections.Counter()
    total_b = sum(r["length"] for r in out if source[r["doc_id"]] == "b")
    for r in sorted(out, key=lambda r: r["sequence_id"]):
        ids[source[r["doc_id"]]] += r["length"]
        if ids.total() > 12_000 and ids["b"] < 0.85 * total_b:
            assert 0.35 < ids["b"] / ids.total() < 0.65
    assert packing.pack_mixed(fx.empty(spark), packing.tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_best_two_fit(lengths):
    counts = [lengths.count(n) for n in range(61)]
    plan = packing.best_two_fit(counts, 60)
    used = collections.Counter(x for chosen, times in plan for x in chosen for _ in range(times))
    assert used == collections.Counter(lengths) and all(sum(c) <= 60 for c, _ in plan)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=6))
def test_pfair_deviation(weights):
    w = {str(k): n for k, n in enumerate(weights)}
    slots, total = mixing.pfair_period(w), sum(weights)
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for s, n in w.items():
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - t * n / total) < 1


@pytest.mark.parametrize("broadcast_phases", [20_000, 0])
def test_mixing(spark, broadcast_phases):
    docs = fx.documents(spark)
    weights = {"src0": 3, "src1": 2, mixing.NO_SOURCE: 1}
    rows = mixing.mix_sources(docs, weights, block_chars=200, broadcast_phases=broadcast_phases).collect()
    assert len(rows) == docs.count()
    blocks = {}
    for r in rows:
        key = r["source"] or mixing.NO_SOURCE, r["block"]
        assert r["block"] == r["start"] // 200 and blocks.setdefault(key, r["slot"]) == r["slot"]
    assert len(set(blocks.values())) == len(blocks)
    # one at a time: the closed form against the schedule played out
    chars = collections.Counter()
    for r in rows:
        chars[r["source"] or mixing.NO_SOURCE] += len(r["text"] or "") + 1
    plan, order = {s: -(-n // 200) for s, n in chars.items()}, {}
    given_weights, done, slot = {s: weights.get(s, 1) for s in plan}, {s: 0 for s in plan}, 0
    while live := {s: given_weights[s] for s in plan if done[s] < plan[s]}:
        period, base, begun = mixing.pfair_period(live), slot, dict(done)
        at = {p: s for s, ps in period.items() for p in ps}
        while all(done[s] < plan[s] for s in live):
            s = at[(slot - base) % sum(live.values())]
            order[s, done[s]] = slot
            done[s] += 1
            slot += 1
        assert begun != done
    assert all(order[k] == v for k, v in blocks.items())
    assert mixing.mix_sources(fx.empty(spark)).count() == 0
    assert mixing.mixed_order(docs).columns == docs.columns


def test_first_sequences_and_columns_of_any_name(spark):
    from lectern.llm._common import Scratch

    rng = np.random.default_rng(3)
    rows = [(int(w), int(n)) for w, n in zip(rng.permutation(500), rng.integers(1, 9, 500), strict=True)]
    got = packing.first_sequences(spark.createDataFrame(rows, "window long, n long"), Scratch(spark, "test"), 7)
    total, expected = 0, []
    for w, n in sorted(rows):
        expected.append((w, total))
        total += n
    assert sorted(map(tuple, got.collect())) == expected
    pieces = spark.createDataFrame([(k, 900 + k % 3, 9, 8, 7) for k in range(40)], "id long, length long, _rank int, `_bu.cket` int, c0 int")
    out = packing.pack(pieces, Scratch(spark, "test"), ["id"])
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    assert {(r["_rank"], r["_bu.cket"], r["c0"]) for r in out.collect()} == {(9, 8, 7)} and out.count() == 40


def test_fingerprints_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 2)], "doc_id long, text string, _bytes string, `a.b` int")
    out = simhash.fingerprints(docs)
    assert out.columns == ["doc_id", "_bytes", "a.b", "fp"] and tuple(out.first())[:3] == (1, "x", 2)
