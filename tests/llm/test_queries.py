"""The registered queries of the subpackage and the pipeline at the smallest scale."""

import collections
import random
import re

import pytest
from oracle import compare, connect

from lectern import llm
from lectern.llm import quality

from . import fixtures as fx

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert compare(llm.queries()[name](spark, sf_dir), connect(sf_dir), llm.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert llm.queries()[name](spark, sf_dir).count() > 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns, name
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    assert 0 < before.count() < docs.count()
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == before.count()


def test_repeated_string_stage_keeps_rows(spark, sf_dir):
    rng = random.Random(2)
    texts = [fx.sentence(rng, 60) for _ in range(6)]
    rows = [(None, texts[0], "a", "en", 1), (None, texts[1], None, None, None), (7, texts[2], "a", "en", 1), (7, texts[3], "b", "fr", 1), (7, texts[4], None, "de", 1), (8, texts[5], "c", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(2)
    out = corpus_pipeline.repeated_string_stage(spark, docs, sf_dir)
    assert out.dtypes == docs.dtypes
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((*r[:4], len(r[1]))) for r in rows)
    assert corpus_pipeline.repeated_string_stage(spark, docs.limit(0), sf_dir).count() == 0


def as_rows(df):
    return collections.Counter(map(repr, map(tuple, df.collect())))


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def judged(rows, min_docs):
    """Whether the quality rules keep each row (doc_id, text, source, ...), by counting."""
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    lines = [[normal(x) for x in (r["text"] or "").split("\n") if words_of(x)] for r in rows]
    copies = {(r["source"], frozenset(x)) for r, x in zip(rows, lines, strict=True)}
    docs, hosts = collections.Counter((h, x) for h, s in copies for x in s), collections.Counter(h for h, _ in copies)
    for r, own in zip(rows, lines, strict=True):
        w = words_of(r["text"])
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = collections.Counter(windows)
        again = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(3)}
        lost = sum(len(x.split(" ")) for x in own if docs[r["source"], x] > max(min_docs, 0.05 * hosts[r["source"]]))
        yield len(w) >= 50 and 100 * len(again) <= 50 * len(w) and 100 * lost <= 50 * len(w)


def test_quality_stage_on_awkward_rows(spark, sf_dir):
    rng = random.Random(9)
    common = [fx.sentence(rng, 9) for _ in range(30)]  # boilerplate of which each document has a part, in any order
    rows = [(k, "\n".join([*rng.sample(common, 25), fx.sentence(rng, 12)]), "h", "en", 0) for k in range(60)]
    rows += [(100 + k, "\n".join([*rng.sample(common, 5), fx.sentence(rng, 90)]), "h", "en", 0) for k in range(30)]
    rows += [(200 + k, rows[0][1], "h", "en", 0) for k in range(40)]  # copies count once
    rows += [(300 + k, "\n".join(common[:20]) + "\n" + fx.sentence(rng, 20), None, "en", 0) for k in range(15)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    for docs in (plain, fx.documents(spark), plain.limit(0)):
        held = docs.collect()
        expected = collections.Counter(repr(tuple(r)) for r, keep in zip(held, judged(held, 20), strict=True) if keep)
        got = corpus_pipeline.quality_stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and as_rows(got) == expected
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, plain, sf_dir).collect()}
    assert kept == {*range(100, 130), *range(300, 315)}


def test_copies_of_one_document_do_not_raise_the_limit(spark):
    rng = random.Random(3)
    notice = [fx.sentence(rng, 9) for _ in range(20)]
    rows = [(k, "\n".join([*notice, fx.sentence(rng, 60)]), "h") for k in range(100)]
    rows += [(1000 + k, fx.sentence(random.Random(1), 80), "h") for k in range(3000)]  # 3,000 copies: 5 % of all rows would be 155
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = quality.quality_rules(docs, with_text=True).collect()
    assert {r["removed_words"] for r in out if r["doc_id"] < 1000} == {180} and {r["removed_words"] for r in out if r["doc_id"] >= 1000} == {0}
    assert not any(r["kept"] for r in out if r["doc_id"] < 1000)
    assert {len(r["kept_text"].split()) for r in out if r["doc_id"] < 1000} == {60}


def test_common_lines_are_struck_in_the_query(spark, sf_dir):
    out = llm.queries()["quality_common_lines"](spark, sf_dir).collect()
    assert any(r["removed_words"] > 0 for r in out) and any(not r["kept"] and not r["base_failed"] for r in out)


def test_near_duplicate_stage_on_awkward_rows(spark, sf_dir):
    def shingles(t):
        w = words_of((t or "").lower())
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    docs = fx.documents(spark)
    held = docs.collect()
    sets = [shingles(r["text"]) for r in held]
    top = list(range(len(held)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(held)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if sets[a] == sets[b] or both and 5 * len(sets[a] & sets[b]) >= 4 * both:
                top[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(held)):
        groups[find(k)].append(held[k]["doc_id"])
    least = sorted((min((x for x in ids if x is not None), default=None) for ids in groups.values()), key=repr)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and not as_rows(out) - as_rows(docs)
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == least
    assert corpus_pipeline.near_duplicate_stage(spark, fx.empty(spark), sf_dir).count() == 0


def test_repeated_string_stage_on_awkward_rows(spark, sf_dir):
    docs = fx.documents(spark).coalesce(1)
    held = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    bodies = [(r["text"] or "").encode() for r in held]
    expected = collections.Counter()
    for r, body, starts in zip(held, bodies, fx.repeated_starts(bodies, 100), strict=True):
        gone = fx.spans_of(len(body), starts, 100)
        text = bytes(b for b, g in zip(body, gone, strict=True) if not g).decode("utf-8", "replace")
        if text.strip(" "):
            row = r.asDict() | {"text": text, "n_chars": len(text)}
            expected[repr(tuple(row[c] for c in docs.columns))] += 1
    out = corpus_pipeline.repeated_string_stage(spark, docs, sf_dir)
    assert out.dtypes == docs.dtypes and as_rows(out) == expected


def test_mixing_and_packing_stages_on_awkward_rows(spark, sf_dir):
    docs = fx.documents(spark)
    mixed = corpus_pipeline.mixing_stage(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and as_rows(mixed) == as_rows(docs)
    assert corpus_pipeline.mixing_stage(spark, fx.empty(spark), sf_dir).count() == 0
    pieces = corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()
    assert collections.Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in docs.collect())
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert corpus_pipeline.packing_stage(spark, fx.empty(spark), sf_dir).count() == 0


def test_frames_made_of_a_stage_keep_its_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = corpus_pipeline.quality_stage(spark, docs, sf_dir).where("doc_id >= 0")
    n = corpus_pipeline.mixing_stage(spark, d, sf_dir).count()
    corpus_pipeline.near_duplicate_stage(spark, docs.limit(5), sf_dir)
    assert d.count() == n > 0
