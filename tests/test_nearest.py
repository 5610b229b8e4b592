"""Bounded nearest-neighbour search against all pairs, and its plan."""

import contextlib
import io
import random

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from lectern import registry
from lectern.operators import nearest, retrieval


def tables(spark):
    rng = random.Random(8)
    v = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] if rng.random() < 0.9 else rng.choice([None, [0.0] * 4, [1.0], [float("nan")] * 4])
    rows = [(k, v(), f"Src{k % 5}_x", rng.choice(["fr", "en", None]), rng.choice([True, False, None]), "clash") for k in range(300)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>, source string, language string, readable boolean, _rank string").repartition(5)
    asked = [(k, [float(k % 3), 1.0, -0.5, 0.5], ["fr", "en", None][k % 3], [None, "sRC1", "src4_X", "zz"][k % 4]) for k in range(9)]
    return rows, asked, chunks, spark.createDataFrame(asked, "question_id long, query array<double>, question_language string, prefix string")


def all_pairs(rows, asked):
    import math

    norm = lambda x: math.sqrt(sum(y * y for y in x))
    for i, e, source, language, readable, _ in rows:
        if e and len(e) == 4 and norm(e) > 0:
            for q, x, ql, prefix in asked:
                d = round(1 - sum(a * b for a, b in zip(e, x, strict=True)) / norm(e) / norm(x), 6) + 0.0
                named = prefix is not None and source.lower().startswith(prefix.lower()) and readable
                yield q, i, d, {"all"} | ({"own"} if language and language == ql and readable else set()) | ({"named"} if named else set())


@pytest.mark.parametrize("block", [nearest.QUESTIONS, 2])
def test_nearest_and_within(spark, monkeypatch, block):
    rows, asked, chunks, questions = tables(spark)
    monkeypatch.setattr(nearest, "FAN", 2)
    ways = [nearest.Way(0, "named", 3), nearest.Way(1, "own", 2), nearest.Way(2, "all", 7)]
    pairs = list(all_pairs(rows, asked))
    expected = []
    for w in ways:
        for q, *_ in asked:
            best = sorted((d, i) for of, i, d, kinds in pairs if of == q and w.kind in kinds)[: w.k]
            expected += [(q, w.number, i, d, rank) for rank, (d, i) in enumerate(best, 1)]
    got = nearest.nearest(chunks, questions, ways, block)
    assert set(got.columns) == {*chunks.columns, *questions.columns, "_way", "distance", "rank"} - {"embedding", "query"}
    assert sorted((r["question_id"], r["_way"], r["id"], r["distance"], r["rank"]) for r in got.collect()) == sorted(expected)
    prefix = {q: p for q, _, _, p in asked}
    assert all(r["prefix"] == prefix[r["question_id"]] for r in got.collect())
    near = nearest.within(chunks, questions, 0.25, block)
    assert sorted((r["question_id"], r["id"], r["distance"]) for r in near.collect()) == sorted((q, i, d) for q, i, d, _ in pairs if d <= 0.25)


def test_without_rows(spark):
    _, _, chunks, questions = tables(spark)
    way = [nearest.Way(0, "all", 3)]
    assert nearest.nearest(chunks.limit(0), questions, way).count() == nearest.nearest(chunks, questions.limit(0), way).count() == 0
    assert nearest.within(chunks, questions.limit(0), 1.0).count() == 0


def test_a_task_keeps_no_more_than_its_nearest():
    best = nearest.Nearest(3, 2)
    import numpy as np
    import pyarrow as pa

    for k in range(200):
        d = np.random.default_rng(k).random((50, 2))
        best.offer(d, pa.RecordBatch.from_arrays([pa.array(range(50 * k, 50 * k + 50))], names=["id"]))
        assert sum(t.num_rows for t in best.held) <= 4 * 3 * 2 + 100
    assert best.settle().num_rows == 6


def test_a_row_is_held_once_however_many_questions_it_is_near_to():
    import numpy as np
    import pyarrow as pa

    best = nearest.Nearest(20, 200)
    for k in range(5):
        texts = [f"{n:04d}" * 250 for n in range(200 * k, 200 * k + 200)]
        best.offer(np.random.default_rng(k).random((200, 200)), pa.RecordBatch.from_arrays([pa.array(range(200 * k, 200 * k + 200)), pa.array(texts)], names=["id", "content"]))
        assert sum(t.nbytes for t in [*best.held, *getattr(best, "rows", [])]) < 4e6
    found = pa.concat_tables(best.slices())
    assert found.num_rows == 20 * 200
    assert all(c == f"{i:04d}" * 250 for i, c in zip(found.column("id").to_pylist(), found.column("content").to_pylist(), strict=True))


def test_ways_by_language_and_one_of_each(spark, monkeypatch):
    rows, asked, chunks, questions = tables(spark)
    monkeypatch.setattr(nearest, "FAN", 2)
    chunks = chunks.withColumn("page", F.when(F.col("id") % 9 != 4, (F.col("id") % 3).cast("int")))
    languages, of, page = {q: x for q, _, x, _ in asked}, {r[0]: r for r in rows}, lambda i: i % 3 if i % 9 != 4 else None
    places = {1: ("Src1_x", [0, 2]), 2: ("Src4_x", [1]), 5: (None, [1]), 7: ("Src0_x", [])}
    told = spark.createDataFrame([(q, *places.get(q, (None, None))) for q, *_ in asked], "question_id long, _source string, _pages array<int>")
    same = lambda q, i: languages[q] is not None and of[i][3] == languages[q]
    beside = lambda q, i: q in places and places[q][0] == of[i][2] and page(i) in places[q][1]
    admits = {"language": same, "foreign": lambda q, i: of[i][3] != languages[q], "beside": beside, "beside_language": lambda q, i: beside(q, i) and same(q, i), "all": lambda q, i: True}
    ways = [nearest.Way(0, "language", 4), nearest.Way(1, "foreign", 2, ("source",)), nearest.Way(2, "all", 6, ("source", "page")), nearest.Way(3, "beside", 5), nearest.Way(4, "beside_language", 3)]
    pairs, expected = list(all_pairs(rows, asked)), []
    for w in ways:
        for q, *_ in asked:
            seen, rank = set(), 0
            for d, i in sorted((d, i) for p, i, d, _ in pairs if p == q and admits[w.kind](q, i)):
                key = tuple({"source": of[i][2], "page": page(i)}[c] for c in w.each) or i
                if key not in seen and rank < w.k:
                    seen.add(key)
                    rank += 1
                    expected.append((q, w.number, i, d, rank))
    got = nearest.nearest(chunks, questions.join(told, "question_id"), ways)
    assert sorted((r["question_id"], r["_way"], r["id"], r["distance"], r["rank"]) for r in got.collect()) == sorted(expected)


def test_context_from_the_nearest_is_that_of_all_ranked(spark):
    _, _, chunks, questions = tables(spark)
    chunks = chunks.where("size(embedding) = 4 and exists(embedding, x -> x <> 0 and not isnan(x))").withColumns({"page": (F.col("id") % 4).cast("int"), "chunk": F.lit(0)})
    questions = questions.withColumn("expand", F.col("question_id") % 2 == 0)
    pairs = chunks.crossJoin(questions).withColumn("distance", retrieval.cosine_distance(F.col("embedding"), F.col("query")))
    whole = retrieval.select_context(retrieval.language_ranked(pairs)).select("question_id", "id", "mode", "place")
    got = retrieval.nearest_context(chunks, questions).select("question_id", "id", "mode", "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


SEARCHES = ["top2_language_ranking", "win2_first_of_key", "win5_foreign_best", "set1_preferred_and_readable", "set2_with_fallback", "ret2_select_context", "ret4_weak_match"]


@pytest.mark.parametrize("name", [*SEARCHES, "joi11_same_source_neighbours", "agg12_summary"])
def test_searches_make_no_pairs_and_read_no_texts(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "text#" not in plan


def test_no_language_is_one_more_language(spark):
    rows = [(1, "Quel délai pour le texte ?", "", "rien", 1, 0.1, "fr"), (1, "Quel délai pour le texte ?", "", "quel texte, délai pour le texte", 2, 0.12, None)]
    asked = spark.createDataFrame(rows, "question_id long, question string, answer string, content string, place int, distance double, language string")
    assert [r["place"] for r in retrieval.evidence(asked).collect()] == [1]


@pytest.mark.parametrize("name", ["ret1_search", "top1_vector_knn", "joi5_similarity_pairs", "top3_document_knn"])
def test_no_pair_of_all_is_a_row(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        df.explain("formatted")
    assert "NestedLoop" not in shown.getvalue() and "Cartesian" not in shown.getvalue() and "Generate" not in shown.getvalue()
    assert compare(df, connect(sf_dir), registry.oracle_sql()[name]) is None


def test_condition_columns_reach_the_scan(spark, sf_dir):
    from lectern.plans import frames as fr

    chunks = fr.vectors(spark, sf_dir).where(F.col("language") == "fr")
    assert retrieval.knn(chunks, fr.questions(spark, sf_dir), 2).where("language <> 'fr'").count() == 0


def test_indexed_search_loses_no_neighbour(spark, tmp_path):
    from lectern.operators import vector_index

    rng = random.Random(5)
    spots = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = lambda s: [x + rng.gauss(0, 0.05) for x in s]
    rows = [(k, near(rng.choice(spots[:3] if k % 3 else spots)), f"s{k % 4}") for k in range(1500)] + [(2000, None, "s"), (2001, [0.0] * 8, "s"), (2002, [1.0], "s")]
    rows += [(3000 + k, rows[0][1], "copy") for k in range(30)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>, source string").repartition(6)
    questions = spark.createDataFrame([(q, near(spots[q % 12])) for q in range(40)] + [(99, None)], "question_id long, query array<double>")
    index = vector_index.build(chunks, str(tmp_path / "cells"), 24)
    assert index.sizes.sum() == 1530 and (index.radius <= 2).all()
    for k in (1, 10, 2000):
        found, share = vector_index.search(spark, index, chunks.schema, questions, k)
        exact = nearest.nearest(chunks, questions, [nearest.Way(0, "all", k)])
        columns = ["question_id", "rank", "id", "distance", "source"]
        assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, exact.select(columns).collect()))
        assert share < 0.5 if k < 2000 else share == 1.0
    none, share = vector_index.search(spark, index, chunks.schema, questions.limit(0), 3)
    assert none.count() == 0 and share == 0.0
    empty = vector_index.build(chunks.limit(0), str(tmp_path / "none"), 4)
    assert vector_index.search(spark, empty, chunks.schema, questions, 3)[0].count() == 0
