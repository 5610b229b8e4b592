"""Models in tasks: loads, batches, time limits, and answers that are kept."""

import os
import time

from pyspark.sql import functions as F

from lectern.plans import answering, inference


def logged(folder, line):
    with open(os.path.join(folder, f"{os.getpid()}.log"), "a") as f:
        f.write(line + "\n")


def lines(folder):
    return {name: open(os.path.join(folder, name)).read().split("\n")[:-1] for name in os.listdir(folder)}


def test_embedding_in_batches_by_a_model_loaded_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        logged(folder, "load")

        def model(texts):
            logged(folder, str(len(texts)))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = spark.range(100).select(F.concat(F.lit("text "), F.col("id")).alias("t")).coalesce(1)
    got = rows.select("t", inference.ModelEmbedder(load).embed(F.col("t")).alias("e")).collect()
    assert len(got) == 100 and all(abs(sum(x * x for x in r["e"]) - 1) < 1e-9 for r in got)
    (told,) = lines(folder).values()
    assert told.count("load") == 1 and max(int(x) for x in told[1:]) == 8 and sum(int(x) for x in told[1:]) == 100


def test_answers_are_cut_off_late_or_broken(spark):
    def load():
        def model(prompt):
            if "late" in prompt:
                time.sleep(30)
            if "bad" in prompt:
                raise OSError("no model")
            return prompt.upper(), "length" if "long" in prompt else "stop"

        return model

    rows = spark.createDataFrame([("a",), ("long",), ("late",), ("bad",), (None,)], "p string").coalesce(1)
    got = {r["p"]: r["a"] for r in rows.select("p", inference.ModelGenerator(load, seconds=1.0).generate(F.col("p")).alias("a")).collect()}
    assert got == {"a": "A", "long": "", "late": None, "bad": None, None: None}


def test_a_second_run_makes_no_call(spark, tmp_path):
    folder, calls = str(tmp_path / "answers"), str(tmp_path / "calls")
    os.mkdir(calls)

    def load():
        def model(prompt):
            logged(calls, "call")
            return '{"answer": "Le délai de dépôt est de dix jours."}', "stop"

        return model

    n = lambda: sum(map(len, lines(calls).values()))
    store, model = inference.AnswerStore(spark, folder), inference.ModelGenerator(load, "m1")
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None)], "k int, p string").repartition(3)
    first = store.answered(rows, F.col("p"), model, "a").collect()
    assert n() == 2 and {r["k"]: r["a"] is None for r in first} == {1: False, 2: False, 3: False, 4: True}
    assert sorted(first) == sorted(store.answered(rows, F.col("p"), model, "a").collect()) and n() == 2
    store.answered(rows, F.col("p"), inference.ModelGenerator(load, "m2"), "a").collect()
    assert n() == 4  # other settings, other answers

    texts = [(1, "Le délai de dépôt est de dix jours ouvrables.", "026_2021_fr.pdf", 1)]
    chunks = spark.createDataFrame(texts, "id long, content string, source string, page int").withColumns({"language": F.lit("fr"), "readable": F.lit(True), "chunk": F.lit(0), "document": F.col("content")})
    e = answering.HashEmbedder()
    chunks = answering.embed_passages(chunks, e).drop("document")
    asked = answering.embed_questions(spark.createDataFrame([(1, "Quel est le délai ?"), (2, "Quel est le délai de dépôt ?")], "question_id int, question string"), e)
    before, told = n(), "Le délai de dépôt est de dix jours.\n\nSource : 026_2021_fr.pdf, page 1"
    for _ in range(2):
        kept = answering.ask(chunks, asked, model, store=store).select("question_id", "answer", "error")
        assert sorted(map(tuple, kept.collect())) == [(1, told, None), (2, told, None)] and n() == before + 2
    spark.catalog.clearCache()
