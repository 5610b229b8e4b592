"""Streams and the answering plan."""

import datetime

from pyspark.sql import functions as F

from lectern.plans import answering
from lectern.streaming import extensions


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("p.pdf", 1, "a" * 900, t), ("p.pdf", 2, "b", t), ("q.pdf", 1, "b", t)]
    df = spark.createDataFrame(rows, "relative_path string, page int, text string, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    pages = extensions.page_stream(spark, str(tmp_path / "in"), df.schema)
    run(extensions.chunk_stream(pages), "chunks")
    assert spark.table("chunks").count() == 4
    run(extensions.new_content(pages, "at"), "fresh")
    assert spark.table("fresh").count() == 2
    run(extensions.session_recency(pages, "relative_path", "at"), "recent", "complete")
    assert {r["relative_path"]: r["messages"] for r in spark.table("recent").collect()} == {"p.pdf": 2, "q.pdf": 1}


def test_ask(spark):
    rows = [(1, "Le délai de dépôt est de dix jours ouvrables pour tous. Il peut être prolongé.", "026_2021_fr.pdf", 1), (2, "Les taxes sont fixées par la loi de finances de chaque année.", "x_fr.pdf", 3)]
    chunks = spark.createDataFrame(rows, "id long, content string, source string, page int").withColumns({"language": F.lit("fr"), "readable": F.lit(True), "chunk": F.lit(0), "document": F.col("content")})
    e = answering.HashEmbedder()
    chunks = answering.embed_passages(chunks, e).drop("document")
    asked = spark.createDataFrame([(1, "Quel est le délai du texte n° 26 ?"), (2, "Comment les taxes sont fixées par la loi ?")], "question_id int, question string")
    got = {r["question_id"]: r for r in answering.ask(chunks, answering.embed_questions(asked, e), answering.ExtractiveGenerator()).collect()}
    assert got[1]["answer"] == "Le délai de dépôt est de dix jours ouvrables pour tous.\n\nSource : 026_2021_fr.pdf, page 1"
    assert [s["source"] for s in got[1]["sources"]] == ["026_2021_fr.pdf"]
    assert got[2]["answer"].endswith("Source : x_fr.pdf, page 3")


class Scripted:
    """Says what it is told to for each case that a question names, by what the prompt asks for."""

    def __init__(self, cases):
        self.cases = cases

    def generate(self, prompt):
        t, said = answering.TEMPLATES["fr"], F.lit("")
        for k, (first, repaired, consistent) in enumerate(self.cases):
            one = F.when(prompt.contains(t["consistency"][:30]), consistent).when(prompt.contains(t["repair"]), repaired).otherwise(first)
            said = F.when(prompt.contains(f"cas {k}."), one).otherwise(said)
        return F.when(said == "", "").otherwise(F.to_json(F.struct(said.alias("answer"))))


def test_prompts_again(spark):
    rows = [(1, "Le texte 026/2021 fixe le délai de dépôt à dix jours. Le texte 030/2021 est abrogé.", "a_fr.pdf", 1)]
    chunks = spark.createDataFrame(rows, "id long, content string, source string, page int").withColumns({"language": F.lit("fr"), "readable": F.lit(True), "chunk": F.lit(0), "document": F.col("content")})
    e = answering.HashEmbedder()
    chunks = answering.embed_passages(chunks, e).drop("document").persist()
    footer, plain = "\n\nSource : a_fr.pdf, page 1", "Le texte 026/2021 fixe le délai de dépôt à dix jours."
    other = "La note 030/2021 fixe le délai de dépôt à vingt jours."
    cases = [
        (plain, "", ""),
        ("Excerpt: copie du contexte", plain, ""),
        (other, "", plain),
        (other, "", "La note 031/2021 fixe un autre délai de dépôt."),  # no better, so the first stays
        ("", "", ""),
        ("نعم", "نعم", ""),
    ]
    asked = spark.createDataFrame([(k, f"Quel délai fixe la note 026/2021 ? cas {k}.") for k in range(len(cases))], "question_id int, question string")
    asked = answering.embed_questions(asked, e).withColumn("prefix", F.lit(None).cast("string"))
    answers, seconds = answering.timed(chunks, asked, Scripted(cases))
    got = {r["question_id"]: (r["answer"], r["error"]) for r in answers.collect()}
    assert got == {0: (plain + footer, None), 1: (plain + footer, None), 2: (plain + footer, None), 3: (other + footer, None), 4: (None, "empty answer"), 5: (None, "invalid answer")}
    assert seconds["total_seconds"] >= seconds["generation_seconds"] >= 0
    engine = answering.Engine(chunks, e, Scripted([(plain, "", "")]))
    m = spark.createDataFrame([(7, 0, "user", "Quel délai fixe le dépôt ? cas 0."), (7, 1, "assistant", "x"), (7, 2, "user", "Pourquoi ?")], "session_id int, turn int, role string, text string")
    assert {r["turn"]: r["answer"] for r in engine.chat(m).collect()} == {0: plain + footer, 2: plain + footer}
    assert answering.Engine(chunks, e, answering.ExtractiveGenerator()).health() == {"status": "ok"}


def test_only_texts_with_a_fact_are_normalised(spark, sf_dir):
    from lectern import registry

    plan = registry.queries()["set6_token_coverage"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("EvalPython") < plan.index("Join")
