"""Question answering over a chunk table, with the models behind interfaces.

Embedding and generation are not part of the engine. The stand-ins here are deterministic and only let
the plan run; what they give says nothing about a model's quality.
"""

from __future__ import annotations

import re
import time
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig
from ..functions import references as R
from ..functions.language import chain_answer_language_matches, question_language
from ..functions.text import strip, zfill
from ..functions.unicode import references_udf
from ..operators import conversations, retrieval
from .inference import AnswerStore


class Embedder(Protocol):
    def embed(self, text: Column) -> Column:
        """array<double> of unit length for a text column."""


class Generator(Protocol):
    def generate(self, prompt: Column) -> Column:
        """Answer text for a prompt column."""


class HashEmbedder:
    """Signed feature hashing of words; equal texts get equal vectors."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, text: Column) -> Column:
        n = self.dimensions

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def run(s: pd.Series) -> pd.Series:
            def one(t):
                v = np.zeros(n)
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % n] += 1 if h >> 31 else -1
                size = np.linalg.norm(v)
                return (v / size if size else v).tolist()

            return s.map(one)

        return run(text)


class ExtractiveGenerator:
    """First sentence of the first excerpt in the prompt."""

    def generate(self, prompt: Column) -> Column:
        first = F.regexp_extract(prompt, r"(?s)Excerpt: (.*?[.!?؟](?=\s|$)|.*)", 1)
        return F.to_json(F.struct(F.trim(first).alias("answer")))


def embed_passages(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    return chunks.withColumn("embedding", embedder.embed(F.concat(F.lit("passage: "), "document")))


def embed_questions(questions: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds query, question_language, prefix and expand to (question_id, question)."""
    q = F.col("question")
    language = question_language(q)
    rows = questions.withColumn("question_language", language).withColumn("prefix", R.document_number_prefix(q))
    return rows.withColumn("expand", (language == "ar") & q.rlike("[A-Za-z]{2,}")).withColumn("query", embedder.embed(F.concat(F.lit("query: "), q)))


#: What prompts say, by language; a deployment can pass its own.
TEMPLATES = {
    "ar": {
        "intro": "أجب اعتمادا على المقتطفات التالية وحدها.",
        "question": "السؤال",
        "answer": "أجب بالعربية في {words} كلمة على الأكثر، أو قل إن المعلومة غير متوفرة.",
        "repair": "كانت الإجابة السابقة غير صالحة. أجب مباشرة دون نسخ المقتطفات ودون شرح للتفكير.",
        "consistency": "يتعلق السؤال بالوثيقة {reference} وحدها. لا تذكر أي وثيقة أخرى.",
    },
    "fr": {
        "intro": "Réponds d'après les seuls extraits qui suivent.",
        "question": "Question",
        "answer": "Réponds en français, en {words} mots au plus, ou dis que l'information n'est pas disponible.",
        "repair": "La réponse précédente n'était pas valable. Réponds directement, sans recopier les extraits ni exposer ton raisonnement.",
        "consistency": "La question porte sur le seul document {reference}. Ne cite aucun autre document.",
    },
}


def _prompt(question: Column, context: Column, parts: list[str], values: dict, templates: dict) -> Column:
    """Introduction, context, question and further parts of a question's language, with `values` in their places."""

    def told(language: str) -> Column:
        t = templates[language]
        out = [F.lit(t["intro"]), context, F.concat(F.lit(t["question"] + " : "), question)]
        for p in parts:
            text = F.lit(t[p])
            for name, value in values.items():
                text = F.replace(text, F.lit("{" + name + "}"), value)
            out.append(text)
        return F.concat_ws("\n\n", *out)

    return F.when(question_language(question) == "ar", told("ar")).otherwise(told("fr"))


def answer_prompt(question: Column, context: Column, words: int = DEFAULT.answer_words, templates: dict = TEMPLATES) -> Column:
    return _prompt(question, context, ["answer"], {"words": F.lit(str(words))}, templates)


def repair_prompt(question: Column, context: Column, words: int = DEFAULT.answer_words, templates: dict = TEMPLATES) -> Column:
    return _prompt(question, context, ["repair", "answer"], {"words": F.lit(str(words))}, templates)


def consistency_prompt(question: Column, context: Column, reference: Column, words: int = DEFAULT.answer_words, templates: dict = TEMPLATES) -> Column:
    return _prompt(question, context, ["consistency", "answer"], {"words": F.lit(str(words)), "reference": reference}, templates)


def reference_label(refs: Column) -> Column:
    """`NNN/YYYY` of the first of an array of references."""
    first = F.get(refs, F.lit(0))
    return F.concat(zfill(first["number"]), F.lit("/"), first["year"])


def settled(asked: DataFrame) -> DataFrame:
    """Rows dealt by question: Spark moves no expression over this, so what a model said is computed once and then read.

    A row is a question with its answer so far, so the exchange is small beside what makes it.
    """
    return asked.repartition("question_id")


def ask(chunks: DataFrame, questions: DataFrame, generator: Generator, config: EngineConfig = DEFAULT, store: AnswerStore | None = None) -> DataFrame:
    """question_id, question, answer, sources for embedded questions over chunks (id, content, embedding, ...).

    Search, context, generation, one repair of answers that need it, one more prompt where an answer to a
    question on one document names others, evidence, footer. Questions without context get the set sentence
    that nothing is available. `error` is set where the answer is still empty or not valid after its repair.
    With a `store`, prompts that it knows are answered from it, and the others are asked when this is called.
    """
    found = retrieval.search(chunks, questions, config)
    rows = found.join(chunks.select("id", "content", "readable"), "id")
    context = retrieval.format_context(rows, config).select("question_id", "context")
    seen = rows.groupBy("question_id").agg(
        F.collect_list(F.coalesce("content", F.lit(""))).alias("_texts"), F.collect_list(F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("content", F.lit("")))).alias("_named_texts")
    )
    asked = questions.select("question_id", "question").join(context, "question_id", "left").join(seen, "question_id", "left")

    def told(rows: DataFrame, name: str, prompt: Column) -> DataFrame:
        """Adds what the model says to a prompt, cleaned."""
        if store is None:
            return settled(rows.withColumn(name, R.clean_answer(R.answer_text(generator.generate(prompt)))))
        rows = store.answered(rows, prompt, generator, "_raw")
        return rows.withColumn(name, R.clean_answer(R.answer_text(F.col("_raw")))).drop("_raw")

    q, c = F.col("question"), F.col("context")
    texts = F.coalesce("_texts", F.array().cast("array<string>"))

    def poor(answer: Column) -> Column:
        bare = F.coalesce(answer, F.lit(""))
        copied = F.exists(texts, lambda t: R.long_copy(bare, t))
        return R.needs_repair(bare, chain_answer_language_matches(q, bare), copied, config.answer_words)

    asked = told(asked, "answer", answer_prompt(q, c, config.answer_words))
    bad = R.is_unavailable(F.coalesce("answer", F.lit(""))) | poor(F.col("answer"))
    asked = asked.withColumn("_bad", bad & c.isNotNull())
    asked = told(asked, "_again", F.when(F.col("_bad"), repair_prompt(q, c, config.answer_words)))
    asked = asked.withColumn("_again", F.nullif("_again", F.lit("")))
    asked = asked.withColumn("answer", F.when(F.col("_bad"), F.coalesce("_again", "answer")).otherwise(F.col("answer")))
    error = F.when(c.isNull(), F.lit(None)).when(F.coalesce("answer", F.lit("")) == "", "empty answer").when(poor(F.col("answer")), "invalid answer")
    asked = asked.withColumn("error", error)

    refs = lambda text: references_udf(F.coalesce(text, F.lit("")))
    asked = settled(asked)
    asked = asked.withColumns({"_asked": refs(q), "_named": refs(R.strip_trailing_source(F.col("answer"))), "_context": refs(F.array_join("_named_texts", "\n"))})
    asked = settled(asked)
    conflict = R.reference_conflict(F.col("_asked"), F.col("_named"), F.col("_context"), R.is_unavailable(F.coalesce("answer", F.lit(""))))
    asked = asked.withColumn("_conflict", F.coalesce(conflict & F.col("error").isNull() & c.isNotNull(), F.lit(False)))
    wanted = F.when(F.col("_conflict"), consistency_prompt(q, c, reference_label(F.col("_asked")), config.answer_words))
    asked = told(asked, "_third", wanted)
    asked = settled(asked.withColumn("_third", F.when(F.col("_conflict"), F.col("_third"))))
    third = F.coalesce("_third", F.lit(""))
    asked = settled(asked.withColumn("_third_named", refs(R.strip_trailing_source(third))))
    still = R.reference_conflict(F.col("_asked"), F.col("_third_named"), F.col("_context"), R.is_unavailable(third))
    better = F.col("_conflict") & (third != "") & ~R.is_unavailable(third) & ~poor(third) & ~F.coalesce(still, F.lit(False))
    asked = asked.withColumn("answer", F.when(better, third).otherwise(F.col("answer"))).drop("_texts", "_named_texts", "_bad", "_asked", "_named", "_context", "_conflict", "_again", "_third", "_third_named")

    best = retrieval.evidence(rows.join(asked.select("question_id", "question", "answer"), "question_id"))
    best = best.select("question_id", F.col("source").alias("_source"), F.col("page").alias("_page"))
    sources = rows.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", "source", "page", "chunk", "language", "readable", "distance"))).alias("sources"))
    out = asked.join(best, "question_id", "left").join(sources, "question_id", "left")
    answer = F.when(F.coalesce(strip(F.col("answer")), F.lit("")) == "", R.unavailable_answer(F.col("question"))).otherwise(
        R.with_source(F.col("answer"), F.col("question"), F.col("_source"), F.col("_page"))
    )
    return out.select("question_id", "question", F.when(F.col("error").isNull(), answer).alias("answer"), "sources", "error")


def timed(chunks: DataFrame, questions: DataFrame, generator: Generator, config: EngineConfig = DEFAULT) -> tuple[DataFrame, dict[str, float]]:
    """The answers, kept, and seconds: of the search alone, of the rest, of all. Times are of the driver's clock."""
    began = time.perf_counter()
    retrieval.search(chunks, questions, config).write.format("noop").mode("overwrite").save()
    searched = time.perf_counter() - began
    began = time.perf_counter()
    answers = ask(chunks, questions, generator, config).persist()
    answers.count()
    total = time.perf_counter() - began
    return answers, {"retrieval_seconds": searched, "generation_seconds": max(total - searched, 0.0), "total_seconds": total}


class Engine:
    """The functions of the service over one set of tables: chat, sessions and liveness, without a server."""

    def __init__(self, chunks: DataFrame, embedder: Embedder, generator: Generator, config: EngineConfig = DEFAULT):
        self.chunks, self.embedder, self.generator, self.config = chunks, embedder, generator, config

    def health(self) -> dict:
        """Whether the generator answers at all; what it raises is told, not raised."""
        try:
            row = self.chunks.sparkSession.range(1).select(self.generator.generate(F.lit("Excerpt: ok.")).alias("a")).first()
            return {"status": "ok" if row["a"] is not None else "empty"}
        except Exception as e:
            return {"status": "unreachable", "error": f"{type(e).__name__}: {e}"[:300]}

    def chat(self, messages: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
        """Answers to the user messages of sessions, follow-ups rewritten with what they follow."""
        asked = conversations.rewritten_questions(messages, session, order)
        asked = asked.select(F.xxhash64(session, order).alias("question_id"), F.col("rewritten").alias("question"), session, order)
        answers = ask(self.chunks, embed_questions(asked.select("question_id", "question"), self.embedder), self.generator, self.config)
        return asked.select("question_id", session, order).join(answers, "question_id")

    def sessions(self, sessions: DataFrame, messages: DataFrame, user) -> DataFrame:
        """A user's sessions, newest first."""
        return conversations.recency(sessions.where(conversations.owned_by(F.col("user_id"), F.lit(user))), messages)
