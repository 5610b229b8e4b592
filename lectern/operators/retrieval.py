"""Vector search over chunk tables: exact k-NN, language-aware ranking, expansion, fallback.

Every operator takes any number of questions at once: all windows are partitioned by question_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .nearest import Way, nearest

KEY = ["question_id"]
#: Ways of finding chunks: by the document that a question names, in its own language, anywhere.
ROUTED, OWN, WIDE = range(3)
#: Questions that are broadcast to a pass over the chunks.
BROADCAST_QUESTIONS = 10_000


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision, to 6 decimals."""
    return F.round(1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)


def scored(chunks: DataFrame, questions: DataFrame, condition: Column | None = None, block: int = BROADCAST_QUESTIONS) -> DataFrame:
    """Every chunk that may answer a question with its distance. `questions`: question_id, query, ... .

    The stated questions meet all chunks in one pass over the chunk table: `block` questions at most are
    broadcast, more are dealt to blocks by hash, with a pass for each. Filters on chunk columns stay below
    the join and reach the scan.
    """
    on = F.lit(True) if condition is None else condition
    n = -(-questions.count() // block) or 1
    of = F.pmod(F.xxhash64("question_id"), F.lit(n))
    parts = [chunks.join(F.broadcast(questions.where(of == k) if n > 1 else questions), on) for k in range(n)]
    pairs = reduce(DataFrame.unionByName, parts)
    return pairs.withColumn("distance", cosine_distance(F.col("embedding"), F.col("query"))).drop("embedding", "query")


def top_k(rows: DataFrame, k: Column | int, by: str = "distance", tie: str = "id") -> DataFrame:
    """First k rows of each question with their 1-based rank."""
    w = Window.partitionBy(*KEY).orderBy(by, tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(chunks: DataFrame, questions: DataFrame, k: int = DEFAULT.top_k, kind: str = "all", each: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest chunks of each question, of those that `kind` admits, and of each value of `each` one (see nearest.Way)."""
    return nearest(chunks, questions, [Way(WIDE, kind, k, each)]).drop("_way")


def first_of_each(rows: DataFrame, order: list, limit: int | None = None) -> DataFrame:
    """First row of each (source, page, chunk) of a question, in order; at most `limit` of them."""
    w = Window.partitionBy(*KEY, "source", "page", "chunk").orderBy(*order)
    once = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if limit is None:
        return once
    w = Window.partitionBy(*KEY).orderBy(*order)
    return once.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def language_ranked(rows: DataFrame, bonus: float = DEFAULT.language_bonus) -> DataFrame:
    """Adds score (distance less the bonus for the question's language) and rank."""
    score = F.round(F.col("distance") - F.when(F.col("language") == F.col("question_language"), bonus).otherwise(0.0), 6)
    w = Window.partitionBy(*KEY).orderBy("score", "distance", "id")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(w))


def language_knn(chunks: DataFrame, questions: DataFrame, k: int, bonus: float = DEFAULT.language_bonus, among: str = "") -> DataFrame:
    """The first k of language_ranked over all chunks, or those `beside` what the question names.

    They are among the k nearest of all and the k nearest in the question's language, as the bonus is the same for all of these.
    """
    kinds = (among, f"{among}_language") if among else ("all", "language")
    found = nearest(chunks, questions, [Way(n, kind, k) for n, kind in enumerate(kinds)])
    once = F.row_number().over(Window.partitionBy(*KEY, "id").orderBy("_way"))
    found = found.withColumn("_n", once).where("_n = 1").drop("_n", "_way", "rank")
    return language_ranked(found, bonus).where(F.col("rank") <= k)


def _context_places(ranked: DataFrame, config: EngineConfig, k: int) -> DataFrame:
    """Adds mode and place (null: not selected) to rows with rank (null: no candidate), in windows of a question."""
    w = Window.partitionBy(*KEY)
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c))).over(w)
    chosen = F.col("rank") <= k
    rows = ranked.withColumns(
        {
            "_s1": at(1, "source"), "_s2": at(2, "source"), "_p1": at(1, "page"), "_p2": at(2, "page"), "_d1": at(1, "distance"), "_d2": at(2, "distance"),
            "_any": F.coalesce(F.bool_or(F.when(chosen, F.col("expand"))).over(w), F.lit(False)),
            "_of": F.count_if(chosen).over(w), "_pages": F.collect_list(F.when(chosen, F.col("page"))).over(w),
        }
    )
    near = F.abs(F.col("_p1") - F.col("_p2")) <= 1
    mode = (
        F.when((F.col("_of") < 2) | (F.lit(k) < 2), "plain")
        .when(F.col("_s1") == F.col("_s2"), F.when(near | F.col("_any"), "expand").otherwise("plain"))
        .when(F.round(F.col("_d2") - F.col("_d1"), 6) >= config.distance_gap, "first")
        .otherwise("plain")
    )
    beside = F.exists("_pages", lambda p: F.abs(F.col("page") - p) <= 1)
    keep = (
        F.when(F.col("mode") == "expand", (F.col("source") == F.col("_s1")) & beside)
        .when(F.col("mode") == "first", F.col("rank") == 1)
        .otherwise(chosen)
    )
    rows = rows.withColumn("mode", mode).withColumn("_keep", F.coalesce(keep & F.col("rank").isNotNull(), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*KEY, "_keep").orderBy("rank"))
    place = F.when(F.col("_keep") & ((F.col("mode") != "expand") | (place <= config.context_chunks)), place)
    return rows.withColumn("place", place).drop("_s1", "_s2", "_p1", "_p2", "_d1", "_d2", "_any", "_of", "_pages", "_keep")


def select_context(ranked: DataFrame, config: EngineConfig = DEFAULT, k: int | None = None) -> DataFrame:
    """What of the ranked chunks goes to the answer; `ranked` has rank, expand (boolean), source, page.

    The first k are selected. If the first two have one source and their pages are adjacent, or expand
    is set, all ranked chunks of that source on a selected or adjacent page are taken, 4 at most. If
    they have two sources and the second is farther by the gap, only the first is taken.
    """
    return _context_places(ranked, config, k or config.top_k).where(F.col("place").isNotNull())


def nearest_context(chunks: DataFrame, questions: DataFrame, config: EngineConfig = DEFAULT, k: int | None = None) -> DataFrame:
    """What select_context takes of all chunks in the order of language_ranked, without ranking them all.

    The first k tell how to go on; a second pass finds the nearest chunks on the selected pages and beside them
    for the questions that take those.
    """
    k = k or config.top_k
    first = _context_places(language_knn(chunks, questions, max(k, 2), config.language_bonus), config, k)
    near = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)))))
    pages = first.where("mode = 'expand'").groupBy(*KEY).agg(F.min_by("source", "rank").alias("_source"), near.alias("_pages"))
    beside = language_knn(chunks, questions.join(pages, KEY), config.context_chunks, config.language_bonus, "beside")
    beside = beside.withColumns({"mode": F.lit("expand"), "place": F.col("rank")}).drop("_source", "_pages")
    return first.where("mode <> 'expand' and place is not null").unionByName(beside)


def foreign_best(rows: DataFrame, limit: int = 2) -> DataFrame:
    """Best chunk of each source in another language than the question's, or in none, the nearest `limit` of them."""
    other = rows.where(~F.col("language").eqNullSafe(F.col("question_language")))
    w = Window.partitionBy(*KEY, "source").orderBy("distance", "id")
    each = other.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *({"rank"} & set(rows.columns)))
    return top_k(each, limit)


def search(chunks: DataFrame, questions: DataFrame, config: EngineConfig = DEFAULT, k: int | None = None) -> DataFrame:
    """The whole search for a batch of questions (question_id, query, question_language, prefix, expand).

    A question with a document number searches the documents whose name starts with it and returns what
    it finds there. Others rank the nearest chunks of their own language together with the nearest of
    all; chunks marked unreadable are dropped after the global limit, not before. A weak best match in
    the own language lets the best foreign documents in.

    One pass: a task multiplies its chunks' vectors with the questions' and keeps the nearest few of each
    question and each of the three ways to find them. All that follows are windows over these rows,
    partitioned by question.
    """
    k = k or config.top_k
    names = ["id", "source", "page", "chunk", "language", "distance"]
    ways = [Way(ROUTED, "named", max(4 * k, 8)), Way(OWN, "own", k), Way(WIDE, "all", max(10 * k, 20))]
    found = nearest(chunks.select("embedding", "readable", *names[:-1]), questions, ways)
    rows = found.select(*KEY, *names, "readable", "question_language", "prefix", "expand", "_way", "rank")
    way = F.col("_way")

    q = Window.partitionBy(*KEY)
    rows = rows.withColumn("_routed", F.bool_or(way == ROUTED).over(q))
    rows = rows.where(F.when(F.col("_routed"), way == ROUTED).otherwise((way == OWN) | (way == WIDE) & F.coalesce("readable", F.lit(True))))
    rows = rows.withColumn("expand", F.col("expand") & ~F.col("_routed"))
    # Candidates: all that a number led to; else each (source, page, chunk) once, own language first.
    once = F.row_number().over(Window.partitionBy(*KEY, "source", "page", "chunk").orderBy("_way", "rank")) == 1
    bonus = F.when((F.col("language") == F.col("question_language")) & ~F.col("_routed"), config.language_bonus).otherwise(0.0)
    rows = rows.withColumn("_candidate", F.col("_routed") | once).withColumn("_score", F.round(F.col("distance") - bonus, 6))
    place = F.row_number().over(Window.partitionBy(*KEY, "_candidate").orderBy("_score", "distance", "id"))
    rows = _context_places(rows.withColumn("rank", F.when(F.col("_candidate"), place)), config, k)

    best = F.min(F.when(way == OWN, F.col("distance"))).over(q)
    rows = rows.withColumn("_weak", ~F.col("_routed") & (F.coalesce(best, F.lit(1.0)) > config.weak_match))
    rows = rows.withColumn("_foreign", (way == WIDE) & ~F.col("language").eqNullSafe(F.col("question_language")))
    rows = rows.withColumn("_foreign", F.col("_foreign") & (F.row_number().over(Window.partitionBy(*KEY, "_foreign", "source").orderBy("distance", "id")) == 1))
    nth = F.row_number().over(Window.partitionBy(*KEY, "_foreign").orderBy("distance", "id"))
    extra = F.when(F.col("_weak") & F.col("_foreign") & (nth <= 2), nth)
    first = F.when(~F.col("_weak") | (F.col("place") <= k), F.col("place"))
    rows = rows.withColumn("_extra", extra).withColumn("_at", F.when(first.isNotNull(), F.struct(F.lit(0).alias("part"), first.alias("at"))).when(F.col("_extra").isNotNull(), F.struct(F.lit(1).alias("part"), F.col("_extra").alias("at"))))
    rows = rows.where(F.col("_at").isNotNull())
    once = F.row_number().over(Window.partitionBy(*KEY, "source", "page", "chunk").orderBy("_at", "id"))
    rows = rows.withColumn("_once", once).where(F.col("_routed") | (F.col("_once") == 1))
    rows = rows.withColumn("place", F.row_number().over(q.orderBy("_at", "id")))
    rows = rows.where(F.col("_routed") | (F.col("place") <= max(config.context_chunks, k)))
    return rows.select(*KEY, *names, "place")


def format_context(rows: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Prompt context of each question: numbered excerpts under a budget, cut rather than left out.

    `rows` has place, content, source, page, language, readable. At most a few rows a question come in,
    so the ordered fold holds a few strings.
    """
    from ..functions.text import base_name, truncate_text

    shown = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    head = F.concat(
        F.lit("]\nSource: "), base_name(F.col("source"), "Unknown source"), F.lit("\nPage: "), shown("page", "Unknown page"),
        F.lit("\nLanguage: "), shown("language", "unknown"), F.lit("\nReadable: "), F.initcap(shown("readable", "unknown")), F.lit("\nExcerpt: "),
    )
    parts = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("place", head.alias("head"), F.coalesce("content", F.lit("")).alias("text")))).alias("parts"))
    start = F.struct(F.lit("").alias("context"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s, x):
        header = F.concat(F.lit("[Document "), x["place"].cast("string"), x["head"])
        gap = F.when(s["n"] > 0, F.lit(2)).otherwise(F.lit(0))
        room = F.least(F.lit(config.context_chunk_chars), F.lit(config.context_chars) - s["used"] - gap - F.length(header))
        body = truncate_text(x["text"], room)
        section = F.concat(F.when(s["n"] > 0, F.lit("\n\n")).otherwise(F.lit("")), header, body)
        used = s["used"] + F.length(section)
        more = F.struct(F.concat(s["context"], section).alias("context"), used.alias("used"), (s["n"] + 1).alias("n"), (used >= config.context_chars).alias("done"))
        stop = F.struct(s["context"].alias("context"), s["used"].alias("used"), s["n"].alias("n"), F.lit(True).alias("done"))
        return F.when(s["done"], s).when(room <= 0, stop).when(body == "", s).otherwise(more)

    return parts.select(*KEY, F.aggregate("parts", start, step).alias("c")).select(*KEY, "c.context", F.col("c.used").alias("chars"), F.col("c.n").alias("chunks"))


def evidence(rows: DataFrame) -> DataFrame:
    """The chunk that an answer rests on: one it names, the nearest, or that with the best overlap of terms.

    `rows` has question, answer, content, place, distance, language; a row for each question comes out.
    """
    from ..functions.language import question_language
    from ..functions.references import evidence_terms

    named = F.regexp_extract("answer", r"(?i)(?:document|extrait|الوثيقة|المقتطف)\s*(?:n[°o]?\s*)?(\d+)", 1).try_cast("int")
    terms = evidence_terms(F.concat_ws(" ", "question", "answer"))
    entities = F.array_intersect(evidence_terms(F.col("question")), F.regexp_extract_all(F.lower("question"), F.lit(r"(\d+|[a-zÀ-ÿ]{2,})"), 1))
    content = evidence_terms(F.coalesce("content", F.lit("")))
    distance = F.coalesce("distance", F.lit(1.0))
    overlap = F.size(F.array_intersect(entities, content)) * 0.12 + F.size(F.array_intersect(terms, content)) * 0.01 - distance
    w = Window.partitionBy(*KEY)
    languages = F.collect_set(F.struct("language")).over(w)  # no language counts as one more
    several = (question_language(F.col("question")) == "fr") & (F.size(languages) > 1)
    score = F.when(F.col("place") == named, F.lit(1e9)).when(several, -distance).otherwise(F.round(overlap, 9))
    best = F.row_number().over(w.orderBy(F.col("evidence_score").desc(), "place"))
    return rows.withColumn("evidence_score", score).withColumn("_n", best).where("_n = 1").drop("_n")
