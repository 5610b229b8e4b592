"""Document numbers, dates, citations and answer hygiene."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases as P
from .language import question_language, url_path
from .text import ascii_digits, collapse, rstrip, strip, strip_source_footer, zfill


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def document_number_prefix(c: Column) -> Column:
    """`NNN_YYYY`, or `NNN_` without a year, by the first pattern that fits."""
    plain = ascii_digits(c)
    each = []
    for p in P.ROUTES:
        number = _found(plain, p, 1)
        each.append(F.when(number.isNotNull(), F.concat(zfill(number), F.lit("_"), F.regexp_extract(plain, p, 2))))
    return F.coalesce(*each)


# How catalogue cells and file names write number and year, and dates.
NUMBER_OF_YEAR = r"(?:عدد|رقم)\s*(\d{1,5})\s*(?:لسنة|سنة)\s*(\d{4})"
YEAR_SLASH_NUMBER = r"(?i)(?:n(?:°|o)?|num(?:é|e)ro)\s*(\d{4})\s*[-/]\s*(\d{1,5})"
NUMBER_YEAR = r"(?<!\d)(\d{1,5})[_-](\d{4})(?!\d)"
FILE_YEAR_NUMBER, FILE_NUMBER_YEAR, FILE_DATE = r"^(\d{4})[_-](\d{1,5})(?!\d)", r"^(\d{1,5})[_-](\d{4})(?!\d)", r"^\d{4}-\d{2}-\d{2}[_-]*"
DAY_FIRST, YEAR_FIRST = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", r"\b\d{4}-\d{2}-\d{2}\b"
# How an answer names its sources.
NAMED_FILE_END = r"(?i)\s*[^.!؟\n]*[\w.-]+\.pdf[^.!؟\n]*(?:[.!؟]\s*)$"
SOURCE_END = r"(?i)\s*\(?\s*(?:Source\s*:|المصدر\s*:).*?(?:page|الصفحة)\s*\d+\s*\)?[.۔]?\s*$"
SOURCE_LINE, SOURCE_START = r"(?im)^\s*(?:source|المصدر)\s*:\s*(.+)$", r"(?im)^\s*(?:source|المصدر)\s*:"
CITED_PAGE, FROM_PAGE = r"(?i)(?:الصفحة|page)\s*[:#-]?\s*(\d+)\b", r"(?i)(?:الصفحة|page)\s*[:#-]?\s*\d+\b.*$"
THOUGHT, FINAL = r"(?is)<think\b[^>]*>.*?(?:</think>|$)", r"(?is)^.*(?:final answer|réponse finale|الإجابة النهائية)\s*:\s*"
LEAKED = r"(?i)\[(?:context|document)\s+\d+\]|\b(?:content|excerpt):"


def record_number(values: Column, pdf_url: Column) -> Column:
    """Number of a catalogue record from its cells, else from the file name."""
    combined = F.array_join(F.filter(values, lambda x: x != ""), " ")
    named = lambda c, p, n, y: F.when(_found(c, p).isNotNull(), F.concat(zfill(F.regexp_extract(c, p, n)), F.lit("_"), F.regexp_extract(c, p, y)))
    pairs = NUMBER_YEAR
    last = F.element_at(F.regexp_extract_all(combined, F.lit(pairs), 0), -1)
    file = F.regexp_replace(F.element_at(F.split(url_path(pdf_url), "/"), -1), r"(?<=.)\.[^.]*$", "")
    undated = F.regexp_replace(file, FILE_DATE, "")
    return F.coalesce(
        named(combined, NUMBER_OF_YEAR, 1, 2),
        named(combined, YEAR_SLASH_NUMBER, 2, 1),
        F.when(F.size(F.regexp_extract_all(combined, F.lit(pairs), 0)) > 0, F.concat(zfill(F.regexp_extract(last, pairs, 1)), F.lit("_"), F.regexp_extract(last, pairs, 2))),
        named(undated, FILE_YEAR_NUMBER, 2, 1),
        named(undated, FILE_NUMBER_YEAR, 1, 2),
        F.nullif(collapse(file), F.lit("")),
        F.lit("document"),
    )


def record_date(values: Column, pdf_url: Column) -> Column:
    combined = F.array_join(F.filter(values, lambda x: x != ""), " ")
    iso = _found(F.concat_ws(" ", combined, url_path(pdf_url)), YEAR_FIRST)
    return F.coalesce(_found(combined, DAY_FIRST), iso, F.lit(""))


def record_title(values: Column, number: Column, date: Column) -> Column:
    """The first of the longest cells that are neither number nor date."""
    rest = F.filter(values, lambda x: (x != "") & (x != number) & (x != date))
    longest = F.aggregate(rest, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(F.size(rest) > 0, longest).otherwise(number)


def evidence_terms(c: Column) -> Column:
    """Distinct numbers and words of two letters or more that are no stop-words."""
    terms = F.regexp_extract_all(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit(r"(\d+|[a-zÀ-ÿ]{2,}|[ء-ي]{2,})"), 1)
    return F.array_except(terms, F.array(*map(F.lit, P.EVIDENCE_STOPWORDS)))


def strip_trailing_source(c: Column) -> Column:
    named = rstrip(F.regexp_replace(c, NAMED_FILE_END, ""))
    return rstrip(F.regexp_replace(named, SOURCE_END, ""))


def citation_line(c: Column) -> Column:
    return strip(_found(c, SOURCE_LINE, 1))


def cited_page(c: Column) -> Column:
    return F.regexp_extract(citation_line(c), CITED_PAGE, 1).try_cast("int")


def cited_source(c: Column) -> Column:
    before = F.regexp_replace(citation_line(c), FROM_PAGE, "")
    return F.nullif(strip(F.regexp_replace(before, r"[ ،,.\-]+$", "")), F.lit(""))


def answer_body(c: Column) -> Column:
    return F.element_at(F.split(c, SOURCE_START, 2), 1)


def is_unavailable(c: Column) -> Column:
    text = F.lower(collapse(c))
    return F.exists(F.array(*map(F.lit, P.UNAVAILABLE_ANSWER)), lambda p: text.contains(p))


def unavailable_answer(question: Column) -> Column:
    return F.when(question_language(question) == "ar", F.lit(P.UNAVAILABLE_MESSAGE["ar"])).otherwise(F.lit(P.UNAVAILABLE_MESSAGE["fr"]))


def clean_answer(c: Column) -> Column:
    """An answer without thinking, fences and reasoning lines; what follows the last final marker if there is one."""
    bare = F.replace(F.regexp_replace(c, THOUGHT, ""), F.lit("`" * 3), F.lit(""))
    final = F.regexp_replace(bare, FINAL, "")
    lines = F.transform(F.split(final, r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(P.REASONING_LINE)), "\n")


def answer_text(c: Column) -> Column:
    """The answer inside a model's JSON, whole, fenced, embedded, doubly encoded or cut off; else the text."""
    text = F.regexp_replace(strip(c), r"(?is)^```(?:json)?\s*|\s*```$", "")
    span = _found(text, r"(?s)\{.*\}")
    field = lambda x: strip(F.get_json_object(x, "$.answer"))
    inner = F.coalesce(field(text), field(span))
    cut = F.regexp_replace(_found(text, r'(?s)"answer"\s*:\s*"((?:[^"\\]|\\.)*)', 1), r'\\(["\\/])', "$1")
    return F.coalesce(F.nullif(F.coalesce(field(inner), inner), F.lit("")), F.nullif(F.replace(cut, F.lit("\\n"), F.lit("\n")), F.lit("")), text)


def long_copy(answer: Column, chunk: Column, size: int = 240, step: int = 120) -> Column:
    """Whether an answer of `size` characters holds a stretch of `size` of the chunk, or all of a shorter chunk."""
    a, c = collapse(answer), collapse(chunk)
    last = F.greatest(F.length(c) - size, F.lit(0))
    starts = F.array_append(F.sequence(F.lit(0), last, F.lit(step)), last)
    hit = F.exists(starts, lambda s: a.contains(F.substring(c, s + 1, F.lit(size))))
    return (F.length(a) >= size) & (F.length(c) > 0) & hit


def needs_repair(answer: Column, language_matches: Column, copied: Column, words: int = 120) -> Column:
    lines = F.split(F.coalesce(answer, F.lit("")), r"\R")
    leaked = answer.rlike(LEAKED)
    reasoning = F.exists(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+", "").rlike(P.REASONING_LINE))
    empty = F.coalesce(answer, F.lit("")) == ""
    return empty | ~language_matches | (F.size(F.split(collapse(answer), " ")) > words) | leaked | reasoning | copied


def with_source(answer: Column, question: Column, source: Column, page: Column) -> Column:
    """The answer with a footer naming its evidence, or the set sentence if it says that there is none."""
    arabic = question_language(question) == "ar"
    footer = F.when(arabic, F.concat(F.lit("\n\nالمصدر: "), source, F.lit("، الصفحة "), page.cast("string"))).otherwise(
        F.concat(F.lit("\n\nSource : "), source, F.lit(", page "), page.cast("string"))
    )
    return F.when(is_unavailable(answer), unavailable_answer(question)).otherwise(
        F.concat(strip_trailing_source(answer), F.coalesce(footer, F.lit("")))
    )


def has_chat_reference(c: Column) -> Column:
    return c.rlike(P.CHAT_REFERENCE)


def is_follow_up(normalised: Column) -> Column:
    """On text in the follow-up form: a single word for more, or a known phrase in six words at most."""
    from .unicode import follow_up

    known = "|".join(rf"\Q{follow_up(p)}\E" for p in P.FOLLOW_UPS if p not in P.SINGLE_FOLLOW_UPS)
    phrase = normalised.rlike(known)
    return normalised.isin(*P.SINGLE_FOLLOW_UPS) | ((F.size(F.split(normalised, " ")) <= 6) & phrase)


def reference_conflict(question_refs: Column, answer_refs: Column, context_refs: Column, unavailable: Column) -> Column:
    """An answer to a question on one document names others: unsupported, instead of it, or before it."""
    target = F.get(question_refs, F.lit(0))
    foreign = F.array_except(answer_refs, question_refs)
    wrong = (F.size(F.array_except(foreign, context_refs)) > 0) | ~F.array_contains(answer_refs, target) | (F.get(answer_refs, F.lit(0)) != target)
    return F.when((F.size(F.array_distinct(question_refs)) != 1) | unavailable | (F.size(foreign) == 0), F.lit(False)).otherwise(wrong)


def rewrite_question(question: Column, follow_up: Column, user: Column, assistant: Column) -> Column:
    """A follow-up with the last standalone question and answer behind it; other questions stay."""
    from .text import compact

    arabic = question_language(question) == "ar"
    asked, said = compact(user, 300), compact(strip_source_footer(assistant), 500)
    first = F.when(arabic, F.lit("\nالمقصود بالسؤال السابق: ")).otherwise(F.lit("\nQuestion précédente concernée : "))
    then = F.when(arabic, F.lit("\nالسياق السابق: ")).otherwise(F.lit("\nContexte précédent : "))
    tail = F.when(F.coalesce(said, F.lit("")) != "", F.concat(then, said)).otherwise(F.lit(""))
    plain = strip(question)
    return F.when(follow_up & user.isNotNull() & ~has_chat_reference(plain), F.concat(plain, first, asked, tail)).otherwise(plain)
