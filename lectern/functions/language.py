"""Script counts, language and readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ARABIC, LATIN = r"[\u0600-\u06FF]", r"[A-Za-z\u00C0-\u00FF]"
MARKERS = {
    "ar": (("ar", "arabic", "arabe"), ("arabic", "arabe")),
    "fr": (("fr", "french", "francais", "français"), ("french", "francais", "français")),
}


#: Lower-case Latin letters in the order of their bits in a mask of kinds.
KINDS = "".join(map(chr, [*range(0x61, 0x7B), 0xD7, 0xDF, *range(0xE0, 0x100)]))


def arabic_letters(c: Column) -> Column:
    """The Arabic letters of a text. Runs of other characters go at once, so this costs a match a word, not a letter."""
    return F.regexp_replace(c, r"[^\u0600-\u06FF]+", "")


def latin_letters(c: Column) -> Column:
    """The Latin letters of a text in lower case. What is not LATIN is spelled out: Java runs that many times faster."""
    return F.lower(F.regexp_replace(c, r"[\x00-@\[-`{-\u00BF\u0100-\x{10FFFF}]+", ""))


def arabic_count(c: Column) -> Column:
    return F.length(arabic_letters(c))


def latin_count(c: Column) -> Column:
    return F.length(latin_letters(c))


def kinds_mask(letters: Column) -> Column:
    """A bit for each kind of letter in lower-case Latin letters; masks of parts of a text add up by OR.

    Kinds beyond a to z, most of them absent, are looked for in what is left without a to z, which is short.
    """

    def mask(text: Column, kinds: str, first: int) -> Column:
        bits = F.transform(F.array(*map(F.lit, kinds)), lambda x, i: F.when(text.contains(x), F.call_function("shiftleft", F.lit(1).cast("long"), i + first)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    others = let(F.regexp_replace(letters, "[a-z]+", ""), lambda rest: F.when(rest == "", F.lit(0).cast("long")).otherwise(mask(rest, KINDS[26:], 26)))
    return mask(letters, KINDS[:26], 0).bitwiseOR(others)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def scripts(c: Column) -> Column:
    """struct(ar, la, mask): Arabic letters, Latin letters, kinds of Latin letters."""
    return let(latin_letters(c), lambda la: F.struct(arabic_count(c).alias("ar"), F.length(la).alias("la"), kinds_mask(la).alias("mask")))


def language_of_scripts(s: Column) -> Column:
    """ar from 30 % Arabic letters, fr from 70 % Latin ones of 4 kinds; null below 10 letters."""

    def told(s: Column) -> Column:
        total = s["ar"] + s["la"]
        return (
            F.when(total < 10, F.lit(None).cast("string"))
            .when(share(s["ar"], total) >= 0.3, F.lit("ar"))
            .when((share(s["la"], total) >= 0.7) & (F.bit_count(s["mask"]) >= 4), F.lit("fr"))
        )

    return let(s, told)


def script_language(c: Column) -> Column:
    return language_of_scripts(scripts(c))


def stem(c: Column) -> Column:
    """File name without its last extension, lower-cased."""
    name = F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def filename_language(c: Column) -> Column:
    name = stem(c)
    tokens = F.split(name, r"[_\-\s.]+")
    out = None
    for lang, (words, parts) in MARKERS.items():
        hit = F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
        for p in parts:
            hit = hit | name.contains(p)
        out = F.when(hit, F.lit(lang)) if out is None else out.when(hit, F.lit(lang))
    return out


def detect_language(scripts_of: Column, filename: Column, default: Column) -> Column:
    """struct(language, language_source): from the file name, the text's scripts, what is inherited, or unknown."""
    made = lambda value, origin: F.struct(F.coalesce(value, F.lit("unknown")).alias("language"), F.lit(origin).alias("language_source"))
    both = F.struct(filename_language(filename).alias("named"), language_of_scripts(scripts_of).alias("script"))

    def told(s: Column) -> Column:
        return (
            F.when(s["named"].isNotNull(), made(s["named"], "filename"))
            .when(s["script"].isNotNull(), made(s["script"], "text"))
            .when(default.isin("ar", "fr"), made(default, "inherited"))
            .otherwise(made(F.lit("unknown"), "unknown"))
        )

    return let(both, told)


def question_language(c: Column) -> Column:
    return F.when(c.rlike(ARABIC), F.lit("ar")).otherwise(F.lit("fr"))


def arabic_ratio(s: Column) -> Column:
    return let(s, lambda x: F.round(F.coalesce(share(x["ar"], x["ar"] + x["la"]), F.lit(0.0)), 3))


def readable_scripts(s: Column, language: Column) -> Column:
    arabic = (s["ar"] >= 5) & (F.coalesce(share(s["ar"], s["ar"] + s["la"]), F.lit(0.0)) >= 0.15)
    return F.when(language == "ar", arabic).when(language == "fr", (s["la"] >= 10) & (F.bit_count(s["mask"]) >= 4)).otherwise(F.lit(False))


def is_readable(c: Column, language: Column) -> Column:
    return let(scripts(c), lambda s: readable_scripts(s, language))


def expected_page_language(filename: Column, folder: Column) -> Column:
    return F.coalesce(filename_language(filename), F.when(folder.isin("ar", "fr"), folder), F.lit("unknown"))


def chain_answer_language_matches(question: Column, answer: Column) -> Column:
    ar, la = arabic_count(answer), latin_count(answer)
    return F.when(question_language(question) == "ar", is_readable(answer, F.lit("ar"))).otherwise((la >= 5) & (la > ar))


def eval_answer_language(expected: Column, body: Column) -> Column:
    ar, la = arabic_count(body), latin_count(body)
    return F.when(expected == "ar", (ar > 0) & (ar >= la)).when(expected == "fr", (la > 0) & (la > ar)).otherwise(F.lit(True))


def url_path(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))


def record_language(title: Column, pdf_url: Column, page_url: Column) -> Column:
    """Language of a catalogue record: file name, URL path, title letters, page path, else French."""
    path, page = F.lower(url_path(pdf_url)), F.lower(url_path(page_url))
    names = F.split(stem(path), r"[_\-\s./]+")
    tokens, page_tokens = F.split(path, r"[/_.\-]+"), F.split(page, r"[/_.\-]+")
    ar = F.regexp_count(title, F.lit(r"[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF]"))
    la = latin_count(title)
    any_of = lambda t, lang: F.arrays_overlap(t, F.array(*map(F.lit, MARKERS[lang][0])))
    return (
        F.when(any_of(names, "ar"), "ar")
        .when(any_of(names, "fr"), "fr")
        .when(F.array_contains(tokens, "ar"), "ar")
        .when(F.array_contains(tokens, "fr"), "fr")
        .when(share(ar, ar + la) >= 0.3, "ar")
        .when(share(la, ar + la) >= 0.7, "fr")
        .when(F.array_contains(page_tokens, "ar"), "ar")
        .otherwise("fr")
    )
