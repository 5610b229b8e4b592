"""Extraction quality of page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import KINDS, arabic_count, arabic_letters, latin_letters
from .text import let

WORD = r"[A-Za-z\u00C0-\u00FF\u0600-\u06FF0-9]+"


def _letters(c: Column) -> Column:
    return F.struct(arabic_letters(c).alias("ar"), latin_letters(c).alias("la"))


#: Latin letters of either script count by these, the frequent ones first.
BY_FREQUENCY = "etaoinsrhldcumfpgwybvkxjqz" + "".join(x for x in KINDS if not "a" <= x <= "z")


def _dominance(s: Column) -> Column:
    """Of struct(ar, la), the letters of either script: the count of the most frequent letter, as a share of all.

    Each letter is taken out of what the ones before it left, and none is looked for once fewer letters are
    left than the most frequent one has: a text is gone after a few of them.
    """

    def most(text: Column, alphabet: Column) -> Column:
        def without(state: Column, x: Column) -> Column:
            less = lambda rest: F.struct(rest.alias("rest"), F.greatest(state["most"], F.length(state["rest"]) - F.length(rest)).alias("most"))
            return F.when(F.length(state["rest"]) <= state["most"], state).otherwise(let(F.replace(state["rest"], x, F.lit("")), less))

        return F.aggregate(alphabet, F.struct(text.alias("rest"), F.lit(0).alias("most")), without, lambda state: state["most"])

    latin = most(s["la"], F.array(*map(F.lit, BY_FREQUENCY)))
    arabic = F.when(F.length(s["ar"]) > 0, most(s["ar"], F.filter(F.array_distinct(F.split(s["ar"], "")), lambda x: x != ""))).otherwise(F.lit(0))
    return F.coalesce(F.try_divide(F.greatest(latin, arabic).cast("double"), (F.length(s["ar"]) + F.length(s["la"])).cast("double")), F.lit(0.0))


def dominance(c: Column) -> Column:
    """Greatest share of one letter, case aside, among the letters."""
    return let(_letters(c), _dominance)


def quality_score(c: Column, language: Column) -> Column:
    """0..1 by amount, share and variety of letters and digits and the expected script, less repetition."""
    text = F.coalesce(c, F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1))
    counted = lambda s: F.struct(
        (F.length(s["ar"]) + F.length(s["la"])).cast("double").alias("letters"),
        F.length(F.regexp_replace(text, r"(?U)\D+", "")).alias("digits"),
        F.greatest(F.length(F.regexp_replace(text, r"(?U)\s+", "")), F.lit(1)).cast("double").alias("visible"),
        F.size(F.array_distinct(F.transform(words, F.lower))).alias("words"),
        F.length(s["ar"]).alias("ar"),
        F.length(s["la"]).alias("la"),
        F.regexp_count(text, F.lit(r"(.)\1{5,}")).alias("runs"),
        _dominance(s).alias("dominance"),
    )
    counts = let(_letters(text), counted)

    def scored(s: Column) -> Column:
        one, meaningful = F.lit(1.0), s["letters"] + s["digits"]
        script = (
            F.when(language == "ar", F.least(s["ar"] / 20.0, one))
            .when(language == "fr", F.least(s["la"] / 30.0, one))
            .otherwise(F.least(s["letters"] / 30.0, one))
        )
        score = (
            0.30 * F.least(meaningful / 120.0, one)
            + 0.25 * F.least(meaningful / s["visible"] / 0.70, one)
            + 0.20 * F.least(s["words"] / 20.0, one)
            + 0.25 * script
            - F.least(s["runs"] * 0.12, F.lit(0.36))
            - F.greatest(s["dominance"] - 0.35, F.lit(0.0))
        )
        return F.when((meaningful >= 10) & (s["words"] > 0), F.round(F.greatest(F.lit(0.0), F.least(score, one)), 3)).otherwise(F.lit(0.0))

    return let(counts, scored)


def lines_of(c: Column) -> Column:
    stripped = F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def looks_like_table(c: Column, language: Column) -> Column:
    lines = lines_of(c)
    n = F.size(lines).cast("double")
    part = lambda test: F.size(F.filter(lines, test)) / n
    short = part(lambda x: F.length(x) <= 80)
    numeric = part(lambda x: x.rlike(r"(?U)[\d%]"))
    latin = part(lambda x: F.regexp_count(x, F.lit(r"[A-Za-z\u00C0-\u00FF]")) >= 3)
    return F.when(n < 6, F.lit(False)).otherwise(((numeric >= 0.6) & (short >= 0.85)) | ((language == "ar") & (short >= 0.85) & (latin >= 0.6)))


def corrupted_arabic(c: Column, language: Column) -> Column:
    n = arabic_count(c)
    odd = F.regexp_count(c, F.lit(r"[\u0600-\u06FF&&[\p{Mn}\u063B-\u063F]]"))
    return (language == "ar") & (n >= 50) & (F.coalesce(F.try_divide(odd.cast("double"), n.cast("double")), F.lit(0.0)) >= 0.015)


def clean_lines(c: Column) -> Column:
    """Cleaning of extracted text that is in NFKC already: blanks, filler lines, runs of empty lines."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00\uFFFD]", "")
    lines = F.transform(F.split(bare, r"\R"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))

    def kept(x):
        solid = F.regexp_replace(x, r"(?U)\s+", "")
        filler = (F.length(solid) >= 8) & (F.size(F.array_distinct(F.split(F.lower(solid), ""))) <= 2) & ~solid.rlike(r"(?U)\d")
        return ~filler

    joined = F.regexp_replace(F.array_join(F.filter(lines, kept), "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"(?U)^\s+|\s+$", "")
