"""Text expressions: Column -> Column, all in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC_INDIC_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "0123456789"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def compact(c: Column, limit: int) -> Column:
    """Collapsed text, `limit` characters at most."""
    return F.rtrim(F.substring(collapse(c), 1, limit))


def session_title(c: Column) -> Column:
    return F.substring(collapse(c), 1, 80)


def last_place(text: Column, mark: str) -> Column:
    """0-based place of the last `mark` in `text`, -1 without one."""
    at = F.locate(mark[::-1], F.reverse(text))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - len(mark) + 1)


def truncate_text(c: Column, limit: Column | int) -> Column:
    """Collapsed text cut after a sentence in its second half, else at a space or hard, with an ellipsis."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    full = collapse(c)
    short = F.substring(full, F.lit(1), limit + 1)
    sentence = F.greatest(*[last_place(short, m) for m in (". ", "؟ ", "! ", "? ")])
    space = last_place(short, " ")
    at_space = F.when(space >= 0, F.substring(short, F.lit(1), space)).otherwise(F.substring(full, F.lit(1), limit))
    cut = F.when(sentence >= F.floor(limit / 2), F.substring(short, F.lit(1), sentence + 1)).otherwise(F.concat(at_space, F.lit("…")))
    return F.when(F.length(full) <= limit, full).otherwise(cut)


def base_name(c: Column, default: str = "") -> Column:
    return F.coalesce(F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1), F.lit(default))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_INDIC_DIGITS, ASCII_DIGITS)


def zfill(c: Column, width: int = 3) -> Column:
    """Zeros in front up to `width`; longer values stay whole."""
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit("0"))


def email(c: Column) -> Column:
    return F.lower(strip(c))


def safe_component(c: Column, limit: int, default: str) -> Column:
    """A file name's part: forbidden characters and white space to `_`, cut, without dots and bars at the ends."""
    bare = F.regexp_replace(c, r"[<>:\"/\\|?*\x00-\x1F]", " ")
    joined = F.substring(F.regexp_replace(strip(bare), r"(?U)\s+", "_"), 1, limit)
    out = F.btrim(joined, F.lit(" ._"))
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def strip_source_footer(c: Column) -> Column:
    """An answer without the source footer that ends it."""
    return F.regexp_replace(c, r"(?is)\n+\s*(?:sources?|documents?|r[eé]f[eé]rences?|المصدر|المصادر)\s*[:：].*$", "")


#: Lines at an answer's end among which a footer is looked for.
FOOTER_LINES = 8


def shown_answer(c: Column) -> Column:
    """An answer as it is shown: cut at the last line that begins a footer and is followed by a page or document.

    Only the last FOOTER_LINES lines can begin one.
    """
    text = strip(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    label = r"(?i)^\s*(?:sources?|documents?|références?|المصدر|المصادر)\s*[:：]"
    named = r"(?i)(?:\bpages?\s*[:：]?\s*\d+|(?:الصفحة|صفحة)\s*[:：]?\s*\d+)|(?:\.pdf\b|\b\d{1,4}[_/-]\d{4}\b)"

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        rest = lambda k: F.array_join(F.slice(lines, k + 1, n), "\n")
        places = F.sequence(F.greatest(n - FOOTER_LINES, F.lit(0)), n - 1)
        footers = F.filter(places, lambda k: F.get(lines, k).rlike(label) & rest(k).rlike(named))
        last = F.array_max(footers)
        return F.when(last.isNull(), F.array_join(lines, "\n")).otherwise(rstrip(F.array_join(F.slice(lines, 1, F.coalesce(last, F.lit(0))), "\n")))

    return let(F.split(text, "\n"), cut)


def ellipsis(c: Column, limit: int = 70) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…")))
