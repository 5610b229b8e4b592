"""Quality rules by cross-document line frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, SPACES, Scratch, aside, split_words


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _packed_windows() -> Column:
    """Sorted longs of the three-word windows of `_w`: hash bits above, window number below."""
    return F.expr(
        "sort_array(transform(sequence(0, _n - 3),"
        " i -> shiftleft(xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2)), _b) | i))"
    )


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to every row.

    Null and blank texts count as no words. n_repeat_words sorts the hashed windows of a text with
    their numbers, keeps neighbours with equal hash bits, compares their words, and counts the words
    that the kept windows cover. The work stays in the row; nothing is exploded or shuffled.
    """
    away, back = aside(docs.columns)
    return _statistics(docs.select(*away, F.col(text).alias("text"))).select(*back, *STATISTICS)


def _statistics(df: DataFrame) -> DataFrame:
    """The columns of `df`, whose text is in `text`, with STATISTICS and the array of the lines with a word."""
    kept = df.columns
    t = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("_w", split_words(F.col("text"))).withColumn("_n", F.size("_w"))
    df = df.withColumn("_b", F.expr("int(ceil(log2(_n + 1))) + 1"))
    df = df.withColumn("_p", F.when(F.col("_n") >= 4, _packed_windows()).otherwise(F.expr("cast(array() as array<bigint>)")))
    df = df.withColumn(
        "_q",
        F.expr(
            "filter(_p, (p, k) -> shiftright(p, _b) <=> shiftright(get(_p, k + 1), _b)"
            " or shiftright(p, _b) <=> shiftright(get(_p, k - 1), _b))"
        ),
    )
    df = df.withColumn("_q", F.expr("transform(_q, p -> int(p & (shiftleft(1L, _b) - 1)))"))
    same = "get(_w, i) = get(_w, {0}) and get(_w, i + 1) = get(_w, {0} + 1) and get(_w, i + 2) = get(_w, {0} + 2)"
    near = " or ".join(f"({same.format(f'get(_q, k {d})')})" for d in ("- 2", "- 1", "+ 1", "+ 2"))
    df = df.withColumn("_r", F.expr(f"sort_array(filter(_q, (i, k) -> coalesce({near}, false)))"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    df = df.withColumn("_l", lines)
    return df.select(
        *kept,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "cast(aggregate(transform(_r, (i, k) -> least(3, coalesce(get(_r, k + 1) - i, 3))), 0, (s, x) -> s + x) as bigint)"
        ).alias("n_repeat_words"),
        F.col("_l").alias("lines"),
    )


def line_frequency(lines: DataFrame, min_docs: int, max_share: float, totals: DataFrame) -> DataFrame:
    """(host, line) of the lines that more than max(min_docs, max_share of the host's documents) hold.

    Documents count by `copy`, a hash of their whole set of lines: copies of one text count once, all
    others each, however many of their lines are common to the host. `totals` has to count them so too.
    """
    per_text = lines.select("host", "line", "copy").distinct().groupBy("host", "line").agg(F.count("*").alias("docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.lit(float(max_share)) * F.col("host_docs"))
    return per_text.where(F.col("docs") > min_docs).join(totals, "host").where(F.col("docs") > limit).select("host", "line")


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 20,
    max_share: float = 0.05,
    max_removed_percent: int = 50,
    with_text: bool = False,
    carry_text: bool = False,
) -> DataFrame:
    """Judges every row of `docs`; returns its columns and the statistics, base_failed, removed_words, kept.

    Base rule: fewer than `min_words` words, or more than `max_repeat_percent` of them in three-word
    windows found twice. Line rule: lines are lower-cased, white space is collapsed, the result hashed;
    lines in too many distinct documents of a host (see line_frequency) are struck, and a document that
    loses more than `max_removed_percent` of its words is depleted: rejected. Copies, documents with one
    set of lines, count once, for a line and for the host alike. `with_text` adds kept_text, the text
    without struck lines; `carry_text` keeps the text's own column.

    Null text is empty (base_failed); a null host is a host of its own; repeated rows and ids each keep
    their own row; an empty table gives an empty result. A text of any length is judged whole in its row
    (some 60 times its bytes in arrays meanwhile). Columns named as a result replace the input's; all
    others come back, whatever their names.
    """
    made = [*STATISTICS, "base_failed", "removed_words", "kept", "kept_text"]
    away, back = aside([c for c in docs.columns if c not in made and (carry_text or c != text)])
    scratch = Scratch(docs.sparkSession, "quality")
    norm = lambda x: F.lower(F.btrim(F.regexp_replace(x, SPACE_CLASS + "+", " "), F.lit(" ")))
    held = docs.select(*away, F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.col(text).alias("text"))
    judged = _statistics(held)
    if not with_text:
        judged = judged.drop("text")
    judged = judged.withColumn("lines", F.transform("lines", lambda x: F.struct(F.xxhash64(norm(x)).alias("line"), F.size(split_words(x)).alias("words"))))
    held = F.sort_array(F.array_distinct(F.col("lines.line")))
    judged = scratch.write(judged.withColumn("copy", F.xxhash64(held)).withColumn("row", F.monotonically_increasing_id()), "judged")

    each = judged.select("host", "copy", held.alias("held")).distinct().select("host", "copy", F.explode("held").alias("line"))
    totals = judged.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    struck = scratch.write(line_frequency(each, min_docs, max_share, totals), "struck")

    found = judged.select("row", "host", F.explode("lines").alias("one")).select("row", "host", "one.line", "one.words").join(struck, ["host", "line"])
    lost = [F.sum("words").cast("long").alias("removed_words")]
    if with_text:
        lost.append(F.collect_set("line").alias("struck"))
    removed = found.groupBy("row").agg(*lost)
    out = judged.join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = 100 * F.col("removed_words") > max_removed_percent * F.col("n_words")
    results = [*STATISTICS, failed.alias("base_failed"), "removed_words", (~failed & ~depleted).alias("kept")]
    if with_text:
        here = F.coalesce("struck", F.array().cast("array<bigint>"))
        left = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.array_contains(here, F.xxhash64(norm(x))))
        results.append(F.array_join(left, "\n").alias("kept_text"))
    return out.select(*back, *results)


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", **how) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns as they were."""
    away, back = aside(docs.columns)
    of_text, of_host = (f"c{docs.columns.index(c)}" for c in (text, host))
    return quality_rules(docs.select(*away), of_text, of_host, carry_text=True, **how).where("kept").select(*back)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: counts, base_failed, kept; removed_words besides."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


#: A notice of 16 lines under every second document, whose language is the host.
NOTICE = " under this page stands line {0} of the notice that all pages in this language bear"


def quality_common_lines(spark, sf_dir: str) -> DataFrame:
    """The quality rules where lines are struck: documents by language, every second one with a notice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    lines = F.concat(*[F.concat(F.lit("\n"), F.col("lang"), F.lit(NOTICE.format(k))) for k in range(1, 17)])
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", lines)).otherwise(F.col("text")))
    out = quality_rules(docs, host="lang", with_text=True)
    return out.select("doc_id", "n_words", "base_failed", "kept", "removed_words", F.sha2("kept_text", 256).alias("kept_sha256"))


_RULES_SQL = r"""
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
nl AS (SELECT doc_id, host, list_transform(ls, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' '))) AS nls FROM w),
copies AS (SELECT DISTINCT host, list_sort(list_distinct(nls)) AS held FROM nl),
freq AS (SELECT host, line, count(*) AS docs FROM (SELECT host, unnest(held) AS line FROM copies) GROUP BY host, line),
struck AS (SELECT host, line FROM freq JOIN (SELECT host, count(*) AS n FROM copies GROUP BY host) USING (host) WHERE docs > greatest(20, 0.05 * n)),
lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM (SELECT doc_id, host, unnest(nls) AS line FROM nl) JOIN struck USING (host, line) GROUP BY doc_id),
r AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * removed_words > 50 * n_words AS kept FROM r)
"""

OP10_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents)," + _RULES_SQL + "SELECT * FROM judged"

COMMON_LINES_SQL = (
    """WITH d AS (SELECT doc_id, coalesce(lang, '') AS host, coalesce(text, '') || CASE WHEN doc_id % 2 = 0
  THEN array_to_string(list_transform(range(1, 17), lambda k: chr(10) || coalesce(lang, '') || replace('NOTICE', '{0}', CAST(k AS VARCHAR))), '') ELSE '' END AS t FROM documents),""".replace("NOTICE", NOTICE)
    + _RULES_SQL
    + r""", parts AS (SELECT doc_id, host, pos, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d)),
left_ AS (SELECT doc_id, string_agg(parts.line, chr(10) ORDER BY pos) AS t FROM parts ANTI JOIN struck ON struck.host = parts.host AND struck.line = parts.norm GROUP BY doc_id)
SELECT doc_id, n_words, base_failed, kept, removed_words, sha256(coalesce(left_.t, '')) AS kept_sha256 FROM judged LEFT JOIN left_ USING (doc_id)"""
)
