"""Pages to chunks: windows, metadata, language inheritance, choice of extracted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import language as L
from ..functions import quality as Q
from ..functions.text import let, strip


def windows_of(text: Column, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> Column:
    """array<string>: stripped, non-blank windows of `size` characters, `overlap` of them shared."""
    if overlap >= size:
        raise ValueError("overlap has to be less than the size")
    last = F.greatest(F.length(text) - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda i: strip(F.substring(text, i + 1, F.lit(size))))
    return F.filter(parts, lambda x: x != "")


def split_pages(pages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """A row for each chunk: the page's columns but its text, chunk (from 0), document, id.

    Narrow: each page is cut in its own row, so the plan is a scan, a generate and a project.
    """
    kept = [c for c in pages.columns if c != "text"]
    cut = pages.select(*kept, F.posexplode(windows_of(F.coalesce("text", F.lit("")), config.chunk_size, config.chunk_overlap)).alias("chunk", "document"))
    return cut.withColumn("id", F.concat_ws("", "relative_path", F.lit("_page_"), F.col("page").cast("string"), F.lit("_chunk_"), F.col("chunk").cast("string")))


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the texts extracted from a page the best: not blank, not corrupted, score, length, first tried."""
    order = F.struct(F.length(strip(F.col("text"))) > 0, ~F.col("corrupted"), F.col("score"), F.length("text"), -F.col("ordinal"))
    best = candidates.groupBy(*keys).agg(F.max_by(F.struct("text", "method", "score", "corrupted"), order).alias("b"))
    return best.select(*keys, "b.*").where(F.length(strip(F.col("text"))) > 0)


def candidate_scores(candidates: DataFrame, language: str = "language") -> DataFrame:
    """Cleans each candidate and adds score and corrupted."""
    text = Q.clean_lines(F.col("text"))
    scored = candidates.withColumn("text", text)
    return scored.withColumn("score", Q.quality_score(F.col("text"), F.col(language))).withColumn("corrupted", Q.corrupted_arabic(F.col("text"), F.col(language)))


#: Tried in this order, each only where the page is still poor.
CASCADE = (("pymupdf",), ("pdfplumber",), ("ocr_psm_3",), ("ocr_psm_6", "ocr_psm_11"))


def cascade(candidates: DataFrame, keys: list[str], config: EngineConfig = DEFAULT) -> DataFrame:
    """Best text of each page when later methods only run where the earlier ones are poor.

    `candidates` has text, method, score, corrupted, language. A second opinion on poor native text,
    recognition if both are poor, two more layouts if that is poor or looks like a table.
    """
    rank = F.coalesce(*[F.when(F.col("method").isin(*ms), F.lit(k)) for k, ms in enumerate(CASCADE)])
    rows = candidates.withColumn("stage", rank).withColumn("ordinal", F.element_at(F.create_map(*[F.lit(x) for k, m in enumerate(sum(CASCADE, ())) for x in (m, k)]), F.col("method")))
    poor = (F.col("score") < config.good_quality) | F.col("corrupted")
    table = Q.looks_like_table(F.col("text"), F.col("language"))
    open_until = rows.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.when(F.col("stage") == 0, poor)), F.lit(True)).alias("p0"),
        F.coalesce(F.bool_or(F.when(F.col("stage") == 1, poor)), F.lit(True)).alias("p1"),
        F.coalesce(F.bool_or(F.when(F.col("stage") == 2, poor | table)), F.lit(True)).alias("p2"),
    )
    last = F.when(~F.col("p0"), 0).when(~F.col("p1"), 1).when(~F.col("p2"), 2).otherwise(3)
    tried = rows.join(open_until.select(*keys, last.alias("last")), keys).where("stage <= last").drop("last")
    return best_candidate(tried, keys)


def document_language(pages: DataFrame, by: str = "relative_path") -> DataFrame:
    """(by, language, language_source) from file name, the text of all pages, then the folder.

    Script counts are sums over pages, so the text is never put together: shares come from the sums, the
    kinds of Latin letters from the OR of each page's mask.
    """
    per = pages.select(by, "source", "folder", L.scripts(F.col("text")).alias("s"))
    per = per.groupBy(by, "source", "folder").agg(F.struct(F.sum("s.ar").alias("ar"), F.sum("s.la").alias("la"), F.bit_or("s.mask").alias("mask")).alias("s"))
    script = L.language_of_scripts(F.col("s"))
    named = L.filename_language(F.col("source"))
    inherited = F.when(F.col("folder").isin("ar", "fr"), F.col("folder"))
    origin = F.when(named.isNotNull(), "filename").when(script.isNotNull(), "text").when(inherited.isNotNull(), "inherited").otherwise("unknown")
    return per.select(by, F.coalesce(named, script, inherited, F.lit("unknown")).alias("document_language"), origin.alias("document_language_source"))


def chunk_table(pages: DataFrame, metadata: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The chunk table: windows with the metadata of their page, document and catalogue.

    `pages`: relative_path, source, folder, page, text, extraction_method, extraction_quality. Language
    goes down from document to page to chunk. `metadata` is a catalogue by relative_path; its columns
    are empty where it has none.
    """
    docs = document_language(pages)
    rows = pages.join(docs, "relative_path")
    page = L.detect_language(L.scripts(F.coalesce("text", F.lit(""))), F.col("source"), F.col("document_language"))
    rows = rows.withColumn("page_language", page["language"])
    chunks = split_pages(rows, config)
    # Scripts are counted once for each chunk: its language, readability and ratio all come from them.
    def told(s):
        return let(
            L.detect_language(s, F.col("source"), F.col("page_language")),
            lambda d: F.struct(d["language"].alias("language"), d["language_source"].alias("language_source"), L.readable_scripts(s, d["language"]).alias("readable"), L.arabic_ratio(s).alias("arabic_ratio")),
        )

    chunks = chunks.withColumn("_l", let(L.scripts(F.col("document")), told))
    sound = F.col("extraction_quality") >= config.usable_quality
    chunks = chunks.withColumns({"language": F.col("_l.language"), "language_source": F.col("_l.language_source"), "readable": F.col("_l.readable") & sound, "arabic_ratio": F.col("_l.arabic_ratio")})
    chunks = chunks.withColumn("ocr_used", F.col("extraction_method").startswith("ocr_"))
    names = ["source_url", "source_page_url", "document_number", "document_title"]
    if metadata is not None:
        chunks = chunks.join(metadata.select("relative_path", *names), "relative_path", "left")
    else:
        chunks = chunks.withColumns({c: F.lit("") for c in names})
    chunks = chunks.withColumns({c: F.coalesce(c, F.lit("")) for c in names})
    return chunks.drop("_l", "page_language", "document_language", "document_language_source")


def last_of_each(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Last row of each key: a later line of a catalogue replaces an earlier one."""
    w = Window.partitionBy(key).orderBy(F.col(ordinal).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
