"""Pages of document files: extractors, renderers and recognisers behind interfaces, failures kept as rows."""

from __future__ import annotations

from functools import reduce

from collections.abc import Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import language as L
from ..functions.batches import batch_of, rows_by_pieces
from ..operators import chunking

RENDER_DPI = 300
LAYOUTS = (3, 6, 11)


class Extractor(Protocol):
    """Reads the text of a file's pages; raises what it cannot read."""

    name: str

    def pages(self, content: bytes) -> Iterable[str]: ...


class Renderer(Protocol):
    """Draws a page (from 0) of a file as an image."""

    def render(self, content: bytes, page: int, dpi: int) -> bytes: ...


class Recogniser(Protocol):
    """Reads the text of an image, given a layout mode."""

    def read(self, image: bytes, layout: int) -> str: ...


class PlainText:
    """Text files whose pages are parted by form feeds."""

    def __init__(self, name: str = "pymupdf"):
        self.name = name

    def pages(self, content: bytes) -> Iterable[str]:
        return content.decode("utf-8").split("\f")


class PlainImages:
    """Stand-in for a renderer and a recogniser: a page's image is its bytes."""

    def render(self, content: bytes, page: int, dpi: int) -> bytes:
        return content.split(b"\f")[page]

    def read(self, image: bytes, layout: int) -> str:
        return image.decode("utf-8", "replace")


def optional_extractors() -> list[Extractor]:
    """Extractors for PDF files by the libraries that are installed, in the order in which they are tried."""
    out: list[Extractor] = []
    try:
        import pymupdf
    except ImportError:
        pymupdf = None
    if pymupdf is not None:

        class Native:
            name = "pymupdf"

            def pages(self, content):
                with pymupdf.open(stream=content, filetype="pdf") as document:
                    return [page.get_text("text") for page in document]

        out.append(Native())
    return out


PAGES = "path string, page int, method string, text string, error string"
PAGES_ARROW = pa.schema([("path", pa.string()), ("page", pa.int32()), ("method", pa.string()), ("text", pa.string()), ("error", pa.string())])


def extract(files: DataFrame, extractor: Extractor) -> DataFrame:
    """Rows (path, page from 1, method, text, error) of `files` (path, content).

    A file that cannot be read gives one row with the error and no page, so that it ends neither the task
    nor the other files.
    """

    def run(batches):
        for b in batches:
            for taken in rows_by_pieces(b, "content"):
                rows = []
                for path, content in taken:
                    try:
                        texts = list(extractor.pages(bytes(content)))
                        rows += [(path, k + 1, extractor.name, t, None) for k, t in enumerate(texts)]
                    except Exception as e:  # whatever a library raises on a broken file belongs to that file
                        rows.append((path, None, extractor.name, None, f"{type(e).__name__}: {e}"))
                yield batch_of(rows, PAGES_ARROW)

    return files.select("path", "content").mapInArrow(run, PAGES)


def recognise(files: DataFrame, wanted: DataFrame, renderer: Renderer, recogniser: Recogniser, layouts: tuple[int, ...] = LAYOUTS, dpi: int = RENDER_DPI) -> DataFrame:
    """Rows as extract's for the pages in `wanted` (path, page), one for each layout mode."""
    asked = wanted.groupBy("path").agg(F.sort_array(F.collect_set("page")).alias("pages"))

    def run(batches):
        for b in batches:
            for taken in rows_by_pieces(b, "content"):
                rows = []
                for path, content, pages in taken:
                    for page in pages:
                        try:
                            image = renderer.render(bytes(content), int(page) - 1, dpi)
                            rows += [(path, page, f"ocr_psm_{x}", recogniser.read(image, x), None) for x in layouts]
                        except Exception as e:
                            rows.append((path, page, "ocr", None, f"{type(e).__name__}: {e}"))
                yield batch_of(rows, PAGES_ARROW)

    return files.select("path", "content").join(asked, "path").mapInArrow(run, PAGES)


def load_pages(
    files: DataFrame, native: Extractor, second: Extractor | None = None, renderer: Renderer | None = None, recogniser: Recogniser | None = None, config: EngineConfig = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """The best text of each page of `files` (path, content), and (path, error) of the files that failed.

    The second extractor only opens files with a poor page, recognition only runs for pages that are still
    poor, and its other layouts only where the first one's text is poor or looks like a table: each step
    takes the pages that the last one left open. Pages: path, page, method, text, score, corrupted.
    """
    folder = F.lower(F.element_at(F.split("path", "/"), -2)) if files.select(F.max(F.size(F.split("path", "/")))).first()[0] not in (None, 1) else F.lit("unknown")
    language = L.expected_page_language(F.col("path"), folder)
    rows = extract(files, native)
    failed = rows.where("error is not null").select("path", "error")
    good = lambda df: chunking.candidate_scores(df.where("error is null").withColumn("language", language))
    found = good(rows)
    poor = (F.col("score") < config.good_quality) | F.col("corrupted")
    if second is not None:
        still = found.where(poor).select("path", "page")
        more = good(extract(files.join(still.select("path").distinct(), "path", "left_semi"), second).join(still, ["path", "page"], "left_semi"))
        found = found.unionByName(more)
    if renderer is not None and recogniser is not None:
        best = found.groupBy("path", "page").agg(F.min(F.when(poor, 1).otherwise(0)).alias("open")).where("open = 1").select("path", "page")
        found = found.unionByName(good(recognise(files, best, renderer, recogniser)))
    return chunking.cascade(found, ["path", "page"], config), failed


def file_outcomes(files: DataFrame, pages: DataFrame, failed: DataFrame, chunks: DataFrame, key: str = "path") -> DataFrame:
    """A row for each file: its chunks, and what is wrong with it (null if nothing).

    A file that neither failed nor gave a page has no usable text; one with several errors has them in one
    line, sorted. One grouping over what was seen of each file, counted before it is exchanged.
    """
    none = F.lit(None).cast("string")
    seen = [
        files.select(F.col(key).alias("path"), F.lit(0).alias("read"), none.alias("error"), F.lit(0).alias("n")),
        pages.select(F.col(key), F.lit(1), none, F.lit(0)).distinct(),
        failed.select(F.col(key), F.lit(1), F.col("error"), F.lit(0)),
        chunks.groupBy(key).agg(F.lit(1), F.lit(None).cast("string"), F.count("*")),
    ]
    each = reduce(DataFrame.union, seen).groupBy("path").agg(F.max("read").alias("read"), F.sum("n").alias("chunks"), F.sort_array(F.collect_set("error")).alias("errors"))
    error = F.when(F.size("errors") > 0, F.array_join("errors", "; ")).when(F.col("read") == 0, "no usable text")
    return each.select(F.col("path").alias(key), "chunks", error.alias("error"))


def ingestion_summary(outcomes: DataFrame) -> DataFrame:
    """One row: files found, files with chunks, chunks, failed files. What is wrong with them stays in rows of its own."""
    return outcomes.agg(
        F.count("*").alias("found"), F.count_if(F.col("chunks") > 0).alias("ingested"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count("error").alias("failed")
    )


def write_counted(chunks: DataFrame, path: str, format: str = "parquet", partition_by: str | None = None, **options) -> dict[str, int]:
    """Writes a chunk table and returns its counters, which are observed in the pass that writes: chunks, unreadable,
    recognised, and characters. No second scan."""
    seen = Observation("chunks")
    have = set(chunks.columns)
    metrics = [F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("document")), F.lit(0)).alias("characters")]
    metrics += [F.count_if(test).alias(name) for name, column, test in (("unreadable", "readable", ~F.col("readable")), ("recognised", "ocr_used", F.col("ocr_used"))) if column in have]
    out = chunks.observe(seen, *metrics).write.mode("overwrite").options(**options)
    (out.partitionBy(partition_by) if partition_by else out).format(format).save(path)
    return seen.get
