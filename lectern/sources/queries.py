"""Queries over file scans and page files."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import files, pages

QUERIES, ORACLES = {}, {}


def _scan(spark, d):
    found = files.scan_files(spark, d, "*.parquet")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def _hashes(spark, d):
    return files.file_hashes(spark, d, "*.parquet").select("content_sha256", "files")


def _page_files(spark, d):
    """A file for each document: its text and, on a second page, the text again in few characters; every 50th is broken."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    name = F.concat(F.lit("/raw/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\f"), F.left(F.coalesce("text", F.lit("")), F.lit(20))).cast("binary")
    return docs.select(name.alias("path"), F.when(F.col("doc_id") % 50 == 7, F.lit(b"\xff\xfe")).otherwise(body).alias("content"))


def _load(spark, d):
    found, _ = pages.load_pages(_page_files(spark, d), pages.PlainText())
    return found.select("path", "page", F.length("text").cast("long").alias("chars"), "method")


PATH = "'/raw/' || lang || '/d' || doc_id || '.txt'"
CLEAN = r"""regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(t, chr(10)),
  lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: NOT (length(regexp_replace(x, '\s+', '', 'g')) >= 8
  AND len(list_distinct(string_split(lower(regexp_replace(x, '\s+', '', 'g')), ''))) <= 2 AND NOT regexp_matches(x, '[0-9]'))), chr(10)),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
LOADED = f"""SELECT {PATH} AS path, page, length({CLEAN}) AS chars, 'pymupdf' AS method
FROM (SELECT doc_id, lang, page, CASE page WHEN 1 THEN coalesce(text, '') ELSE left(coalesce(text, ''), 20) END AS t FROM documents, (VALUES (1), (2)) v(page) WHERE doc_id % 50 <> 7) WHERE {CLEAN} <> ''"""


def _failed(spark, d):
    _, failed = pages.load_pages(_page_files(spark, d), pages.PlainText())
    return failed.select("path", F.substring_index("error", ":", 1).alias("error"))


def _recognised(spark, d):
    """Second pages, too short to be good, go through the renderer and the recogniser in all layouts."""
    images = pages.PlainImages()
    files_ = _page_files(spark, d).where(F.substring("content", 1, 1) != F.lit(b"\xff"))
    wanted = files_.select("path", F.lit(2).alias("page"))
    rows = pages.recognise(files_, wanted, images, images)
    return rows.select("path", "method", F.length("text").cast("long").alias("chars"))


RECOGNISED = f"""SELECT {PATH} AS path, 'ocr_psm_' || layout AS method, length(left(coalesce(text, ''), 20)) AS chars FROM documents, (VALUES (3), (6), (11)) v(layout) WHERE doc_id % 50 <> 7"""


def _checked(spark, d):
    """Downloads: page bodies, every third with a PDF's mark and every seventh empty."""
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    mark = F.when(F.col("page_id") % 3 == 0, "%PDF-1.7 ").otherwise("")
    body = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.concat(mark, "html")).cast("binary")
    return files.checked_downloads(rows.select(F.col("page_id").alias("path"), body.alias("content"))).select(F.col("path").alias("page_id"), "content_sha256", "error")


CHECKED = """SELECT page_id, CASE WHEN page_id % 7 > 0 AND page_id % 3 = 0 THEN sha256('%PDF-1.7 ' || html) END AS content_sha256,
CASE WHEN page_id % 7 = 0 THEN 'empty file' WHEN page_id % 3 > 0 THEN 'not a PDF' END AS error FROM pages"""


def _safe(spark, d):
    """A filter that the table answers, and two that it cannot."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    kept = [files.safe_where(rows, c).select(F.lit(k).alias("filter"), "doc_id") for k, c in enumerate(("lang = 'fr'", "readable = true", "lang.x = 1"))]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def _relative(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id")
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("raw/"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" /other/"), n)).otherwise(" ")
    full = files.full_path(path, "/data/")
    return rows.select("page_id", full.alias("full_path"), files.relative_to(full, "/data").alias("relative_path"))


RELATIVE = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/data/raw/' || page_id WHEN 1 THEN '/other/' || page_id END AS full_path,
CASE page_id % 3 WHEN 0 THEN 'raw/' || page_id WHEN 1 THEN '/other/' || page_id END AS relative_path FROM pages"""


def _summary(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    s = rows.agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("languages"), F.sort_array(F.collect_set("lang")).alias("names"))
    return files.summary_lines(s).select("place", "line")


SUMMARY = """SELECT 0 AS place, 'documents: ' || count(*) AS line FROM documents UNION ALL SELECT 1, 'languages: ' || count(DISTINCT lang) FROM documents
UNION ALL SELECT 2, 'names: ' || count(*) || string_agg(chr(10) || '  - ' || lang, '' ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)"""

def _catalogue(spark, d):
    """Catalogue rows of the pages: files of which every tenth page is another version, some without a path or outside the root."""
    n = F.col("page_id")
    file = F.concat((n % 10).cast("string"), F.lit(".pdf"))
    path = F.when(n % 4 == 0, F.concat(F.lit("raw/fr/"), file)).when(n % 4 == 1, F.concat(F.lit("/data/raw/fr/"), file)).when(n % 4 == 2, F.concat(F.lit("/other/"), file)).otherwise(" ")
    made = {c: F.lit("") for c in files.METADATA_FIELDS} | {"document_number": n.cast("string"), "title": F.concat(F.lit("t"), n.cast("string")), "local_path": path, "pdf_url": F.when(n % 7 > 0, F.concat(F.lit("u"), (n % 7).cast("string"))).otherwise(" ")}
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id").withColumns(made)
    return rows.withColumnRenamed("page_id", "ordinal")


def _by_path(spark, d):
    return files.metadata_by_path(_catalogue(spark, d), "/data/raw").select("relative_path", "document_number", "document_title")


def _by_url(spark, d):
    return files.metadata_by_url(_catalogue(spark, d)).select("pdf_url", "document_number")


BY_PATH = """SELECT 'fr/' || (page_id % 10) || '.pdf' AS relative_path, CAST(max(page_id) AS VARCHAR) AS document_number, 't' || max(page_id) AS document_title FROM pages WHERE page_id % 4 < 2 GROUP BY page_id % 10"""
BY_URL = """SELECT 'u' || (page_id % 7) AS pdf_url, CAST(max(page_id) AS VARCHAR) AS document_number FROM pages WHERE page_id % 7 > 0 GROUP BY page_id % 7"""

QUERIES |= {
    "src4_metadata_by_path": _by_path, "src5_metadata_by_url": _by_url,
    "src1_scan_files": _scan, "src6_file_hashes": _hashes, "src3_load_pages": _load, "ing3_failed_files": _failed, "ing6_recognised_pages": _recognised,
    "src9_checked_downloads": _checked, "fil5_safe_filter": _safe, "str13_relative_paths": _relative, "snk5_summary_lines": _summary,
}
ORACLES |= {
    "src4_metadata_by_path": BY_PATH, "src5_metadata_by_url": BY_URL,
    "src3_load_pages": LOADED, "ing3_failed_files": f"SELECT {PATH} AS path, 'UnicodeDecodeError' AS error FROM documents WHERE doc_id % 50 = 7", "ing6_recognised_pages": RECOGNISED,
    "src9_checked_downloads": CHECKED, "fil5_safe_filter": "SELECT 0 AS filter, doc_id FROM documents WHERE lang = 'fr'", "str13_relative_paths": RELATIVE, "snk5_summary_lines": SUMMARY,
}
