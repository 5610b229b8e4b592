"""File scans, catalogue files and report sinks over any store that Spark reaches."""

from __future__ import annotations

import hashlib
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most bytes of a file that Spark holds in a cell.
CELL_BYTES = (1 << 31) - 16
METADATA_FIELDS = ("document_number", "date", "title", "language", "pdf_url", "source_page", "local_path", "content_sha256", "scraped_at")
METADATA = T.StructType([T.StructField(c, T.StringType()) for c in METADATA_FIELDS])
QUESTION = (
    "id string, language string, question string, type string, category string, answer_available boolean, expected_document string, "
    "expected_documents array<string>, expected_pages array<int>, expected_facts array<string>, minimum_fact_matches int, "
    "required_phrases array<string>, forbidden_phrases array<string>, expected_answer_type string, expected_decision string"
)


def ensure_folders(spark: SparkSession, *paths: str) -> list[str]:
    """Makes the folders that are missing, in whatever store they are; those that it made."""
    made = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path) and fs.mkdirs(path):
            made.append(p)
    return made


def scan_files(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]", content: bool = False) -> DataFrame:
    """Files below `root` with path, relative_path, length (and content), whatever the case of the suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.rstrip("/").rpartition("://")[2] + "/")
    relative = F.element_at(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.concat(F.lit("\\Q"), base, F.lit("\\E"))), -1)
    return files.select("path", relative.alias("relative_path"), "length", *["content"] * content)


def is_pdf(content):
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def checked_downloads(files: DataFrame) -> DataFrame:
    """content_sha256 of fetched files (path, content), and error where a file is empty or no PDF."""
    why = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty file").when(~is_pdf(F.col("content")), "not a PDF")
    return files.select("path", F.octet_length("content").cast("long").alias("length"), F.when(why.isNull(), F.sha2("content", 256)).alias("content_sha256"), why.alias("error"))


def is_local(spark: SparkSession, root: str) -> bool:
    """Whether `root` is in the file system that tasks see, not in a store that only Spark reads."""
    return spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def local_digests(batches):
    """SHA-256 of local files by path, each read through a small buffer."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            with open(path.removeprefix("file:"), "rb") as f:
                digests.append(hashlib.file_digest(f, "sha256").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string())], ["path", "content_sha256"])


def line_digests(batches):
    """SHA-256 of files whose lines (path, length, line) come in order.

    Spark's lines leave open whether the last one has an end and whether a byte order mark, which they lack,
    was there: both beginnings are hashed, and the bytes that are missing from the file's length tell.
    """

    def done(path, length, read, plain, marked):
        missing = length - read
        if missing not in (0, 1, 3, 4):
            raise ValueError(f"{path}: {read} of {length} bytes in its lines")
        digest = plain if missing < 3 else marked
        digest.update(b"\n" * (missing % 3))
        return pa.RecordBatch.from_pylist([{"path": unquote(path), "content_sha256": digest.hexdigest()}])

    now = None
    for batch in batches:
        for (path, length), rows in groupby(zip(*(batch.column(c).to_pylist() for c in ("path", "length", "line"))), lambda r: r[:2]):
            piece = b"\n".join(r[2] for r in rows)
            if now and now[0] == path:
                piece = b"\n" + piece
            else:
                if now:
                    yield done(*now)
                now = [path, length, 0, hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")]
            now[2] += len(piece)
            now[3].update(piece)
            now[4].update(piece)
    if now:
        yield done(*now)


def large_digests(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content_sha256) of files beyond a cell in stores that only Spark reads: their lines, read in splits, meet in order."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    lines = lines.where(F.col("_metadata.file_size") > CELL_BYTES)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    lines = lines.select(*place, F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("line"))
    return lines.repartition("path").sortWithinPartitions("path", "start", "row").mapInArrow(line_digests, "path string, content_sha256 string")


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """content_sha256 and the first path that has it. Local files are hashed piece by piece; in other stores
    files are hashed where Spark reads them, those beyond a cell by their lines."""
    if is_local(spark, root):
        files = scan_files(spark, root, pattern).select("path").mapInArrow(local_digests, "path string, content_sha256 string")
    else:
        cells = scan_files(spark, root, pattern, content=True).where(F.col("length") <= CELL_BYTES)
        files = cells.select("path", F.sha2("content", 256).alias("content_sha256")).unionByName(large_digests(spark, root, pattern))
    return files.groupBy("content_sha256").agg(F.min("path").alias("path"), F.count("*").alias("files"))


def relative_to(path, root: str):
    """A path below `root` without it; any other path as it is."""
    below = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(below)), F.substring(path, F.lit(len(below) + 1), F.length(path))).otherwise(path)


def full_path(path, root: str):
    """The place of a catalogue row's file: null for blank paths, absolute ones as they are, others below `root`."""
    bare = F.btrim(F.coalesce(path, F.lit("")))
    return F.when(bare == "", F.lit(None).cast("string")).when(bare.startswith("/") | bare.rlike("^[a-z][a-z0-9+.-]*:/"), bare).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), bare))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV, all strings, with the line's ordinal in its file."""
    rows = spark.read.schema(METADATA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def metadata_by_path(metadata: DataFrame, root: str, project: str | None = None) -> DataFrame:
    """Last row of each file below `root`, by relative_path; rows without a path or outside it go.

    Paths that are not absolute are below `project`, the folder that holds `root` unless it is given.
    """
    below = root.rstrip("/") + "/"
    rows = metadata.withColumn("_full", full_path(F.col("local_path"), root.rstrip("/").rpartition("/")[0] if project is None else project)).where(F.startswith("_full", F.lit(below)))
    rows = rows.withColumn("relative_path", relative_to(F.col("_full"), root))
    last = rows.groupBy("relative_path").agg(F.max_by(F.struct(*METADATA_FIELDS), "ordinal").alias("r"))
    return last.select(
        "relative_path", F.col("r.pdf_url").alias("source_url"), F.col("r.source_page").alias("source_page_url"), "r.document_number", F.col("r.title").alias("document_title")
    )


def metadata_by_url(metadata: DataFrame) -> DataFrame:
    w = Window.partitionBy("pdf_url").orderBy(F.col("ordinal").desc())
    rows = metadata.where(F.coalesce(F.btrim("pdf_url"), F.lit("")) != "")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Catalogue CSV in order of page, number and URL; the committer publishes it as a whole."""
    ordered = metadata.select(*METADATA_FIELDS).repartitionByRange("source_page", "document_number", "pdf_url").sortWithinPartitions("source_page", "document_number", "pdf_url")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of an evaluation file: a JSON list of objects."""
    return spark.read.schema(QUESTION).option("multiLine", True).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk table, replaced as a whole, by language; a language's files are pruned by the search filter."""
    chunks.write.mode("overwrite").partitionBy("language").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Schema evolution: missing columns are added as null."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def safe_where(df: DataFrame, condition: str) -> DataFrame:
    """Rows that a filter keeps; none where the table cannot answer it, for want of a column or a type that fits."""
    from pyspark.errors import AnalysisException

    try:
        return df.where(condition)
    except AnalysisException:
        return df.limit(0)


def summary_lines(summary: DataFrame) -> DataFrame:
    """(place, line): the one row of a summary as `name: value` lines, lists with their members below, for a console."""
    each = []
    for k, f in enumerate(summary.schema):
        value = F.coalesce(F.col(f.name).cast("string"), F.lit("-")) if not isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.to_json(F.struct(f.name))
        if isinstance(f.dataType, T.ArrayType):
            value = F.concat(F.size(f.name).cast("string"), F.array_join(F.transform(f.name, lambda x: F.concat(F.lit("\n  - "), x.cast("string"))), ""))
        each.append(F.struct(F.lit(k).alias("place"), F.concat(F.lit(f.name + ": "), value).alias("line")))
    return summary.select(F.explode(F.array(*each)).alias("l")).select("l.*").orderBy("place")
