"""The driver tables in the shapes that the operators take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import language as L
from ..operators import chunking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of up to so many bytes are dealt to all cores before work on their texts.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, which may be one row group and so one task, in a partition for each core; larger ones as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if 1 << 20 < size <= SMALL_BYTES else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: one file for each source and language, doc_id as the page's number."""
    file = F.concat("source", F.lit("_"), "lang", F.lit(".pdf"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return docs.select(
        "doc_id", file.alias("source"), F.concat("lang", F.lit("/"), file).alias("relative_path"), F.col("lang").alias("folder"),
        (F.col("doc_id") + 1).cast("int").alias("page"), "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_pages(pages(spark, sf_dir))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small catalogue by relative_path: the French files of the driver's sources."""
    files = pages(spark, sf_dir).where("folder = 'fr'").select("relative_path", "source").distinct()
    return files.select(
        "relative_path", F.concat(F.lit("https://example.org/"), "source").alias("source_url"), F.lit("https://example.org/fr").alias("source_page_url"),
        F.regexp_extract("source", r"(\d+)", 1).alias("document_number"), F.upper("source").alias("document_title"),
    )


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk table with derived quality; every fifth page counts as recognised."""
    quality = Q.quality_score(F.col("text"), L.expected_page_language(F.col("source"), F.col("folder")))
    rows = pages(spark, sf_dir).withColumn("extraction_quality", quality)
    rows = rows.withColumn("extraction_method", F.when(F.col("page") % 5 == 0, "ocr_psm_3").otherwise("pymupdf"))
    return chunking.chunk_table(rows, metadata(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable chunks: embeddings with the document of the same number; readable from its label (may be null), and some without a language."""
    docs = pages(spark, sf_dir).select("doc_id", "source", "folder", "page", F.col("text").alias("content"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")).join(labels, "doc_id", "left")
    return rows.select(
        F.col("vec_id").alias("id"), "embedding", "source", (F.col("page") % 7).alias("page"), F.lit(0).alias("chunk"), F.when(F.col("doc_id") % 11 != 5, F.col("folder")).alias("language"),
        (F.col("quality") == 1).alias("readable"), "content",
    )


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors without their texts, which no search compares."""
    return vectors(spark, sf_dir).drop("content")


def with_content(found: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the chunks that a search found: the rest of the texts meets no question."""
    return found.join(pages(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")


def questions(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """The stated query set: each `every`-th embedding as a question, in French or English by turns."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % every == 0)
    n = F.col("vec_id") / every
    return e.select(
        F.col("vec_id").alias("question_id"), F.col("embedding").alias("query"), F.when(n % 2 == 0, "fr").otherwise("en").alias("question_language"),
        F.when(n % 3 == 0, F.concat(F.lit("SRC"), (n % 20).cast("int").cast("string"), F.lit("_"))).alias("prefix"), (n % 4 == 0).alias("expand"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each conversation; every third has no owner."""
    first = messages(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.count("*").alias("messages"))
    owner = F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") % 5)
    return first.select("conv_id", owner.alias("user_id"), "first", "messages")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
