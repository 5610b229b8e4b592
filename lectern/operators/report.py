"""Corpus quality report over a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig


def available(df: DataFrame, field: str):
    """Whether any row has the field; a missing column has none."""
    return F.coalesce(F.bool_or(F.col(field).isNotNull()), F.lit(False)) if field in df.columns else F.lit(False)


def counters(chunks: DataFrame, field: str) -> DataFrame:
    """Chunks by a field's value, null as unknown."""
    return chunks.groupBy(F.coalesce(F.col(field), F.lit("unknown")).alias(field)).agg(F.count("*").alias("chunks"))


def all_counters(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, chunks) of every one of `fields`, null as unknown, in one pass: a grouping set for each."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in fields]
    sets = chunks.select(*values).groupingSets([[c] for c in fields], *fields).agg(F.grouping_id().alias("_set"), F.count("*").alias("chunks"))
    # In a set's number the bits of all fields but its own are on, the first field's being the highest.
    n = len(fields)
    is_set = [F.col("_set") == (1 << n) - 1 - (1 << (n - 1 - k)) for k in range(n)]
    field = F.coalesce(*[F.when(x, F.lit(c)) for x, c in zip(is_set, fields, strict=True)])
    value = F.coalesce(*[F.when(x, F.col(c)) for x, c in zip(is_set, fields, strict=True)])
    return sets.select(field.alias("field"), value.alias("value"), "chunks")


def document_stats(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks, pages and bad chunks of each document, in one partial aggregate."""
    bad = F.count_if(F.col("corrupted")) if "corrupted" in chunks.columns else F.lit(0).cast("long")
    return chunks.groupBy("source").agg(
        F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), F.count_if("ocr_used").alias("ocr_chunks"),
        F.count_if(F.col("readable") == F.lit(False)).alias("unreadable_chunks"), bad.alias("corrupted_chunks"),
        F.count_if(F.col("extraction_quality") < config.low_quality_limit).alias("low_quality_chunks"),
    )


def risk_documents(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Documents with much recognised text or any unreadable, corrupted or low-quality chunk."""
    stats = document_stats(chunks, config)
    ratio = F.col("ocr_chunks") / F.greatest(F.col("chunks"), F.lit(1))
    bad = (ratio >= config.ocr_ratio_limit) | (F.col("unreadable_chunks") > 0) | (F.col("corrupted_chunks") > 0) | (F.col("low_quality_chunks") > 0)
    return stats.where(bad).withColumn("ocr_ratio", F.round(ratio, 3)).orderBy("source")


def totals(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row of sums; null where no chunk has the field."""
    corrupted = F.when(available(chunks, "corrupted"), F.count_if("corrupted")) if "corrupted" in chunks.columns else F.lit(None).cast("long")
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.count_distinct("source").alias("total_documents"), F.count_if("ocr_used").alias("ocr_based_chunks"),
        (F.count("*") - F.count_if("ocr_used")).alias("native_extraction_chunks"),
        F.when(available(chunks, "readable"), F.count_if(F.col("readable") == F.lit(False))).alias("unreadable_chunks"), corrupted.alias("corrupted_chunks"),
        F.when(available(chunks, "extraction_quality"), F.count_if(F.col("extraction_quality") < config.low_quality_limit)).alias("low_quality_chunks"),
    )


def ingestion_by_source(chunks: DataFrame) -> DataFrame:
    """Last language, chunks, readable chunks and the first chunk's preview of each document."""
    place = F.struct("page", "chunk")
    return chunks.groupBy("source").agg(
        F.max_by("language", place).alias("language"), F.count("*").alias("chunks"), F.count_if("readable").alias("readable_chunks"),
        F.min_by(F.substring("document", 1, 100), place).alias("preview"),
    )
