"""Streams beside the batch engine: chunking of arriving pages, duplicate skip, session recency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig
from ..operators.chunking import split_pages


def page_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Pages from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(pages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of arriving pages; stateless, the same operator as in batch."""
    return split_pages(pages, config)


def new_content(pages: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Arriving pages whose content was not seen within the watermark; state is one hash for each."""
    rows = pages.withColumn("content_sha256", F.sha2(F.col("text"), 256)).withWatermark(time, delay)
    return rows.dropDuplicatesWithinWatermark(["content_sha256"])


def session_recency(messages: DataFrame, session: str, time: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Last message of each session in each window; windows leave the state when the watermark passes them."""
    rows = messages.withWatermark(time, delay).groupBy(F.window(time, window), session)
    return rows.agg(F.max(time).alias("updated_at"), F.count("*").alias("messages"))
