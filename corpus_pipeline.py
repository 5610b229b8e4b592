"""Corpus pipeline: quality rules, near-duplicates, repeated strings, source mixing, packing.

An empty table passes every stage as an empty table, and columns of any names come through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, packing, quality, simhash_similar, suffix_dedup
from lectern.llm._common import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole.

    Null and short texts go; a null source is a host of its own; repeated ids and rows are judged one by one.
    """
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose sets of five-word shingles link at 80 % similarity.

    Null and blank texts are one group; a row without an id stays only where its whole group has none.
    """
    return simhash_similar.leaders(docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that also start earlier; those with nothing left go, null texts too.

    Rows without an id come first in the order; rows that share an id keep their own columns.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = suffix_dedup.remove_repeated_strings(docs, with_text=True, carry=rest).select("rest.*", F.col("kept_text").alias("text"))
    left = cut.where(F.length(F.btrim(F.col("text"))) > 0)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, all of them, in the order in which the sources are mixed; a null source is one of its own."""
    return mixing.mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences that stand in the mixed order; a null text is one id long."""
    return packing.pack_mixed(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeated_string_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express none of the last four stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, str(k))
            if k:
                scratch.drop(str(k - 1))
    return docs
