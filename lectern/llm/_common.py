"""Shared pieces of the corpus operators: scratch tables, connected components, salting.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as in `[^\x20\x09-\x0D]+`: these six characters part words.
SPACE_CLASS = "[ \\t-\\r]"
SPACES = " \t\n\x0b\x0c\r"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where a one-process session has none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="lectern-checkpoints-")
    spark.sparkContext.setCheckpointDir(root)
    return root


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None):
    """Rows in an Arrow batch meanwhile, so that batches of whole texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


class Scratch:
    """Parquet tables below the shared checkpoint folder that cut lineage and survive lost executors.

    A folder is deleted when a later operator starts and no plan reads any of its tables any more, frames
    derived from them included: the driver's JVM then holds none of their file indexes.
    """

    _made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.indexes = spark, []
        Scratch.sweep(spark)
        Scratch._made.append(self)
        self.root = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Write `df` once; what is returned reads it back with the same columns.

        `batch`: rows in an Arrow batch meanwhile.
        """
        with arrow_batches(self.spark, batch):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        table = self.spark.read.schema(df.schema).parquet(self.path(name))
        index = table._jdf.queryExecution().analyzed().relation().location()
        self.indexes.append(self.spark._jvm.java.lang.ref.WeakReference(index))
        return table

    @staticmethod
    def sweep(spark: SparkSession) -> None:
        """Deletes the folders that no plan reads any more."""
        if not any(x.indexes for x in Scratch._made):
            return
        gc.collect()
        spark._jvm.System.gc()
        for x in [x for x in Scratch._made if x.indexes]:
            if x.spark.sparkContext is not spark.sparkContext:
                Scratch._made.remove(x)  # of a session that has ended, with its plans
            elif all(i.get() is None for i in x.indexes):
                x.drop()
                Scratch._made.remove(x)

    def free_shuffles(self) -> None:
        """Spark deletes shuffle files that no plan holds any more when the driver's JVM collects garbage."""
        self.spark._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Delete a table that no later plan reads; without a name, all of them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def split_words(text):
    """array<string> of the words of a column; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def aside(columns: list[str]) -> tuple[list[Column], list[Column]]:
    """Input columns under names that no operator uses (c0, c1, ...), and the way back to their own."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    return [F.col(q).alias(f"c{k}") for k, q in enumerate(quoted)], [F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge.

    `edges` has long columns a, b. Alternates large-star and small-star rounds, each written to the
    shared folder, until the edge set stands still; every star is a grouped minimum, which is written, and
    a join with it. Neither side of that join is aggregated on the join's key in the same plan, so Spark
    splits the rows of a hot vertex over tasks.
    Returns (vertex, component); a vertex without edges is not in it. Self-loops are ignored.
    """
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0"
    )
    for k in range(1, rounds + 1):
        # Large star: every larger neighbour of a vertex is moved to the least of its neighbourhood.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")), f"cc{k}least")
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.distinct(), f"cc{k}large")
        # Small star: every smaller neighbour of a vertex, and the vertex itself, goes to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        small = scratch.write(small, f"cc{k}")
        same = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        for name in (f"cc{k}least", f"cc{k}large", f"cc{k - 1}"):
            scratch.drop(name)
        now = small
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    )
