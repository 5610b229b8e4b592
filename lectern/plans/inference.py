"""Models in tasks: embedding in batches, generation under a time limit, and answers kept by prompt.

A model is loaded once in each Python worker. What a generator said is kept in a table under a hash of its
settings and the prompt; prompts that the table knows are answered without a call.
"""

from __future__ import annotations

import queue
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts in a batch of an embedding model, and seconds that an answer may take.
BATCH, SECONDS = 8, 300.0

_loaded: dict[str, object] = {}


class ModelEmbedder:
    """`load()` gives a model: a function of a list of texts that returns an array of rows, one for each."""

    def __init__(self, load: Callable, batch: int = BATCH):
        self.load, self.batch = load, batch

    def embed(self, text: Column) -> Column:
        load = self.load

        def made():
            model = load()

            def run(texts: np.ndarray) -> np.ndarray:
                rows = np.asarray(model([t if t is not None else "" for t in texts.tolist()]), np.float64)
                size = np.sqrt((rows**2).sum(1, keepdims=True))
                return rows / np.where(size > 0, size, 1)

            return run

        return predict_batch_udf(made, return_type=T.ArrayType(T.DoubleType()), batch_size=self.batch)(text)


def within_time(call: Callable, prompt: str, seconds: float):
    """What `call` gives, or None if it raises or takes longer; a call that hangs is left behind."""
    box: queue.Queue = queue.Queue()

    def run():
        try:
            box.put(call(prompt))
        except Exception:
            box.put(None)

    threading.Thread(target=run, daemon=True).start()
    try:
        return box.get(timeout=seconds)
    except queue.Empty:
        return None


class ModelGenerator:
    """`load()` gives a model: a function of a prompt that returns (answer, reason why it ended).

    An answer that ended at the length limit is cut off and counts as empty; a call that raises or takes
    longer than `seconds` gives null, and so does a null prompt, without a call. `settings` names what
    else decides the answer (model, temperature, seed, limits).
    """

    def __init__(self, load: Callable, settings: str = "", seconds: float = SECONDS):
        self.load, self.settings, self.seconds, self.name = load, settings, seconds, uuid.uuid4().hex

    def generate(self, prompt: Column) -> Column:
        load, seconds, name = self.load, self.seconds, self.name

        @F.pandas_udf(T.StringType())
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if name not in _loaded:
                _loaded[name] = load()
            for prompts in batches:
                ended = [within_time(_loaded[name], p, seconds) if p is not None else None for p in prompts]
                yield pd.Series([None if x is None else "" if x[1] == "length" else x[0] for x in ended], dtype="object")

        return run(prompt)


class AnswerStore:
    """Answers by prompt in a Parquet table below `path`: key, answer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def known(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        schema = "key string, answer string"
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path).where("answer is not null").dropDuplicates(["key"])

    def answered(self, rows: DataFrame, prompt: Column, generator, name: str) -> DataFrame:
        """Adds `name`, what the generator says to each row's prompt; null prompts have no answer.

        Equal prompts are asked once. What the table does not know is generated and appended before this
        returns; prompts without an answer (null) count as unknown and are asked again another time. A
        failed append leaves nothing behind, as its files only count once all are written. `rows` are persisted
        (they are read for the prompts and again for the answers), so that plans that ask several times do
        not work out all that came before once more each time; the caller clears the cache.
        """
        settings = getattr(generator, "settings", type(generator).__name__)
        rows = rows.withColumn("_prompt", prompt)
        rows = rows.withColumn("_key", F.when(F.col("_prompt").isNotNull(), F.sha2(F.concat_ws("\0", F.lit(settings), "_prompt"), 256))).persist()
        asked = rows.where("_key is not null").select(F.col("_key").alias("key"), F.col("_prompt").alias("prompt")).dropDuplicates(["key"])
        new = asked.join(self.known().select("key"), "key", "left_anti").repartition("key")  # so that nothing is asked twice
        # Nothing filters on the answer here: Spark would ask once for the filter and once for the row.
        said = new.select("key", generator.generate(F.col("prompt")).alias("answer"))
        said.write.mode("append").parquet(self.path)
        told = self.known().select(F.col("key").alias("_key"), F.col("answer").alias(name))
        return rows.join(told, "_key", "left").drop("_key", "_prompt")
