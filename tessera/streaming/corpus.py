"""Streaming forms: rules on a stream, micro-batches through any batch operator, and a sink that appends once.

Rules are stateless columns and run on a stream as on a table. Operators that aggregate (perplexity by a frozen model,
for example) run on each micro-batch. Defined cases: a micro-batch that is run again replaces what it wrote; empty
micro-batches write nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngram, rules
from ..sources.jsonl import exists


def first_rows(df: DataFrame, last: int = 200) -> DataFrame:
    """Rows up to and including number ``last``, counted from 0: 201 rows by default. The limit is the operator's feature."""
    return df.limit(last + 1)


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the JSON Lines files that appear at ``path``; undecodable lines go."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def filtered(stream: DataFrame, text_col: str = "text", config: rules.RuleConfig = rules.RuleConfig()) -> DataFrame:
    """Rows of a stream that the rules keep."""
    return rules.keep(stream, text_col, config)


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x):
    """Starts a query that appends ``transform`` of each micro-batch to ``path``, rows of keys that are there already aside.

    Each micro-batch has a folder of its own that a rerun overwrites: after a failure nothing is appended twice. Runs
    until what is there has been read.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = transform(df)
        if exists(spark, path):
            done = spark.read.parquet(path).filter(F.col("batch") < number)
            new = new.join(done.select(key).distinct(), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(model: ngram.NgramModel, keys: list[str], text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A transform for :func:`append_stream`: perplexity by a frozen model."""
    return lambda df: ngram.perplexity(model, df, keys, text_col)
