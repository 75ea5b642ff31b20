"""JSON Lines in and out, results, the run log, and batch resume.

Defined cases: a missing path reads as an empty table, blank and undecodable lines go. Rows that repeat a key in one
append are all appended. Appends of an empty table add nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .written import written


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the lines that are JSON; blank and undecodable lines go, a missing path is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not yet at ``path`` (Parquet) and returns how many: a rerun adds nothing twice.

    What is new is worked out once and written before it is appended, so that the count is that of the rows appended.
    """
    spark = df.sparkSession
    new = written(df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if exists(spark, path) else df, "append")
    n = new.count()
    if n:
        new.select(*df.columns).write.mode("append").parquet(path)
    return n


def write_result(spark: SparkSession, path: str, result: dict) -> None:
    """A small result as one line of JSON at ``path``, in any store that Spark writes."""
    spark.createDataFrame([(json.dumps(result, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_result(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def benchmark_table(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    """(label, text) of stated texts by quality label, for calibration."""
    return spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "label string, text string")


def log_run(spark: SparkSession, path: str, experiment: str, seconds: float, inputs: dict, outputs: dict, metrics: dict, notes: str = "") -> None:
    text = lambda d: {str(k): str(v) for k, v in d.items()}
    row = [(experiment, float(seconds), text(inputs), text(outputs), text(metrics), notes)]
    ddl = "experiment string, duration_sec double, inputs map<string,string>, outputs map<string,string>, metrics map<string,string>, notes string"
    spark.createDataFrame(row, ddl).withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def list_runs(spark: SparkSession, path: str, experiment: str | None = None, limit: int = 10) -> DataFrame:
    runs = spark.read.parquet(path)
    return (runs.filter(F.col("experiment") == experiment) if experiment else runs).orderBy(F.desc("timestamp")).limit(limit)
