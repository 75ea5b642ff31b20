"""What the operators of this subpackage share: tables, and written cuts of the lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one where it is unset and the master is local."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own_dir[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


#: Spark removes a write's shuffle files as soon as it is done, while this is set.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, and safe when executors are lost.

    The shuffle files that the write needed go with its end: later steps read the written table.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def words_text(col):
    """Text with every white-space character as a plain space, trimmed; null is empty."""
    return F.trim(F.translate(F.coalesce(col, F.lit("")), WS, " " * len(WS)))


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` has it (case aside)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def let(value, body):
    """``body(v)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers (wraps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ids_of_fold(id_col, parts: int):
    """crc32 of the id as text, modulo ``parts``; null ids are in fold -1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts, F.lit(-1))
