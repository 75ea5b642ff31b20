"""Ranks, cumulative sums and percentiles over whole tables, without one task that holds all rows.

Rows are first summed by value, range-partitioned by group and value and written; each partition's totals (one row
per partition and group) give the partitions' offsets; ranks are then worked out partition by partition. A group of
any size is thus many tasks, and a task keeps one partition.

Defined cases: null and NaN values have no rank. Ties share a value's row. Groups may be null. An empty table, or one
without a valid value, gives no rows for groups that have none and, without groups, one row of nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written


def cumulative(rows: DataFrame, amount: str, order: list[str], keys: list[str] = (), name: str = "ranks") -> DataFrame:
    """``rows`` (their order columns distinct in each group) with _upto, the sum of ``amount`` up to the row, and _all, the group's sum.

    Columns that begin with an underscore are this module's own.
    """
    keys = list(keys)
    dealt = rows.repartitionByRange(*keys, *order) if rows.columns else rows
    kept = written(dealt.withColumn("_part", F.spark_partition_id()), name)
    sums = kept.groupBy(*keys, "_part").agg(F.sum(amount).alias("_s"))  # a row per partition and group
    # a window over a row per partition: the offsets of the partitions, in order
    group = Window.partitionBy(*(F.struct(F.col(k)) for k in keys)) if keys else Window.partitionBy(F.lit(1))
    before = sums.withColumn("_before", F.sum("_s").over(group.orderBy("_part")) - F.col("_s")).withColumn("_all", F.sum("_s").over(group)).drop("_s")
    before = before.toDF(*(f"_k{i}" for i in range(len(keys))), "_p", "_before", "_all")
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy("_part", *(F.struct(F.col(k)) for k in keys)).orderBy(*order)
    out = kept.withColumn("_in", F.sum(amount).over(within)).join(before, on, "left")
    return out.withColumn("_upto", F.col("_in") + F.col("_before")).select(*rows.columns, "_upto", "_all")


def counted(df: DataFrame, value, keys: list[str] = ()) -> DataFrame:
    """(keys, _v, _n, _upto, _all): the valid values, their counts, and counts up to them."""
    v = value if not isinstance(value, str) else F.col(value)
    rows = df.select(*keys, v.alias("_v"))
    counts = rows.filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double"))).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return cumulative(counts, "_n", ["_v"], keys)


def order_statistics(df: DataFrame, value, at: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """For each name the value of rank floor(n * q) (from 0) in each group."""
    ranked = counted(df, value, keys)
    pick = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * q), F.col("_v")))
    return ranked.groupBy(*keys).agg(*(pick(q).alias(name) for name, q in at.items()))


def percentiles(df: DataFrame, value, at: dict[str, float], keys: list[str] = ()) -> DataFrame:
    """For each name the percentile ``q`` (0 to 1) of each group, interpolated between neighbouring ranks."""
    ranked = counted(df, value, keys)
    place = lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    at_rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v").cast("double")))
    out = []
    for name, q in at.items():
        low, high, part = at_rank(F.floor(place(q))), at_rank(F.ceil(place(q))), F.max(place(q) - F.floor(place(q)))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def row_numbers(df: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """``df`` with its place (from 0) in the order of the columns ``order``; equal rows follow each other in no fixed order."""
    dealt = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kept = written(dealt, "numbers")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.withColumn("_before", F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).select(F.col("_part").alias("_p"), "_before")  # a row per partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn("_in", within).join(before, F.col("_part") == F.col("_p")).withColumn(out, F.col("_in") + F.col("_before") - 1).drop("_part", "_p", "_in", "_before")
