"""Summaries of training runs: losses by run, the run that did best, and losses weighted by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order in which a comparison lists runs; others follow by name.
RUN_ORDER = ("baseline", "band", "beta")


def run_summary(log: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """(run, n_steps, first_loss, last_loss, min_loss) by run. Rows with a null loss or step are left out; of rows with one step the smallest loss counts."""
    each = log.filter(F.col(loss).isNotNull() & F.col(step).isNotNull())
    at = F.struct(F.col(step), F.col(loss))
    last = F.struct(F.col(step), -F.col(loss))
    return each.groupBy(F.col(run).alias("run")).agg(
        F.count_distinct(step).alias("n_steps"), F.min_by(loss, at).alias("first_loss"), F.max_by(loss, last).alias("last_loss"), F.min(loss).alias("min_loss")
    )


def compare_runs(summary: DataFrame) -> DataFrame:
    """The summary with position (the fixed order, then names) and best (the smallest min_loss; ties to the first position). One row a run, so the window is small."""
    known = F.array_position(F.array(*map(F.lit, RUN_ORDER)), F.col("run"))
    order = F.when(known > 0, known).otherwise(len(RUN_ORDER) + 1)
    placed = summary.withColumn("position", F.row_number().over(Window.orderBy(order, "run")))
    return placed.withColumn("best", F.row_number().over(Window.orderBy(F.col("min_loss").asc_nulls_last(), "position")) == 1)


def token_weighted_loss(items: DataFrame, keys: list[str], loss: str = "loss", tokens: str = "n_tokens") -> DataFrame:
    """(keys, tokens, weighted_loss, mean_loss): sum of loss times tokens over tokens, null where a group has no tokens; rows with a null are left out."""
    each = items.filter(F.col(loss).isNotNull() & F.col(tokens).isNotNull())
    n = F.sum(F.col(tokens).cast("long"))
    return each.groupBy(*keys).agg(n.alias("tokens"), F.try_divide(F.sum(F.col(loss) * F.col(tokens)), n).alias("weighted_loss"), F.avg(loss).alias("mean_loss"))
