"""Curriculum: difficulty clean-up, quantile bands and annealed sampling weights.

Defined cases: ``preprocess`` takes null, infinite and NaN difficulties out or fills them; the other operators take its
result. Where a difficulty is invalid all the same, its band is null, and it has no weight (null) and no part in the
others' weights. Ties of difficulty go to the same band. Repeated rows are each returned. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import cumulative, percentiles


def _finite(c: str):
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))


def preprocess(df: DataFrame, strategy: str = "drop", max_ppl: float = 5.0, fallback: float = 0.6) -> DataFrame:
    """Rows of a perplexity over ``max_ppl`` go (null stays); invalid difficulties go or become the median or mean of all rows."""
    good = _finite("ifd_score")
    keep = df.filter(F.col("ppl").isNull() | (F.col("ppl") <= max_ppl))
    if strategy == "drop":
        return keep.filter(good.isNotNull())
    value = percentiles(df, good, {"_value": 0.5}) if strategy == "median" else df.agg(F.avg(good).alias("_value"))
    fill = value.agg(F.coalesce(F.round(F.max("_value"), 4), F.lit(fallback)).alias("_fill"))
    return keep.crossJoin(F.broadcast(fill)).withColumn("ifd_score", F.coalesce(good, F.col("_fill"))).drop("_fill")  # one row


def bands(df: DataFrame, id_col: str, n: int = 3, bounds: list[float] | None = None, seed: int = 42) -> DataFrame:
    """curriculum_band (from 1) by quantile bounds (three places) and shuffle_key, the order within a band."""
    if bounds:
        q = df.sparkSession.createDataFrame([(sorted(bounds),)], "_b array<double>")
    else:
        q = percentiles(df, _finite("ifd_score"), {f"q{i}": i / n for i in range(1, n)}).select(F.array(*(F.round(f"q{i}", 3) for i in range(1, n))).alias("_b"))
    out = df.crossJoin(F.broadcast(q))  # one row
    return out.withColumn("curriculum_band", F.when(_finite("ifd_score").isNotNull(), 1 + F.size(F.filter("_b", lambda b: F.col("ifd_score") >= b))).cast("int")).withColumn("shuffle_key", T.md5_order(seed, F.col(id_col))).drop("_b")


def band_stats(banded: DataFrame, type_col: str = "task_type", top: int = 3) -> DataFrame:
    types = banded.groupBy("curriculum_band", type_col).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("curriculum_band").orderBy(F.desc("n"), type_col))
    best = types.withColumn("r", rank).filter(F.col("r") <= top).groupBy("curriculum_band").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", type_col))), lambda x: x[type_col]).alias("top_types"))
    return banded.groupBy("curriculum_band").agg(F.count(F.lit(1)).alias("n"), F.min("ifd_score").alias("ifd_min"), F.max("ifd_score").alias("ifd_max")).join(best, "curriculum_band")


def beta_weights(df: DataFrame, start: float = 1.0, end: float = 0.1, steps: int = 5, temperature: float = 0.5) -> DataFrame:
    """A row per input row and step with weight: the softmax of -ifd / median * beta / temperature.

    The largest exponent and the sum come from aggregates joined as one row per step.
    """
    med = percentiles(df, _finite("ifd_score"), {"_m": 0.5})
    beta = F.lit(start) + F.col("beta_step") * F.lit((end - start) / max(1, steps - 1))
    x = df.crossJoin(F.broadcast(med)).withColumn("beta_step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("beta", beta).withColumn("_e", -_finite("ifd_score") / F.col("_m") * F.col("beta") / temperature)
    top = x.groupBy("beta_step").agg(F.max("_e").alias("_t"))
    y = x.join(F.broadcast(top), "beta_step").withColumn("_x", F.exp(F.col("_e") - F.col("_t")))
    total = y.groupBy("beta_step").agg(F.sum("_x").alias("_s"))
    return y.join(F.broadcast(total), "beta_step").withColumn("weight", F.col("_x") / F.col("_s")).drop("_m", "_e", "_t", "_x", "_s")


def step_stats(weighted: DataFrame) -> DataFrame:
    w = F.col("weight")
    return weighted.groupBy("beta_step", "beta").agg((F.max(w) / F.min(F.when(w > 1e-8, w))).alias("ratio"), F.avg((w > 0.001).cast("double")).alias("active"), (-F.sum(w * F.ln(w + 1e-12))).alias("entropy"))


def final_weights(df: DataFrame, end: float = 0.1) -> DataFrame:
    return beta_weights(df, end, end, 1).withColumn("sampling_weight", F.round("weight", 6)).drop("weight", "beta", "beta_step")


def extremes(df: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    return df.orderBy("ifd_score", id_col).limit(n).unionByName(df.orderBy(F.desc("ifd_score"), id_col).limit(n))


def ifd(cond, uncond):
    """Conditional over unconditional loss, four places; infinite where a loss is missing or the second is about 0."""
    return F.coalesce(F.when(uncond > 1e-8, F.round(cond / uncond, 4)), F.lit(float("inf")))


def weighted_sample(weighted: DataFrame, n: int, id_col: str, weight_col: str = "weight", step_col: str = "beta_step", seed: int = 42) -> DataFrame:
    """(step, draw, id, sampling_weight): ``n`` draws with replacement for each step, in proportion to the weights.

    Draw number d of a step is at a uniform place fixed by the seed, and takes the row whose cumulative weight (in the
    order of ids) first exceeds it. Rows and draws are cut into the same ``cells`` of the unit interval and joined by
    cell, so nothing is compared with everything; a row that spans several cells is in each of them.
    """
    cells = max(1, n // 64)
    rows = weighted.filter(F.col(weight_col) > 0).groupBy(F.col(step_col).alias("step"), F.col(id_col).alias("id")).agg(F.sum(weight_col).alias("w"))
    at = cumulative(rows, "w", ["id"], ["step"], "weights").select("step", "id", F.round("w", 6).alias("sampling_weight"), ((F.col("_upto") - F.col("w")) / F.col("_all")).alias("lo"), (F.col("_upto") / F.col("_all")).alias("hi"))
    last = at.groupBy("step").agg(F.max("hi").alias("top"))
    at = at.join(last, "step").withColumn("hi", F.when(F.col("hi") == F.col("top"), 1.0).otherwise(F.col("hi")))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    spans = at.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    u = F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("step").cast("string"), F.col("draw").cast("string"))), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(16**13)
    draws = last.select("step").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", u).withColumn("cell", cell(F.col("u")))
    got = draws.join(spans, ["step", "cell"]).filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return got.groupBy("step", "draw").agg(F.min("id").alias("id"), F.min_by("sampling_weight", "id").alias("sampling_weight"))


def profile(df: DataFrame, max_ppl: float = 5.0) -> DataFrame:
    """One row: minimum, quartiles and maximum of the valid difficulties, range of perplexities, and counts."""
    good = _finite("ifd_score")
    quart = percentiles(df, good, {"ifd_p25": 0.25, "ifd_p50": 0.5, "ifd_p75": 0.75})
    figures = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(good).alias("n_valid"), F.min(good).alias("ifd_min"), F.max(good).alias("ifd_max"),
        F.min(_finite("ppl")).alias("ppl_min"), F.max(_finite("ppl")).alias("ppl_max"), F.count_if(F.col("ppl") > max_ppl).alias("n_high_ppl"),
    )
    return figures.crossJoin(F.broadcast(quart))  # one row each


def orderings(banded: DataFrame, weighted: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """(arm, position, id): the rows of three training runs in order. baseline: the banded rows shuffled; band: by band and
    the order within it; beta: the weighted rows by sampling_weight, highest first (missing: 0), then id."""
    key = F.col(id_col).alias("id")
    none = F.lit(0.0)
    arms = banded.select(F.lit("baseline").alias("arm"), key, none.alias("a"), T.md5_order(seed, F.col(id_col)).alias("b"))
    arms = arms.unionByName(banded.select(F.lit("band").alias("arm"), key, F.col("curriculum_band").cast("double").alias("a"), F.col("shuffle_key").alias("b")))
    arms = arms.unionByName(weighted.select(F.lit("beta").alias("arm"), key, (-F.coalesce("sampling_weight", none)).alias("a"), F.lit("").alias("b")))
    rows = arms.groupBy("arm", "a", "b", "id").agg(F.count(F.lit(1)).alias("copies"))
    at = cumulative(rows, "copies", ["a", "b", "id"], ["arm"], "orders")
    each = at.withColumn("position", F.explode(F.sequence(F.col("_upto") - F.col("copies"), F.col("_upto") - 1)))
    return each.select("arm", F.col("position").cast("long").alias("position"), "id")
