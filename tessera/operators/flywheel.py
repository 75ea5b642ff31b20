"""Feedback controller: signals to deviations, deviations to parameter changes, as joins of small tables.

Defined cases: a null raw value or baseline gives a deviation of 0 and a null delta_pct; signals without weights and
weights without signals take no part. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: signal, whether higher is better, baseline, raw value, weight
SIGNALS = [
    ("code_accuracy", True, 0.60, 0.45, 0.25),
    ("reasoning_accuracy", True, 0.55, 0.50, 0.15),
    ("qa_accuracy", True, 0.65, 0.62, 0.10),
    ("dialogue_quality", True, 0.60, 0.58, 0.10),
    ("diversity_score", True, 0.70, 0.73, 0.15),
    ("effective_ratio", True, 0.85, 0.82, 0.10),
    ("loss_volatility", False, 0.10, 0.15, 0.10),
    ("ifd_gap", True, 0.20, 0.18, 0.05),
]
#: fixed values: raw values by scenario, in the order of the signals
SCENARIOS = {
    "baseline": [0.45, 0.50, 0.62, 0.58, 0.73, 0.82, 0.15, 0.18],
    "drift": [0.60, 0.52, 0.63, 0.38, 0.42, 0.78, 0.22, 0.10],
    "hard": [0.28, 0.30, 0.64, 0.55, 0.68, 0.88, 0.08, 0.25],
    "noise": [0.52, 0.48, 0.60, 0.54, 0.65, 0.60, 0.45, 0.15],
}
#: fixed values: parameter, kind, current value, lower and upper bound, and two signals with weights
PARAMETERS = [
    ("code_ratio", "ratio", 0.20, 0.05, 0.40, "code_accuracy", 0.7, "diversity_score", 0.3),
    ("reasoning_ratio", "ratio", 0.20, 0.05, 0.40, "reasoning_accuracy", 0.7, "diversity_score", 0.3),
    ("temperature_creative", "threshold", 0.80, 0.40, 1.20, "diversity_score", 0.6, "effective_ratio", 0.4),
    ("ei_max_evolve", "count", 150.0, 50.0, 300.0, "ifd_gap", 0.5, "effective_ratio", 0.5),
    ("deep_reasoning_ratio", "ratio", 0.25, 0.05, 0.50, "reasoning_accuracy", 0.6, "code_accuracy", 0.4),
    ("multi_turn_ratio", "ratio", 0.25, 0.05, 0.50, "dialogue_quality", 0.8, "diversity_score", 0.2),
    ("seed_max_ppl", "threshold", 15.0, 5.0, 30.0, "effective_ratio", 0.6, "loss_volatility", 0.4),
    ("max_seeds", "count", 80.0, 20.0, 200.0, "diversity_score", 0.5, "effective_ratio", 0.5),
    ("postfilter_jaccard_threshold", "threshold", 0.70, 0.40, 0.90, "diversity_score", 0.7, "effective_ratio", 0.3),
    ("postfilter_consistency_threshold", "threshold", 0.70, 0.40, 0.90, "effective_ratio", 0.5, "loss_volatility", 0.5),
    ("min_text_length", "count", 10.0, 5.0, 50.0, "effective_ratio", 0.7, "loss_volatility", 0.3),
    ("dedup.jaccard_threshold", "threshold", 0.60, 0.30, 0.90, "diversity_score", 0.6, "effective_ratio", 0.4),
    ("ngram_ppl.ppl_threshold", "threshold", 30.0, 10.0, 60.0, "loss_volatility", 0.6, "effective_ratio", 0.4),
]


@dataclass(frozen=True)
class FeedbackConfig:
    trigger: float = 0.05
    max_change: float = 0.30
    min_change: float = 0.02


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNALS, "signal string, higher_better boolean, baseline double, raw_value double, weight double")


def scenario_signals(spark: SparkSession) -> DataFrame:
    """scenario, signal and raw value of all mock scenarios, with the signals' definitions."""
    raw = [(s, n[0], v) for s, values in SCENARIOS.items() for n, v in zip(SIGNALS, values, strict=True)]
    return spark.createDataFrame(raw, "scenario string, signal string, raw_value double").join(F.broadcast(signals(spark).drop("raw_value")), "signal")


def with_real(table: DataFrame, real: DataFrame) -> DataFrame:
    """Raw values replaced by those of ``real`` (signal, raw_value) where it has one."""
    r = real.select("signal", F.col("raw_value").alias("_real"))
    return table.join(r, "signal", "left").withColumn("raw_value", F.coalesce("_real", "raw_value")).drop("_real")


def real_signals(scored: DataFrame, n_cleaned: int) -> DataFrame:
    """ifd_gap and effective_ratio measured on scored rows (source, ifd_score) against the cleaned rows' number."""
    mean = lambda s: F.avg(F.when((F.col("source") == s) & (F.abs("ifd_score") < float("inf")), F.col("ifd_score")))
    agg = scored.agg(F.round(mean("evol_instruct") - mean("self_instruct"), 4).alias("ifd_gap"), F.round(F.least(F.count(F.lit(1)) / F.lit(max(n_cleaned, 1)) / 0.5, F.lit(1.0)), 4).alias("effective_ratio"))
    return agg.selectExpr("stack(2, 'ifd_gap', ifd_gap, 'effective_ratio', effective_ratio) AS (signal, raw_value)").filter("raw_value IS NOT NULL")


def normalize(table: DataFrame) -> DataFrame:
    """deviation from the baseline, 0 to 1 towards worse (4 places), and delta_pct; a baseline of 0 gives 0 and null."""
    b, r = F.col("baseline"), F.col("raw_value")
    d = F.when(F.col("higher_better"), b - r).otherwise(r - b) / F.nullif(b, F.lit(0.0))
    return table.withColumn("deviation", F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)), F.lit(0.0)), 4)).withColumn("delta_pct", F.round((r - b) / F.nullif(b, F.lit(0.0)) * 100, 1))


def weights(spark: SparkSession) -> DataFrame:
    rows = [(p[0], k, p[5 + 2 * k], p[6 + 2 * k]) for p in PARAMETERS for k in (0, 1)]
    return spark.createDataFrame(rows, "param string, declared int, signal string, w double")


def parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([p[:5] for p in PARAMETERS], "param string, kind string, cur double, lo double, hi double")


def decide(normalized: DataFrame, weight_table: DataFrame, keys: list[str] = (), config: FeedbackConfig = FeedbackConfig()) -> DataFrame:
    """param, magnitude, adjustment, dominant signal and action; ties of weights go to the first declared."""
    keys = list(keys)
    d = F.col("deviation")
    got = normalized.join(F.broadcast(weight_table), "signal").groupBy(*keys, "param").agg(
        (F.sum(d * F.col("w")) / F.sum("w")).alias("magnitude"),
        F.max_by("signal", F.struct("w", -F.col("declared"))).alias("dominant"),
        F.max_by("higher_better", F.struct("w", -F.col("declared"))).alias("_up"),
    )
    dev = normalized.filter("signal = 'diversity_score'").groupBy(*keys).agg(F.max("deviation").alias("_div"))
    got = got.join(dev, keys, "left") if keys else got.crossJoin(dev)
    collapsed = F.coalesce(F.col("_div") > 0.1, F.lit(False))
    sign = F.when(F.col("_up"), 1).otherwise(-1)
    sign = F.when(collapsed & (F.col("param") == "dedup.jaccard_threshold"), -1).when(collapsed & (F.col("param") == "temperature_creative"), 1).otherwise(sign)
    hold = F.col("magnitude") < config.trigger
    return got.select(
        *keys, "param", F.round("magnitude", 4).alias("magnitude"), "dominant", F.when(hold, 0.0).otherwise(sign * F.col("magnitude")).alias("adjustment"),
        F.when(hold, "hold").when(sign > 0, "increase").otherwise("decrease").alias("action"),
    )


def adjust(decisions: DataFrame, schema: DataFrame, config: FeedbackConfig = FeedbackConfig()) -> DataFrame:
    """New values within bounds: ratios and counts move by their range, thresholds by their own value."""
    adj = F.greatest(F.lit(-config.max_change), F.least(F.lit(config.max_change), F.col("adjustment")))
    x = decisions.join(F.broadcast(schema), "param").withColumn("_a", adj)
    step = F.col("_a") * (F.col("hi") - F.col("lo")) * 0.5
    toward_zero = F.when(step < 0, F.ceil(F.round(step, 9))).otherwise(F.floor(F.round(step, 9)))
    new = F.when(F.col("kind") == "ratio", F.col("cur") + step).when(F.col("kind") == "count", F.col("cur") + toward_zero).otherwise(F.col("cur") * (1 + F.col("_a") * 0.5))
    new = F.when(F.abs("adjustment") < config.min_change, F.col("cur")).otherwise(F.greatest("lo", F.least("hi", new)))
    return x.withColumn("new", F.round(new, 4)).withColumn("change_pct", F.round((F.col("new") - F.col("cur")) / F.nullif("cur", F.lit(0.0)) * 100, 1)).drop("_a")


def ranked(normalized: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` signals of the largest deviation; ties in the declared order, then by name."""
    place = F.array_position(F.array(*(F.lit(x[0]) for x in SIGNALS)), F.col("signal"))
    return normalized.orderBy(F.desc("deviation"), F.when(place > 0, place).otherwise(len(SIGNALS) + 1), "signal").limit(n)


def action_counts(decisions: DataFrame, keys: list[str] = ()) -> DataFrame:
    return decisions.groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("n"))
