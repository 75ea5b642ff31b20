"""Queries of curricula, the feedback controller and training reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison, curriculum, flywheel, instructions
from .shared import PAIRS, difficulty, docs, table


def _raw(spark, sf_dir):
    """Documents with a difficulty that is invalid for some, and a perplexity."""
    n = F.col("n_chars")
    bad = F.when(n % 11 == 0, F.lit(None).cast("double")).when(n % 13 == 0, F.lit(float("inf"))).when(n % 17 == 0, F.lit(float("nan"))).otherwise(n % 997 / 500.0)
    return docs(spark, sf_dir).select("doc_id", "source", bad.alias("ifd_score"), F.when(F.col("doc_id") % 6 != 0, (F.col("doc_id") % 8).cast("double")).alias("ppl"))


def _plain(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.col("source").alias("task_type"), difficulty())


def preprocess_drop(spark, sf_dir):
    return curriculum.preprocess(_raw(spark, sf_dir)).select("doc_id", F.round("ifd_score", 4).alias("ifd_score"))


def preprocess_median(spark, sf_dir):
    return curriculum.preprocess(_raw(spark, sf_dir), "median").select("doc_id", F.round("ifd_score", 4).alias("ifd_score"))


def preprocess_mean(spark, sf_dir):
    return curriculum.preprocess(_raw(spark, sf_dir), "mean").select("doc_id", F.round("ifd_score", 4).alias("ifd_score"))


def curriculum_bands(spark, sf_dir):
    return curriculum.bands(_plain(spark, sf_dir), "doc_id").select("doc_id", "curriculum_band")


def band_order(spark, sf_dir):
    return curriculum.bands(_plain(spark, sf_dir), "doc_id").select("doc_id", "curriculum_band", "shuffle_key")


def band_stats(spark, sf_dir):
    s = curriculum.band_stats(curriculum.bands(_plain(spark, sf_dir), "doc_id"))
    return s.select("curriculum_band", "n", "ifd_min", "ifd_max", F.array_join("top_types", ",").alias("top_types"))


def beta_weights(spark, sf_dir):
    w = curriculum.beta_weights(_plain(spark, sf_dir))
    return w.groupBy("beta_step").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("beta"), 3).alias("beta"), F.round(-F.sum(F.col("weight") * F.ln(F.col("weight") + 1e-12)), 4).alias("entropy"))


def beta_step_stats(spark, sf_dir):
    s = curriculum.step_stats(curriculum.beta_weights(_plain(spark, sf_dir)))
    return s.select("beta_step", F.round("beta", 3).alias("beta"), F.round("ratio", 3).alias("ratio"), F.round("active", 4).alias("active"), F.round("entropy", 4).alias("entropy"))


def final_weights(spark, sf_dir):
    return curriculum.final_weights(_plain(spark, sf_dir)).select("doc_id", "sampling_weight")


def weighted_draws(spark, sf_dir):
    """1000 draws with replacement at each step's weights: the number of draws is the sampling operator's feature."""
    return curriculum.weighted_sample(curriculum.beta_weights(_plain(spark, sf_dir)), 1000, "doc_id").select("step", "draw", F.col("id").alias("doc_id"), "sampling_weight")


def ifd_extremes(spark, sf_dir):
    """The three easiest and hardest documents: a top-k report."""
    return curriculum.extremes(_plain(spark, sf_dir), "doc_id").select("doc_id", F.round("ifd_score", 4).alias("ifd_score"))


def curriculum_profile(spark, sf_dir):
    p = curriculum.profile(_raw(spark, sf_dir))
    return p.select("n", "n_valid", "n_high_ppl", *(F.round(c, 4).alias(c) for c in ("ifd_min", "ifd_p25", "ifd_p50", "ifd_p75", "ifd_max", "ppl_min", "ppl_max")))


def training_orders(spark, sf_dir):
    b = curriculum.bands(_plain(spark, sf_dir), "doc_id")
    return curriculum.orderings(b, curriculum.final_weights(_plain(spark, sf_dir)), "doc_id").select("arm", "position", F.col("id").alias("doc_id"))


def feedback_signals(spark, sf_dir):
    return flywheel.normalize(flywheel.scenario_signals(spark)).select("scenario", "signal", "deviation", "delta_pct")


def _decisions(spark):
    return flywheel.decide(flywheel.normalize(flywheel.scenario_signals(spark)), flywheel.weights(spark), ["scenario"])


def feedback_decisions(spark, sf_dir):
    return _decisions(spark).select("scenario", "param", "magnitude", "dominant", "action", F.round("adjustment", 4).alias("adjustment"))


def feedback_adjustments(spark, sf_dir):
    return flywheel.adjust(_decisions(spark), flywheel.parameters(spark)).select("scenario", "param", "action", "new")


def feedback_actions(spark, sf_dir):
    return flywheel.action_counts(_decisions(spark), ["scenario"])


def feedback_ranked(spark, sf_dir):
    """The five signals of the drift scenario that deviate most: a top-k report."""
    s = flywheel.normalize(flywheel.scenario_signals(spark).filter("scenario = 'drift'"))
    return flywheel.ranked(s).select("signal", "deviation")


def real_signals(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.when(F.col("doc_id") % 4 == 0, "evol_instruct").otherwise("self_instruct").alias("source"), difficulty())
    return flywheel.real_signals(d, 1_000_000)


def controlled_by_real(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.when(F.col("doc_id") % 4 == 0, "evol_instruct").otherwise("self_instruct").alias("source"), difficulty())
    t = flywheel.with_real(flywheel.signals(spark), flywheel.real_signals(d, 1_000_000))
    return flywheel.normalize(t).select("signal", "deviation")


def sampled(spark, sf_dir):
    """50 rows without replacement."""
    return comparison.sample_rows(docs(spark, sf_dir), 50, "doc_id").select("doc_id")


def triplet_losses(spark, sf_dir):
    n = F.col("n_chars")
    x = instructions.triplet_loss(n % 7 / 3.0, n % 5 / 3.0, F.when(n % 2 == 0, n % 3 / 3.0), 1.0, 0.5)
    return docs(spark, sf_dir).select("doc_id", F.round(x, 6).alias("loss"))


def loss_delta(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", (F.col("n_chars") % 997 / 500.0).alias("loss"))
    x = comparison.delta(d.filter("lang = 'en'"), d.filter("lang <> 'en'"))
    return x.select(*(F.round(c, 4).alias(c) for c in x.columns))


def sft_format(spark, sf_dir):
    s = instructions.to_sft(instructions.pairs(table(spark, sf_dir, "conversations")), ["conv_id", "turn"])
    return s.select("conv_id", "turn", F.explode("conversations").alias("m")).select("conv_id", "turn", "m.role", "m.content")


QUERIES = [preprocess_drop, preprocess_median, preprocess_mean, curriculum_bands, band_order, band_stats, beta_weights, beta_step_stats, final_weights, weighted_draws, ifd_extremes, curriculum_profile, training_orders, feedback_signals, feedback_decisions, feedback_adjustments, feedback_actions, feedback_ranked, real_signals, controlled_by_real, sampled, triplet_losses, loss_delta, sft_format]

_X = "n_chars % 997 / 500.0::DOUBLE"
_RAW = f"raw AS (SELECT doc_id, source, CASE WHEN n_chars % 11 = 0 OR n_chars % 13 = 0 OR n_chars % 17 = 0 THEN NULL ELSE {_X} END AS x, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 8)::DOUBLE END AS ppl FROM documents)"
_BANDED = f"d AS (SELECT doc_id, source AS task_type, {_X} AS x, md5('42:' || doc_id) AS shuffle_key FROM documents), q AS (SELECT round(quantile_cont(x, 1 / 3::DOUBLE), 3) AS a, round(quantile_cont(x, 2 / 3::DOUBLE), 3) AS b FROM d), banded AS (SELECT doc_id, task_type, x, shuffle_key, (1 + (x >= a)::INT + (x >= b)::INT)::INT AS curriculum_band FROM d, q)"
_WEIGHTS = f"d0 AS (SELECT doc_id, {_X} AS x FROM documents), s AS (SELECT s::INT AS beta_step, 1 + s * (0.1 - 1)::DOUBLE / 4 AS beta FROM range(5) r(s)), e AS (SELECT doc_id, beta_step, beta, -x / (SELECT median(x) FROM d0) * beta / 0.5::DOUBLE AS e FROM d0, s), z AS (SELECT *, exp(e - max(e) OVER (PARTITION BY beta_step)) AS z FROM e), w AS (SELECT doc_id, beta_step, beta, z / sum(z) OVER (PARTITION BY beta_step) AS weight FROM z)"
_SIGNALS = "sig AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{n[0]}', {k}, {n[1]}, {n[2]}::DOUBLE, {v}::DOUBLE)" for s, vs in flywheel.SCENARIOS.items() for k, (n, v) in enumerate(zip(flywheel.SIGNALS, vs, strict=True))) + ") t(scenario, signal, place, up, b, r)), dev AS (SELECT *, round(greatest(0, least(1, CASE WHEN up THEN b - r ELSE r - b END / b)), 4) AS deviation FROM sig)"
_PARAMS = "par AS (SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', '{p[1]}', {p[2]}::DOUBLE, {p[3]}::DOUBLE, {p[4]}::DOUBLE, '{p[5 + 2 * k]}', {p[6 + 2 * k]}::DOUBLE, {k})" for p in flywheel.PARAMETERS for k in (0, 1)) + ") t(param, kind, cur, lo, hi, signal, w, declared))"
_DECIDE = f"""{_SIGNALS}, {_PARAMS}, m AS (SELECT scenario, param, sum(deviation * w) / sum(w) AS m, arg_max(signal, w * 10 - declared) AS dominant, arg_max(up, w * 10 - declared) AS up FROM dev JOIN par USING (signal) GROUP BY scenario, param),
dv AS (SELECT scenario, deviation > 0.1 AS low FROM dev WHERE signal = 'diversity_score'),
dec AS (SELECT scenario, param, m, dominant, CASE WHEN low AND param = 'dedup.jaccard_threshold' THEN -1 WHEN low AND param = 'temperature_creative' THEN 1 WHEN up THEN 1 ELSE -1 END AS sign FROM m JOIN dv USING (scenario)),
act AS (SELECT *, CASE WHEN m < 0.05 THEN 0 ELSE sign * m END AS adj, CASE WHEN m < 0.05 THEN 'hold' WHEN sign > 0 THEN 'increase' ELSE 'decrease' END AS action FROM dec)"""
_REAL = f"real AS (SELECT round(avg({_X}) FILTER (doc_id % 4 = 0) - avg({_X}) FILTER (doc_id % 4 <> 0), 4) AS gap, round(least(count(*) / 1000000 / 0.5::DOUBLE, 1), 4) AS eff FROM documents)"

SQL = {
    "preprocess_drop": f"WITH {_RAW} SELECT doc_id, round(x, 4) AS ifd_score FROM raw WHERE x IS NOT NULL AND (ppl IS NULL OR ppl <= 5)",
    "preprocess_median": f"WITH {_RAW} SELECT doc_id, round(coalesce(x, (SELECT round(median(x), 4) FROM raw)), 4) AS ifd_score FROM raw WHERE ppl IS NULL OR ppl <= 5",
    "preprocess_mean": f"WITH {_RAW} SELECT doc_id, round(coalesce(x, (SELECT round(avg(x), 4) FROM raw)), 4) AS ifd_score FROM raw WHERE ppl IS NULL OR ppl <= 5",
    "curriculum_bands": f"WITH {_BANDED} SELECT doc_id, curriculum_band FROM banded",
    "band_order": f"WITH {_BANDED} SELECT doc_id, curriculum_band, shuffle_key FROM banded",
    "band_stats": f"WITH {_BANDED}, t AS (SELECT curriculum_band, task_type, row_number() OVER (PARTITION BY curriculum_band ORDER BY count(*) DESC, task_type) AS r FROM banded GROUP BY 1, 2), b AS (SELECT curriculum_band, string_agg(task_type, ',' ORDER BY r) AS top_types FROM t WHERE r <= 3 GROUP BY 1) SELECT curriculum_band, count(*) AS n, min(x) AS ifd_min, max(x) AS ifd_max, any_value(top_types) AS top_types FROM banded JOIN b USING (curriculum_band) GROUP BY 1",
    "beta_weights": f"WITH {_WEIGHTS} SELECT beta_step, count(*) AS n, round(max(beta), 3) AS beta, round(-sum(weight * ln(weight + 1e-12)), 4) AS entropy FROM w GROUP BY 1",
    "beta_step_stats": f"WITH {_WEIGHTS} SELECT beta_step, round(max(beta), 3) AS beta, round(max(weight) / min(weight) FILTER (weight > 1e-8), 3) AS ratio, round(avg((weight > 0.001)::INT), 4) AS active, round(-sum(weight * ln(weight + 1e-12)), 4) AS entropy FROM w GROUP BY 1",
    "final_weights": f"WITH {_WEIGHTS} SELECT doc_id, round(weight, 6) AS sampling_weight FROM w WHERE beta_step = 4",
    "weighted_draws": f"WITH {_WEIGHTS}, c AS (SELECT beta_step AS step, doc_id, weight, sum(weight) OVER (PARTITION BY beta_step ORDER BY doc_id) AS hi FROM w), u AS (SELECT s::INT AS step, d::INT AS draw, ('0x' || substr(md5('42:' || s || ':' || d), 1, 13))::BIGINT / 16::DOUBLE ** 13 AS u FROM range(5) a(s), range(1000) b(d)) SELECT step, draw, doc_id, round(weight, 6) AS sampling_weight FROM u JOIN c USING (step) WHERE u < hi AND u >= hi - weight",
    "ifd_extremes": f"WITH d AS (SELECT doc_id, {_X} AS x FROM documents) SELECT doc_id, round(x, 4) AS ifd_score FROM (SELECT * FROM d ORDER BY x, doc_id LIMIT 3) UNION ALL SELECT doc_id, round(x, 4) FROM (SELECT * FROM d ORDER BY x DESC, doc_id LIMIT 3)",
    "curriculum_profile": f"WITH {_RAW} SELECT count(*) AS n, count(x) AS n_valid, count(*) FILTER (ppl > 5) AS n_high_ppl, round(min(x), 4) AS ifd_min, round(quantile_cont(x, 0.25), 4) AS ifd_p25, round(quantile_cont(x, 0.5), 4) AS ifd_p50, round(quantile_cont(x, 0.75), 4) AS ifd_p75, round(max(x), 4) AS ifd_max, min(ppl) AS ppl_min, max(ppl) AS ppl_max FROM raw",
    "training_orders": f"WITH {_BANDED}, {_WEIGHTS}, a AS (SELECT 'baseline' AS arm, doc_id, row_number() OVER (ORDER BY shuffle_key, doc_id) - 1 AS position FROM banded UNION ALL SELECT 'band', doc_id, row_number() OVER (ORDER BY curriculum_band, shuffle_key, doc_id) - 1 FROM banded UNION ALL SELECT 'beta', doc_id, row_number() OVER (ORDER BY round(weight, 6) DESC, doc_id) - 1 FROM w WHERE beta_step = 4) SELECT arm, position, doc_id FROM a",
    "feedback_signals": f"WITH {_SIGNALS} SELECT scenario, signal, deviation, round((r - b) / b * 100, 1) AS delta_pct FROM dev",
    "feedback_decisions": f"WITH {_DECIDE} SELECT scenario, param, round(m, 4) AS magnitude, dominant, action, round(adj, 4) AS adjustment FROM act",
    "feedback_adjustments": f"WITH {_DECIDE}, n AS (SELECT act.*, kind, cur, lo, hi, greatest(-0.3, least(0.3, adj))::DOUBLE AS a FROM act JOIN par USING (param) WHERE declared = 0) SELECT scenario, param, action, round(CASE WHEN abs(adj) < 0.02 THEN cur ELSE greatest(lo, least(hi, CASE kind WHEN 'ratio' THEN cur + a * (hi - lo) * 0.5 WHEN 'count' THEN cur + trunc(round(a * (hi - lo) * 0.5, 9)) ELSE cur * (1 + a * 0.5) END)) END, 4) AS new FROM n",
    "feedback_actions": f"WITH {_DECIDE} SELECT scenario, action, count(*) AS n FROM act GROUP BY 1, 2",
    "feedback_ranked": f"WITH {_SIGNALS} SELECT signal, deviation FROM dev WHERE scenario = 'drift' ORDER BY deviation DESC, place LIMIT 5",
    "real_signals": f"WITH {_REAL} SELECT 'ifd_gap' AS signal, gap AS raw_value FROM real UNION ALL SELECT 'effective_ratio', eff FROM real",
    "controlled_by_real": "WITH " + _REAL + ", s AS (SELECT * FROM (VALUES " + ", ".join(f"('{n[0]}', {n[1]}, {n[2]}::DOUBLE, {n[3]}::DOUBLE)" for n in flywheel.SIGNALS) + ") t(signal, up, b, r0)), x AS (SELECT signal, up, b, CASE signal WHEN 'ifd_gap' THEN gap WHEN 'effective_ratio' THEN eff ELSE r0 END AS r FROM s, real) SELECT signal, round(greatest(0, least(1, CASE WHEN up THEN b - r ELSE r - b END / b)), 4) AS deviation FROM x",
    "sampled": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "triplet_losses": "WITH d AS (SELECT doc_id, n_chars % 7 / 3.0::DOUBLE AS r, n_chars % 5 / 3.0::DOUBLE AS g, CASE WHEN n_chars % 2 = 0 THEN n_chars % 3 / 3.0::DOUBLE END AS i FROM documents) SELECT doc_id, round(ln(1 + exp(-(r - g + 0.5::DOUBLE * (g - coalesce(i, r - 0.5))))), 6) AS loss FROM d",
    "loss_delta": f"WITH x AS (SELECT avg({_X}) FILTER (lang = 'en') AS a, avg({_X}) FILTER (lang <> 'en') AS b FROM documents) SELECT round(a, 4) AS before, round(b, 4) AS after, round(b - a, 4) AS delta, round((b - a) / abs(a) * 100, 4) AS pct FROM x",
    "sft_format": f"SELECT conv_id, turn, 'user' AS role, instruction AS content FROM ({PAIRS}) UNION ALL SELECT conv_id, turn, 'assistant', output FROM ({PAIRS})",
}
