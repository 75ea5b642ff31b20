"""Nulls, empties, ties, repeats, empty tables and clashing columns; operators that SQL can't express against plain versions."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import comparison, curriculum, dedup, flywheel, generation, instructions, ngram, profile, ranks, rules, scoring
from tessera.sources import config, jsonl, written
from tessera.streaming import corpus


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_rules_and_profiles(spark):
    df = frame(spark, [(1, None, None, "x"), (2, "", None, "x"), (3, "第一条 本法", "zh", "x"), (3, "第一条 本法", "zh", "x")], "doc_id long, text string, lang string, reject_rule string")
    got = rules.apply_rules(df)
    assert got.columns == [*df.columns, "reject_reason"] and got.filter("reject_rule IS NULL").count() == 4
    assert {(r.lang, r.len_max, r.p50) for r in profile.length_profile(df, keys=["lang"]).collect()} == {(None, 0, 0), ("zh", 6, 6)}
    h = {r.lang: r for r in profile.health(df.withColumn("ppl", F.lit(2.0)), keys=["lang"], ppl_col="ppl").collect()}
    assert h[None]["count"] == 2 and h[None].ppl_median == 2.0 and h["zh"].len_mean == 6
    assert profile.length_profile(df.limit(0), keys=["lang"]).count() == 0 and profile.length_profile(df.limit(0)).first().len_max is None
    assert rules.rule_stats(df.limit(0)).count() == 0
    assert profile.bigram_diversity(df, first=3).first().bigrams == 5
    odd = frame(spark, [("😀😀a",), ("",), (None,)], "text string")
    from tessera.functions import text as T

    assert [r.n for r in odd.select(T.top_char_count(F.col("text")).alias("n")).collect()] == [2, 0, None]


def test_gap_of_a_table_with_itself(spark):
    df = frame(spark, [("a",), (None,), (None,)], "k string")
    assert instructions.distribution_gap(df, df, "k").first().gap == 0
    assert instructions.distribution_gap(df, df.filter("k = 'a'"), "k").first().gap == pytest.approx(1.333, abs=1e-3)


def test_ranks(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float("nan"), r.uniform(0, 5), 2.0])) for _ in range(500)]
    df = frame(spark, rows, "k string, v double").repartition(7)
    for key in ("a", "b", None):
        v = sorted(x for k, x in rows if k == key and x is not None and x == x)
        got = {x.k: x for x in ranks.percentiles(df, "v", {"p": 0.3, "q": 0.95}, ["k"]).collect()}[key]
        assert (got.p, got.q) == pytest.approx((np.percentile(v, 30), np.percentile(v, 95)))
        got = {x.k: x for x in ranks.order_statistics(df, "v", {"m": 0.5}, ["k"]).collect()}[key]
        assert got.m == v[len(v) // 2]
    assert ranks.percentiles(df.limit(0), "v", {"p": 0.5}).first().p is None
    n = ranks.row_numbers(spark.range(1000).repartition(5), ["id"], "at").collect()
    assert sorted((x.id, x.at) for x in n) == [(i, i) for i in range(1000)]


def test_perplexity_of_repeated_and_null_ids(spark):
    df = frame(spark, [(1, "abab", 9), (1, "abab", 9), (1, "xyxyx", 9), (None, "abab", 9), (2, None, 9), (2, "a", 9), (2, "a", 9)], "doc_id int, text string, ppl int")
    m = ngram.train(df)
    got = ngram.perplexity(m, df, ["doc_id"])
    assert got.columns == ["doc_id", "text", "ppl"] and got.count() == 7
    by = {}
    for x in got.collect():
        by.setdefault(x.text, set()).add(round(x.ppl, 9))
    assert len(by["abab"]) == 1 and by[None] == by["a"] == {math.inf}
    assert ngram.text_perplexity(m, "abab") == pytest.approx(by["abab"].pop())
    assert ngram.perplexity(m, df.limit(0), ["doc_id"]).count() == 0
    s = ngram.filter_by_ppl(got, 30.0)
    assert ngram.ppl_stats(s).first().rejected == 3 and ngram.hard_filter(s).count() == 4
    words = df.select(ngram.word_tokens(str.split)(F.col("text")).alias("w")).collect()
    assert words[0].w == ["abab"] and words[4].w == []


def test_saved_model(spark, tmp_path):
    m = ngram.train(frame(spark, [("abcabc",)], "text string"))
    m.save(str(tmp_path / "m"))
    n = ngram.NgramModel.load(spark, str(tmp_path / "m"))
    assert (n.n, n.tokens, n.vocabulary) == (3, 6, 3) and ngram.text_perplexity(n, "abc") == pytest.approx(ngram.text_perplexity(m, "abc"))


def scan(neighbours, order):
    led, done = {}, set()
    for i in order:
        if i not in done and neighbours[i]:
            for j in {i} | {x for x in neighbours[i] if x not in done}:
                led[j] = i
                done.add(j)
    return led


def test_bucket_leaders_are_those_of_a_scan(spark):
    for seed in range(4):
        r = random.Random(seed)
        members = {(b, str(r.randrange(6)), i) for b in range(3) for i in r.sample(range(40), 22)}
        near = {i: {k for b, key, k in members for c, other, j in members if j == i and (b, key) == (c, other) and k != i} for i in range(40)}
        got = dedup.leader_groups(frame(spark, [(i, b, k) for b, k, i in members], "id int, band int, key string")).collect()
        assert {x.id: x.leader for x in got} == scan(near, range(40))


def test_dedup_of_texts(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
    texts = base + [b[:140] + "#" + b[141:] for b in base] + [base[0], "ab", "", None, "zz", "zz"]
    rows = [(i, t, "keep me", 1) for i, t in enumerate(texts)] + [(None, base[1], "n", 1), (3, "another text with the same id", "n", 1)]
    df = frame(spark, rows, "doc_id int, text string, id string, dedup_pass int")
    for verify in (True, False):
        g = dedup.groups(df, config=dedup.DedupConfig(verify=verify))
        led = {(x.id, x.leader_id) for x in g.collect()}
        assert led == {(i, i % 4) for i in range(8)} | {(8, 0)}
    kept = dedup.keep_best(df, g).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == [0, 1, 2, 3, 3, 9, 10, 11, 12, 13] and sum(x.doc_id is None for x in kept) == 1
    assert dedup.keep_best(df.limit(0), dedup.groups(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        dedup.DedupConfig(weights=(0.6, 0.6))


def test_recent_duplicates_are_those_of_a_scan(spark):
    r = random.Random(9)
    words = ["".join(r.sample("abcdefghijkl", r.randint(2, 7))) for _ in range(30)]
    rows = [(i, r.choice([*words, None, ""])) for i in range(700)]
    kept, want = [], {}
    for i, t in rows:
        s = set(t or "")
        want[i] = any(s and len(s & k) >= 0.7 * len(s | k) for k in kept[-20:])
        if not want[i]:
            kept.append(s)
    df = frame(spark, rows, "seq int, instruction string").repartition(4)
    for chunk in (1000, 50, 7):
        got = {x.seq: x.recent_duplicate for x in comparison.dedup_recent(df, "seq", chunk=chunk).collect()}
        assert got == want
    assert comparison.dedup_recent(df.limit(0), "seq").count() == 0


def test_curriculum_edges(spark):
    inf, nan = math.inf, math.nan
    df = frame(spark, [(1, 0.2, 1.0), (2, 0.4, None), (3, nan, 1.0), (4, inf, 1.0), (5, None, 1.0), (6, 0.9, 9.0), (7, 0.4, 1.0)], "doc_id int, ifd_score double, ppl double")
    assert sorted(x.doc_id for x in curriculum.preprocess(df).collect()) == [1, 2, 7]
    assert {x.ifd_score for x in curriculum.preprocess(df, "median").collect()} == {0.2, 0.4}
    b = {x.doc_id: x.curriculum_band for x in curriculum.bands(df, "doc_id", bounds=[0.3, 0.4]).collect()}
    assert b == {1: 1, 2: 3, 3: None, 4: None, 5: None, 6: 3, 7: 3}
    w = curriculum.final_weights(df).collect()
    assert sum(x.sampling_weight for x in w if x.sampling_weight) == pytest.approx(1, abs=1e-5) and sum(x.sampling_weight is None for x in w) == 3
    p = curriculum.profile(df).first()
    assert (p.n, p.n_valid, p.n_high_ppl, p.ifd_p50) == (7, 4, 1, 0.4)
    assert curriculum.bands(df.limit(0), "doc_id").count() == 0 and curriculum.profile(df.limit(0)).first().ifd_p50 is None
    draws = curriculum.weighted_sample(curriculum.beta_weights(frame(spark, [(i, i / 10) for i in range(1, 9)], "doc_id int, ifd_score double")), 4000, "doc_id")
    n = {x.id: x["count"] for x in draws.filter("step = 0").groupBy("id").count().collect()}
    z = [math.exp(-i / 4.5 / 0.5) for i in range(1, 9)]
    assert sum(n.values()) == 4000 and all(abs(n[i] / 4000 - z[i - 1] / sum(z)) < 0.04 for i in range(1, 9))


def test_scores(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 5)).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    cos = (u @ u.T)[np.triu_indices(60, 1)]
    df = frame(spark, [(x.tolist(),) for x in v] + [(None,), ([0.0] * 5,), ([math.nan] * 5,)], "embedding array<float>").repartition(3)
    got = scoring.cosine_spread(df).first()
    assert (got.n, got.cos_mean, got.cos_std) == (60, pytest.approx(cos.mean(), abs=1e-4), pytest.approx(cos.std(), abs=1e-4))
    for block in (7, 100):
        assert scoring.cosine_median(df, block=block).first().cos_median == pytest.approx(np.median(cos), abs=1e-4)
    assert scoring.cosine_spread(df.limit(0)).first().cos_mean is None
    pairs = frame(spark, [("ab", "abab"), (None, "x"), ("q", "")], "instruction string, output string")
    scorer = lambda context, texts: [len(c) + len(t) if t else None for c, t in zip(context, texts, strict=True)]
    got = scoring.with_ifd(scoring.losses(pairs, scorer)).collect()
    assert [(x.loss_uncond, x.loss_cond, x.ifd_score) for x in got] == [(4, 7, 1.75), (1, 2, 2.0), (None, None, math.inf)]
    sft = instructions.to_sft(pairs.withColumn("k", F.lit(1)), ["k"])
    assert scoring.eval_loss(sft, scorer, ["k"]).first().eval_loss == 4.5
    e = scoring.embed(pairs.withColumnRenamed("output", "text"), lambda t: np.array([[len(x), 1] for x in t]), batch=2).collect()
    assert [x.embedding for x in e] == [[4, 1], [1, 1], [0, 1]]


def test_generation(spark):
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) % 3:
            raise OSError("no")
        return "ok " + prompt, 7

    c = generation.ChatClient(flaky, wait=waits.append)
    assert c.ask("a") == ("ok a", 7) and waits == [1.0, 2.0] and (c.calls, c.tokens, c.failures) == (1, 7, 0)
    one = generation.ChatClient(flaky, retries=1, wait=waits.append)
    assert one.ask("b") == (None, 0) and one.failures == 1 and len(waits) == 2
    df = frame(spark, [("p",), (None,)], "prompt string")
    got = generation.ask_all(df, lambda: generation.ChatClient(lambda p: (p * 2, 3)))
    assert [(x.reply, x.tokens) for x in got.collect()] == [("pp", 3), (None, 0)] and generation.cost(got).first().n_calls == 1
    seeds = frame(spark, [(1, "a text that is long enough to ask about"), (2, "short"), (3, None)], "doc_id int, text string")
    reply = lambda ps: ['{"instruction": "i", "output": "o"}' if i % 2 == 0 else None for i in range(len(ps))]
    made = generation.self_instruct(seeds, "{task_type}: {seed_text}", reply).collect()
    assert made and {x.seed_id for x in made} == {"1"}
    cand = instructions.evolve_candidates(frame(spark, [("x", "do it", 1), ("", "do that", 2)], "id string, instruction string, seq int"))
    assert generation.evolve(cand, "{evolution_type} {instruction}", ["a", "b"], reply).count() >= 1
    two = frame(spark, [("t1", "```python\nx = 1\n```", "x ="), ("t2", "y", "z"), ("t3", "(", ")"), ("t4", None, "x")], "instruction string, reply_a string, reply_b string")
    assert [(x.instruction, x.chosen) for x in generation.code_pairs(two).collect()] == [("t1", "```python\nx = 1\n```"), ("t4", None)][:1]
    assert df.select(generation.without_prompt(F.lit("abc"), F.lit("ab")).alias("x")).first().x == "c"


def test_comparison(spark):
    v = frame(spark, [(i, [1.0, float(i == 3)]) for i in range(5)], "id int, v array<double>")
    flags = {x.id: x.flagged for x in comparison.consistency_flags(v, "id", "v", sample=5).collect()}
    assert flags == {0: True, 1: True, 2: True, 3: False, 4: True}
    assert not any(x.flagged for x in comparison.consistency_flags(v, "id", "v", sample=6).collect())
    assert comparison.sample_rows(v, 99, "id").count() == 5
    assert comparison.delta(v.select(F.lit(2.0).alias("loss")), v.select(F.lit(3.0).alias("loss"))).first().pct == 50
    assert comparison.cost_table(spark, [("a", 10, 100, 2.0), ("b", 0, 0, 0.0)]).filter("cost_per_call IS NULL").count() == 1
    same = flywheel.ranked(frame(spark, [("ifd_gap", 0.5), ("qa_accuracy", 0.5), ("zzz", 0.5)], "signal string, deviation double")).collect()
    assert [x.signal for x in same] == ["qa_accuracy", "ifd_gap", "zzz"]


def test_configuration(tmp_path):
    p = str(tmp_path / "c.yaml")
    assert config.load(p) == config.Config()
    with open(p, "w") as f:
        f.write("rules:\n  min_length: 7\ndedup:\n  jaccard_threshold: 0.7\n")
    assert config.load(p).rules.min_length == 7 and config.load(p).rules.max_length == 10000
    assert config.revert(p) is None
    assert config.write_back(p, {"rules.min_length": 9, "rules.max_length": 5, "no.key": 1}, datetime(2024, 1, 2)) == ["rules.max_length", "no.key"]
    assert config.load(p).rules.min_length == 9
    assert config.revert(p) == "c.yaml.bak.20240102_000000" and config.load(p).rules.min_length == 7
    with open(p, "a") as f:
        f.write("dead: 1\n")
    with pytest.raises(ValueError):
        config.load(p)


def test_sinks_and_streams(spark, tmp_path):
    at = str(tmp_path)
    df = frame(spark, [("a", "第一条 本法"), ("b", "短文")], "id string, text string")
    assert jsonl.append_new(df, f"{at}/p", "id") == 2 and jsonl.append_new(df, f"{at}/p", "id") == 0
    jsonl.write_result(spark, f"{at}/r", {"x": 1, "y": "é"})
    assert jsonl.read_result(spark, f"{at}/r") == {"x": 1, "y": "é"}
    jsonl.write_jsonl(df, f"{at}/in")
    for _ in range(2):
        s = corpus.filtered(corpus.read_stream(spark, f"{at}/in", "id string, text string"))
        q = corpus.append_stream(s, f"{at}/out", "id", f"{at}/check", corpus.scored(ngram.train(df), ["id"]))
        q.awaitTermination(120)
        got = spark.read.parquet(f"{at}/out")
        assert [(x.id, x.ppl > 0) for x in got.collect()] == [("a", True)]
    assert corpus.first_rows(spark.range(500)).count() == 201
    assert jsonl.benchmark_table(spark, {"high": ["x", "y"], "low": ["z"]}).count() == 3
    jsonl.log_run(spark, f"{at}/log", "e", 1.0, {"a": 1}, {}, {"m": 2})
    assert jsonl.list_runs(spark, f"{at}/log", "e").first().metrics == {"m": "2"}
    kept = written.written(df, "x")
    assert kept.count() == 2
    written.forget(kept)
