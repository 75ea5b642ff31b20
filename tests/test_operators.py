import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import curriculum, dedup, flywheel, instructions, ngram, rules
from tessera.sources import jsonl

#: new values of the parameters by scenario; None: held
GOLDEN = {
    "baseline": [0.2306, 0.2111, None, 158, 0.2848, None, 16.659, None, None, 0.7937, 13, None, 25.5],
    "drift": [0.221, 0.2277, 0.9092, 186, None, 0.3175, 17.25, 101, 0.805, 0.805, 16, 0.5181, 25.5],
    "hard": [0.2525, 0.2525, None, None, 0.3175, 0.2663, None, None, None, None, None, None, None],
    "noise": [0.2201, 0.2193, 0.8642, 184, 0.2792, 0.2712, 17.25, 96, 0.7484, 0.805, 16, 0.6481, 25.5],
}


def test_controller_goldens(spark):
    d = flywheel.decide(flywheel.normalize(flywheel.scenario_signals(spark)), flywheel.weights(spark), ["scenario"])
    got = {(r.scenario, r.param): r for r in flywheel.adjust(d, flywheel.parameters(spark)).collect()}
    for scenario, values in GOLDEN.items():
        for p, v in zip(flywheel.PARAMETERS, values, strict=True):
            r = got[scenario, p[0]]
            assert r.new == pytest.approx(p[2] if v is None else v, abs=2e-4), (scenario, p[0])
            assert (r.action == "hold") == (v is None)


def test_rules(spark):
    cases = [("", None), ("   ", None), ("第一条 本法", None), ("短文", "length"), ("中" * 10001, "length"), ("use API to call the service now", None), ("plain english sentence only", "non_chinese"), ("哈" * 20, "repeat_char")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = [r.reject_rule for r in rules.apply_rules(df).orderBy("i").collect()]
    assert got == [c for _, c in cases]


def test_perplexity_is_that_of_the_recurrence(spark):
    texts, held = ["abcabcab", "abd", "ab", "xyzxyz"], ["abcd", "zz", "a", "", "bxy"]
    m = ngram.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    c = {}
    for t in texts:
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1 if len(t) >= 3 else 0):
                c[t[i : i + n]] = c.get(t[i : i + n], 0) + 1
    n1 = sum(v for k, v in c.items() if len(k) == 1)
    v1 = sum(len(k) == 1 for k in c)

    def p(g):
        p0 = (c.get(g[-1], 0) + 0.01) / (n1 + 0.01 * v1)
        if len(g) == 1 or not c.get(g):
            return p0
        return 0.6 * c[g] / c[g[:-1]] + 0.4 * p(g[1:])

    want = [math.exp(-sum(math.log(p(t[max(0, i - 2) : i + 1])) for i in range(len(t))) / len(t)) if len(t) > 1 else math.inf for t in held]
    df = spark.createDataFrame(list(enumerate(held)), "i int, text string")
    got = [r.ppl for r in ngram.perplexity(m, df, ["i"]).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_leaders_are_those_of_a_scan(spark):
    import random

    r = random.Random(4)
    edges = {tuple(sorted(r.sample(range(30), 2))) for _ in range(45)}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(30)}
    want, done = {}, set()
    for i in range(30):
        if i not in done and near[i]:
            for j in {i} | {x for x in near[i] if x not in done}:
                want[j] = i
                done.add(j)
    members = [(x, 0, f"{e}") for e in edges for x in e]  # an edge is a bucket of two
    got = {x.id: x.leader for x in dedup.leader_groups(spark.createDataFrame(members, "id int, band int, key string")).collect()}
    assert got == want and dedup.band_shape(0.6, 128) == (18, 7)


def test_parsers(spark):
    df = spark.createDataFrame([('```json\n{"instruction":"x","output":"y"}\n```', "A", "答案：3.5"), ('so {"instruction": "p", "output": "q"} end', "回答B", "答案:-2"), ("no", "无", "答案：1.2.3")], "a string, b string, c string")
    got = df.select(instructions.parse_reply(F.col("a")).alias("p"), instructions.judge(F.col("b")).alias("j"), instructions.answer(F.col("c")).alias("x")).collect()
    assert [(tuple(r.p) if r.p else None, r.j, r.x) for r in got] == [(("x", "y"), "A", 3.5), (("p", "q"), "B", None), (None, None, None)]


def test_weights_sum_to_one_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(i, 0.1 + i / 10) for i in range(9)], "id int, ifd_score double")
    assert all(abs(r[1] - 1) < 1e-9 for r in curriculum.beta_weights(df).groupBy("beta_step").agg(F.sum("weight")).collect())
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": "a"}\n\nbroken\n{"id": "b"}\n')
    assert sorted(r.id for r in jsonl.read_jsonl(spark, str(p), "id string").collect()) == ["a", "b"]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), "id string").count() == 0
