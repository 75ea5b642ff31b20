"""Tests of the findings of round 3."""

import hashlib
import math
import random

import duckdb
import pytest

from tessera.operators import comparison, dedup, ngram, scoring
from tessera.plans import registry

AT = "/root/testdata/sf0.001"
CHAR_QUERIES = ["health_before_after", "health_by_lang", "label_audit", "latin_rule_rejects", "reject_reasons", "rule_stats", "script_rule_stats", "text_profile", "text_ratios"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables with labelled empty, blank and null texts, and DuckDB over them."""
    at, c = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    c.execute(f"CREATE TABLE documents AS SELECT * FROM '{AT}/documents.parquet'")
    c.execute("INSERT INTO documents VALUES (900001, '', 'en', 'web-0', 0), (900002, repeat(' ', 12), 'en', 'web-0', 12), (900003, NULL, 'de', 'web-0', NULL), (900004, '  ', 'de', 'web-1', 2), (900005, '　　', 'fr', 'web-1', 2)")
    c.execute(f"CREATE TABLE labels AS SELECT * FROM '{AT}/labels.parquet'")
    c.execute("INSERT INTO labels SELECT doc_id, 1, 0 FROM documents WHERE doc_id > 900000")
    for t in ("documents", "labels"):
        c.execute(f"COPY {t} TO '{at}/{t}.parquet' (FORMAT parquet)")
    return at, c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHAR_QUERIES)
def test_empty_blank_and_null_texts_agree_with_sql(spark, odd, name):
    at, c = odd
    df = registry.queries()[name](spark, at)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x), key=str)
    assert rows(df.collect()) == rows(want)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packed_models_score_as_joins_do_and_make_no_row_per_character(spark, monkeypatch):
    texts = ["abcabcab", "abd", "ab", "x", "", None, "  \u3000", "😀b😀b😀", " ab\u0000c ", "\u0000\u0000a\u0000", "éàéà", "zzzz", "y" * 3000, "a\nb\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    m = ngram.train(df.filter("i < 10"))
    for backoff in ("jump", "stepwise"):
        got = ngram.perplexity(m, df, ["i"], backoff=backoff)
        assert not {"Join", "Generate", "Aggregate"} & set(plan_of(got).replace("(", " ").split())
        with monkeypatch.context() as p:
            p.setattr(ngram, "PACKED_GRAMS", 0)
            want = ngram.perplexity(m, df, ["i"], backoff=backoff)
            assert "Generate" in plan_of(want)
        assert {r.i: r.ppl for r in got.collect()} == pytest.approx({r.i: r.ppl for r in want.collect()})
    none = ngram.perplexity(ngram.train(df.limit(0)), df, ["i"])
    assert {r.ppl for r in none.filter("i in (0, 3)").collect()} == {None, math.inf}


def test_packed_counts_are_those_of_rows(spark, monkeypatch):
    df = spark.createDataFrame([("abcabcab",), ("😀b😀b😀",), ("a\u0000c",), ("ab",), (None,), ("y" * 50,)], "text string").repartition(3)
    monkeypatch.setattr(ngram, "PIECE", 10)
    monkeypatch.setattr(ngram, "HELD", 4)
    got = {r.g: r.c for r in ngram.train(df).counts.collect()}
    monkeypatch.setattr(ngram, "PACKED_N", 0)
    assert got == {r.g: r.c for r in ngram.train(df).counts.collect()} and got["b"] == 5


def test_rounds_and_the_scan_on_the_driver_find_the_same_leaders(spark, monkeypatch):
    r = random.Random(8)
    members = spark.createDataFrame([(i, b, str(r.randrange(9))) for b in range(4) for i in range(80)], "id int, band int, key string")
    for one in (True, False):
        found = []
        for rows in (0, 60, 200_000):
            monkeypatch.setattr(dedup, "LOCAL_ROWS", rows)
            found.append({x.id: x.leader for x in dedup.leader_groups(members, one_a_band=one).collect()})
        assert found[0] == found[1] == found[2] and len(set(found[0].values())) > 1


def test_groups_write_no_texts_and_verify_exactly(spark, monkeypatch):
    r = random.Random(2)
    base = ["".join(r.choice("abcde ") for _ in range(200)) for _ in range(6)]
    texts = base + [b[: r.randint(20, 199)] + "".join(r.choice("abcde ") for _ in range(40)) for b in base * 8] + base[:2]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    plain, schemas = dedup.written, []
    monkeypatch.setattr(dedup, "written", lambda d, name: schemas.append(d.dtypes) or plain(d, name))
    got = {(x.id, x.leader_id) for x in dedup.groups(df).collect()}
    assert schemas and not [c for x in schemas for c in x if c[0] == "text" or c[1] == "array<string>"]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    led = {x.id: x.leader_id for x in dedup.groups(df, config=dedup.DedupConfig(verify=False)).collect()}
    near = {i for i, j in led.items() if texts[i] == texts[j] or len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    want = {(i, led[i]) for i in near if sum(led[j] == led[i] for j in near) > 1}
    assert {x for x in got if x[1] in set(led.values())} >= want and {i for i, j in got if i != j and texts[i] != texts[j]} == {i for i, j in want if i != j and texts[i] != texts[j]}


def test_signatures_keep_few_hashes(monkeypatch):
    monkeypatch.setattr(dedup, "KEPT_HASHES", 50)
    r = random.Random(1)
    texts = ["".join(r.choice("abcdé😀") for _ in range(60)) for _ in range(40)]
    h = dedup.ShingleHashes(3)
    for s in range(0, 40, 2):
        for t, got in zip(texts[s : s + 2], h.of(texts[s : s + 2]), strict=True):
            assert sorted(got) == sorted(int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in {t[i : i + 3] for i in range(58)})
        assert len(h.keys) <= 120
    family = dedup.np.array([(dedup.PRIME - 1, dedup.PRIME - 1), (1, 0), (123456789, 5)], dedup.np.uint64)
    got = h.of(texts[:1])[0]
    assert dedup.least(got, family).tolist() == [min((int(a) * int(x) + int(b)) % dedup.PRIME for x in got) for a, b in family]


def test_a_scan_goes_on_from_chunk_to_chunk(spark, monkeypatch):
    """Distinct texts that never forget a state in one chunk: before, a round was needed for each chunk."""
    rows = [(i, chr(0x4E00 + i) * 3 if i < 15 else chr(0x4E00 + i % 15)) for i in range(400)]
    df = spark.createDataFrame(rows, "seq int, instruction string")
    plain, rounds = comparison.written, []
    monkeypatch.setattr(comparison, "written", lambda d, name: rounds.append(name) or plain(d, name))
    monkeypatch.setattr(comparison, "RUN_ROWS", 100)
    got = {x.seq: x.recent_duplicate for x in comparison.dedup_recent(df, "seq", chunk=8).collect()}
    assert got == {i: i >= 15 for i in range(400)} and 2 <= len(rounds) <= 1 + 5
    monkeypatch.setattr(comparison, "RUN_ROWS", 16)
    assert got == {x.seq: x.recent_duplicate for x in comparison.dedup_recent(df, "seq", chunk=8).collect()}


def test_pair_losses_make_no_row_per_character(spark, monkeypatch):
    pairs = [(1, "ab b", "abcab"), (1, "ab b", "abcab"), (2, None, "xyx"), (3, "q", ""), (4, "", "a"), (5, "😀 b", "b😀b😀"), (6, "zz", "漢"), (7, "x" * 40, "x" * 500)]
    df = spark.createDataFrame(pairs, "k int, instruction string, output string")
    got = scoring.ngram_losses(df, ["k"])
    assert "Generate" not in plan_of(got) and "Join" not in plan_of(got)
    monkeypatch.setattr(ngram, "PACKED_GRAMS", 0)
    want = {x.k: (x.loss_uncond, x.loss_cond) for x in scoring.ngram_losses(df, ["k"]).collect()}
    got = {x.k: (x.loss_uncond, x.loss_cond) for x in got.collect()}
    assert set(got) == set(want) == {1, 2, 4, 5, 6, 7} and all(got[k] == pytest.approx(want[k]) for k in want)
