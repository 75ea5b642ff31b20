import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from tessera.llm import probminhash as P


def brute(x, y):
    a, b = Counter(x), Counter(y)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in {*a, *b}) for i in a if i in b)


def shingled(text):
    w = text.lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def corpus(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 60, 150, 400]))]
        rows.append(base)
        for _ in range(r.choice([0, 0, 1, 4])):
            c = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                c[r.randrange(len(c))] = r.choice(vocab)
            rows.append(c)
    hub = [r.choice(vocab) for _ in range(200)]
    rows.append(hub)
    for k in range(25):  # copies close to the hub and further from each other
        c = list(hub)
        for j in range(3 + k % 2):
            c[r.randrange(len(c))] = r.choice(vocab)
        rows.append(c)
    texts = [" ".join(x) for x in rows] + ["", None, "  \n", "Same  WORDS here", "same words\nHERE", "same words here"]
    return [(i, t) for i, t in enumerate(texts)]


def test_exact_similarity_is_probability_jaccard():
    r = np.random.default_rng(0)
    for _ in range(50):
        x, y = r.integers(0, 12, r.integers(1, 30)).astype(np.uint64), r.integers(0, 12, r.integers(1, 30)).astype(np.uint64)
        assert abs(P.j_p(x, y) - brute(x.tolist(), y.tolist())) < 1e-9


def test_signatures_estimate_it():
    r = np.random.default_rng(3)
    x = r.integers(0, 40, 60).astype(np.uint64)
    y = np.concatenate([x[:45], r.integers(100, 140, 15).astype(np.uint64)])
    m = 3000
    s = P.signatures([np.unique(x, return_counts=True), np.unique(y, return_counts=True)], m)
    assert abs((s[0] == s[1]).mean() - P.j_p(x, y)) < 0.04


def test_classes_are_those_of_brute_force(spark):
    rows = corpus()
    sets = {i: Counter(shingled(t or "")) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, _ in rows:
        for j, _ in rows:
            if j < i and (sets[i].keys() & sets[j].keys()) and brute(sets[i].elements(), sets[j].elements()) >= 0.8 - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for config in (P.ProbMinHashConfig(), P.ProbMinHashConfig(block=3)):
        got = {r.doc_id: r.class_id for r in P.near_duplicates(df, config=config).collect()}
        assert got == {i: find(i) for i, _ in rows}
    kept = sorted(r.doc_id for r in P.keep_one(df).collect())
    assert kept == [i for i, _ in rows if find(i) == i]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    long = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, long, 7), (1, long, 7), (None, long, 8), (None, None, 9), (3, "x", 1), (3, "y", 1)], "doc_id long, text string, content int")
    rows = P.near_duplicates(df).collect()
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in rows if r.doc_id != 3)
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1)]
    named = [r.class_id for r in rows if r.doc_id == 3]
    assert len(named) == 2 and 3 in named and min(named) < 0
    assert P.near_duplicates(df.limit(0)).count() == 0
    assert P.keep_one(df.limit(0)).columns == df.columns


def test_different_classes_have_different_names(spark):
    texts = ["alpha beta gamma", "one two three four five six", "solo text", "ALPHA beta  gamma"]
    df = spark.createDataFrame([(3, texts[0]), (3, texts[1]), (4, texts[2]), (None, texts[3]), (None, "only null here"), (None, "only null here"), (None, "another null")], "doc_id long, text string")
    rows = P.near_duplicates(df).collect()
    name = {}
    for r in rows:
        name.setdefault(r.content, set()).add(r.class_id)
    assert all(len(v) == 1 for v in name.values()) and len(set.union(*name.values())) == len(name) == 5
    assert P.keep_one(df).count() == 5


def test_very_long_texts_and_extra_columns(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(5000)}" for _ in range(60000)]
    other = list(words)
    for _ in range(300):
        other[r.randrange(len(other))] = "x"
    df = spark.createDataFrame([(1, " ".join(words), 1, "a"), (2, " ".join(other), 1, "b"), (3, "short one", 1, "c")], "doc_id long, text string, root int, _content string")
    assert {r.doc_id: r.class_id for r in P.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    kept = P.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_one_row_of_each_class_stays_whatever_its_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (None, text["c"] + " more"), (None, text["c"])]
    rows += [(5, text["d"]), (5, text["e"]), (5, text["e"]), (9, text["e"]), (None, text["e"]), (7, text["f"]), (None, text["f"]), (None, None), (None, "")]
    kept = P.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, (r.text or "")[:1]) for r in kept)
    assert got == {(None, "a"): 1, (None, "b"): 1, (None, "c"): 1, (5, "d"): 1, (5, "e"): 1, (7, "f"): 1, (None, ""): 2}


def test_words_of_a_whole_batch_are_not_held_at_once(spark, monkeypatch):
    steps, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: (steps.append((self.columns, run)), plain(self, run, schema))[1])
    base = " ".join(map(str, range(100)))
    assert P.keep_one(spark.createDataFrame([(1, base), (2, base + " x")], "doc_id long, text string")).count() == 1
    on_texts = [(c, run) for c, run in steps if "text" in c]
    assert len(on_texts) == 4  # sketches, contents, shingles, and the contents of whole rows
    r = np.random.default_rng(0)
    for n, length, names, most in ((4000, 150, ("contents", "sets"), 10e6), (40, 15000, ("run",), 50e6)):
        text = " ".join(map(str, r.integers(100, 9999, length).tolist()))
        batch = {"doc_id": pa.array(range(n)), "id": pa.array(range(n)), "content": pa.array([b""] * n), "text": pa.array([text] * n)}
        for columns, run in on_texts:
            if run.__name__ in names:
                tracemalloc.start()
                try:
                    rows = sum(x.num_rows for x in run([pa.RecordBatch.from_pydict({c: batch[c] for c in columns})]))
                    peak = tracemalloc.get_traced_memory()[1]
                finally:
                    tracemalloc.stop()
                assert rows == n and peak < most, (run.__name__, peak)
