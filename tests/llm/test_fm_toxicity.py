import itertools
import random
import zlib

import numpy as np

from tessera.llm import fm_toxicity as M


def made(label, n=1600, seed=1):
    """Texts of filler words in which ``insult`` and ``group`` stand at random, and what ``label`` says of the two."""
    r = random.Random(seed)
    filler = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    texts, y = [], []
    for _ in range(n):
        w = [r.choice(filler) for _ in range(12)]
        a, b = r.random() < 0.4, r.random() < 0.4
        texts.append(" ".join(w + ["insult"] * a + ["group"] * b))
        y.append(int(label(a, b)))
    return texts, np.array(y)


def interaction(m, one, other):
    """The sum of the factor products of all terms of one word with all of another."""
    at = {int(t): i for i, t in enumerate(m.terms)}
    x, y = ([at[t] for t in M.term_ids(w) if t in at] for w in (one, other))
    return sum(m.v[i] @ m.v[j] for i in x for j in y)


def test_interactions_are_learned():
    """Neither word is toxic alone; both together are."""
    texts, y = made(lambda a, b: a and b)
    m = M.fit_arrays([M.document_terms(t) for t in texts[:1200]], y[:1200], M.FMConfig(epochs=400))
    s = m.scorer()
    assert (np.array([s(t) >= 0.5 for t in texts[1200:]]) == y[1200:]).mean() > 0.97
    assert interaction(m, "insult", "group") > 1


def test_words_that_matter_only_together_are_offered_to_the_machine():
    """Toxic when both or neither occur: no word stands out by itself, and weights alone can't tell."""
    r = random.Random(2)
    texts, y = made(lambda a, b: a == b, 2400, 3)
    keep = [i for i in range(len(texts)) if ("insult" in texts[i]) == ("group" in texts[i]) or r.random() < 0.95]
    texts, y = [texts[i] for i in keep], y[keep]
    rows = [M.document_terms(t) for t in texts]
    m = M.fit_arrays(rows[:1800], y[:1800], M.FMConfig(epochs=600, rank=8))
    s = m.scorer()
    assert (np.array([s(t) >= 0.5 for t in texts[1800:]]) == y[1800:]).mean() > 0.97
    assert interaction(m, "insult", "group") > 1


def test_noise_adds_no_pairs():
    texts, y = made(lambda a, b: False)
    y = np.array([zlib.crc32(t.encode()) % 3 == 0 for t in texts], int)
    assert not len(M.fit_arrays([M.document_terms(t) for t in texts], y, M.FMConfig(epochs=5)).terms)


def test_factorised_sum_and_gradients_against_explicit_pairs():
    r = np.random.default_rng(5)
    x = (r.random((30, 9)) < 0.4).astype(float)
    y = (r.random(30) < 0.5).astype(float)
    bias, w, v, l2 = 0.3, r.normal(size=9), r.normal(size=(9, 3)), 0.1

    def logits(bias, w, v):
        return np.array([bias + row @ w + sum(row[i] * row[j] * (v[i] @ v[j]) for i, j in itertools.combinations(range(9), 2)) for row in x])

    def loss(bias, w, v):
        z = logits(bias, w, v)
        return np.mean(np.log1p(np.exp(z)) - y * z) + l2 / 20 * (w**2).sum() + l2 / 2 * (v**2).sum()

    assert np.allclose(M.fm_logits(x, bias, w, v)[0], logits(bias, w, v))
    g = M.fm_gradients(x, y, bias, w, v, l2)
    h = 1e-6
    assert np.isclose(g[0][0], (loss(bias + h, w, v) - loss(bias - h, w, v)) / (2 * h), atol=1e-6)
    for i in range(9):
        d = np.eye(9)[i] * h
        assert np.isclose(g[1][i], (loss(bias, w + d, v) - loss(bias, w - d, v)) / (2 * h), atol=1e-6)
        for k in range(3):
            d = np.zeros_like(v)
            d[i, k] = h
            assert np.isclose(g[2][i, k], (loss(bias, w, v + d) - loss(bias, w, v - d)) / (2 * h), atol=1e-6)


def test_scorer_is_the_explicit_sum():
    texts, y = made(lambda a, b: a and b)
    m = M.fit_arrays([M.document_terms(t) for t in texts], y, M.FMConfig(epochs=60))
    at = {int(t): i for i, t in enumerate(m.terms)}
    s = m.scorer()
    for t in texts[:50] + ["", "insult", "Insult GROUP " * 400]:
        k = sorted({at[x] for word in M.WORD.findall(t.lower()) for x in M.term_ids(word) if x in at})
        z = m.bias + sum(m.w[i] for i in k) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(k, 2))
        assert np.isclose(s(t), 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = M.fit(docs, labels)
    rows = M.score_column(docs.join(labels, "doc_id"), model).select("doc_id", "toxic", "score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    flagged = [r for r in held if r.score >= 0.5]
    assert sum(r.toxic for r in flagged) / len(flagged) > 0.95
    assert sum(r.toxic for r in flagged) / sum(r.toxic for r in held) > 0.6
    odd = spark.createDataFrame([(None, None, "x", 1), (1, "", "y", 1), (1, "", "y", 1)], "doc_id long, text string, score string, _toxicity int")
    got = M.score_column(odd, model)
    assert got.columns == ["doc_id", "text", "_toxicity", "score"]
    got = [r.score for r in got.collect()]
    assert len(got) == 3 and len(set(got)) == 1 and 0 <= got[0] < 0.5
    none = M.fit(docs.limit(0), labels.limit(0))
    assert M.score_column(odd, none).first().score == 0.5
    assert M.filter_documents(odd, labels.limit(0)).columns == odd.columns


def test_repeated_ids_and_labels(spark):
    texts, y = made(lambda a, b: a and b, 300)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, t) for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    sample = M.training_sample(docs, labels, config=M.FMConfig(max_train_rows=100))
    rows = sample.collect()
    assert len(rows) == 100 == len({r.id for r in rows}) and all(zlib.crc32(r.id.encode()) % 5 for r in rows)
