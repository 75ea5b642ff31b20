"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-case words (runs of letters) and their prefixes of 4 to 7 letters,
hashed to 2^22 ids. From a bounded sample of labelled documents two kinds of terms are chosen: those that stand
out in either class by themselves (chi-square), and those that do so in pairs: of the ``pair_pool`` terms whose
presence varies most, pairs whose joint presence says more than both members do alone. A second-order
factorization machine is fitted to them by logistic loss: a bias, a weight per term, and ``rank`` factors per
term whose products are the pairwise interactions.

The sample's terms go to one task, which fits; only the weights (at most ``max_terms`` + ``max_pair_terms``
terms) come to the driver. The sample is bounded by ``max_train_rows``, whatever the number of documents.

Defined cases: null and empty texts have no terms and get the score of the bias alone. Null ids are scored and
never learned from. Null labels are ignored; of several labels of one id the largest counts, and of several texts
of one id one is learned from. With labels of one class or none the score is the smoothed share of toxic labels
(0.5 without labels) for every text. Repeated rows are scored each time. Labels, language and source are never
inputs of a score. A column that has the score's name already is replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ids_of_fold, unused

WORD = re.compile(r"[^\W\d_]+")
BITS = 22
PREFIXES = (4, 5, 6, 7)


@dataclass(frozen=True)
class FMConfig:
    #: most labelled documents that the model is fitted to (chosen by a hash of the id), and terms it may use
    max_train_rows: int = 20000
    max_terms: int = 1024
    #: terms that are tried in pairs, and most terms that pairs may add
    pair_pool: int = 1536
    max_pair_terms: int = 128
    #: least chi-square of a pair's joint presence, and how often it must exceed both members' own together
    pair_chi: float = 60.0
    pair_gain: float = 2.0
    rank: int = 4
    epochs: int = 150
    learning_rate: float = 0.05
    l2: float = 2e-4
    min_docs: int = 4
    seed: int = 7


@dataclass
class FMModel:
    """bias + sum w_i + sum over pairs <v_i, v_j> of the terms in a text; terms: sorted ids."""

    bias: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def scorer(self):
        """A function from a text to its score. Words are looked up once; the cache is emptied at 400,000 words."""
        at = {int(t): i for i, t in enumerate(self.terms)}
        cache: dict[str, tuple] = {}
        w, v, bias = self.w, self.v, self.bias

        def score(text: str | None) -> float:
            if len(cache) > 400_000:
                cache.clear()
            found: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                hit = cache.get(word)
                if hit is None:
                    hit = cache[word] = tuple(i for i in map(at.get, term_ids(word)) if i is not None)
                if hit:
                    found.update(hit)
            z = bias
            if found:
                k = sorted(found)
                s = v[k].sum(0)
                z += w[k].sum() + 0.5 * float((s * s).sum() - (v[k] ** 2).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def term_ids(word: str) -> list[int]:
    """Hashed ids of a word and of its prefixes (a prefix and the word that equals it are different terms)."""
    raw = ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in raw]


def document_terms(text: str | None, cache: dict[str, list[int]] | None = None) -> np.ndarray:
    found: set[int] = set()
    cache = {} if cache is None else cache
    for w in set(WORD.findall((text or "").lower())):
        if (ids := cache.get(w)) is None:
            ids = cache[w] = term_ids(w)
        found.update(ids)
    return np.sort(np.fromiter(found, np.int32, len(found)))


def chi_square(a, b, pos: int, neg: int):
    """Chi-square of something present in ``a`` of ``pos`` and ``b`` of ``neg`` documents."""
    n = pos + neg
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return n * (a * (neg - b) - b * (pos - a)) ** 2 / np.maximum(float(pos) * neg * (a + b) * (n - a - b), 1)


def _dense(rows: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    """The 0/1 matrix of documents by (sorted) terms."""
    x = np.zeros((len(rows), len(terms)), np.float32)
    if len(terms):
        for i, r in enumerate(rows):
            at = np.searchsorted(terms, r)
            at[at == len(terms)] = 0
            x[i, at[terms[at] == r]] = 1
    return x


def single_terms(ids, a, b, pos: int, neg: int, config: FMConfig) -> np.ndarray:
    """Of the terms ``ids``, those that stand out in one class, strongest first."""
    lift = (a / pos + 1e-4) / (b / neg + 1e-4)
    chi = chi_square(a, b, pos, neg)
    chi[(a + b < config.min_docs) | ((lift < 2) & (lift > 0.25)) | (chi < 12)] = 0
    order = np.argsort(-chi, kind="stable")[: config.max_terms]
    return ids[order[chi[order] > 0]]


def pair_terms(rows: list[np.ndarray], y: np.ndarray, ids, a, b, config: FMConfig) -> np.ndarray:
    """Members of the pairs whose joint presence tells the classes apart far better than its members do, strongest first.

    The pool holds the terms whose presence varies most (nearest to half of the documents): others have too few joint
    documents. Terms that always occur together are one (of words and their prefixes, the first).
    """
    n, pos = len(y), int(y.sum())
    spread = np.minimum(a + b, n - a - b)
    pool = np.argsort(-spread, kind="stable")[: config.pair_pool]
    pool = np.sort(pool[spread[pool] >= 4 * config.min_docs])
    if len(pool) < 2:
        return ids[:0]
    x = _dense(rows, ids[pool])
    _, first = np.unique(np.packbits(x.T.astype(bool), axis=1), axis=0, return_index=True)
    pool, x = pool[np.sort(first)], x[:, np.sort(first)]
    own = chi_square(a[pool], b[pool], pos, n - pos)
    hit = y > 0
    both_a, both_b = x[hit].T @ x[hit], x[~hit].T @ x[~hit]
    chi = chi_square(both_a, both_b, pos, n - pos)
    chi[(both_a + both_b < 2 * config.min_docs) | (chi < config.pair_chi) | (chi < config.pair_gain * (own[:, None] + own[None, :]))] = 0
    i, j = np.nonzero(np.triu(chi, 1))
    found: dict[int, None] = {}
    for k in np.argsort(-chi[i, j], kind="stable"):
        if len(found) + 2 > config.max_pair_terms:
            break
        found[int(i[k])] = found[int(j[k])] = None
    return ids[pool[list(found)]] if found else ids[:0]


def fm_logits(x: np.ndarray, bias, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of each 0/1 row of ``x``, the pair sum by its factorised form, and ``x @ v``."""
    k = v.shape[1]
    both = x @ np.concatenate([w[:, None], v, v**2], 1)
    xv = both[:, 1 : 1 + k]
    return bias + both[:, 0] + 0.5 * ((xv * xv).sum(1) - both[:, 1 + k :].sum(1)), xv


def fm_gradients(x: np.ndarray, y: np.ndarray, bias, w: np.ndarray, v: np.ndarray, l2: float) -> list[np.ndarray]:
    """Gradients of mean logistic loss + l2 / 20 |w|^2 + l2 / 2 |v|^2 for 0/1 rows."""
    z, xv = fm_logits(x, bias, w, v)
    e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    both = x.T @ np.concatenate([e[:, None], e[:, None] * xv], 1)
    return [np.array([e.sum()]), both[:, 0] + l2 * w / 10, both[:, 1:] - both[:, :1] * v + l2 * v]


def fit_arrays(rows: list[np.ndarray], y: np.ndarray, config: FMConfig = FMConfig()) -> FMModel:
    """The machine fitted to documents (sorted arrays of distinct term ids) and their labels."""
    n, pos = len(y), int(y.sum())
    if pos == 0 or pos == n:
        p = (pos + 1) / (n + 2)
        return FMModel(float(np.log(p / (1 - p))))
    neg = n - pos
    a, b = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)  # documents with the term, toxic and not
    for r, label in zip(rows, y, strict=True):
        (a if label else b)[r] += 1
    ids = np.flatnonzero(a + b).astype(np.int32)
    a, b = a[ids].astype(float), b[ids].astype(float)
    terms = np.unique(np.concatenate([single_terms(ids, a, b, pos, neg, config), pair_terms(rows, y, ids, a, b, config)]))
    x = _dense(rows, terms)
    rng = np.random.default_rng(config.seed)
    d = len(terms)
    p = [np.array([np.log(pos / neg)], np.float32), np.zeros(d, np.float32), rng.normal(0, 0.05, (d, config.rank)).astype(np.float32)]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    yf = y.astype(np.float32)
    for t in range(1, config.epochs + 1):
        for i, g in enumerate(fm_gradients(x, yf, p[0][0], p[1], p[2], config.l2)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            p[i] = p[i] - config.learning_rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return FMModel(float(p[0][0]), terms.astype(np.int64), p[1].astype(float), p[2].astype(float))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_parts: int = 5, config: FMConfig = FMConfig()) -> DataFrame:
    """(id, y, text) of at most ``max_train_rows`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    fold = ids_of_fold(F.col("id"), held_out_parts)
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & (fold != 0))
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("id"), F.lit(config.seed)), "id").limit(config.max_train_rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return found.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select(F.col("id").cast("string").alias("id"), "y", F.col("t.text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_parts: int = 5, config: FMConfig = FMConfig()) -> FMModel:
    """Fits to the training sample in one task.

    The ids of the sample go to the executors as a broadcast of at most ``max_train_rows`` rows; terms are found where the
    texts are, the fitting task gets hashed terms, and the driver gets the weights.
    """

    def terms(batches):
        for b in batches:
            cache: dict[str, list[int]] = {}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([document_terms(t.as_py(), cache) for t in b.column(2)], pa.list_(pa.int32()))], ["id", "y", "terms"])

    def train(batches):
        keys, ys, rows = [], [], []
        for b in batches:
            keys += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
            flat, sizes = b.column(2).flatten().to_numpy(), b.column(2).value_lengths().to_numpy()
            rows += [r.copy() for r in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []
        by = sorted(range(len(keys)), key=keys.__getitem__)  # whatever order the rows come in
        m = fit_arrays([rows[i] for i in by], np.array([ys[i] > 0 for i in by], int), config)
        yield pa.RecordBatch.from_arrays([pa.array([m.bias]), pa.array([m.terms], pa.list_(pa.int64())), pa.array([m.w], pa.list_(pa.float64())), pa.array([m.v.ravel()], pa.list_(pa.float64()))], ["bias", "terms", "w", "v"])

    sample = training_sample(docs, labels, id_col, text_col, label_col, held_out_parts, config)
    got = sample.mapInArrow(terms, "id string, y int, terms array<int>").repartition(1).mapInArrow(train, "bias double, terms array<long>, w array<double>, v array<double>").first()
    if got is None:  # no rows reached the task
        return fit_arrays([], np.zeros(0, int), config)
    d = len(got["terms"])
    return FMModel(got["bias"], np.array(got["terms"], np.int64), np.array(got["w"]), np.array(got["v"]).reshape(d, -1) if d else np.zeros((0, 1)))


def score_column(docs: DataFrame, model: FMModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as the last column (in place of one of that name), in one pass without a shuffle."""
    docs = docs.drop(out) if out != text_col else docs
    k = docs.columns.index(text_col)

    def run(batches):
        score = model.scorer()
        for b in batches:
            s = pa.array([score(t.as_py()) for t in b.column(k)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, config: FMConfig = FMConfig()) -> DataFrame:
    """The documents that score under the threshold, with the columns that ``docs`` has."""
    model = fit(docs, labels, config=config)
    out = unused("_toxicity", docs)
    return score_column(docs, model, out=out).filter(F.col(out) < threshold).drop(out)
