"""Character n-gram language model: count tables, probabilities and perplexity as DataFrames.

A seen n-gram has 0.6 of its relative frequency and 0.4 of its suffix's probability; an unseen one goes
straight to the smoothed unigram (``backoff="jump"``) or to its suffix (``"stepwise"``).

N-grams of up to three characters fit a 64-bit integer: texts are counted and scored over Arrow batches, with the model's
probabilities in a sorted array that every task gets, so that no row per character is ever made. Longer n-grams, and
models of more than ``PACKED_GRAMS``, are counted and joined as rows.

Defined cases: null, empty and blank texts have no tokens and an infinite perplexity, as texts of one token have; texts
shorter than ``n`` are scored and not learned from. Without training texts every probability is undefined and every
perplexity null. Repeated rows and ids are each scored. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.written import written
from .profile import join_groups
from .ranks import percentiles

ALPHA, DISCOUNT = 0.01, 0.4


def char_tokens(col):
    """A token per character of the stripped text."""
    s = T.strip(F.coalesce(col, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def word_tokens(segment):
    """A tokenizer from ``segment``, a function from a text to a list of words: one pass over Arrow batches."""
    @F.arrow_udf("array<string>")
    def tokens(col: pa.Array) -> pa.Array:
        return pa.array([segment(t.strip()) if t and t.strip() else [] for t in col.to_pylist()], pa.list_(pa.string()))

    return tokens


def gram_stream(df: DataFrame, n: int, text_col: str, keys: list[str]) -> DataFrame:
    """A row per token: keys and g, the token after up to n - 1 before it; short at a text's start. n_tokens too.

    Returns (keys, n_tokens, g).
    """
    s = T.strip(F.coalesce(F.col(text_col), F.lit("")))
    base = df.select(*keys, s.alias("_s")).withColumn("n_tokens", F.length("_s")).filter("n_tokens > 0")
    grams = T.windows(F.col("_s"), n, short=True)
    return base.select(*keys, "n_tokens", F.explode(grams).alias("g"))


@dataclass
class NgramModel:
    """counts: (g, c) of all orders, g the n-gram's text; tokens and vocabulary: the totals N and V."""

    counts: DataFrame
    n: int
    tokens: int
    vocabulary: int

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        spark = self.counts.sparkSession
        spark.createDataFrame([(self.n, self.tokens, self.vocabulary)], "n int, tokens long, vocabulary long").write.mode("overwrite").parquet(f"{path}/scalars")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NgramModel:
        s = spark.read.parquet(f"{path}/scalars").first()
        return NgramModel(spark.read.parquet(f"{path}/counts"), s["n"], s["tokens"], s["vocabulary"])


#: bits of a packed character (code point + 1, 0 for none) and most characters of a packed n-gram
BITS, PACKED_N = 21, 3
#: most characters that are packed at once, and most n-grams that a task sums before it lets them go
PIECE, HELD = 1 << 18, 1 << 19
#: most n-grams of a model that is sent to every task packed (16 bytes each)
PACKED_GRAMS = 2_000_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1


def packed_grams(c: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """For each character the n-gram that ends there, short at a text's start; ``at``: places within the texts."""
    out = c.copy()
    for j in range(1, n):
        out[j:] |= np.where(at[j:] >= j, c[:-j], 0) << (BITS * j)
    return out


def pieces(texts: list[str], most: int | None = None):
    """(first, codes, starts, places) of runs of texts with some ``most`` (``PIECE``) characters; no text is empty."""
    most = most or PIECE
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= most):
            size += len(texts[last])
            last += 1
        lengths = np.array([len(t) for t in texts[first:last]], np.int64)
        starts = np.cumsum(lengths) - lengths
        yield first, codes("".join(texts[first:last])), starts, np.arange(size) - np.repeat(starts, lengths)
        first = last


def unpacked(keys: np.ndarray) -> list[str]:
    parts = [(keys >> (BITS * j)) & ((1 << BITS) - 1) for j in range(PACKED_N - 1, -1, -1)]
    return ["".join(chr(x - 1) for x in g if x) for g in zip(*(p.tolist() for p in parts), strict=True)]


def packed(grams: list[str]) -> np.ndarray:
    out = np.zeros(len(grams), np.int64)
    size = np.array([len(g) for g in grams], np.int64)
    for j in range(PACKED_N):
        has = np.nonzero(size > j)[0]
        out[has] |= codes("".join(grams[i][-1 - j] for i in has)) << (BITS * j)
    return out


def _counted(n: int):
    """Batches of one text column to (g, c): the n-grams of a task's texts of at least ``n`` characters, summed."""

    def summed(held):
        keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, counts)
        return keys, total

    def out(keys, counts):
        for s in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(keys[s : s + 100_000]), pa.string()), pa.array(counts[s : s + 100_000])], ["g", "c"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            texts = [t for t in ((x.as_py() or "").strip() for x in b.column(0)) if len(t) >= n]
            for _, c, _, at in pieces(texts):
                held.append(np.unique(packed_grams(c, n, at), return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*summed(held))

    return run


@dataclass
class Packed:
    """Log probabilities by packed n-gram, in order; unseen: that of a character that the model lacks, NaN without a model."""

    keys: np.ndarray
    logs: np.ndarray
    unseen: float
    orders: list[int]

    def score(self, grams: np.ndarray) -> np.ndarray:
        """The log probability of each n-gram, or of its longest suffix of ``orders`` that the model has."""
        out = np.full(len(grams), self.unseen)
        if not len(self.keys):
            return out
        left = np.arange(len(grams))
        for k in self.orders:
            g = grams[left] & ((1 << (BITS * k)) - 1)
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            hit = self.keys[at] == g
            out[left[hit]] = self.logs[at[hit]]
            left = left[~hit]
        return out


def pack_model(model: NgramModel, backoff: str = "jump") -> Packed | None:
    """The model as arrays on the driver; None if its n-grams are too long or too many."""
    if model.n > PACKED_N or model.counts.count() > PACKED_GRAMS:
        return None
    got = probabilities(model, model.counts, backoff).select("g", F.ln("p").alias("l")).toArrow()
    keys = packed(got.column("g").to_pylist())
    order = np.argsort(keys)
    unseen = float(np.log(ALPHA / (model.tokens + ALPHA * model.vocabulary))) if model.tokens else float("nan")
    return Packed(keys[order], got.column("l").to_numpy()[order], unseen, _orders(model.n, backoff))


def _orders(n: int, backoff: str) -> list[int]:
    return list(dict.fromkeys([n, 1] if backoff == "jump" else range(n, 0, -1)))


def _perplexities(model: Packed, n: int):
    """A column function: the perplexity of each text. Not pushed through filters, as it would run once more."""

    @F.arrow_udf("double")
    def ppl(col: pa.Array) -> pa.Array:
        texts = [(x.as_py() or "").strip() for x in col]
        out = np.full(len(texts), np.inf)
        scored = [i for i, t in enumerate(texts) if len(t) > 1]
        for first, c, starts, at in pieces([texts[i] for i in scored]):
            logs = np.add.reduceat(model.score(packed_grams(c, n, at)), starts)
            sizes = np.diff(np.r_[starts, len(c)])
            out[scored[first : first + len(starts)]] = np.exp(-logs / sizes)
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return ppl.asNondeterministic()


def train(df: DataFrame, n: int = 3, text_col: str = "text") -> NgramModel:
    """Counts of all orders up to ``n``, from texts of at least ``n`` tokens, written once.

    Longest grams are counted from the texts once (with partial sums); shorter ones are sums over those.
    """
    if n <= PACKED_N:
        top = df.select(F.col(text_col)).mapInArrow(_counted(n), "g string, c long")
        return _model(top, n)
    long = df.filter(F.length(T.strip(F.coalesce(F.col(text_col), F.lit("")))) >= n)
    top = gram_stream(long, n, text_col, []).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    return _model(top, n)


def _model(top: DataFrame, n: int) -> NgramModel:
    suffixes = F.transform(F.sequence(F.lit(1), F.length("g")), lambda k: F.substr(F.col("g"), -k, k))
    counts = written(top.select(F.explode(suffixes).alias("g"), "c").groupBy("g").agg(F.sum("c").alias("c")), "ngrams")
    totals = counts.filter("length(g) = 1").agg(F.sum("c"), F.count(F.lit(1))).first()
    return NgramModel(counts, n, totals[0] or 0, totals[1] or 0)


def probabilities(model: NgramModel, grams: DataFrame, backoff: str = "jump") -> DataFrame:
    """(g, p): the probability of the last token of each distinct n-gram in ``grams`` after the others.

    Joins the count table for each order; the tables hold distinct n-grams, not tokens.
    """
    counts = model.counts
    out = grams.select("g").distinct()
    last = F.substr(F.col("g"), F.lit(-1), F.lit(1))
    out = out.withColumn("w", last).join(counts.select(F.col("g").alias("w"), F.col("c").alias("c1")), "w", "left")
    p0 = (F.coalesce("c1", F.lit(0)) + ALPHA) / (model.tokens + ALPHA * model.vocabulary)
    out = out.withColumn("p0", p0).withColumn("p", F.col("p0"))
    for k in range(2, model.n + 1):
        have = F.length("g") >= k
        suffix, ctx = F.when(have, F.substr(F.col("g"), F.lit(-k), F.lit(k))), F.when(have, F.substr(F.col("g"), F.lit(-k), F.lit(k - 1)))
        out = out.withColumn("s", suffix).withColumn("x", ctx)
        out = out.join(counts.select(F.col("g").alias("s"), F.col("c").alias("cs")), "s", "left").join(counts.select(F.col("g").alias("x"), F.col("c").alias("cx")), "x", "left")
        seen = (1 - DISCOUNT) * F.col("cs") / F.col("cx") + DISCOUNT * F.col("p")
        unseen = F.col("p0") if backoff == "jump" else F.col("p")
        out = out.withColumn("p", F.when(~have, F.col("p")).when((F.col("cs") > 0) & (F.col("cx") > 0), seen).otherwise(unseen)).drop("s", "x", "cs", "cx")
    return out.select("g", "p")


#: most n-grams whose probabilities are sent to every task (some 80 bytes each); more are joined by a shuffle
BROADCAST_GRAMS = 400_000


def with_log_probabilities(model: NgramModel, tokens: DataFrame, backoff: str = "jump") -> DataFrame:
    """``tokens`` (with g) with lnp, in one pass over them.

    The probabilities of the model's own n-grams are worked out once and written, and sent to all tasks if there are few.
    A token whose n-gram was not seen takes that of its last character, or of its longest seen suffix; one whose character
    was not seen takes the unigram estimate of a count of 0.
    """
    table = written(probabilities(model, model.counts, backoff).select(F.col("g").alias("_g"), F.ln("p").alias("_l")), "probabilities")
    table = F.broadcast(table) if table.count() <= BROADCAST_GRAMS else table
    out, found = tokens, []
    for k in _orders(model.n, backoff):
        suffix = F.substr(F.col("g"), -F.least(F.length("g"), F.lit(k)), F.lit(k))
        here = table.select(F.col("_g").alias(f"_g{k}"), F.col("_l").alias(f"_l{k}"))
        out = out.join(here, suffix == F.col(f"_g{k}"), "left")
        found.append(F.col(f"_l{k}"))
    unseen = ALPHA / (model.tokens + ALPHA * model.vocabulary) if model.tokens else None
    return out.select(*tokens.columns, F.coalesce(*found, F.ln(F.lit(unseen).cast("double"))).alias("lnp"))


def perplexity(model: NgramModel, df: DataFrame, keys: list[str], text_col: str = "text", backoff: str = "jump") -> DataFrame:
    """``df`` with ppl, infinite for texts of fewer than two tokens; a column of that name is replaced.

    Probabilities are worked out once for each n-gram of the model. A packed model scores each row where it is; else they
    meet the tokens in the task that made them and one sum per text is shuffled, and rows are told by keys and text: ids
    may be null or repeat.
    """
    rows = df.drop("ppl") if "ppl" in df.columns and "ppl" not in keys and text_col != "ppl" else df
    if (small := pack_model(model, backoff)) is not None:
        return rows.select(*rows.columns, _perplexities(small, model.n)(F.col(text_col)).alias("ppl"))
    tagged = rows.withColumn("_h", F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    names = [f"_k{i}" for i in range(len(keys))]
    texts = tagged.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_h").alias("_t"), F.col(text_col).alias("_text"))
    tokens = gram_stream(texts, model.n, "_text", [*names, "_t"])
    scored = with_log_probabilities(model, tokens, backoff).groupBy(*names, "_t").agg(F.exp(-F.avg("lnp")).alias("_ppl"), F.max("n_tokens").alias("_n"))
    on = F.col("_h") == F.col("_t")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    out = tagged.join(scored, on, "left")
    return out.select(*rows.columns, F.when(F.col("_n") >= 2, F.col("_ppl")).otherwise(F.lit(float("inf"))).alias("ppl"))


def filter_by_ppl(scored: DataFrame, threshold: float) -> DataFrame:
    """ppl rounded to two places, and ppl_pass by the unrounded value."""
    return scored.withColumn("ppl_pass", F.col("ppl") <= threshold).withColumn("ppl", F.round("ppl", 2))


def ppl_stats(filtered: DataFrame) -> DataFrame:
    finite = F.when(F.col("ppl") < float("inf"), F.col("ppl"))
    return filtered.agg(F.count_if("ppl_pass").alias("passed"), F.count_if(~F.col("ppl_pass")).alias("rejected"), F.min(finite).alias("ppl_min"), F.max(finite).alias("ppl_max"))


def hard_filter(filtered: DataFrame) -> DataFrame:
    return filtered.filter(F.coalesce("ppl_pass", F.lit(True)))


def calibrate(scored: DataFrame, label_col: str = "label", factor: float = 1.5) -> DataFrame:
    """Per label: count and figures of finite perplexities; threshold: 1.5 times the 95th percentile, one place."""
    x = written(scored.filter("ppl < double('inf')").select(label_col, F.col("ppl").cast("double").alias("ppl")), "calibration")
    figures = x.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"), F.avg("ppl").alias("ppl_mean"), F.min("ppl").alias("ppl_min"), F.max("ppl").alias("ppl_max"))
    out = join_groups(figures, percentiles(x, "ppl", {"ppl_median": 0.5, "ppl_p95": 0.95}, [label_col]), [label_col])
    return out.withColumn("threshold", F.round(F.col("ppl_p95") * factor, 1))


def text_perplexity(model: NgramModel, text: str, backoff: str = "jump") -> float:
    """The perplexity of one text."""
    one = model.counts.sparkSession.createDataFrame([(0, text)], "i int, text string")
    return perplexity(model, one, ["i"], backoff=backoff).first()["ppl"]


def pair_text(instruction, output):
    """Instruction and output with a line break between, or whichever is not empty: what a pair is scored on."""
    i, o = F.coalesce(instruction, F.lit("")), F.coalesce(output, F.lit(""))
    return F.when((i != "") & (o != ""), F.concat(i, F.lit("\n"), o)).otherwise(F.concat(i, o))


def score_pairs(pairs: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """``pairs`` (instruction, output) with ppl by a model of the pairs' own texts."""
    texts = pairs.withColumn("_pair", pair_text(F.col("instruction"), F.col("output")))
    return perplexity(train(texts, n, "_pair"), texts, keys, "_pair").drop("_pair")
