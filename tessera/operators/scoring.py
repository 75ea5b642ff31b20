"""Scores of instruction pairs: losses of an injected or surrogate model, their ratio, summaries, and embedding spread.

A scorer is a function from lists of contexts and of texts to mean losses per token; a heavy model sits behind it and
is never bundled. ``ngram_losses`` is a surrogate from count tables, for use without a model: it tells how well an
instruction's characters foretell the output, and is not a neural model's score.

Defined cases: null fields are empty texts; an empty output has no loss (null) and an infinite ratio. Infinite and NaN
ratios enter no mean. Vectors that are null, zero or not finite take no part. Repeated rows are each scored. Empty
tables give empty results or null figures.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ngram
from .curriculum import _finite, ifd
from .profile import join_groups
from .ranks import percentiles


def losses(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float | None]], instruction: str = "instruction", output: str = "output") -> DataFrame:
    """``pairs`` with loss_uncond (of the output alone) and loss_cond (after the instruction and a line break) by ``scorer``."""
    i, o = pairs.columns.index(instruction), pairs.columns.index(output)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", loss_uncond double, loss_cond double"

    def run(batches):
        for b in batches:
            texts = [x or "" for x in b.column(o).to_pylist()]
            contexts = [f"{x or ''}\n" for x in b.column(i).to_pylist()]
            alone, after = scorer([""] * len(texts), texts), scorer(contexts, texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alone, pa.float64()), pa.array(after, pa.float64())], [*b.schema.names, "loss_uncond", "loss_cond"])

    return pairs.mapInArrow(run, ddl)


def ngram_losses(pairs: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """(keys, loss_uncond, loss_cond) by a character model of the outputs.

    Both are the mean of -ln p over the output's characters; for the second, p is the mean of the model's probability
    after the instruction's end and the character's share of the instruction.
    """
    texts = pairs.select(*keys, T.strip(F.coalesce("instruction", F.lit(""))).alias("_i"), T.strip(F.coalesce("output", F.lit(""))).alias("_o")).filter("_o != ''")
    model = ngram.train(texts, n, "_o")
    if (small := ngram.pack_model(model, "stepwise")) is not None:
        sums = _pair_sums(texts, keys, small, n)
        return sums.groupBy(*keys).agg((-F.sum("_a") / F.sum("_n")).alias("loss_uncond"), (-F.sum("_b") / F.sum("_n")).alias("loss_cond"))
    lead = F.substr(F.concat(F.col("_i"), F.lit("\n")), F.lit(-(n - 1)), F.lit(n - 1))
    whole = texts.withColumn("_w", F.concat(lead, F.col("_o"))).withColumn("_skip", F.length(lead))
    grams = F.slice(T.windows(F.col("_w"), n, short=True), F.col("_skip") + 1, F.length("_o"))
    cond = whole.select(*keys, "_i", F.explode(grams).alias("g"))
    last = F.substr(F.col("g"), F.lit(-1), F.lit(1))
    cond = cond.groupBy(*keys, "_i", "g").agg(F.count(F.lit(1)).alias("_c"))
    cond = ngram.with_log_probabilities(model, cond, "stepwise")
    share = (F.length("_i") - F.length(F.replace(F.col("_i"), last, F.lit("")))) / F.greatest(F.length("_i"), F.lit(1))
    after = cond.groupBy(*keys).agg((-F.sum(F.col("_c") * F.ln(0.5 * F.exp("lnp") + 0.5 * share)) / F.sum("_c")).alias("loss_cond"))
    plain = texts.select(*keys, F.explode(T.windows(F.col("_o"), n, short=True)).alias("g"))
    alone = ngram.with_log_probabilities(model, plain, "stepwise").groupBy(*keys).agg((-F.avg("lnp")).alias("loss_uncond"))
    return join_groups(alone, after, keys)


def _pair_sums(texts: DataFrame, keys: list[str], model: ngram.Packed, n: int) -> DataFrame:
    """(keys, _a, _b, _n) of each pair (keys, _i, _o): sums of ln p over the output's characters, without and with the instruction, and their number."""
    k = len(keys)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:k]) + ", _a double, _b double, _n long"

    def grams(text: str) -> np.ndarray:
        c = ngram.codes(text)
        return ngram.packed_grams(c, n, np.arange(len(c)))

    def run(batches):
        for b in batches:
            out = []
            for i, o in zip(b.column(k), b.column(k + 1), strict=True):
                i, o = i.as_py(), o.as_py()
                lead = (i + "\n")[max(0, len(i) + 2 - n) :]
                alone, after = model.score(grams(o)), model.score(grams(lead + o)[len(lead) :])
                c, share = ngram.codes(o), 0.0
                if i:
                    kinds, times = np.unique(ngram.codes(i), return_counts=True)
                    at = np.minimum(np.searchsorted(kinds, c), len(kinds) - 1)
                    share = np.where(kinds[at] == c, times[at] / len(i), 0.0)
                out.append((alone.sum(), np.log(0.5 * np.exp(after) + 0.5 * share).sum(), len(o)))
            x = np.array(out, np.float64).reshape(-1, 3)
            sums = [pa.array(x[:, j], pa.float64(), mask=np.isnan(x[:, j])) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *sums, pa.array(x[:, 2].astype(np.int64))], [*keys, "_a", "_b", "_n"])

    return texts.select(*keys, "_i", "_o").mapInArrow(run, ddl)


def with_ifd(scored: DataFrame) -> DataFrame:
    """``scored`` with ifd_score, the ratio of its two losses."""
    return scored.withColumn("ifd_score", ifd(F.col("loss_cond"), F.col("loss_uncond")))


def ifd_summary(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """n_valid, mean, median, min and max of the finite ratios, and how many are under 1 and from 1, of each group."""
    keys = list(keys)
    x = _finite("ifd_score")
    figures = scored.groupBy(*keys).agg(F.count(x).alias("n_valid"), F.avg(x).alias("ifd_mean"), F.min(x).alias("ifd_min"), F.max(x).alias("ifd_max"), F.count_if(x < 1).alias("n_below"), F.count_if(x >= 1).alias("n_from"))
    median = percentiles(scored, x, {"ifd_median": 0.5}, keys)
    return join_groups(figures, median, keys)


def pair_profile(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n, and least, largest and mean lengths of instruction and output, of each group."""
    i, o = F.length("instruction"), F.length("output")
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(i).alias("inst_min"), F.max(i).alias("inst_max"), F.round(F.avg(i), 4).alias("inst_mean"), F.min(o).alias("out_min"), F.max(o).alias("out_max"), F.round(F.avg(o), 4).alias("out_mean")
    )


def embed(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text_col: str = "text", out: str = "embedding", batch: int = 32) -> DataFrame:
    """``df`` with the injected encoder's float vectors, ``batch`` texts at a time; a column of that name is replaced."""
    df = df.drop(out)
    k = df.columns.index(text_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} array<float>"

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                got = np.asarray(encoder([x or "" for x in part.column(k).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(got), pa.list_(pa.float32()))], [*part.schema.names, out])

    return df.mapInArrow(run, ddl)


def _units(batches):
    """Matrices of unit vectors (float64) of the valid rows of batches with one list column; all have one length."""
    for b in batches:
        rows = [np.asarray(x, np.float64) for x in b.column(0).to_pylist() if x and None not in x]
        rows = [x / np.linalg.norm(x) for x in rows if np.isfinite(x).all() and np.any(x)]
        if rows:
            if len({len(x) for x in rows}) > 1:
                raise ValueError("vectors of different lengths have no cosine")
            yield np.stack(rows)


def cosine_spread(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """n, cos_mean, cos_std and diversity over all pairs, from sums of unit vectors and of their outer products.

    Each task sums its batches; d + d^2 numbers a task are summed: no pairs, and no row per product.
    """

    def sums(batches):
        n, s, m = 0, None, None
        for u in _units(batches):
            if s is None:
                s, m = np.zeros(u.shape[1]), np.zeros((u.shape[1], u.shape[1]))
            n += len(u)
            s += u.sum(0)
            m += u.T @ u
        if n:
            at = np.arange(len(s) + m.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[float(n), s, m.ravel()]), pa.array(np.r_[0, [1] * len(s), [2] * m.size].astype(np.int32))], ["i", "x", "kind"])

    summed = vectors.select(vec_col).mapInArrow(sums, "i long, x double, kind int").groupBy("kind", "i").agg(F.sum("x").alias("x"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("x") * F.col("x")))
    one = summed.agg(F.sum(F.when(F.col("kind") == 0, F.col("x"))).cast("long").alias("n"), of(1).alias("s1"), of(2).alias("s2"))
    pairs = F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    mean = (F.col("s1") - F.col("n")) / pairs
    return one.select("n", F.round(mean, 4).alias("cos_mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("n")) / pairs - mean * mean)), 4).alias("cos_std"), F.round(1 - mean, 4).alias("diversity"))


def cosine_median(vectors: DataFrame, vec_col: str = "embedding", block: int = 2048, places: int = 6) -> DataFrame:
    """(cos_median): the median cosine of all pairs, to ``places`` decimal places.

    Counts of cosines (rounded to ``places``) come from blocks of rows that meet blocks: the pairs are inherent in the
    figure, but a task holds two blocks and what leaves it is a row per different value. For tables of moderate size.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("r"), F.col(vec_col).alias("v"))
    from ..sources.written import written

    rows = written(rows, "median")
    n = rows.count()
    blocks = max(1, -(-n // block))
    at = rows.withColumn("b", F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int"))
    left = at.withColumn("c", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))))
    right = at.withColumnRenamed("b", "c").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("c"))))

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        us = [list(_units(t.select(["v"]).to_batches())) for t in (x, y)]
        values, counts = np.zeros(0), np.zeros(0, np.int64)
        if us[0] and us[1]:
            a, b = np.concatenate(us[0]), np.concatenate(us[1])
            c = a @ b.T
            c = c[np.triu_indices(len(a), 1)] if x.column("b")[0].as_py() == x.column("c")[0].as_py() else c.ravel()
            values, counts = np.unique(np.round(c, places), return_counts=True)
        return pa.table({"x": pa.array(values, pa.float64()), "k": pa.array(counts, pa.int64())})

    def ordered(x: pa.Table, y: pa.Table) -> pa.Table:
        return count(x.sort_by("r"), y.sort_by("r")) if x.num_rows and y.num_rows else pa.table({"x": pa.array([], pa.float64()), "k": pa.array([], pa.int64())})

    found = left.select("b", "c", "r", "v").groupBy("b", "c").cogroup(right.select("b", "c", "r", "v").groupBy("b", "c")).applyInArrow(ordered, "x double, k long")
    from .ranks import cumulative

    ranked = cumulative(found.groupBy("x").agg(F.sum("k").alias("k")), "k", ["x"])
    place = 0.5 * (F.col("_all") - 1)
    pick = lambda r: F.min(F.when(F.col("_upto") > r, F.col("x")))
    return ranked.agg(F.round((pick(F.floor(place)) + pick(F.ceil(place))) / 2, 4).alias("cos_median"))


def eval_loss(items: DataFrame, scorer: Callable[[list[str], list[str]], list[float | None]], keys: list[str] = ()) -> DataFrame:
    """Mean loss of each group (for example band) of conversations, by the injected scorer: user turn as context."""
    x = items.select(*keys, F.col("conversations")[0]["content"].alias("instruction"), F.col("conversations")[1]["content"].alias("output"))
    return losses(x, scorer).groupBy(*keys).agg(F.count("loss_cond").alias("n"), F.avg("loss_cond").alias("eval_loss"))
