"""Length profiles, corpus health, and before/after tables.

Defined cases: null texts have no length and enter no figure but ``count``; empty texts have a length and no ratios,
or, with ``empty`` (:data:`AS_SQL`), the ones given.
Null groups are groups. Repeated rows count each time. An empty table gives no groups and, without groups, one row of
nulls and zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import order_statistics
from .rules import URL

#: What SQL's division of doubles makes of an empty text: 1 - 0 / 0, and 1 / 0, as it splits into one empty character.
AS_SQL = (float("nan"), float("inf"))


def ratios(col, empty: tuple[float, float] | None = None):
    """The non-Han and repeat ratios; those of empty texts are null or the two of ``empty``."""
    both = T.non_script_ratio(col), T.repeat_ratio(col)
    return both if empty is None else tuple(F.when(F.length(col) == 0, F.lit(e)).otherwise(x) for x, e in zip(both, empty, strict=True))


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of a row per group side by side; null groups meet. Without keys both have one row."""
    if not keys:
        return left.crossJoin(right)
    r = right.toDF(*(f"_r_{c}" if c in keys else c for c in right.columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, on, "left").drop(*(f"_r_{k}" for k in keys))


def length_profile(df: DataFrame, text_col: str = "text", keys: list[str] = ()) -> DataFrame:
    keys = list(keys)
    n = df.select(*keys, F.length(text_col).alias("_len"))
    stats = order_statistics(n, "_len", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, keys)
    rest = n.groupBy(*keys).agg(F.min("_len").alias("len_min"), F.max("_len").alias("len_max"), F.count_if(F.col("_len") < 10).alias("n_short"), F.count_if(F.col("_len") > 10000).alias("n_long"))
    return join_groups(rest, stats, keys)


def ratio_profile(df: DataFrame, text_col: str = "text", keys: list[str] = (), empty: tuple[float, float] | None = None) -> DataFrame:
    """Means and maxima of the non-Han and repeat ratios (empty texts aside, or with the ratios ``empty``), and URL counts."""
    t = F.col(text_col)
    a, b = ratios(t, empty)
    urls = T.count_matches(t, URL)
    return (
        df.select(*keys, a.alias("a"), b.alias("b"), urls.alias("u"))
        .groupBy(*keys)
        .agg(F.avg("a").alias("non_cn_mean"), F.max("a").alias("non_cn_max"), F.avg("b").alias("repeat_mean"), F.max("b").alias("repeat_max"), F.count_if(F.col("u") > 0).alias("url_docs"), F.max("u").alias("max_urls"))
    )


def bigram_diversity(df: DataFrame, text_col: str = "text", seq: str = "doc_id", first: int | None = None) -> DataFrame:
    """Different over all character bigrams of all texts, or of the ``first`` ones by ``seq``."""
    rows = df if first is None else df.select(seq, text_col).orderBy(seq).limit(first)
    pairs = rows.select(F.explode(T.windows(F.col(text_col), 2)).alias("b"))
    return pairs.groupBy("b").count().agg(F.count(F.lit(1)).alias("distinct_bigrams"), F.sum("count").alias("bigrams")).withColumn("diversity", F.col("distinct_bigrams") / F.col("bigrams"))


def health(df: DataFrame, text_col: str = "text", keys: list[str] = (), ppl_col: str | None = None, empty: tuple[float, float] | None = None) -> DataFrame:
    """count, length mean, population deviation and cv, mean ratios and, if there is a perplexity, its figures."""
    keys = list(keys)
    t = F.col(text_col)
    a, b = ratios(t, empty)
    rows = df.select(*keys, F.length(t).cast("double").alias("n"), a.alias("a"), b.alias("b"), *([F.col(ppl_col).alias("p")] if ppl_col else []))
    finite = F.when(~F.isnan("p") & (F.abs("p") != float("inf")), F.col("p")) if ppl_col else None
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("n").alias("len_mean"),
        F.stddev_pop("n").alias("len_std"),
        (F.stddev_pop("n") / F.greatest(F.avg("n"), F.lit(1.0))).alias("len_cv"),
        F.avg("a").alias("non_cn_mean"),
        F.avg("b").alias("repeat_mean"),
        *([F.avg(finite).alias("ppl_mean"), F.stddev_pop(finite).alias("ppl_std"), F.max(finite).alias("ppl_max")] if ppl_col else []),
    )
    if ppl_col:
        median = order_statistics(rows.withColumn("p", finite), "p", {"ppl_median": 0.5}, keys)
        out = join_groups(out, median, keys)
    return out


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta and percent of two one-row health tables; metrics that both have."""

    def long(df: DataFrame, name: str) -> DataFrame:
        cols = ", ".join(f"'{c}', cast(`{c}` AS double)" for c in df.columns)
        return df.selectExpr(f"stack({len(df.columns)}, {cols}) AS (metric, {name})")

    both = long(before, "before").join(long(after, "after"), "metric")
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("pct", F.col("delta") / F.greatest(F.abs("before"), F.lit(1e-9)) * 100)
