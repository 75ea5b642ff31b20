"""Comparison of two generators' rows, recent-duplicate removal, consistency flags, and sampling.

Defined cases: null texts have no length and no characters; they are never duplicates of anything. Ties of an order go
to the smaller id. Repeated rows count each time. Empty tables give empty results or null figures.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.written import written
from .instructions import top_bigrams
from .ranks import row_numbers


#: rows that one task scans on end, if chunks are smaller: some seconds' work
RUN_ROWS = 50_000


def length_gap(a: DataFrame, b: DataFrame, instruction: str = "instruction", output: str = "output") -> DataFrame:
    """(field, mean_a, mean_b, gap_pct): mean lengths, and their difference against the first mean (1 at least) in per cent."""

    def means(df: DataFrame, name: str) -> DataFrame:
        m = df.agg(F.avg(F.length(instruction)).alias("i"), F.avg(F.length(output)).alias("o"))
        return m.selectExpr(f"stack(2, 'instruction', i, 'output', o) AS (field, {name})")

    both = means(a, "mean_a").join(means(b, "mean_b"), "field")
    gap = F.abs(F.col("mean_a") - F.col("mean_b")) / F.greatest(F.col("mean_a"), F.lit(1.0)) * 100
    return both.select("field", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.round(gap, 4).alias("gap_pct"))


def cost_table(spark, rows: list[tuple[str, int, int, float]]) -> DataFrame:
    """(generator, calls, tokens, cost, cost_per_call) of stated costs."""
    df = spark.createDataFrame(rows, "generator string, calls long, tokens long, cost double")
    return df.withColumn("cost_per_call", F.round(F.col("cost") / F.nullif(F.col("calls"), F.lit(0)), 6))


def only_in(a: DataFrame, b: DataFrame, text_col: str = "text", n: int = 20, least: int = 3) -> DataFrame:
    """(side, bigram, n): the frequent bigrams that one side has among its top ``n`` and the other has not."""
    x, y = top_bigrams(a, text_col, n, least), top_bigrams(b, text_col, n, least)
    return x.join(y, "bigram", "left_anti").select(F.lit("a").alias("side"), "bigram", "n").unionByName(y.join(x, "bigram", "left_anti").select(F.lit("b").alias("side"), "bigram", "n"))


def seeds_in_both(a: DataFrame, b: DataFrame, key: str = "seed_id") -> DataFrame:
    """Rows of ``a`` whose seed ``b`` has too."""
    return a.join(b.select(key).distinct(), key, "left_semi")


def dedup_recent(df: DataFrame, order: str, text_col: str = "instruction", window: int = 20, threshold: float = 0.7, chunk: int = 50_000) -> DataFrame:
    """``df`` with recent_duplicate: whether a row's set of characters has a Jaccard similarity of the threshold or more with
    one of the last ``window`` rows that were kept before it, in the order of ``order`` (distinct).

    A scan by definition, done in runs of whole chunks, one run a task: each is scanned from the state that the run before
    it left in the round before, until no state changes. The first run is right after one round, each later one after its
    predecessor is, and as a state forgets all but its last rows, few rounds are needed; a round scans only runs whose
    state has changed. Only the states (at most ``window`` sets of characters a run) come to the driver.
    """
    rows = row_numbers(df.select(F.col(order).alias("_order"), F.col(text_col).alias("_text")), ["_order"], "_at")
    rows = written(rows.withColumn("_chunk", F.floor(F.col("_at") / chunk)), "recent")
    rows = rows.select("_order", "_text", "_at", F.floor(F.col("_chunk") / max(1, RUN_ROWS // chunk)).alias("_run"))

    def scan(start: dict[int, list[str]]):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("_at")
            k = t.column("_run")[0].as_py()
            bits: dict[str, int] = {}  # each character is a bit, so that a set is one number

            def packed(x: str) -> int:
                s = 0
                for c in set(x):
                    s |= bits.setdefault(c, 1 << len(bits))
                return s

            recent = deque((packed(x) for x in start.get(k, [])), maxlen=window)
            flags = []
            for x in t.column("_text"):
                s = packed(x.as_py() or "")
                dup = s != 0 and any((s & r).bit_count() >= threshold * (s | r).bit_count() for r in recent)
                flags.append(dup)
                if not dup:
                    recent.append(s)
            names = list(bits)
            state = ["".join(sorted(c for i, c in enumerate(names) if s >> i & 1)) for s in recent]
            return pa.table([t.column("_order"), pa.array(flags, pa.bool_()), pa.array([k] * len(flags), pa.int64()), pa.array([state if i == 0 else None for i in range(len(flags))], pa.list_(pa.string()))], names=["_order", "recent_duplicate", "_run", "state"])

        return run

    kind = rows.schema["_order"].dataType.simpleString()
    states: dict[int, list[str]] = {}  # by run: the state that it left,
    given: dict[int, list[str]] = {}  # the one that it was scanned from,
    last: dict[int, int] = {}  # and the round that scanned it last
    outs: list[DataFrame] = []
    todo: list[int] | None = None
    while todo is None or todo:
        some = rows if todo is None else rows.filter(F.col("_run").isin(todo))
        start = {k: states.get(k - 1, []) for k in todo or []}
        outs.append(written(some.groupBy("_run").applyInArrow(scan(start), f"_order {kind}, recent_duplicate boolean, _run long, state array<string>"), "recent"))
        for r in outs[-1].filter("state IS NOT NULL").select("_run", "state").collect():
            k = r["_run"]
            states[k], given[k], last[k] = r["state"], start.get(k, []), len(outs) - 1
        todo = [k for k in sorted(states) if states.get(k - 1, []) != given[k]]
    flagged = outs[0].limit(0)
    for i, out in enumerate(outs):
        flagged = flagged.unionByName(out.filter(F.col("_run").isin([k for k, n in last.items() if n == i])))
    return df.join(flagged.select(F.col("_order").alias(order), "recent_duplicate"), order)


def consistency_flags(vectors: DataFrame, id_col: str, vec_col: str, sample: int = 30, threshold: float = 0.95, seed: int = 42) -> DataFrame:
    """(id, nearest, flagged) of a sample of ``sample`` rows in md5 order, nearest: the largest cosine with another of them.

    The sample's size is the operator's feature. With fewer rows nothing is flagged.
    """
    head = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL").orderBy(T.md5_order(seed, F.col(id_col)), id_col).limit(sample)
    head = written(head, "consistency")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    both = head.alias("a").join(head.alias("b"), F.col("a.id") != F.col("b.id"))  # at most sample x sample rows
    cos = dot(F.col("a.v"), F.col("b.v")) / F.nullif(F.sqrt(dot(F.col("a.v"), F.col("a.v"))) * F.sqrt(dot(F.col("b.v"), F.col("b.v"))), F.lit(0.0))
    near = both.groupBy(F.col("a.id").alias("id")).agg(F.max(cos).alias("nearest"))
    enough = head.agg((F.count(F.lit(1)) >= sample).alias("enough"))
    return near.crossJoin(F.broadcast(enough)).select("id", "nearest", (F.col("enough") & (F.col("nearest") > threshold)).alias("flagged"))  # one row


def sample_rows(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement (all, if there are fewer): the first in md5 order of seed and id."""
    return df.orderBy(T.md5_order(seed, F.col(id_col)), id_col).limit(k)


def delta(before: DataFrame, after: DataFrame, value: str = "loss") -> DataFrame:
    """(before, after, delta, pct): means of ``value``, and the change against the first."""
    x = before.agg(F.avg(value).alias("before")).crossJoin(after.agg(F.avg(value).alias("after")))  # one row each
    d = F.col("after") - F.col("before")
    return x.select("before", "after", d.alias("delta"), (d / F.nullif(F.abs("before"), F.lit(0.0)) * 100).alias("pct"))
