"""Character-shingle MinHash with banding, greedy star groups in scan order, and the best row of each group.

A text's neighbours are all texts that share a band's bucket. No pair of neighbours is ever made: a bucket is one row
of three numbers per member, each round of grouping goes over the members that no round has decided yet, and the last
few are scanned on the driver. Texts stay where they are until members are verified.

Defined cases: null texts and texts shorter than a shingle have no signature and are in no group. Equal texts are one
node whose place is its smallest id. Null ids take no part and their rows stay. Rows that repeat an id with one text
are one; of rows that repeat an id with different texts, each text is in its own group and ``keep_best`` drops a row
only if its text's digest was dropped. Ties of score go to the smaller id. Empty tables give empty results. Columns of
the input other than the named ones are kept and never read; a ``dedup_pass`` column is replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import text as T
from ..sources.written import written
from . import ngram
from .ranks import row_numbers

PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class DedupConfig:
    shingle: int = 3
    permutations: int = 128
    threshold: float = 0.6
    weights: tuple[float, float] = (0.5, 0.5)
    #: members stay in a group only if their exact similarity to its leader reaches the threshold; off: banding alone decides
    verify: bool = True
    seed: int = 42

    def __post_init__(self):
        if abs(sum(self.weights) - 1) > 1e-9:
            raise ValueError("the weights of false positives and negatives must add up to 1")


def band_shape(threshold: float, permutations: int, weights=(0.5, 0.5)) -> tuple[int, int]:
    """Bands and rows with the least weighted area of false positives and false negatives (midpoint sums)."""
    best = None
    grid = [(i + 0.5) / 1000 for i in range(1000)]
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            hit = [1 - (1 - s**r) ** b for s in grid]
            fp = sum(h for s, h in zip(grid, hit, strict=True) if s < threshold) / 1000
            fn = sum(1 - h for s, h in zip(grid, hit, strict=True) if s >= threshold) / 1000
            error = weights[0] * fp + weights[1] * fn
            if best is None or error < best[0]:
                best = (error, b, r)
    return best[1], best[2]


def hash_family(n: int, seed: int) -> list[tuple[int, int]]:
    import random

    r = random.Random(seed)
    return [(r.randrange(1, PRIME), r.randrange(PRIME)) for _ in range(n)]


def shingles(col, n: int = 3):
    """The different substrings of length n; empty for shorter texts."""
    return F.array_distinct(T.windows(col, n))


#: most texts that are packed at once, and most shingles whose hashes a task keeps
TEXTS, KEPT_HASHES = 64, 500_000


def hash28(x: str) -> int:
    """28 bits of md5 by shingle: the same in any SQL engine."""
    return int(hashlib.md5(x.encode()).hexdigest()[:7], 16)


class ShingleHashes:
    """``hash28`` of shingles, found on first use and kept: as two arrays by packed shingle, or by text if those are long."""

    def __init__(self, shingle: int):
        self.n, self.keys, self.hashes, self.long = shingle, np.zeros(0, np.int64), np.zeros(0, np.int64), {}

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The hashes of each text's different shingles; texts have at least one."""
        if self.n > ngram.PACKED_N:
            return [np.array([self._long(x) for x in {t[i : i + self.n] for i in range(len(t) - self.n + 1)}], np.int64) for t in texts]
        return [h for _, c, starts, at in ngram.pieces(texts, 1 << 16) for h in self._packed(ngram.packed_grams(c, self.n, at), starts, at)]

    def _long(self, x: str) -> int:
        if len(self.long) > KEPT_HASHES:
            self.long.clear()
        if x not in self.long:
            self.long[x] = hash28(x)
        return self.long[x]

    def _packed(self, grams: np.ndarray, starts: np.ndarray, at: np.ndarray):
        sets = [np.unique(g[a >= self.n - 1]) for g, a in zip(np.split(grams, starts[1:]), np.split(at, starts[1:]), strict=True)]
        need = np.unique(np.concatenate(sets))
        new = need[~np.isin(need, self.keys)] if len(self.keys) else need
        if len(new):
            if len(self.keys) + len(new) > KEPT_HASHES:
                new, self.keys, self.hashes = need, np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys = np.concatenate([self.keys, new])
            hashes = np.concatenate([self.hashes, np.fromiter(map(hash28, ngram.unpacked(new)), np.int64, len(new))])
            order = np.argsort(keys)
            self.keys, self.hashes = keys[order], hashes[order]
        return [self.hashes[np.searchsorted(self.keys, x)] for x in sets]


def least(h: np.ndarray, family: np.ndarray) -> np.ndarray:
    """For each (a, b) of ``family`` the least (a h + b) mod p."""
    out = np.full(len(family), PRIME, np.uint64)
    p, bits = np.uint64(PRIME), np.uint64(31)
    for s in range(0, len(h), 1024):  # a long text has many shingles
        x = family[:, :1] * h[None, s : s + 1024].astype(np.uint64) + family[:, 1:]
        x = (x & p) + (x >> bits)  # the same mod 2^31 - 1, and less than twice that
        np.minimum(out, np.minimum(x, x - p).min(1), out=out)  # the difference wraps where x is less
    return out.astype(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, permutations: int, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, sig): for each permutation the least (a h + b) mod p. Texts without shingles are left out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") >= shingle)
    return _signed(rows, permutations, shingle, seed)


def _signed(rows: DataFrame, permutations: int, shingle: int, seed: int) -> DataFrame:
    """``rows`` with sig in place of their last column, the text."""
    family = np.array(hash_family(permutations, seed), np.uint64)
    names = [*rows.columns[:-1], "sig"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", sig array<long>"

    def run(batches):
        hashes = ShingleHashes(shingle)
        for b in batches:
            for s in range(0, b.num_rows, TEXTS):
                part = b.slice(s, TEXTS)
                sig = np.concatenate([least(h, family) for h in hashes.of(part.column(part.num_columns - 1).to_pylist())])
                ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * permutations)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(sig))], names)

    return rows.mapInArrow(run, ddl)


def band_keys(bands: int, rows: int):
    """An array of the bands' keys: the md5 of each band's values."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.md5(F.array_join(F.slice("sig", i * rows + 1, rows), "-")))


def banded(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, band, key): a row per member and bucket; key is the md5 of the band's values."""
    return sig.select("id", F.posexplode(band_keys(bands, rows)).alias("band", "key"))


def bucket_sizes(members: DataFrame) -> DataFrame:
    """(band, key, n, least) of the buckets with several members."""
    return members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("n > 1")


#: rows of undecided members that are scanned on the driver (24 bytes each)
LOCAL_ROWS = 200_000


def leader_groups(members: DataFrame, one_a_band: bool = False) -> DataFrame:
    """(id, leader) of all ids that share a bucket (band, key), as a scan in id order would group them.

    A node leads if no smaller neighbour leads; others belong to their smallest leading neighbour. All members of a
    bucket are neighbours, so a bucket has one leader at most. A node that is the smallest undecided one in all of its
    buckets leads, and all other undecided members of its buckets follow at once: a round decides both, and none of the
    buckets that it leaves is led. With ``one_a_band`` a member is in one bucket of a band, which its least member then
    tells instead of the key. Rounds are written.
    """
    of_key, of_bucket, of_id = Window.partitionBy("band", "key"), Window.partitionBy("band", "least"), Window.partitionBy("id")
    shared = members.select("id", "band", "key", F.min("id").over(of_key).alias("least"), F.max("id").over(of_key).alias("most")).filter("most > least")
    shared = written(shared.select("id", "band", "least" if one_a_band else F.col("key").alias("least")), "buckets")
    whole = isinstance(shared.schema["id"].dataType, IntegralType)
    rest, leaders = shared, []
    while (left := rest.count()) > (LOCAL_ROWS if whole else 0):
        first = rest.withColumn("_m", F.min("id").over(of_bucket)).withColumn("leads", F.min(F.col("_m") == F.col("id")).over(of_id))
        led = first.withColumn("_l", F.max("leads").over(of_bucket)).withColumn("decided", F.max("_l").over(of_id))
        done = written(led.select("id", "band", "least", "leads", "decided"), "leaders")
        leaders.append(done.filter("leads").select("id").distinct())
        rest = done.filter("NOT decided").select("id", "band", "least")
    if left:
        leaders.append(_scanned(rest))
    lead = leaders[0] if leaders else shared.select("id").limit(0)
    for x in leaders[1:]:
        lead = lead.unionByName(x)
    flagged = shared.join(lead.withColumn("leads", F.lit(True)), "id", "left")
    near = flagged.withColumn("_l", F.min(F.when(F.col("leads"), F.col("id"))).over(of_bucket))
    # a leader's own buckets are led by itself; others take the smallest leader below them
    return near.groupBy("id").agg(F.min(F.when(F.col("_l") <= F.col("id"), F.col("_l"))).alias("leader"))


def _scanned(rest: DataFrame) -> DataFrame:
    """The leaders (id) among few members, none of whose buckets is led."""
    t = rest.distinct().toArrow().sort_by("id")
    led, leaders, at = set(), [], 0
    ids, buckets = t.column("id").to_pylist(), list(zip(t.column("band").to_pylist(), t.column("least").to_pylist(), strict=True))
    while at < len(ids):
        end = at
        while end < len(ids) and ids[end] == ids[at]:
            end += 1
        if led.isdisjoint(buckets[at:end]):
            leaders.append(ids[at])
            led.update(buckets[at:end])
        at = end
    return rest.sparkSession.createDataFrame(pa.table({"id": pa.array(leaders, t.schema.field("id").type)}), f"id {rest.schema['id'].dataType.simpleString()}")


def _alike(shingle: int):
    """A column function: the Jaccard similarity of the shingle sets of two texts."""

    def sets(t: str):
        if shingle > ngram.PACKED_N:
            return np.array(sorted({t[i : i + shingle] for i in range(len(t) - shingle + 1)}))
        c = ngram.codes(t)
        return np.unique(ngram.packed_grams(c, shingle, np.arange(len(c)))[shingle - 1 :])

    @F.arrow_udf("double")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, y = [], None, None
        for s, t in zip(a, b, strict=True):
            x, t = sets(s.as_py()), t.as_py()
            if t != last:  # rows of a leader follow each other
                last, y = t, sets(t)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    return alike


def verified(led: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``led`` (id, leader) without the members whose Jaccard similarity to their leader is under the threshold.

    ``texts`` (id, text) may repeat rows. Only texts are dealt: shingles are made where two texts meet.
    """
    follow = led.filter("id <> leader")
    own = texts.join(follow, "id")
    lead = texts.join(follow.select(F.col("leader").alias("id")).distinct(), "id").groupBy(F.col("id").alias("leader")).agg(F.first("text").alias("_l"))
    near = own.join(lead, "leader").filter(_alike(shingle)(F.col("text"), F.col("_l")) >= threshold).select("id", "leader").distinct()
    near = written(near, "near")
    return near.unionByName(near.select(F.col("leader").alias("id"), "leader").distinct())


def quality_score(text, ppl=None, extras: tuple = ()):
    """100 / ppl, a length bonus between 100 and 2000 characters, and 2 if any of the extra columns has a value."""
    n = F.length(text)
    p = F.coalesce(ppl, F.lit(100.0)) if ppl is not None else F.lit(100.0)
    score = F.when(p == 0, F.lit(0.0)).otherwise(100 / F.greatest(p, F.lit(1.0))) + F.when((n > 100) & (n < 2000), F.least(n, F.lit(500)) / 500).otherwise(F.lit(0.0))
    filled = F.lit(False)
    for e in extras:
        filled = filled | F.coalesce(e != "", F.lit(False))
    return score + F.when(filled, F.lit(2.0)).otherwise(F.lit(0.0))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: DedupConfig = DedupConfig()) -> DataFrame:
    """(id, digest, leader_id, leader) of every row in a group of two or more. Equal texts are one node, at their smallest id."""
    rows = df.select(F.col(id_col).alias("id"), F.md5(text_col).alias("digest"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= config.shingle))
    b, r = band_shape(config.threshold, config.permutations, config.weights)
    keys = F.transform(band_keys(b, r), lambda k: F.unhex(k))
    signed = written(_signed(rows, b * r, config.shingle, config.seed).select("id", "digest", keys.alias("keys")), "signatures")
    # a node is a text: its place is its smallest id, with the digest behind it where texts share an id
    nodes = row_numbers(signed.groupBy("digest").agg(F.min("id").alias("id")), ["id", "digest"], "n")
    nodes = written(nodes.select("id", "digest", "n"), "nodes")
    led = leader_groups(signed.join(nodes, ["id", "digest"]).select(F.col("n").alias("id"), F.posexplode("keys").alias("band", "key")), one_a_band=True)
    if config.verify:
        led = verified(written(led, "led"), rows.join(nodes, ["id", "digest"]).select(F.col("n").alias("id"), "text"), config.threshold, config.shingle)
    # each node's leader, itself if it has none
    place = nodes.join(led.select(F.col("id").alias("n"), "leader"), "n", "left").select(F.col("digest").alias("_d"), F.coalesce("leader", "n").alias("_n"))
    leads = nodes.select(F.col("n").alias("_n"), F.struct("id", "digest").alias("leader"))
    out = signed.select("id", "digest").distinct().join(place, F.col("digest") == F.col("_d"))
    out = written(out.select("id", "digest", "_n"), "copies")
    sizes = out.groupBy("_n").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    return out.join(sizes.join(leads, "_n"), "_n").select("id", "digest", F.col("leader.id").alias("leader_id"), "leader")


def keep_best(df: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text", ppl_col: str | None = None, extras: tuple[str, ...] = ()) -> DataFrame:
    """Rows outside groups, and of each group the row with the best score (ties: the smallest id), with dedup_pass.

    The best row of a group is the largest by one aggregate, not by a sort of the group.
    """
    score = quality_score(F.col(text_col), F.col(ppl_col) if ppl_col else None, tuple(F.col(e) for e in extras))
    scored = df.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("digest"), score.alias("score")).join(grouped.select("id", "digest", "leader"), ["id", "digest"])
    best = scored.groupBy("leader").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "digest")).alias("best"))
    gone = grouped.join(best, "leader").filter((F.col("id") != F.col("best.id")) | (F.col("digest") != F.col("best.digest"))).select(F.col("id").alias("_gone"), F.col("digest").alias("_digest"))
    # the digest is a column of its own, so that the join deals no texts where none are asked for
    rows = df.drop("dedup_pass").withColumn("_tag", F.md5(F.col(text_col)))
    return rows.join(gone, (F.col(id_col) == F.col("_gone")) & (F.col("_tag") == F.col("_digest")), "left_anti").drop("_tag").withColumn("dedup_pass", F.lit(True))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule_config=None, max_ppl: float = 30.0, config: DedupConfig = DedupConfig()) -> DataFrame:
    """The whole cleaning run: rules, perplexity by a model of what they keep, and near-duplicates; with ppl and dedup_pass."""
    from . import ngram, rules

    kept = written(rules.keep(df, text_col, rule_config or rules.RuleConfig()), "passed")
    scored = ngram.filter_by_ppl(ngram.perplexity(ngram.train(kept, text_col=text_col), kept, [id_col], text_col), max_ppl)
    passed = written(ngram.hard_filter(scored), "scored")
    return keep_best(passed, groups(passed, id_col, text_col, config), id_col, text_col, "ppl")


