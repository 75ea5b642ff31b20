"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded to a power of two, goes through pseudo-random rotations (three rounds of random signs
and a fast Hadamard transform); its hash is the nearest signed axis. A table joins ``hashes`` of them. All
rows are stored in every table under their own bucket; a query visits, in each table, its ``probes`` likeliest
buckets (multiprobe: by how far the query is from each axis). Candidates are ranked by their exact cosine in
double precision on the original vectors, inside the bucket, and only each bucket's best rows leave it.
Buckets of over ``block`` rows are dealt in blocks that are searched apart, so a hot bucket is many tasks.
Query rows whose buckets hold fewer than ``k`` ids are then compared with all rows of their length, in blocks of
both; so a query has fewer than ``k`` answers only where no more ids exist.

Defined cases: vectors null, zero, or holding null or non-finite components take no part. Vectors of different
lengths are never compared. Rows that repeat id and vector count once, and a query never finds rows of its own
id. Ties go to the smaller id. Null ids take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class CrossPolytopeConfig:
    tables: int = 12
    hashes: int = 1
    probes: int = 10
    block: int = 2048
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, config: CrossPolytopeConfig) -> np.ndarray:
    """(rows, tables, hashes, d) rotated unit vectors, with d the next power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    unit = np.zeros((len(x), d))
    unit[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng([config.seed, d])
    signs = rng.choice([-1.0, 1.0], (config.tables, config.hashes, 3, d))
    out = np.empty((len(x), config.tables, config.hashes, d))
    for t in range(config.tables):
        for k in range(config.hashes):
            y = unit
            for s in signs[t, k]:
                y = hadamard(y * s)
            out[:, t, k] = y
    return out


def own_buckets(x: np.ndarray, config: CrossPolytopeConfig) -> np.ndarray:
    """(rows, tables) bucket numbers: the nearest signed axis, 2 i or 2 i + 1 for its negative, of each hash."""
    y = rotations(x, config)
    i = np.abs(y).argmax(-1)
    v = 2 * i + (np.take_along_axis(y, i[..., None], -1)[..., 0] < 0)
    out = np.zeros(v.shape[:2], np.int64)
    for k in range(config.hashes):
        out = out * (2 * y.shape[-1]) + v[:, :, k]
    return out


def probe_buckets(x: np.ndarray, config: CrossPolytopeConfig) -> np.ndarray:
    """(rows, tables, probes) buckets in falling likelihood; the first is the own one."""
    y = rotations(x, config)
    d2 = 2 * y.shape[-1]
    both = np.stack([y, -y], -1).reshape(*y.shape[:3], d2)  # at 2 i: the axis, at 2 i + 1: its negative
    m = min(config.probes, d2**config.hashes)
    if config.hashes == 1:
        return np.argsort(-both[:, :, 0], axis=-1, kind="stable")[..., :m]
    few = min(m, d2)
    order = np.argsort(-both, axis=-1, kind="stable")[..., :few]
    loss = (np.take_along_axis(both, order[..., :1], -1) - np.take_along_axis(both, order, -1)) ** 2
    # ranks (r_1, ..., r_k) among the m best have a product of (r + 1) of at most m
    combos = [c for c in product(range(few), repeat=config.hashes) if np.prod([r + 1 for r in c]) <= m]
    sums = sum(loss[:, :, k][..., [c[k] for c in combos]] for k in range(config.hashes))
    codes = 0
    for k in range(config.hashes):
        codes = codes * d2 + order[:, :, k][..., [c[k] for c in combos]]
    return np.take_along_axis(codes, np.argsort(sums, axis=-1, kind="stable")[..., :m], -1)


def _matrices(b: pa.RecordBatch):
    """(row numbers, float64 matrix) for each vector length in a batch with columns id and vec."""
    lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
    flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.where(lengths == d)[0]
        yield rows, flat[at[rows][:, None] + np.arange(d)[None, :]]


_SCHEMA = pa.schema([("dim", pa.int32()), ("tab", pa.int32()), ("bucket", pa.int64()), ("id", pa.int64()), ("vec", pa.binary())])
_DDL = "dim int, tab int, bucket long, id long, vec binary"


def _hashed(rows: DataFrame, buckets) -> DataFrame:
    def run(batches):
        for b in batches:
            for k, x in _matrices(b):
                for s in range(0, len(k), 2048):
                    found = buckets(x[s : s + 2048])
                    found = found.reshape(*found.shape[:2], -1)
                    n, t, m = found.shape
                    ids = b.column(0).to_numpy()[k[s : s + 2048]]
                    vecs = pa.array([v.tobytes() for v in x[s : s + 2048]], pa.binary())
                    which = np.repeat(np.arange(n), t * m)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n * t * m, x.shape[1], np.int32)), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), m), n)), pa.array(found.ravel()), pa.array(ids[which]), vecs.take(pa.array(which))],
                        schema=_SCHEMA,
                    )

    return rows.mapInArrow(run, _DDL)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.filter(good)


def _search(stored: DataFrame, asked: DataFrame, g: list[str], k: int) -> DataFrame:
    """(query_id, dim, query, vec_id, score): the ``k`` nearest ids of each query row in each group ``g`` that it asks.

    ``query`` tells a query's row by a hash of its vector.
    """
    asked = asked.select(*g, "id", "vec", F.xxhash64("vec").alias("query")).toDF(*(f"q_{c}" for c in [*g, "id", "vec", "query"]))

    def search(rows: pa.Table, probes: pa.Table) -> pa.Table:
        d = 0
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and probes.num_rows:
            d = rows.column("dim")[0].as_py()
            ids, q, names = rows.column("id").to_numpy(), probes.column("q_id").to_numpy(), probes.column("q_query").to_numpy()
            x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(-1, d)
            y = np.frombuffer(b"".join(probes.column("q_vec").to_pylist()), np.float64).reshape(-1, d)
            by = np.argsort(ids, kind="stable")
            ids, x = ids[by], x[by]
            _, once = np.unique(np.concatenate([ids[:, None].view(np.float64), x], 1).view(f"V{8 * (d + 1)}").ravel(), return_index=True)
            once.sort()  # rows that repeat id and vector
            ids, x = ids[once], x[once]
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            starts = np.nonzero(np.r_[True, ids[1:] != ids[:-1]])[0]
            several = [(i, j) for i, j in zip(starts, [*starts[1:], len(ids)], strict=True) if j - i > 1]
            for s in range(0, len(q), 512):
                cos = (y[s : s + 512] @ x.T) / (ny[s : s + 512, None] * nx[None, :])
                for i, j in several:  # of an id's vectors the nearest
                    best = cos[:, i:j].argmax(1)
                    cos[:, i:j] = np.where(np.arange(j - i)[None, :] == best[:, None], cos[:, i:j], -np.inf)
                cos[q[s : s + 512, None] == ids[None, :]] = -np.inf
                # a matrix product may differ in its last bits between equal columns: rank without those, smaller ids first
                top = np.argsort(-np.round(cos, 13), axis=1, kind="stable")[:, :k]
                fine = np.isfinite(np.take_along_axis(cos, top, 1))
                a, b = s + np.nonzero(fine)[0], top[fine]
                new = q[a], names[a], ids[b], np.einsum("ij,ij->i", y[a], x[b]) / (ny[a] * nx[b])
                out = [np.concatenate(z) for z in zip(out, new, strict=True)]
        return pa.table({"query_id": out[0], "dim": pa.array(np.full(len(out[0]), d, np.int32)), "query": out[1], "vec_id": out[2], "score": out[3]})

    return stored.select(*g, "id", "vec").groupBy(*g).cogroup(asked.groupBy(*(f"q_{c}" for c in g))).applyInArrow(search, "query_id long, dim int, query long, vec_id long, score double")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best of the different ids found for each ``by``, with their rank."""
    once = found.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search_all(rows: DataFrame, short: DataFrame, k: int, config: CrossPolytopeConfig) -> DataFrame:
    """As ``_search``, with every row of its length for each query of ``short`` (dim, id, vec): blocks of rows meet blocks of queries."""
    count = lambda t, c: t.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / config.block).cast("int").alias(c))
    sizes = count(rows, "blocks").join(count(short, "q_blocks"), "dim")
    at = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = rows.join(F.broadcast(sizes), "dim").withColumn("block", at("blocks", "id")).withColumn("q_block", every("q_blocks"))
    asked = short.join(F.broadcast(sizes), "dim").withColumn("q_block", at("q_blocks", "id", "vec")).withColumn("block", every("blocks"))
    return _search(stored, asked, ["dim", "block", "q_block"], k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", config: CrossPolytopeConfig = CrossPolytopeConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` nearest rows found, other than its own id's; all rows where there are fewer."""
    rows, wanted = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    stored, asked = _hashed(rows, lambda x: own_buckets(x, config)), _hashed(wanted, lambda x: probe_buckets(x, config))
    g = ["dim", "tab", "bucket"]
    blocks = stored.groupBy(*g).agg(F.ceil(F.count(F.lit(1)) / config.block).cast("int").alias("blocks"))
    stored = stored.join(blocks, g).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = asked.join(blocks, g).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row = ["query_id", "dim", "query"]
    found = cut(_best(_search(stored, asked, [*g, "block"], k), row, k).select(*row, "vec_id", "score"), "nearest")
    plain = lambda t: _hashed(t, lambda x: np.zeros((len(x), 1), np.int64)).select("dim", "id", "vec")
    full = found.groupBy(*row).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "dim", "query")
    short = cut(plain(wanted).distinct().withColumn("query", F.xxhash64("vec")).join(full, ["id", "dim", "query"], "left_anti").select("dim", "id", "vec"), "short")
    if not short.isEmpty():
        found = found.unionByName(_search_all(plain(rows), short, k, config).select(*found.columns))
    return _best(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
