"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A document's weighted set holds its five-word shingles (lower-case words; a text of one to four words is one
shingle) with their counts as weights. Similarity is the probability Jaccard index
``J_P(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)``, which on unweighted sets is the plain index.

1. Texts with equal words become one content (a 128-bit digest), so copies are never compared.
2. Each content gets a signature: every shingle is a Poisson process of arrivals at random components with a
   rate of its weight; a component keeps the earliest. A shingle stops when its next arrival is later than
   all components' earliest. Two signatures agree in a component with probability J_P.
3. Bands of the signature make buckets. Every member is compared with the bucket's hub (the member with most
   bucket mates overall), exactly. Members that are not in their hub's component are then compared with the
   other members whose signatures leave a similarity of the threshold possible (first by the signature, then by
   a longer one that only such members get). They are verified exactly where they meet, and only links leave the
   task. Both sides of a bucket are dealt in blocks, so none meets in one task.
4. Classes are the connected components of the verified pairs (large-star, small-star).

Defined cases: null and empty texts have no shingles and are singletons. Repeated rows are returned each time.
A class is named by its smallest doc_id (nulls aside), and where that is no name of its own, by a negative hash: ids may
repeat with different texts, or be null, and classes are of contents. A text without words has its own id, or null. An empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import cut, mix64, unused


@dataclass(frozen=True)
class ProbMinHashConfig:
    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 5
    #: a pair's estimate may be so many standard deviations under the threshold and still be verified
    deviations: float = 5.0
    #: components of the longer signature of residual members, a byte each
    fine: int = 512
    block: int = 1024

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def least_estimate(self, size: int) -> float:
        t = self.threshold
        return t - self.deviations * (t * (1 - t) / size) ** 0.5


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles, one per position (so repeats are weights)."""
    if not words:
        return np.zeros(0, np.uint64)
    h = mix64(np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words)) + np.uint64(1))
    short = np.uint64(len(words) if len(words) < k else 0)
    k = min(k, len(words))
    out = h[: len(h) - k + 1] + short
    for j in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return mix64(out)


class _WordHashes(dict):
    """64-bit hashes of words, found on first use; emptied at 300,000 words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h


_word_hashes = _WordHashes()


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """ProbMinHash signatures (rows of m uint32) of weighted sets, given as distinct hashes and weights.

    All sets advance together: in round r every active element sends its r-th arrival. An element is active
    while its arrival is earlier than the latest of its set's components. Empty sets have rows of zeros.
    """
    n = len(sets)
    q = np.full(n * m, np.inf)
    z = np.zeros(n * m, np.uint32)
    lengths = np.array([len(s[0]) for s in sets], np.int64)
    doc = np.repeat(np.arange(n), lengths)
    if not len(doc):
        return z.reshape(n, m)
    e = np.concatenate([s[0] for s in sets])
    w = np.concatenate([s[1] for s in sets]).astype(float)
    name = (mix64(e ^ np.uint64(0xA5A5A5A5)) >> np.uint64(32)).astype(np.uint32)
    t = np.zeros(len(e))
    r = 0
    while len(e):
        r += 1
        x = mix64(e + np.uint64((r * 0xD1B54A32D192ED03) & (2**64 - 1)))
        # the upper 40 bits give the waiting time, the lower 24 the component; every element has the same share of arrivals in one component
        t = t - np.log(((x >> np.uint64(24)).astype(float) + 0.5) * 2.0**-40) / w
        at = doc * m + ((x & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        better = t < q[at]
        a, ta = at[better], t[better]
        np.minimum.at(q, a, ta)
        won = q[a] == ta
        z[a[won]] = name[better][won]
        on = t < q.reshape(n, m).max(1)[doc]
        if not on.all():
            e, w, t, doc, name = e[on], w[on], t[on], doc[on], name[on]
    return z.reshape(n, m)


def j_p(x: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two multisets, given as arrays of hashes with repeats."""
    if not len(x) or not len(y):
        return 0.0
    a, ca = np.unique(x, return_counts=True)
    b, cb = np.unique(y, return_counts=True)
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    # sum_j max(x_j / x_i, y_j / y_i) depends on i by x_i and y_i only: with c = x_i / y_i, elements whose ratio is >= c take x_j / x_i
    xs, ys = np.concatenate([ca[ia], np.delete(ca, ia), np.zeros(len(b) - len(both))]), np.concatenate([cb[ib], np.zeros(len(a) - len(both)), np.delete(cb, ib)])
    total = 0.0
    pairs, counts = np.unique(np.stack([ca[ia], cb[ib]], 1), axis=0, return_counts=True)
    for (xi, yi), k in zip(pairs, counts, strict=True):
        total += k / np.maximum(xs / xi, ys / yi).sum()
    return float(total)


def content_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _parts(b: pa.RecordBatch, k: int, rows: int = 256, size: int = 1 << 20):
    """``b`` in slices of at most ``rows`` rows whose values in column ``k`` have ``size`` bytes at most, or of one row.

    Words take some ten times the memory of their text, so those of a whole Arrow batch (10,000 rows) are not held at once.
    """
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(k)), 0).to_numpy(zero_copy_only=False).tolist()):
        if i > start and (i - start == rows or held + n > size):
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < b.num_rows:
        yield b.slice(start)


def _sketch(config: ProbMinHashConfig):
    schema = pa.schema([("id", pa.int64()), ("content", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for b in batches:
            for part in _parts(b, 1):
                words = [(t.as_py() or "").encode().lower().split() for t in part.column(1)]
                sig = signatures([np.unique(shingles(w, config.words), return_counts=True) for w in words], config.size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([content_of(w) if w else None for w in words], pa.binary()), pa.array([s.tobytes() if w else None for s, w in zip(sig, words, strict=True)], pa.binary())], schema=schema
                )

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ProbMinHashConfig = ProbMinHashConfig()) -> DataFrame:
    """(id, content, sig) of each row; content and sig are null where a text has no words."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sketch(config), "id long, content binary, sig binary")


def _shingle_table(pairs: DataFrame, docs: DataFrame, text_col: str, config: ProbMinHashConfig) -> DataFrame:
    """(content, shingles) of the contents in ``pairs``: the texts are read again and shuffled once."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()

    def contents(batches):
        for b in batches:
            for part in _parts(b, 0):
                words = [(t.as_py() or "").encode().lower().split() for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([content_of(w) if w else None for w in words], pa.binary()), part.column(0)], ["content", "text"])

    def sets(batches):
        for b in batches:
            for part in _parts(b, 1):
                s = [np.sort(shingles(t.as_py().encode().lower().split(), config.words)).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.binary())], ["content", "shingles"])

    texts = docs.select(F.col(text_col).alias("text")).mapInArrow(contents, "content binary, text string")
    held = texts.join(wanted.hint("shuffle_hash"), "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
    return cut(held.mapInArrow(sets, "content binary, shingles binary"), "shingles")


def _verified(pairs: DataFrame, held: DataFrame, config: ProbMinHashConfig) -> DataFrame:
    """The pairs (a, b, of contents) whose exact similarity reaches the threshold."""

    def similar(batches):
        for b in batches:
            same = [j_p(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.float64())], ["a", "b", "similarity"])

    both = pairs.join(held.select(F.col("content").alias("a"), F.col("shingles").alias("sa")), "a").join(held.select(F.col("content").alias("b"), F.col("shingles").alias("sb")), "b")
    tried = both.select("a", "b", "sa", "sb").mapInArrow(similar, "a binary, b binary, similarity double")
    return tried.filter(F.col("similarity") >= config.threshold - 1e-12).select("a", "b")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the smallest node of the connected component.

    Large-star and small-star rounds, each written to the shared folder; ends when a round changes nothing.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    before = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:  # the same edges again: every node points at its root
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        before = now


def _open_members(buckets: DataFrame, roots: DataFrame, config: ProbMinHashConfig) -> DataFrame:
    """(band, key, content, root, hub_root, blocks, rest_blocks): the members of the buckets that hold several components.

    Of buckets with the same members only that of the first band stays: the others hold the same pairs.
    """
    b = buckets.join(roots.select(F.col("node").alias("content"), "root"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    print_of = [F.bit_xor(F.xxhash64(F.lit(i), F.col("content"))).alias(f"x{i}") for i in range(2)]
    w = b.groupBy("band", "key").agg(F.max_by("root", F.struct("degree", "content")).alias("hub_root"), F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), *print_of).filter("lo < hi")
    first = w.groupBy("n", "x0", "x1").agg(F.min_by(F.struct("band", "key", "hub_root"), "band").alias("f")).select("f.*", F.ceil(F.col("n") / config.block).cast("int").alias("blocks"))
    b = b.join(first, ["band", "key"])
    rest = b.groupBy("band", "key").agg(F.ceil(F.count_if(F.col("root") != F.col("hub_root")) / config.block).cast("int").alias("rest_blocks"))
    return b.join(rest, ["band", "key"]).select("band", "key", "content", "root", "hub_root", "blocks", "rest_blocks")


def _signs(members: DataFrame, distinct: DataFrame, held: DataFrame, config: ProbMinHashConfig) -> DataFrame:
    """(content, sig, fine, shingles) of the members' contents; fine is a longer signature of which each component keeps a byte."""

    def run(batches):
        for b in batches:
            for part in _parts(b, 2, rows=64):
                sets = [np.unique(np.frombuffer(x.as_py(), np.uint64), return_counts=True) for x in part.column(2)]
                fine = (signatures(sets, config.fine) & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in fine], pa.binary()), part.column(2)], ["content", "sig", "fine", "shingles"])

    wanted = members.select("content").distinct()
    return wanted.join(distinct, "content").join(held, "content").select("content", "sig", "shingles").mapInArrow(run, "content binary, sig binary, fine binary, shingles binary")


def _residual_links(members: DataFrame, signs: DataFrame, config: ProbMinHashConfig) -> DataFrame:
    """Links (a, b) across components in one bucket: enough of them to join all components that exact similarity links.

    A residual member is one outside the component of its bucket's hub; it meets the bucket's other members in blocks
    of both. Pairs are verified where they meet, each in the first band that it shares and once there, the likeliest
    first; those of components that the block has joined by then are passed over, so no block gives more links than
    it has members.
    """
    m = members.join(signs, "content")
    at = lambda n: F.pmod(F.xxhash64(F.lit(n), F.col("content")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["band", "key", "block", "rest_block", "content", "root", "outside", "sig", "fine", "shingles"]
    m = m.withColumn("outside", F.col("root") != F.col("hub_root"))
    here = m.withColumn("block", at("blocks")).withColumn("rest_block", every("rest_blocks"))
    rest = m.filter("outside").withColumn("rest_block", at("rest_blocks")).withColumn("block", every("blocks"))
    least, least_fine = config.least_estimate(config.size) * config.size, config.least_estimate(config.fine) * config.fine

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"a": [], "b": []}
        if left.num_rows and right.num_rows:
            right = right.rename_columns(cols)
            read = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)
            names, others, band = left.column("content").to_pylist(), right.column("content").to_pylist(), left.column("band")[0].as_py()
            codes: dict[bytes, int] = {}
            code = lambda t: np.array([codes.setdefault(x, len(codes)) for x in t.column("root").to_pylist()])
            mine, theirs = code(right), code(left)
            parent = list(range(len(codes)))

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            shingles_at = lambda t, i: np.frombuffer(t.column("shingles")[i].as_py(), np.uint64)
            outside = np.array(left.column("outside").to_pylist())
            sig, fine = read(left, "sig", np.uint32), read(left, "fine", np.uint8)
            for i, (s, f) in enumerate(zip(read(right, "sig", np.uint32), read(right, "fine", np.uint8), strict=True)):
                same = sig == s
                k = np.where((same.sum(1) >= least) & (theirs != mine[i]))[0]
                k = k[same[k].reshape(len(k), config.bands, config.rows).all(2).argmax(1) == band]
                near = (fine[k] == f).sum(1)
                k, near = k[near >= least_fine], near[near >= least_fine]
                once = np.array([not outside[j] or names[j] < others[i] for j in k], bool)  # two outside members meet twice
                k, near = k[once], near[once]
                mine_set = shingles_at(right, i) if len(k) else None
                for j in map(int, k[np.argsort(-near, kind="stable")]):
                    x, y = find(int(mine[i])), find(int(theirs[j]))
                    if x != y and j_p(mine_set, shingles_at(left, j)) >= config.threshold - 1e-12:
                        parent[x] = y
                        out["a"].append(max(others[i], names[j]))
                        out["b"].append(min(others[i], names[j]))
        return pa.table({c: pa.array(v, pa.binary()) for c, v in out.items()})

    g = cols[:4]
    rest = rest.select(cols).toDF(*(f"r_{c}" for c in cols))
    return here.select(cols).groupBy(*g).cogroup(rest.groupBy(*(f"r_{c}" for c in g))).applyInArrow(compare, "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ProbMinHashConfig = ProbMinHashConfig()) -> DataFrame:
    """(id, content, root) of every row of ``docs``: root is the smallest content of its class; both are null for texts without words."""
    sk = cut(sketches(docs, id_col, text_col, config), "sketches")
    distinct = sk.filter("content IS NOT NULL").groupBy("content").agg(F.first("sig").alias("sig"))
    size = 4 * config.rows
    bands = F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(F.col("sig"), i * size + 1, F.lit(size))).alias("key")))
    each = distinct.select("content", F.explode(bands).alias("x")).select("content", "x.*")
    counts = each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = each.join(counts, ["band", "key"])
    members = cut(members, "buckets")
    degrees = members.groupBy("content").agg(F.sum("n").alias("degree"))
    buckets = members.join(degrees, "content")
    hubs = buckets.groupBy("band", "key").agg(F.max_by("content", F.struct("degree", "content")).alias("hub"))
    stars = members.join(hubs, ["band", "key"]).filter("content != hub").select(F.greatest("content", "hub").alias("a"), F.least("content", "hub").alias("b")).distinct()
    tried = cut(stars, "stars")
    # every member of a bucket is in a star, so the residual members need no other shingles
    held = _shingle_table(tried, docs, text_col, config)
    links = cut(_verified(tried, held, config), "links")
    roots = components(links)
    opened = cut(_open_members(buckets, roots, config), "open")
    if not opened.isEmpty():
        more = cut(_residual_links(opened, cut(_signs(opened, distinct, held, config), "signs"), config), "links")
        if not more.isEmpty():
            roots = components(links.union(more))
    return sk.select("id", "content").join(roots.withColumnRenamed("node", "content"), "content", "left").select("id", "content", F.coalesce("root", "content").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ProbMinHashConfig = ProbMinHashConfig()) -> DataFrame:
    """(doc_id, class_id, content) of every row of ``docs``; content is null for texts without words.

    A class is named by its smallest id. Where several classes have one smallest id (an id that repeats with different
    texts), or a class has no id, those but the first are named by a negative hash of their root.
    """
    named = classes(docs, id_col, text_col, config)
    least = cut(named.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")), "names")
    owners = least.filter("least IS NOT NULL").groupBy("least").agg(F.min("root").alias("owner"))
    hashed = -1 - F.xxhash64("root").bitwiseAND(F.lit((1 << 63) - 1))
    # a root is joined with the row that it owns, so no key meets more than one row
    names = least.join(owners.select(F.col("owner").alias("root"), F.lit(True).alias("owns")), "root", "left").select("root", F.when(F.col("owns") & F.col("least").isNotNull(), F.col("least")).otherwise(hashed).alias("class_id"))
    return named.join(names, "root", "left").select(F.col("id").alias("doc_id"), F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "content")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: ProbMinHashConfig = ProbMinHashConfig()) -> DataFrame:
    """One row of each class (that with the smallest id, nulls last, then the smallest content; of repeated rows one),
    and every row without words.

    A class is told by its root: ids may be null or repeat on different texts. The rows that go are found from ids
    and digests alone; the texts are then read once and matched with them.
    """
    each = classes(docs, id_col, text_col, config).filter("root IS NOT NULL").groupBy("root", "id", "content").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "content", "n")).alias("f"))
    kept = cut(first.select("f.id", "f.content", "f.n"), "kept")

    k, own = docs.columns.index(text_col), unused("_content", docs)

    def contents(batches):
        for b in batches:
            for part in _parts(b, k):
                words = [(t.as_py() or "").encode().lower().split() for t in part.column(k)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([content_of(x) if x else None for x in words], pa.binary())], [*b.schema.names, own])

    held = docs.mapInArrow(contents, StructType([*docs.schema.fields, StructField(own, BinaryType())]))
    keys = kept.select(F.col("id").alias(unused("_id", docs)), F.col("content").alias(unused("_kept", docs)))
    key_id, key_content = keys.columns
    joined = held.filter(F.col(own).isNotNull()).join(keys.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(own) == F.col(key_content)), "left_semi")
    if not kept.filter("n > 1").isEmpty():  # whole rows are repeated
        joined = joined.dropDuplicates([id_col, own])
    return joined.unionByName(held.filter(F.col(own).isNull())).select(*docs.columns)
