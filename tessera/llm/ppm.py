"""Prediction by partial matching over bytes, pretrained on a fold of the corpus, with a word-unigram base.

A text is its lower-cased (A to Z) words joined by one space and closed by an end byte; contexts before its
first byte are end bytes. The trie of contexts of up to ``order`` bytes is held as counts of (order + 1)-grams;
counts of shorter contexts are their sums. With n(s), T and D the count of s, the sum of counts and the number
of different bytes after a context, the byte s gets n(s) / (T + D), and D / (T + D) is the escape (method C)
to the context without its first byte, where the bytes seen after the longer one are excluded from counts and
sums. Below the empty context all bytes not seen in training are equally likely. The probabilities of the
256 bytes after any context add up to 1. A text's code length is the sum over its bytes.

The corpus is dealt into blocks by a hash of its rows. Each block sends its distinct words (their 64-bit hashes) and grams with
their training counts; counts are summed per word and gram over all blocks; the log probability of each
distinct gram that any text needs is worked out once; and each block gets back just its own words and grams.
Nothing of the model is collected or broadcast but counts of byte pairs (at most 65,536) and two totals.

Defined cases: null and empty texts have no words (one end token). Without training texts all counts are 0:
the base gives 1 / (V + 1) = 1 a token and every byte has 1 / 256. Repeated rows are scored each time and
count each time. An empty table gives an empty result. Null ids are in no held-out fold and are learned from.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

END = 10  # the line feed: no word holds it


@dataclass(frozen=True)
class PPMConfig:
    order: int = 5
    held_out_parts: int = 7
    held_out_part: int = 2
    block_bytes: int = 16_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def stream(docs: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the (order + 1)-gram that ends at each byte of each text, one after another, and the texts' lengths."""
    pad = bytes([END]) * order
    bodies = [b" ".join(w) + bytes([END]) for w in docs]
    raw = np.frombuffer(b"".join([x for b in bodies for x in (pad, b)]), np.uint8).astype(np.uint64)
    lengths = np.array([len(b) for b in bodies], np.int64)
    code = np.zeros(max(0, len(raw) - order), np.uint64)
    for j in range(order + 1):
        code = (code << np.uint64(8)) | raw[j : len(code) + j]
    # windows that end in a later text's padding are left out
    starts = np.cumsum(lengths + order) - lengths - order
    keep = np.ones(len(code), bool)
    for j in range(order):
        at = starts[1:] + j - order
        keep[at] = False
    return code[keep], lengths


class Lookup:
    """An open-addressing table from 64-bit keys to floats, read and filled with whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.zeros(size), np.zeros(size, bool)
        left, slot, claim = np.arange(len(keys)), self._slot(keys), np.full(size, -1, np.int64)
        while len(left):
            at = slot[left]
            free = ~self.used[at]
            claim[at[free]] = left[free]
            won = free & (claim[at] == left)
            w = left[won]
            self.keys[slot[w]], self.values[slot[w]], self.used[slot[w]] = keys[w], values[w], True
            left = left[~won]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for start in range(0, len(keys), 1 << 18):
            k = keys[start : start + (1 << 18)]
            slot = self._slot(k)
            left = np.where(self.keys[slot] != k)[0] if len(k) else np.zeros(0, int)
            while len(left):
                if not self.used[slot[left]].all():
                    raise KeyError("a gram that its block's dictionary does not hold")
                slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
                left = left[self.keys[slot[left]] != k[left]]
            out[start : start + len(k)] = self.values[slot]
        return out


def gram_log10(grams: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after its context.

    grams: distinct, sorted codes; all that share the last two context bytes with any of them must be there
    (those with count 0 are asked for and not learned). pairs: 256 x 256 counts of (previous, byte).
    """
    logp, esc = np.full(len(grams), np.nan), np.ones(len(grams))
    open_ = np.ones(len(grams), bool)
    # per gram, for the longer context tried before: bytes seen after it, and the sum of this level's counts over them
    up_d = np.zeros(len(grams))
    up_key, up_seen = grams, counts > 0  # distinct grams of the longer order, and which of them were seen
    for j in range(order, -1, -1):
        mask = np.uint64((1 << 8 * (j + 1)) - 1)
        g = grams & mask
        if j >= 2:
            keys, inv = np.unique(g, return_inverse=True)
            n = np.bincount(inv, counts, len(keys))
        else:
            keys = np.unique(g)
            n = pairs[(keys >> np.uint64(8)).astype(int), (keys & np.uint64(255)).astype(int)].astype(float) if j else pairs.sum(0)[keys.astype(int)].astype(float)
            inv = np.searchsorted(keys, g)
        ctx = g >> np.uint64(8)
        if j >= 2:
            c, c_inv = np.unique(keys >> np.uint64(8), return_inverse=True)
            t, d = np.bincount(c_inv, n), np.bincount(c_inv, n > 0)
            at = np.searchsorted(c, ctx)
            t, d = t[at], d[at].astype(float)
        elif j == 1:
            t, d = pairs.sum(1)[ctx.astype(int)].astype(float), (pairs > 0).sum(1)[ctx.astype(int)].astype(float)
        else:
            t, d = np.full(len(grams), pairs.sum(), float), np.full(len(grams), (pairs.sum(0) > 0).sum(), float)
        if j < order:
            # bytes seen after the longer context are excluded: their counts after this one
            longer = up_key >> np.uint64(8)
            own = up_key & mask
            if j >= 1:
                n_of = n[np.searchsorted(keys, own)] if j >= 2 else pairs[((own >> np.uint64(8)) & np.uint64(255)).astype(int), (own & np.uint64(255)).astype(int)]
            else:
                n_of = pairs.sum(0)[own.astype(int)]
            lc, l_inv = np.unique(longer, return_inverse=True)
            x = np.bincount(l_inv, np.where(up_seen, n_of, 0), len(lc))
            at = np.searchsorted(lc, (grams & np.uint64((1 << 8 * (j + 2)) - 1)) >> np.uint64(8))
            t, d = t - x[at], d - up_d
        mine = n[inv]
        total = t + d
        hit = open_ & (mine > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logp[hit] = np.log10(esc[hit] * mine[hit] / total[hit])
            esc = np.where(open_ & ~hit & (total > 0), esc * d / total, esc)
        open_ &= ~hit
        up_d = d + up_d if j < order else d
        if j == 1:  # every byte after one context byte, not only those asked for
            ctxs = np.unique(ctx)
            up_key = (np.repeat(ctxs, 256) << np.uint64(8)) | np.tile(np.arange(256, dtype=np.uint64), len(ctxs))
            up_seen = (pairs[ctxs.astype(int)] > 0).ravel()
        else:
            up_key, up_seen = keys, n > 0
    unseen = 256 - (pairs.sum(0) > 0).sum()
    logp[open_] = np.log10(esc[open_] / max(1, unseen))
    return logp


def word_keys(words: list[bytes]) -> np.ndarray:
    """64-bit XXH64 of words: 10 million different words hold two with one key with a probability of 3e-6."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words)).astype(np.int64)


def _chunks(texts: pa.ChunkedArray, most: int = 1_000_000):
    """The words of a block's texts in runs of about ``most`` bytes, with the run's place: only a run is held at a time."""
    docs, size, start, at = [], 0, 0, 0
    for x in texts:
        docs.append(words_of(x.as_py()))
        size += sum(map(len, docs[-1]))
        at += 1
        if size > most:
            yield start, docs
            docs, size, start = [], 0, at
    if docs:
        yield start, docs


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and their counts summed."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(k, kind="stable")
    k, c = k[by], c[by]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[: len(k)]
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _dictionary(config: PPMConfig):
    schema = pa.schema([("block", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        learn = t.column("held_out").to_numpy() == 0
        known, other = Counter(), set()
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for start, docs in _chunks(t.column("text")):
            mine = learn[start : start + len(docs)]
            for w, k in zip(docs, mine.tolist(), strict=True):
                (known if k else other).update(w)
            code, lengths = stream(docs, config.order)
            train = np.repeat(mine, lengths)
            g, c = np.unique(code[train], return_counts=True)
            rest = np.unique(code[~train])
            keys += [g, rest]
            counts += [c, np.zeros(len(rest), np.int64)]
            if len(keys) > 8:
                g, c = _merged(keys, counts)
                keys, counts = [g], [c]
        other -= known.keys()
        words = np.concatenate([word_keys(list(known)), word_keys(list(other))])
        n = np.concatenate([np.fromiter(known.values(), np.int64, len(known)), np.zeros(len(other), np.int64)])
        grams, c = _merged(keys, counts)
        kind = np.concatenate([np.zeros(len(words), np.int8), np.ones(len(grams), np.int8)])
        return pa.table([pa.array(np.full(len(kind), block, np.int32)), pa.array(kind), pa.array(np.concatenate([words, grams.astype(np.int64)])), pa.array(np.concatenate([n, c]))], schema=schema)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: PPMConfig = PPMConfig()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    order = config.order
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % config.held_out_parts == config.held_out_part, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.cast("int").alias("held_out"))
    total = rows.agg(F.sum(F.octet_length("text") + 1), F.count_if(F.col("held_out") == 0)).first()
    blocks = 1 + (total[0] or 0) // config.block_bytes
    ends = total[1]
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(4 * int(blocks), "block")  # several to a block, so that two blocks seldom share one
    entries = cut(blocked.groupBy("block").applyInArrow(_dictionary(config), "block int, kind byte, key long, n long"), "ppm-entries")

    # a word's rows: one per block that holds it
    by_word = Window.partitionBy("key")
    words = entries.filter("kind = 0").select("block", "key", "n", F.sum("n").over(by_word).alias("c"), (F.min("block").over(by_word) == F.col("block")).alias("one"))
    words = cut(words, "ppm-words")
    sums = words.agg(F.sum("n"), F.count_if(F.col("one") & (F.col("c") > 0))).first()
    n_train, vocabulary = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)

    counted = cut(entries.filter("kind = 1").groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")), "ppm-grams")
    pairs = np.zeros((256, 256))
    for r in counted.groupBy(F.col("gram").bitwiseAND(65535).alias("p")).agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[r["p"] >> 8, r["p"] & 255] = r["n"]

    def logs(t: pa.Table) -> pa.Table:
        g, n = t.column("gram").to_numpy().astype(np.uint64), t.column("n").to_numpy().astype(float)
        by = np.argsort(g, kind="stable")
        return pa.table({"gram": pa.array(g[by].astype(np.int64)), "logp": pa.array(gram_log10(g[by], n[by], order, pairs))})

    group = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(65535)), F.lit(256)).alias("g")
    logp = counted.groupBy(group).applyInArrow(logs, "gram long, logp double")
    back = words.select("block", F.lit(0).cast("byte").alias("kind"), "key", F.col("c").cast("double").alias("value")).unionByName(
        entries.filter("kind = 1").join(logp.withColumnRenamed("gram", "key"), "key").select("block", "kind", "key", F.col("logp").alias("value"))
    )
    back = back.withColumnRenamed("block", "b")

    def scored(t: pa.Table, d: pa.Table) -> pa.Table:
        import pyarrow.compute as pc
        from xxhash import xxh64_intdigest

        kind, keys, values = (d.column(c).to_numpy() for c in ("kind", "key", "value"))
        c = values[kind == 0]
        floor = np.log10(n_train + vocabulary + 1)
        counts = Lookup(keys[kind == 0].astype(np.uint64), c)
        grams = Lookup(keys[kind == 1].astype(np.uint64), values[kind == 1])
        del keys, values, kind
        end = float(np.log10(ends + 1) - floor)
        base, n_tokens, n_known, total = [], [], [], []
        for _, docs in _chunks(t.column("text")):
            # each word of the run is looked up once
            place = {w: i for i, w in enumerate(dict.fromkeys(w for x in docs for w in x))}
            c = counts.get(np.fromiter((xxh64_intdigest(w) for w in place), np.uint64, len(place)))
            logs = np.log10(c + 1) - floor
            lengths = np.array([len(x) for x in docs], np.int64)
            at = np.fromiter((place[w] for x in docs for w in x), np.int64, int(lengths.sum()))
            owner = np.repeat(np.arange(len(docs)), lengths)
            base.append(end + np.bincount(owner, logs[at], len(docs)))
            n_tokens.append(lengths + 1)
            n_known.append(np.bincount(owner, c[at] > 0, len(docs)).astype(np.int64) + (ends > 0))
            code, lengths = stream(docs, order)
            total.append(np.add.reduceat(grams.get(code), np.cumsum(lengths) - lengths))
        rows = [np.concatenate(x) if x else np.zeros(0) for x in (n_tokens, n_known, base, total)]
        n = t.num_rows
        return pa.table(
            {
                "doc_id": t.column("doc_id"),
                "held_out": pc.cast(t.column("held_out"), pa.bool_()),
                "n_tokens": pa.array(rows[0].astype(np.int64)),
                "n_known": pa.array(rows[1].astype(np.int64)),
                "train_tokens": pa.array(np.full(n, n_train, np.int64)),
                "base_score": pa.array(rows[2]),
                "score": pa.array(rows[3]),
            }
        )

    return blocked.groupBy("block").cogroup(back.groupBy("b")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
