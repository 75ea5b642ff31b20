"""Packing of tokenized documents into sequences: dominance reduction, then best fit.

Lengths are what matters, and there are at most ``size`` of them, so the instance is a histogram: the driver
gets one count per length, whatever the number of documents. Martello and Toth's reduction fixes sets of one
to three lengths that provably dominate every other set that holds the same piece; what is left is packed
by best fit in decreasing order. Both work on runs of equal sequences, and their result is, for each length,
a list of rank intervals: piece number r of that length goes to a sequence and an offset given by its interval.
Ranks are counted by partition of a written table, so no task sees all pieces of one length.

Defined cases: a null text is empty and has its end id alone. Documents longer than ``size`` are cut; their
first piece takes the remainder. Repeated rows are packed each time. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Text for which the word pattern below is certain to be the tokenizer's own: Latin letters, and common punctuation.
PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7e\\u00a0-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")
_NO = "²³¹¼½¾"  # numbers that are not decimal digits
WORD = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_{_NO}]+| ?[\d{_NO}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
SPECIAL = "<|endoftext|>"


class WordIds:
    """Ids of texts as little-endian uint32 bytes, by the byte-level BPE at ``path``.

    Words come from the tokenizer's own pattern and are encoded once; the cache is emptied at ``most`` words.
    Texts with other scripts or the special token's string go through the tokenizer whole.
    """

    def __init__(self, path: str, ranks_path: str | None = None, most: int = 300_000):
        from tokenizers import Tokenizer

        self.whole, self.most, self.cache = Tokenizer.from_file(path), most, {}
        self.one = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def _word(self, word: str) -> bytes:
        if self.one is not None:
            ids = self.one._encode_single_piece(word.encode())
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        out = self.cache[word] = np.array(ids, "<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if PLAIN.search(text) or SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.cache) > self.most:
            self.cache.clear()
        get, word = self.cache.get, self._word
        return b"".join([get(w) or word(w) for w in WORD.findall(text)])


_encoders: dict[tuple, WordIds] = {}


def encoder(path: str, ranks_path: str | None) -> WordIds:
    key = (path, ranks_path)
    if key not in _encoders:
        _encoders[key] = WordIds(path, ranks_path)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, doc_id, piece, start, length, ids_crc32): the pieces of every document; part: the task that made them."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer, ranks), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = [[], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(t.as_py() or "") + end
                n = len(ids) // 4
                bounds = [0, *range(n % size or size, n + 1, size)]
                for k, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for o, v in zip(out, (i, k, x, y - x, zlib.crc32(ids[4 * x : 4 * y])), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out[0]), pa.int32()), *(pa.array(o, f.type) for o, f in zip(out, list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "part int, doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """``count`` pieces of one length, ranks from ``rank``, at ``offset`` in the sequences from ``sequence``."""

    length: int
    rank: int
    count: int
    sequence: int
    offset: int


class _Instance:
    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.runs: list[Run] = []

    def take(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: list[int], count: int) -> None:
        at = 0
        for x in lengths:
            self.take(x, count, self.sequences, at)
            at += x
        self.sequences += count


def reduce_dominated(p: _Instance, size: int) -> None:
    """Fixes sets that dominate (Martello and Toth), longest piece first, while any does.

    With a piece j and room = size - j: alone, if nothing fits beside it; with k, the longest that
    fits, if k fills the room or no two others fit together; with k and b, the longest that then fits, if no
    three fit together and no pair that fits has a shorter member over b. Each feasible set with j then has
    its other members exchanged for members at least as long, so some best packing holds the fixed set.
    Pieces j for which none of this holds stay; the next shorter are tried in turn.
    """
    import bisect

    xs = sorted(p.left)
    todo = list(xs)
    while todo:
        j = todo[-1]
        room = size - j
        have = lambda x, y: p.left.get(x, 0) - (x == j) - sum(z == x for z in y)

        def fit(r: int, taken: list[int]) -> int:
            k = bisect.bisect_right(xs, r) - 1
            while k >= 0 and have(xs[k], taken) <= 0:
                k -= 1
            return xs[k] if k >= 0 else 0

        def least(n: int) -> list[int]:
            out: list[int] = []
            for x in xs:
                out += [x] * min(n - len(out), have(x, []))
                if len(out) == n:
                    break
            return out

        members = None
        k = fit(room, [])
        low = least(3)
        if not k:
            members = [j]
        elif k == room or len(low) < 2 or low[0] + low[1] > room:
            members = [j, k]
        elif (b := fit(room - k, [k])) and (len(low) < 3 or sum(low) > room):
            # the longest q that can be the shorter of two that fit together: q <= room / 2, with a partner p >= q, p + q <= room
            q = fit(room // 2, [])
            while q > b:
                nxt = [x for x in (q, *xs[bisect.bisect_right(xs, q) : bisect.bisect_right(xs, q) + 1]) if x + q <= room and have(x, [q]) > 0]
                if nxt:
                    break
                i = bisect.bisect_left(xs, q) - 1
                while i >= 0 and have(xs[i], []) <= 0:
                    i -= 1
                q = xs[i] if i >= 0 else 0
            if q <= b:
                members = [j, k, b]
        if members is None:
            todo.pop()
            continue
        times = min(p.left[x] // members.count(x) for x in members)
        # the same set stays dominant while its lengths last: fewer others only make its conditions hold the more
        p.fix(members, times)
        xs = [x for x in xs if x in p.left]
        todo = [x for x in todo if x in p.left]


def best_fit(p: _Instance, size: int) -> None:
    """Best fit in decreasing order on runs of sequences with equal room."""
    import bisect

    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, count)

    def add(room: int, first: int, count: int) -> None:
        if room:
            if room not in by_room:
                bisect.insort(rooms, room)
                by_room[room] = []
            by_room[room].append((first, count))

    for x in sorted(p.left, reverse=True):
        while (n := p.left.get(x, 0)) > 0:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                each = size // x
                full, part = divmod(n, each)
                if full:
                    for t in range(each):
                        p.take(x, full, p.sequences, t * x)
                    add(size - each * x, p.sequences, full)
                    p.sequences += full
                if part:
                    for t in range(part):
                        p.take(x, 1, p.sequences, t * x)
                    add(size - part * x, p.sequences, 1)
                    p.sequences += 1
                continue
            room = rooms[i]
            first, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            each = room // x
            full = min(count, n // each)
            if full:
                for t in range(each):
                    p.take(x, full, first, size - room + t * x)
                add(room - each * x, first, full)
            rest = n - full * each
            if full < count:
                if 0 < rest < each:
                    for t in range(rest):
                        p.take(x, 1, first + full, size - room + t * x)
                    add(room - rest * x, first + full, 1)
                    full += 1
                if full < count:
                    add(room, first + full, count - full)


def pack_histogram(counts: dict[int, int], size: int) -> tuple[list[Run], int]:
    """Rank intervals for every length, and the number of sequences."""
    p = _Instance(counts)
    reduce_dominated(p, size)
    best_fit(p, size)
    return p.runs, p.sequences


def pack(made: DataFrame, size: int = 2048) -> DataFrame:
    """``made`` (as from :func:`pieces`, written) with sequence_id and offset, without part."""
    by_part = cut(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs, _ = pack_histogram(counts, size)
    table: dict[int, tuple] = {}
    by_length: dict[int, list[Run]] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append(r)
    for x, rs in by_length.items():
        table[x] = tuple(np.array(c, np.int64) for c in zip(*((r.rank, r.sequence, r.offset) for r in sorted(rs, key=lambda r: r.rank)), strict=True))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = by_part.select("part", "length", before.alias("first"))
    local = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = made.withColumn("_local", local).join(firsts, ["part", "length"]).select(*(c for c in made.columns if c != "part"), (F.col("_local") + F.col("first")).alias("_rank"))
    k_len, k_rank = ranked.columns.index("length"), ranked.columns.index("_rank")

    def place(batches):
        for b in batches:
            length, rank = b.column(k_len).to_numpy(), b.column(k_rank).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.where(length == x)[0]
                ranks, sequences, offsets = table[int(x)]
                i = np.searchsorted(ranks, rank[at], side="right") - 1
                seq[at], off[at] = sequences[i] + rank[at] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(b.columns) if j != k_rank), pa.array(seq), pa.array(off)], [*(x for x in b.schema.names if x != "_rank"), "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    return ranked.mapInArrow(place, StructType([*(f for f in ranked.schema.fields if f.name != "_rank"), StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(docs, tokenizer, ranks, size, end_id, id_col, text_col), "pieces"), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
