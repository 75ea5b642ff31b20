"""Subword encoding by merges with seeded dropout, and lossless decoding.

The vocabulary and the scores are those of a SentencePiece BPE model. A text (a space in front, spaces as
U+2581) is cut where no piece can span: before each run of U+2581 and around line feeds. In each part the
agenda holds every adjacent pair whose join is a piece; the best score, and of equals the leftmost, is taken,
until none is left. With dropout a candidate is skipped for good when a hash, keyed by the seed, the document,
the part's number in the text, and the candidate's start, middle and end in the part, falls under ``dropout``: so a
seed and a document fix the result, and each occurrence of a part is segmented by itself. Characters without a
piece become their UTF-8 bytes' pieces.

Each distinct part is merged once without dropout, and the candidates taken are kept. For an occurrence these are
hashed first (all occurrences as arrays); if none is skipped, its result is the one without dropout, as the
agenda's best is never a skipped one. Other occurrences go through the agenda: parts of up to 48 characters
together, as arrays; longer ones one by one with a heap.

Decoding joins the pieces' bytes, reads U+2581 as a space and takes off the first. A literal U+2581 in a text
is encoded as bytes, so that decoding gives every text back exactly.

Defined cases: null and empty texts have no pieces and decode to an empty text. Repeated rows are returned
each time, alike; null ids are one document key. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

SPACE = "▁"
PART = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
WIDE = 48
#: no pair of pieces, in the table of joins
NO_PAIR = np.int64(-(1 << 60))


@dataclass(frozen=True)
class DropoutConfig:
    dropout: float = 0.1
    seed: int = 1


class Pieces:
    """A model's vocabulary as arrays: characters' pieces, and for adjacent pieces the piece that joins them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        normal = {}
        for i, x in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(x[3:5], 16)] = i
                self.bytes_of.append(bytes([int(x[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                normal[x] = i
                self.bytes_of.append(x.replace(SPACE, " ").encode())
        if any(SPACE in x.lstrip(SPACE) for x in normal):
            raise ValueError("a piece holds U+2581 inside: parts can't be cut there")
        self.chars = {x: i for x, i in normal.items() if len(x) == 1}
        self.char_ids = np.full(0x110000, -1, np.int32)
        self.char_ids[[ord(x) for x in self.chars]] = list(self.chars.values())
        # better pieces have smaller ranks; equal scores have equal ranks, and then the leftmost is taken
        scores = sorted({-sp.get_score(i) for i in normal.values()})
        rank_of = {s: k for k, s in enumerate(scores)}
        joins = {}
        for x, i in normal.items():
            for k in range(1, len(x)):
                a, b = normal.get(x[:k]), normal.get(x[k:])
                if a is not None and b is not None:
                    joins[a << 20 | b] = (i, rank_of[-sp.get_score(i)])
        self.joins = joins
        # an open-addressed table of the joins: pair, rank and joined piece by slot
        self.bits = max(10, (4 * len(joins)).bit_length())
        size = 1 << self.bits
        self.pair, self.rank, self.join = np.full(size, NO_PAIR), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k, slot in zip(joins, self.slots(np.array(list(joins), np.int64)).tolist(), strict=True):
            while self.pair[slot] != NO_PAIR:
                slot = (slot + 1) % size
            self.pair[slot], (self.join[slot], self.rank[slot]) = k, joins[k]

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def found(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs have a join (their places), and the slots of these."""
        slot = self.slots(pairs)
        got = self.pair[slot]
        probe = np.nonzero((got != pairs) & (got != NO_PAIR))[0]
        while len(probe):
            slot[probe] = (slot[probe] + 1) & ((1 << self.bits) - 1)
            got[probe] = self.pair[slot[probe]]
            probe = probe[(got[probe] != pairs[probe]) & (got[probe] != NO_PAIR)]
        at = np.nonzero(got == pairs)[0]
        return at, slot[at]

    def ids_of_char(self, c: str) -> list[int]:
        return [int(self.byte[b]) for b in c.encode()]


_M64 = (1 << 64) - 1


def document_keys(documents: list[int], config: DropoutConfig) -> np.ndarray:
    return mix64(np.array([(x ^ config.seed * 0x9E3779B97F4A7C15) & _M64 for x in documents], np.uint64))


def occurrence_keys(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Keys of parts, from their documents' keys and their numbers in the texts."""
    return mix64(keys + numbers.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def candidate_codes(start, middle, end):
    """The candidate that joins [start, middle) and [middle, end) of a part as one number."""
    return (np.asarray(start, np.uint64) << np.uint64(42)) + (np.asarray(middle, np.uint64) << np.uint64(21)) + np.asarray(end, np.uint64)


def skipped(keys: np.ndarray, codes: np.ndarray, config: DropoutConfig) -> np.ndarray:
    """Whether candidates are skipped in parts with these keys."""
    return (mix64(keys + codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) * 2.0**-53 < config.dropout


def _skipped_one(key: int, start: int, middle: int, end: int, dropout: float) -> bool:
    """As :func:`skipped`, for one candidate, without arrays."""
    x = (key + ((start << 42) + (middle << 21) + end) * 0x9E3779B97F4A7C15) & _M64
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M64
    return ((x ^ x >> 31) >> 11) * 2.0**-53 < dropout


def _heap_merge(part: str, p: Pieces, config: DropoutConfig | None, key: int) -> list[int]:
    """One part, with a heap over a linked list."""
    n = len(part)
    ids = [p.chars.get(c, -1) for c in part]
    right, left, end = [*range(1, n), -1], [-1, *range(n - 1)], list(range(1, n + 1))
    dropout = config.dropout if config else 0.0
    heap: list[tuple] = []

    def offer(a: int) -> None:
        b = right[a]
        if b >= 0 and ids[a] >= 0 and ids[b] >= 0:
            j = p.joins.get(ids[a] << 20 | ids[b])
            if j and not (dropout and _skipped_one(key, a, b, end[b], dropout)):
                heapq.heappush(heap, (j[1], a, b, end[b], j[0], ids[a], ids[b]))

    for a in range(n - 1):
        offer(a)
    while heap:
        _, a, b, e, j, x, y = heapq.heappop(heap)
        if ids[a] != x or right[a] != b or ids[b] != y or end[b] != e:
            continue
        ids[a], end[a], right[a] = j, e, right[b]
        ids[b] = -2
        if right[a] >= 0:
            left[right[a]] = a
        if left[a] >= 0:
            offer(left[a])
        offer(a)
    out, a = [], 0
    while a >= 0:
        out += [ids[a]] if ids[a] >= 0 else p.ids_of_char(part[a])
        a = right[a]
    return out


def _array_merge(parts: list[str], keys: np.ndarray | None, p: Pieces, config: DropoutConfig | None, taken: list | None = None) -> list[bytes]:
    """Parts of like length together: in each round every part takes its best candidate. A column is a part.

    Pieces are linked by position: ``ids``, ``after`` and ``prior`` hold the piece that starts there and its neighbours'
    places. ``agenda`` holds the rank of the candidate that starts at a place, with the place in its low bits.
    ``taken`` gets, for each round, the numbers of the parts that took a candidate, and the candidates.
    """
    n = len(parts)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    w = int(lengths.max())
    offset = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(n), lengths)
    ids = np.full((w + 1, n), -1, np.int64)
    ids[np.arange(len(owner)) - offset[owner], owner] = p.char_ids[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
    after = np.repeat(np.arange(1, w + 2), n)
    prior = np.repeat(np.arange(-1, w), n)
    keys = keys if config and config.dropout else None
    none = np.int64(1) << 60

    def candidates(x, y, rows, a, b, e) -> tuple[np.ndarray, np.ndarray]:
        """Agenda entries and joins of the pairs of pieces x at a and y at b, which ends at e."""
        k, slot = p.found(x << 20 | y)
        if keys is not None:
            stays = ~skipped(keys[rows[k]], candidate_codes(a[k], b[k], e[k]), config)
            k, slot = k[stays], slot[stays]
        entry, joined = np.full(len(x), none), np.zeros(len(x), np.int64)
        entry[k], joined[k] = p.rank[slot] << 6 | a[k], p.join[slot]
        return entry, joined

    place, row = np.repeat(np.arange(w), n), np.tile(np.arange(n), w)
    flat = ids.reshape(-1)
    agenda, join = candidates(flat[: w * n], flat[n:], row, place, place + 1, np.minimum(place + 2, lengths[row]))
    agenda = agenda.reshape(w, n)
    live = np.arange(n)
    while True:
        best = agenda.min(0)
        act = np.nonzero(best < none)[0]
        if not len(act):
            break
        best = best[act]
        if len(act) < 0.7 * agenda.shape[1]:
            agenda, live = agenda[:, act], live[act]
            act = np.arange(len(act))
        a, r = best & 63, live[act]
        at_a = a * n + r
        b = after[at_a]
        at_b = b * n + r
        e, left = after[at_b], prior[at_a]
        if taken is not None:
            taken.append((r, candidate_codes(a, b, e)))
        at_e = e * n + r
        piece = flat[at_a] = join[at_a]
        flat[at_b], after[at_a], prior[at_e] = -2, e, a
        agenda[b, act] = none
        has = np.nonzero(left >= 0)[0]
        r2, l2, a2 = r[has], left[has], a[has]
        both = candidates(np.concatenate([piece, flat[l2 * n + r2]]), np.concatenate([flat[at_e], piece[has]]), np.concatenate([r, r2]), np.concatenate([a, l2]), np.concatenate([e, a2]), np.concatenate([after[at_e], e[has]]))
        agenda[np.concatenate([a, l2]), np.concatenate([act, act[has]])] = both[0]
        join[np.concatenate([at_a, l2 * n + r2])] = both[1]
    ends = ids[:w].T
    kept = (ends != -2) & (np.arange(w) < lengths[:, None])
    raw = ends[kept].astype("<u4").tobytes()
    stop = 4 * np.cumsum(kept.sum(1))
    out = [raw[s:e] for s, e in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]
    for k in np.nonzero(((ends == -1) & kept).any(1))[0]:  # characters without a piece
        c = np.nonzero(kept[k])[0]
        out[k] = np.array([y for x, s in zip(ends[k, c].tolist(), c.tolist(), strict=True) for y in ([x] if x >= 0 else p.ids_of_char(parts[k][s]))], "<u4").tobytes()
    return out


def encode_keyed(parts: list[str], keys: np.ndarray, p: Pieces, config: DropoutConfig | None, taken: list | None = None) -> list[bytes]:
    """The ids of each part under its key, as little-endian uint32 bytes.

    ``taken`` gets pairs of arrays: numbers of parts (of those up to ``WIDE`` characters), and candidates that they took.
    """
    out: list = [None] * len(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    order = np.argsort(lengths, kind="stable")
    one, wide = np.searchsorted(lengths[order], [1, WIDE], "right")
    for i in order[:one].tolist():
        x = parts[i]
        out[i] = np.array([p.chars[x]] if x in p.chars else p.ids_of_char(x), "<u4").tobytes()
    for i in order[wide:].tolist():
        out[i] = np.array(_heap_merge(parts[i], p, config, int(keys[i])), "<u4").tobytes()
    for at in np.split(order[one:wide], np.nonzero(np.diff((lengths[order[one:wide]] - 1) // 8))[0] + 1):
        for s in range(0, len(at), 4096):
            some = at[s : s + 4096]
            rounds: list | None = None if taken is None else []
            for i, ids in zip(some.tolist(), _array_merge([parts[i] for i in some.tolist()], keys[some], p, config, rounds), strict=True):
                out[i] = ids
            if rounds:
                taken += [(some[r], c) for r, c in rounds]
    return out


def split_parts(text: str) -> list[list[str]]:
    """The parts of a text, in runs between its literal U+2581."""
    return [PART.findall(x.replace(" ", SPACE)) for x in (" " + text).split(SPACE)] if text else []


class Encoder:
    """Encodes texts to ids as little-endian uint32 bytes. Distinct parts are kept, and emptied at ``most``.

    Of each part, by its number, it holds the ids without dropout and the candidates taken for them (``codes``, from
    ``first`` on, ``count`` of them; -1 for a part over ``WIDE`` characters).
    """

    def __init__(self, path: str, most: int = 400_000, run: int = 100_000):
        self.p, self.most, self.run = Pieces(path), most, run
        self.literal = np.array(self.p.ids_of_char(SPACE), "<u4").tobytes()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.size = self.first = self.count = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.uint64)

    def _learn(self, parts: list[str]) -> None:
        """Merges the parts that are not kept yet."""
        if len(self.ids) > self.most:
            self._clear()
        new = [x for x in set(parts) if x not in self.number]
        if not new:
            return
        taken: list = []
        ids = encode_keyed(new, np.zeros(len(new), np.uint64), self.p, None, taken)
        row, code = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.uint64)), *taken, strict=True))
        count = np.bincount(row, minlength=len(new))
        self.number.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
        self.ids += ids
        self.first = np.concatenate([self.first, len(self.codes) + np.cumsum(count) - count])
        self.codes = np.concatenate([self.codes, code[np.argsort(row, kind="stable")]])
        count[np.fromiter(map(len, new), np.int64, len(new)) > WIDE] = -1
        self.count = np.concatenate([self.count, count])
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids)) // 4])

    def encode(self, texts: list[str], documents: list[int], config: DropoutConfig | None) -> list[bytes]:
        return self.encode_split(list(map(split_parts, texts)), documents, config)[0]

    def encode_split(self, texts: list[list[list[str]]], documents: list[int], config: DropoutConfig | None) -> tuple[list[bytes], list[int]]:
        """The ids of texts (as from :func:`split_parts`), and how many each has without dropout."""
        flat = [x for runs in texts for parts in runs for x in parts]
        self._learn(flat)
        of = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        ids = list(map(self.ids.__getitem__, of.tolist()))
        sizes = np.fromiter((sum(map(len, runs)) for runs in texts), np.int64, len(texts))
        stops = np.cumsum(sizes)
        upto = np.concatenate([[0], np.cumsum(self.size[of])])
        literals = np.array([len(self.literal) // 4 * max(0, len(runs) - 1) for runs in texts], np.int64)
        n_plain = (upto[stops] - upto[stops - sizes] + literals).tolist()
        if config and config.dropout and flat:
            number = np.arange(len(flat)) - np.repeat(stops - sizes, sizes)
            keys = occurrence_keys(np.repeat(document_keys(documents, config), sizes), number)
            for s in range(0, len(flat), self.run):
                mine = keys[s : s + self.run]
                again = np.nonzero(self._touched(of[s : s + self.run], mine, config))[0]
                for i, x in zip((s + again).tolist(), encode_keyed([flat[s + i] for i in again.tolist()], mine[again], self.p, config), strict=True):
                    ids[i] = x
        out, at = [], 0
        for runs in texts:
            each = []
            for parts in runs:
                each.append(b"".join(ids[at : at + len(parts)]))
                at += len(parts)
            out.append(self.literal.join(each))
        return out, n_plain

    def _touched(self, of: np.ndarray, keys: np.ndarray, config: DropoutConfig) -> np.ndarray:
        """Which occurrences (parts by number, with keys) skip a candidate that they would take, or are too long to tell."""
        n = np.maximum(self.count[of], 0)
        upto = np.cumsum(n)
        where = np.repeat(self.first[of] - (upto - n), n) + np.arange(int(upto[-1]))
        hit = np.concatenate([[0], np.cumsum(skipped(np.repeat(keys, n), self.codes[where], config))])
        return (hit[upto] > hit[upto - n]) | (self.count[of] < 0)

    def decode(self, ids: bytes) -> str:
        """The text of ids (as from :meth:`encode`)."""
        return b"".join(map(self.p.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()[1:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.xxhash64(F.col(id_col).cast("long"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, model: str, config: DropoutConfig = DropoutConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids, n_plain): ids with dropout of every text, and how many it has without, in one pass."""

    def run(batches):
        e = encoder(model)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                ids, plain = e.encode_split(list(map(split_parts, part.column(2).to_pylist())), part.column(1).to_pylist(), config)
                both = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(plain, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *both], ["doc_id", "text", "ids", "n_plain"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>, n_plain long")


def decode_documents(encoded: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids in ``ids_col`` decode to."""
    k = encoded.columns.index(ids_col)
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        e = encoder(model)
        for b in batches:
            texts = [e.decode(np.asarray(x.values.to_numpy(zero_copy_only=False), "<u4").tobytes()) if x.is_valid else None for x in b.column(k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, StringType())]))


def digest(docs: DataFrame, model: str, config: DropoutConfig = DropoutConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, n_plain, ids_crc32 and lossless (decoding gives the text back) of every text.

    Encodes and decodes each batch in one task, so that neither ids nor texts leave it.
    """

    def run(batches):
        e = encoder(model)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                texts = part.column(2).to_pylist()
                ids, plain = e.encode_split(list(map(split_parts, texts)), part.column(1).to_pylist(), config)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(plain, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([e.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())],
                    ["doc_id", "n_pieces", "n_plain", "ids_crc32", "lossless"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, n_plain long, ids_crc32 long, lossless boolean")
