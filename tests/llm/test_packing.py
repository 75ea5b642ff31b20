import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import packing as P

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(PATHS[0]), P.WordIds(*PATHS)
    r = random.Random(5)
    texts = ["", " ", "a  b\n\n c\t\td  ", "I'll we've it's 'S x_y __ 12² ½ª ßé", "中文 ١", "a\x85b\x1cc d e", "<|endoftext|> x", "café’s €5 …"]
    texts += ["".join(r.choice(" \n\t'_abcZ09.,!?éß²½×–sdl") for _ in range(r.randrange(80))) for _ in range(400)]
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def fewest(items, size):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in seen:
                seen.add(bins[k])
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        bins.append(size - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def laid_out(runs, size):
    bins, seen = {}, {}
    for r in runs:
        seen.setdefault(r.length, []).append((r.rank, r.rank + r.count))
        for i in range(r.count):
            bins.setdefault(r.sequence + i, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= size
    for v in seen.values():
        at = 0
        for a, b in sorted(v):
            assert a == at
            at = b
    return len(bins)


def test_reduction_never_costs_a_sequence_and_best_fit_is_whole():
    r = random.Random(2)
    for _ in range(400):
        size = r.choice([10, 20, 31])
        items = [r.randint(1, size) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in set(items)}
        runs, n = P.pack_histogram(counts, size)
        assert laid_out(runs, size) == n
        p = P._Instance(counts)
        P.reduce_dominated(p, size)
        rest = [x for x, k in p.left.items() for _ in range(k)]
        assert p.sequences + fewest(rest, size) == fewest(items, size), (size, items)


def test_large_histogram():
    r = random.Random(3)
    counts = {}
    for _ in range(50000):
        x = min(2048, int(r.expovariate(1 / 500)) + 1)
        counts[x] = counts.get(x, 0) + 1
    runs, n = P.pack_histogram(counts, 2048)
    assert laid_out(runs, 2048) == n <= 1.001 * sum(k * v for k, v in counts.items()) / 2048 + 1


@pytest.mark.parametrize("size", [16, 2048])
def test_documents(spark, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    rows = [(1, "hello world " * 40), (2, None), (3, ""), (4, "x"), (4, "x"), (None, "a b c"), (5, "w " * 3000)] + [(10 + i, "one two three " * (i % 7)) for i in range(60)]
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), *PATHS, size=size).collect()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        n, a, k = len(ids), 0, 0
        while a < n:
            b = a + (((n - a - 1) % size) + 1)
            want.append((i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            a, k = b, k + 1
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= size
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
