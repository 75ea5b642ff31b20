import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ppm as P


def words(t):
    import re

    return [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


class Trie:
    """A plain trie walk, context by context, with the excluded bytes as a set."""

    def __init__(self, order, texts):
        self.order, self.n = order, defaultdict(Counter)
        for body in texts:
            s = bytes([P.END]) * order + body
            for i in range(order, len(s)):
                for j in range(order + 1):
                    self.n[s[i - j : i]][s[i]] += 1

    def log10(self, ctx, s):
        p, out = 1.0, set()
        for j in range(self.order, -1, -1):
            seen = self.n.get(ctx[len(ctx) - j :], {})
            left = {k: v for k, v in seen.items() if k not in out}
            total = sum(left.values()) + len(left)
            if s in left:
                return math.log10(p * left[s] / total)
            if total:
                p *= len(left) / total
            out |= set(seen)
        return math.log10(p / (256 - len(out)))


@pytest.mark.parametrize("order", [2, 4, 5])
def test_scores_are_those_of_a_trie(spark, order):
    r = random.Random(order)
    texts = [" ".join(r.choice(["ab", "abc", "ba", "cab", "Été", "x"]) for _ in range(r.randint(0, 30))) for _ in range(60)]
    texts += ["zebra ab\tQ\x0bab", None, "", "ab ab", "ab ab", "É"]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "ab abc", "d")]
    got = {r.doc_id: r for r in P.score(spark.createDataFrame(rows, "doc_id long, text string, block string"), config=P.PPMConfig(order=order, block_bytes=300)).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows}
    body = lambda t: " ".join(words(t)).encode() + bytes([P.END])
    trie = Trie(order, [body(t) for i, t, _ in rows if not held[i]])
    c = Counter(w for i, t, _ in rows if not held[i] for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, t, _ in rows:
        tokens = [*words(t), "\n"]
        x, s = got[i], bytes([P.END]) * order + body(t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), abs=1e-9)
        assert x.score == pytest.approx(sum(trie.log10(s[k - order : k], s[k]) for k in range(order, len(s))), abs=1e-9)
    for ctx in (b"ab a"[-order:], b"zzzzz"[:order], b"\n" * order):
        assert sum(10 ** trie.log10(ctx, s) for s in range(256)) == pytest.approx(1)


def test_no_training_rows_and_empty_tables(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    x = P.score(spark.createDataFrame([(one, "ab")], "doc_id long, text string")).collect()[0]
    assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) == (True, 2, 0, 0, 0.0)
    assert x.score == pytest.approx(-3 * math.log10(256))
    assert P.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lookup():
    r = np.random.default_rng(0)
    k = np.unique(r.integers(0, 2**50, 5000).astype(np.uint64))
    t = P.Lookup(k, np.arange(len(k)).astype(float))
    assert len(P.Lookup(k[:0], np.zeros(0)).get(k[:0])) == 0
    assert (t.get(k[::-1]) == np.arange(len(k))[::-1]).all()
    with pytest.raises(KeyError):
        t.get(np.array([2**55], np.uint64))
