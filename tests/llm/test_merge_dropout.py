import random

import numpy as np
import public_tokenizers
import sentencepiece

from tessera.llm import merge_dropout as M

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(3)
    out = ["", " ", "   two  spaces ", "a\nb\n\n c", "naïve café — “q”", "中文 日本語 😀", "x" * 130 + " end", "▁ lit▁eral ▁", "tab\tcr\r\n", "the theatre's internationalisation", " " * 40 + "deep"]
    return out + ["".join(r.choice("theraonsing  \n.,éß中▁XY") for _ in range(r.randrange(120))) for _ in range(300)]


def ints(x):
    return np.frombuffer(x, "<u4").tolist()


def test_without_dropout_it_is_the_models_own_encoding():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ts = [t for t in texts() if "▁" not in t]
    e = M.Encoder(PATH)
    for t, ids in zip(ts, e.encode(ts, [0] * len(ts), None), strict=True):
        assert ints(ids) == sp.encode(t), repr(t)


def naive(text, documents_key, p, config):
    """All from the definition: adjacent pairs are looked at anew after each merge; decisions are remembered; big integers only."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    doc = mix((documents_key ^ config.seed * 0x9E3779B97F4A7C15) & mask)
    out, number = [], 0
    for k, run in enumerate((" " + text).split(M.SPACE) if text else []):
        out += [int(p.byte[b]) for b in M.SPACE.encode()] if k else []
        for part in M.PART.findall(run.replace(" ", M.SPACE)):
            key = mix((doc + number * 0xD1B54A32D192ED03) & mask)
            number += 1
            held = [(c, i, i + 1) for i, c in enumerate(part)]
            names = {x: i for x, i in p_names(p).items()}
            while True:
                best = None
                for (x, a, b), (y, _, e) in zip(held, held[1:], strict=False):
                    joined = names.get(x + y)
                    if joined is None or x not in names or y not in names:
                        continue
                    rank = p.joins[names[x] << 20 | names[y]][1]
                    h = mix((key + ((a << 42) + (b << 21) + e) * 0x9E3779B97F4A7C15) & mask)
                    if (h >> 11) / 2**53 >= config.dropout and (best is None or (rank, a) < best[:2]):
                        best = (rank, a, b, e)
                if best is None:
                    break
                _, a, b, e = best
                held = [(part[a:e], a, e) if i == a else (x, i, j) for x, i, j in held if i != b]
            for x, _, _ in held:
                out += [names[x]] if x in names else [int(p.byte[b]) for b in x.encode()]
    return out


def p_names(p, cache={}):
    if not cache:
        sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
        cache.update({sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))})
    return cache


def test_dropout_against_the_definition():
    ts, c = texts()[:150] + ["the theatre internationalisation " * 3], M.DropoutConfig(dropout=0.25, seed=11)
    keys = [hash((7, i)) for i in range(len(ts))]
    e = M.Encoder(PATH, run=37)
    got, plain = e.encode_split(list(map(M.split_parts, ts)), keys, c)
    for t, k, ids in zip(ts, keys, got, strict=True):
        assert ints(ids) == naive(t, k, e.p, c), repr(t)
    assert plain == [len(x) // 4 for x in e.encode(ts, keys, None)]


def test_each_occurrence_is_segmented_by_itself():
    e, c = M.Encoder(PATH), M.DropoutConfig()
    one = e.encode_split([M.split_parts("international " * 300)], [5], c)[0][0]
    pieces = [bytes(x) for x in e.p.bytes_of]
    words, at = [], []
    for i in ints(one):
        if pieces[i].startswith(b" ") and at:
            words.append(tuple(at))
            at = []
        at.append(i)
    assert len({*words}) > 20


def test_dropout_decodes_varies_and_repeats():
    ts = texts()
    c = M.DropoutConfig(dropout=0.2, seed=9)
    e = M.Encoder(PATH)
    a, b, again = (e.encode(ts, [v] * len(ts), c) for v in (1, 2, 1))
    assert a == again == M.Encoder(PATH, most=10, run=64).encode(ts[::-1], [1] * len(ts), c)[::-1]
    assert [e.decode(x) for x in a] == ts and [e.decode(x) for x in b] == ts
    assert sum(x != y for x, y in zip(a, b, strict=True)) > 200


def test_arrays_and_heap_agree():
    p, c = M.Pieces(PATH), M.DropoutConfig(dropout=0.3, seed=4)
    parts = sorted({x for t in texts() for x in M.PART.findall((" " + t).replace(" ", M.SPACE)) if 1 < len(x) <= M.WIDE})
    keys = M.occurrence_keys(M.document_keys([3] * len(parts), c), np.arange(len(parts)))
    for config in (None, c):
        assert [ints(x) for x in M.encode_keyed(parts, keys, p, config)] == [M._heap_merge(x, p, config, int(k)) for x, k in zip(parts, keys, strict=True)]


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:40])] + [(None, None, "y"), (3, "rep", ""), (3, "rep", ""), (8, "a very long word " + "x" * 40000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    d = M.digest(df, PATH).collect()
    assert len(d) == len(rows) and all(r.lossless for r in d)
    full = M.decode_documents(M.encode_documents(df, PATH), PATH)
    assert full.filter("decoded != text").count() == 0 and full.count() == len(rows)
    assert M.digest(df.limit(0), PATH).count() == 0
