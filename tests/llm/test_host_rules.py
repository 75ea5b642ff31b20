from tessera.llm import host_rules as R


def naive(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts(spark):
    texts = [None, "", "  \n\t", "a", "a b c", "a a a a", "a b c a b c", "x y a b c z a b c a b c q", "l 1\nl 1\n\n \nl 1 \nother #$ <b>", "a b a b a b\x0ba b", "é ü #"]
    df = spark.createDataFrame([(i, "h", t, 1) for i, t in enumerate(texts)], "doc_id long, source string, text string, kept int")
    for r in R.judged(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == naive(r.row.text), r
        assert r.base_failed and not r.kept


def test_hosts(spark):
    clean = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}###" for i in range(60))
    rows = [(i, "good", clean) for i in range(200)] + [(300, "good", junk)] + [(400 + i, "bad", junk) for i in range(80)] + [(500, "bad", clean), (600, None, clean), (600, None, clean), (700, "tiny", junk)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    kept = sorted(r.doc_id for r in R.filter_documents(df).collect())
    assert kept == [*range(200), 300, 500, 600, 600]  # the tiny host's rate of 1 is shrunk, but stays over the limit
    clash = df.select("*", df.doc_id.alias("kept"), df.text.alias("row"), df.doc_id.alias("n_words"), df.source.alias("host"))
    got = R.filter_documents(clash)
    assert got.columns == clash.columns and sorted(r.doc_id for r in got.collect()) == kept
    assert R.filter_documents(df.limit(0)).count() == 0
