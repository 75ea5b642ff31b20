import hashlib

from tessera.llm import warc as W


def test_url_keys():
    assert W.url_key("https://www.Blog.example.co.uk:443/a?b=1#c") == "uk,co,example,blog)/a?b=1"
    assert W.url_key("http://x.org:8080") == "org,x:8080)/"
    assert W.url_key(None) == "-" and W.url_key("http://[bad") == "http://[bad"


def test_round_trip_and_lookup(spark):
    big = "é" * 600
    rows = [(i, f"http://h{i % 7}.example.com/{i % 11}", f"<p>{i}</p>" * 200) for i in range(300)]
    rows += [(1000 + i, f"https://copy.org/{i}", big) for i in range(5)] + [(2000, None, None), (2001, "", ""), (2002, "http://s.org/", "x"), (2003, "http://s.org/", "x"), (None, "http://n.org/\r\nX: y", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    a = W.write(df, lines_per_block=20)
    got = {r.id: r for r in W.read_all(spark, a, payloads=True).collect()}
    assert len(got) == len(rows) and a.directory.count() >= 15
    for i, u, h in rows:
        data, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = i is not None and 1000 <= i < 1004
        assert (r.record_type, r.refers_to) == (("revisit", 1004) if revisit else ("response", None))
        assert r.payload == (None if revisit else data)
    urls = df.select("url").union(spark.createDataFrame([("http://absent.org/",), ("http://h3.example.com/3",)], "url string"))
    sought = W.seek(spark, a, W.url_keys(urls), payloads=True).collect()
    assert sorted(map(tuple, sought), key=str) == sorted((tuple(r) for r in got.values()), key=str)
    some = W.seek(spark, a, W.url_keys(urls.filter("url like '%h3.example%'"))).collect()
    assert sorted(r.id for r in some) == sorted(i for i, u, _ in rows if u and "h3.example" in u)
    found = W.lookup(a, ["http://h3.example.com/3", "http://copy.org/2", "http://absent.org"])
    assert sorted(r["id"] for r in found) == sorted([i for i, u, _ in rows if u == "http://h3.example.com/3"] + [1002])


def test_repeated_ids_and_empty(spark):
    big = "x" * 2000
    df = spark.createDataFrame([(1, "u", big), (1, "u", big), (2, "u", big)], "page_id long, url string, html string")
    assert sorted((r.id, r.record_type, r.refers_to) for r in W.read_all(spark, W.write(df)).collect()) == [(1, "revisit", 2), (1, "revisit", 2), (2, "response", None)]
    hot = spark.createDataFrame([(i, "http://one.org/", f"{i}") for i in range(90)] + [(None, "http://one.org/", big), (None, "http://two.org/", big)], "page_id long, url string, html string")
    a = W.write(hot, lines_per_block=7)
    got = W.seek(spark, a, W.url_keys(hot)).collect()
    assert len(got) == 92 and sum(r.id is None and r.record_type == "response" for r in got) == 2
    mixed = W.write(hot.union(spark.createDataFrame([(500, None, big)], hot.schema)))
    assert {(r.id, r.record_type, r.refers_to) for r in W.read_all(spark, mixed).collect() if r.payload_bytes > 999} == {(None, "revisit", 500), (500, "response", None)}
    e = W.write(df.limit(0))
    assert W.seek(spark, e, W.url_keys(df)).count() == 0
    assert W.read_all(spark, e).count() == 0 and W.lookup(e, ["u"]) == []
