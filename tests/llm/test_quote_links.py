import random
import re
from collections import Counter

from tessera.llm import quote_links as Q


def level(line):
    return re.match(r"(?:[ \t]*>)*", line)[0].count(">")


def norm(line):
    return re.sub(r"\s+", " ", re.sub(r"^(?:[ \t]*>)+", "", line)).strip(" ").lower()


def split(text):
    """(level, lines) of the passages of a text."""
    out, last = [], None
    for line in re.split("\r?\n", text or ""):
        if not norm(line):
            last = None
            continue
        if last != level(line):
            out.append((level(line), []))
            last = level(line)
        out[-1][1].append(norm(line))
    return out


def brute(rows):
    own = {}
    for c, t, _, x in rows:
        for lv, lines in split(x):
            if lv == 0 and t is not None:
                for u in [" ".join(lines), *lines]:
                    own[c, u] = min(own.get((c, u), t), t)
    out, parent, counts, linked = [], {}, {}, Counter()
    for c, t, _, x in rows:
        for lv, lines in split(x):
            if lv and t is not None:
                whole = own.get((c, " ".join(lines)))
                for u in lines:
                    o = whole if whole is not None and whole < t else own.get((c, u))
                    if o is not None and o < t:
                        linked[c, t] += 1
                        if lv == 1:
                            counts.setdefault((c, t), Counter())[o] += 1
    for k, n in counts.items():
        parent[k] = max((v, o) for o, v in n.items())[1]
    for c, t, r, x in rows:
        k, d = t, 0
        while (c, k) in parent:
            k, d = parent[c, k], d + 1
        out.append([c, t, r, parent.get((c, t)), sum(len(ls) for lv, ls in split(x) if lv), linked[c, t], k, d])
    place = lambda o: (o[0], -1 if o[6] is None else o[6], -1 if o[1] is None else o[1])
    for o in out:
        o.append(sum(p[0] == o[0] and place(p)[1:] < place(o)[1:] for p in out))
    return out


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = []
    for conv in [None, *range(12)]:
        said = []
        for turn in range(r.randrange(1, 14)):
            lines = [" ".join(r.choice("ab cd ef gh ij".split()) for _ in range(r.randint(1, 5))) + f" {turn}" for _ in range(r.randint(1, 3))] + ["Thanks"]
            if said and r.random() < 0.7:
                q = r.choice(said)
                if r.random() < 0.4 and not any(x.startswith(">") for x in q):  # wrapped anew
                    q = " ".join(q).split(" ")
                    q = [" ".join(q[i : i + 3]) for i in range(0, len(q), 3)]
                    lines = ["Someone wrote:"] + ["> " + x for x in q] + lines
                else:
                    lines = ["On Monday someone wrote:"] + [("> " if x.startswith(">") else r.choice(["> ", ">", " > "])) + x.upper() for x in r.sample(q, min(2, len(q)))] + ["> never said"] * (turn % 2) + lines  # noqa: E501
            said.append(lines)
            rows.append((conv, turn, "user", "\n".join(lines)))
    rows += [(20, 0, None, None), (20, None, "user", "> x"), (20, 1, "user", ""), (20, 2, "u", ">")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "conv_id long, turn long, role string, text string, thread string").repartition(3)
    got = Q.conversations(df).collect()
    key = lambda x: [(-1 if v is None else v) if not isinstance(v, str) else v for v in x]
    have = sorted((key([x.conv_id, x.turn, x.role, x.reply_to, x.n_quoted, x.n_linked, x.thread, x.depth, x.position]) for x in got), key=str)
    assert have == sorted((key(x) for x in brute(rows)), key=str)
    assert max(x.depth for x in got) >= 2
    for x in got:
        assert not any(level(y) for y in x.clean_text.split("\n")) and "wrote:" not in x.clean_text


def test_levels_and_clean_text(spark):
    rows = [(1, 0, "a", "First line\nsecond line"), (1, 1, "b", "On Tue a wrote:\n> first  LINE\n\nAgreed. It wrote:\nno quote"), (1, 2, "a", "b wrote:\n> Agreed. It wrote:\n>> First line\n> > second line\nok"), (1, 2, "a", "repeated turn")]
    got = sorted(Q.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r.turn, r.clean_text))
    assert [(r.turn, r.clean_text, r.reply_to, r.thread, r.depth, r.n_quoted, r.n_linked) for r in got] == [
        (0, "First line\nsecond line", None, 0, 0, 0, 0),
        (1, "Agreed. It wrote:\nno quote", 0, 0, 1, 1, 1),
        (2, "ok", 1, 0, 2, 3, 3),
        (2, "repeated turn", 1, 0, 2, 0, 3),
    ]


def test_wrapped_anew_and_reply_order(spark):
    said = "The first point is about time. The second one\nis about money."
    rows = [(1, 0, "a", said), (1, 1, "b", "Another matter."), (1, 2, "c", "> The first point is\n> about time. The second one is about\n>  money.\nYes."), (1, 3, "a", "> Another matter.\nNo."), (1, 4, "b", "> > The first point is about time. The second one\n> > is about money.\n> Yes.\nSo be it.")]
    got = sorted(Q.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    assert [(r.turn, r.reply_to, r.thread, r.depth, r.position, r.n_linked) for r in got] == [(0, None, 0, 0, 0, 0), (2, 0, 0, 1, 1, 3), (4, 2, 0, 2, 2, 3), (1, None, 1, 0, 3, 0), (3, 1, 1, 1, 4, 1)]


def test_registered_queries_agree_with_sql(spark):
    import duckdb

    from tessera.llm import queries

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet'")
    for name in ("op7_quote_links", "quoted_conversations"):
        df = queries.queries()[name](spark, at)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str), name
    assert sum(x.depth > 0 for x in df.collect()) > 20


def test_empty(spark):
    assert Q.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
