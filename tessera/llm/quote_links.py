"""Conversations in reply order, rebuilt from quoted passages with built-in SQL functions only.

A line's quote level is the number of ``>`` at its start (spaces between them aside). A passage is a run of lines of one
level that are not blank, with line breaks as spaces: normalised (markers off, lower case, white space as one space) and
hashed, it is the same however it was wrapped. Each quoted passage is joined to the earliest message of the same
conversation that holds it as its own passage or line, if that message is earlier. The lines of passages that were never
said as a whole (parts of a passage were quoted, or several were run together) are joined one by one. A message replies
to the message that most of its level-1 lines come from (of several, the latest); deeper levels are links to
older messages. Threads are found by pointer doubling over the messages that reply. What is returned has no
quotes and no attribution line before a quote ("On ... wrote:").

The own passages and lines of a conversation become one row per hash before the join, so a very common one costs one
row, and no message is ever paired with all others. ``position`` is a message's place in its conversation in reply
order: by thread (the first message's turn), then by turn; an answered message stands before its answers. It comes from
cumulative counts over range partitions, so a conversation of any size is many tasks.

Defined cases: null texts have no lines. Null conversations are one conversation, and null turns come before all others and are never quoted.
Rows that repeat conversation and turn are returned each time and share a position; their lines count together. Quotes
without an original, or whose original is not earlier or in another conversation, stay unlinked. An empty table gives
an empty result. Columns of the input other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import cumulative
from .common import cut, let

MARKS = r"^(?:[ \t]*>)+"
#: fixed values: what an attribution line ends with, in the corpus's languages
ATTRIBUTION = r"^\s*\S.*(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def quote_level(line):
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[ \t]", ""))


def normalised(line):
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def without_quotes(text):
    """The lines of level 0, without attribution lines that stand before a quoted line; trimmed."""
    lines = _lines(text)

    def own(ls):
        keep = F.filter(ls, lambda x, i: (quote_level(x) == 0) & ~(x.rlike(ATTRIBUTION) & (F.coalesce(quote_level(F.get(ls, i + 1)), F.lit(0)) > 0)))
        return F.regexp_replace(F.array_join(keep, "\n"), r"^\s+|\s+$", "")

    return F.element_at(F.transform(F.array(lines), own), 1)


def passages(text):
    """An array of (level, hash, lines) of a text's passages in order; lines: the hashes of their lines."""
    hashed = lambda x: F.sha2(x, 256)

    def of(ls):
        same = lambda i, j: (F.get(ls, j)["norm"] != "") & (F.get(ls, j)["level"] == F.get(ls, i)["level"])
        places = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.get(ls, i)["norm"] != "")
        # a line starts (ends) a passage if that before (after) it isn't of the passage; starts and ends pair up in order
        starts = F.filter(places, lambda i: ~F.coalesce(same(i, i - 1), F.lit(False)))
        ends = F.filter(places, lambda i: ~F.coalesce(same(i, i + 1), F.lit(False)))

        def one(s, e):
            norms = F.transform(F.slice(ls, s + 1, e - s + 1), lambda x: x["norm"])
            return F.struct(F.get(ls, s)["level"].alias("level"), hashed(F.array_join(norms, " ")).alias("hash"), F.transform(norms, hashed).alias("lines"))

        return F.zip_with(starts, ends, one)

    lines = F.transform(_lines(text), lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("norm")))
    return let(lines, of)


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, original, n_lines): how many quoted lines of a message come from which earlier one."""
    each = messages.select("conv", "turn", F.explode(passages(F.col("text"))).alias("p")).select("conv", "turn", "p.*")
    own = each.filter("level = 0 AND turn IS NOT NULL").select("conv", "turn", F.explode(F.array_union(F.array("hash"), "lines")).alias("hash"))
    own = own.groupBy("conv", "hash").agg(F.min("turn").alias("original"))
    quoted = each.filter("level > 0").groupBy("conv", "turn", "level", "hash", "lines").agg(F.count(F.lit(1)).alias("n"))

    def join(rows: DataFrame) -> DataFrame:
        q, o = rows.alias("q"), own.alias("o")
        found = q.join(o, F.col("q.conv").eqNullSafe(F.col("o.conv")) & (F.col("q.hash") == F.col("o.hash")) & (F.col("o.original") < F.col("q.turn")), "left")
        return found.select("q.*", "o.original")

    whole = cut(join(quoted), "quoted")
    parts = whole.filter("original IS NULL").select("conv", "turn", "level", F.explode("lines").alias("hash"), "n").groupBy("conv", "turn", "level", "hash").agg(F.sum("n").alias("n"))
    said = whole.filter("original IS NOT NULL").select("conv", "turn", "level", "original", (F.col("n") * F.size("lines")).alias("n"))
    both = said.unionByName(join(parts).filter("original IS NOT NULL").select("conv", "turn", "level", "original", "n"))
    return both.groupBy("conv", "turn", "level", "original").agg(F.sum("n").alias("n_lines"))


def _threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of every message that replies: the turn at the chain's end and its distance."""
    at = cut(replies.select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        a, b = at.alias("a"), at.alias("b")
        step = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.thread") == F.col("b.turn")), "left")
        step = step.select(
            F.col("a.conv").alias("conv"), F.col("a.turn").alias("turn"), F.coalesce("b.thread", "a.thread").alias("thread"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"), F.col("b.turn").isNotNull().alias("moved")
        )
        step = cut(step, "threads")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, clean_text, reply_to, thread, depth, position, n_quoted (lines) and n_linked of every row."""
    m = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    found = cut(links(m), "quote-links")
    best = found.filter("level = 1").groupBy("conv", "turn").agg(F.max_by("original", F.struct("n_lines", "original")).alias("reply_to"))
    linked = found.groupBy("conv", "turn").agg(F.sum("n_lines").alias("n_linked"))
    threads = _threads(best)
    same = lambda x, y: F.col(f"{x}.conv").eqNullSafe(F.col(f"{y}.conv")) & (F.col(f"{x}.turn").eqNullSafe(F.col(f"{y}.turn")))
    info = linked.alias("l").join(best.alias("b"), same("l", "b"), "left").join(threads.alias("t"), same("l", "t"), "left")
    info = info.select("l.conv", "l.turn", "l.n_linked", "b.reply_to", "t.thread", "t.depth")
    counts = m.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"))
    turns = counts.alias("c").join(info.alias("i"), same("c", "i"), "left").select("c.conv", "c.turn", "c.n", F.coalesce("i.thread", "c.turn").alias("thread"), "i.n_linked", "i.reply_to", "i.depth")
    placed = cumulative(turns, "n", ["thread", "turn"], ["conv"], "reply-order")
    n_quoted = F.size(F.filter(_lines(F.col("m.text")), lambda x: (quote_level(x) > 0) & (normalised(x) != ""))).cast("long")
    return m.alias("m").join(placed.alias("i"), same("m", "i")).select(
        F.col("m.conv").alias("conv_id"),
        F.col("m.turn").alias("turn"),
        F.col("m.role").alias("role"),
        without_quotes(F.col("m.text")).alias("clean_text"),
        F.col("i.reply_to").alias("reply_to"),
        F.col("i.thread").alias("thread"),
        F.coalesce("i.depth", F.lit(0)).cast("int").alias("depth"),
        (F.col("i._upto") - F.col("i.n")).alias("position"),
        n_quoted.alias("n_quoted"),
        F.coalesce("i.n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
