"""The queries of this subpackage over the tables' whole contents, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import crosspolytope, fm_toxicity, host_rules, html_tree, merge_dropout, packing, ppm, probminhash, quote_links, warc
from .common import ids_of_fold, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write(pages)
    return warc.seek(spark, archive, warc.url_keys(pages)).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fm_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = fm_toxicity.score_column(docs, model).select("doc_id", "score")
    return scored.select("doc_id", (ids_of_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return crosspolytope.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.conversations(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking on a derived table, as ``conversations`` holds no quotes: each message quotes the one before it,
    with its sentences on lines of their own, and each third one only that one's first sentence."""
    m = table(spark, sf_dir, "conversations")
    before = F.regexp_replace(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), r"([.!?]) ", "$1\n")
    quote = F.when(F.col("turn") % 3 == 2, F.split(before, "\n").getItem(0)).otherwise(before)
    text = F.when(before.isNull(), F.col("text")).otherwise(F.concat(F.lit("On Monday they wrote:\n> "), F.regexp_replace(quote, "\n", "\n> "), F.lit("\n\n"), "text"))
    return quote_links.conversations(m.withColumn("text", text))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = host_rules.judged(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return got.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages"))


def queries() -> dict:
    found = [op1_warc, op2_toxicity, op3_lm_score, op4_cross_polytope, op5_merge_dropout, op6_near_duplicates, op7_quote_links, op8_best_fit, op9_host_rules, op10_html_tree, quoted_conversations]
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in found}


_OP1 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
top AS (SELECT d, max(page_id) AS response FROM p WHERE octet_length(b) >= 1000 GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM p LEFT JOIN top ON p.d = top.d AND octet_length(b) >= 1000
"""

_OP9 = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS ls FROM w),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3, 100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (f1) AS k1, count(*) FILTER (f2) AS k2, count(*) FILTER (f3) AS k3, count(*) FILTER (f4) AS k4 FROM f GROUP BY source),
r AS (SELECT source, n, unnest([1, 2, 3, 4]) AS r, unnest([k1, k2, k3, k4]) AS k FROM h),
p AS (SELECT r, avg(k / n) AS m, var_pop(k / n) AS v FROM r GROUP BY r),
b AS (SELECT source, r.r, round((k + m * s) / (n + s), 9) > 0.3 AS bad FROM (SELECT r, m, CASE WHEN v > 0 THEN least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 20.0 END AS s FROM p) q JOIN r USING (r)),
v AS (SELECT source, bool_or(bad AND r = 1) AS b1, bool_or(bad AND r = 2) AS b2, bool_or(bad AND r = 3) AS b3, bool_or(bad AND r = 4) AS b4 FROM b GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed,
  NOT (f1 OR f2) AND NOT (b1 AND f1 OR b2 AND f2 OR b3 AND f3 OR b4 AND f4) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


_QUOTES = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id AS conv, turn, role, coalesce(text, '') AS text FROM (@)),
l AS (SELECT rid, conv, turn, unnest(regexp_split_to_array(text, '
?
')) AS line, generate_subscripts(regexp_split_to_array(text, '
?
'), 1) AS i FROM m),
x AS (SELECT *, length(replace(replace(regexp_extract(line, '^(?:[ 	]*>)+'), ' ', ''), chr(9), '')) AS level, lower(trim(regexp_replace(regexp_replace(line, '^(?:[ 	]*>)+', ''), '\s+', ' ', 'g'))) AS norm FROM l),
b AS (SELECT *, (norm <> '' AND coalesce(lag(norm) OVER w = '' OR lag(level) OVER w <> level, true))::INT AS starts, lead(level) OVER w > 0 AS before_quote FROM x WINDOW w AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY i) AS pn FROM b WHERE norm <> ''),
p AS (SELECT rid, conv, turn, level, pn, string_agg(norm, ' ' ORDER BY i) AS unit FROM g GROUP BY ALL),
own AS (SELECT conv, unit, min(turn) AS original FROM (SELECT conv, turn, unit FROM p WHERE level = 0 UNION ALL SELECT conv, turn, norm FROM g WHERE level = 0) WHERE turn IS NOT NULL GROUP BY ALL),
q AS (SELECT g.conv, g.turn, g.level, coalesce(a.original, o.original) AS original FROM g JOIN p USING (rid, pn)
  LEFT JOIN own a ON a.conv IS NOT DISTINCT FROM g.conv AND a.unit = p.unit AND a.original < g.turn
  LEFT JOIN own o ON o.conv IS NOT DISTINCT FROM g.conv AND o.unit = g.norm AND o.original < g.turn WHERE g.level > 0),
k AS (SELECT conv, turn, level, original, count(*) AS n FROM q WHERE original IS NOT NULL GROUP BY ALL),
best AS (SELECT conv, turn, original AS reply_to FROM k WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY n DESC, original DESC) = 1),
linked AS (SELECT conv, turn, sum(n)::BIGINT AS n_linked FROM k GROUP BY ALL),
t AS (SELECT conv, turn, reply_to AS thread, 1 AS depth FROM best UNION ALL SELECT t.conv, t.turn, b.reply_to, t.depth + 1 FROM t JOIN best b ON t.conv IS NOT DISTINCT FROM b.conv AND t.thread = b.turn),
top AS (SELECT conv, turn, arg_max(thread, depth) AS thread, max(depth)::INT AS depth FROM t GROUP BY ALL),
clean AS (SELECT rid, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (regexp_matches(line, '^\s*\S.*(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$') AND coalesce(before_quote, false))), ''), '^\s+|\s+$', '', 'g') AS clean_text,
  count(*) FILTER (level > 0 AND norm <> '') AS n_quoted FROM b GROUP BY rid),
r AS (SELECT m.conv AS conv_id, m.turn, role, clean_text, reply_to, coalesce(top.thread, m.turn) AS thread, coalesce(top.depth, 0)::INT AS depth, n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked FROM m JOIN clean USING (rid)
  LEFT JOIN linked k ON k.conv IS NOT DISTINCT FROM m.conv AND k.turn = m.turn LEFT JOIN best ON best.conv IS NOT DISTINCT FROM m.conv AND best.turn = m.turn LEFT JOIN top ON top.conv IS NOT DISTINCT FROM m.conv AND top.turn = m.turn)
SELECT *, rank() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST) - 1 AS position FROM r
"""
_MADE = r"""SELECT conv_id, turn, role, CASE WHEN b IS NULL THEN text ELSE 'On Monday they wrote:' || chr(10) || '> ' || replace(CASE WHEN turn % 3 = 2 THEN string_split(b, chr(10))[1] ELSE b END, chr(10), chr(10) || '> ') || chr(10) || chr(10) || text END AS text
  FROM (SELECT *, regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '([.!?]) ', '\1' || chr(10), 'g') AS b FROM conversations)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _OP1, "op9_host_rules": _OP9, "op7_quote_links": _QUOTES.replace("@", "SELECT * FROM conversations"), "quoted_conversations": _QUOTES.replace("@", _MADE)}
