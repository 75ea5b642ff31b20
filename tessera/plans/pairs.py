"""Queries of instruction data: seeds, prompts, parsers, filters, scores and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import comparison, generation, instructions, ngram, scoring
from .shared import PAIRS, count_sql, docs, gram_ctes, ppl_sql, strip_sql, table

LATIN_LETTER = r"\p{IsLatin}"
TEMPLATE = "Make a task of the kind {task_type} from this text:\n{seed_text}"


def pairs(spark, sf_dir):
    return instructions.pairs(table(spark, sf_dir, "conversations"))


def seed_select(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("ppl", F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 20).cast("double")))
    return instructions.select_seeds(d, 80, script=LATIN_LETTER).select("doc_id", "rank")


def seeds_by_noise(spark, sf_dir):
    return instructions.select_seeds_by_noise(docs(spark, sf_dir), 80, script=LATIN_LETTER).select("doc_id")


def prompts(spark, sf_dir):
    s = instructions.select_seeds_by_noise(docs(spark, sf_dir), 80, script=LATIN_LETTER)
    return instructions.prompts(s, TEMPLATE).select("seed_id", "gen", "task_type", "prompt")


def drawn_types(spark, sf_dir):
    """A task type for each document by hash."""
    return docs(spark, sf_dir).select("doc_id", generation.hashed_task_type(instructions.TASK_TYPES, 42, F.col("doc_id")).alias("task_type"))


def seed_text(spark, sf_dir):
    """The text resolver on rows with empty and null columns."""
    d = docs(spark, sf_dir)
    a, b = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return d.select("doc_id", F.md5(T.first_text(a, b, F.col("lang"))).alias("three"), F.md5(T.first_text(a, b)).alias("two"))


def evolve_candidates(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("seq", F.col("conv_id") * 1000 + F.col("turn")).withColumn("id", F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string")).otherwise(F.lit("")))
    return instructions.evolve_candidates(p).select("seq", "parent_id")


def parsed_replies(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('```json\n{"instruction":"q'), i, F.lit('","output":"a'), i, F.lit('"}\n```')))
    reply = reply.when(F.col("doc_id") % 3 == 1, F.concat(F.lit('so {"instruction": "p'), i, F.lit('", "output": "o"} end'))).otherwise(F.concat(F.lit("none "), i))
    p = docs(spark, sf_dir).select("doc_id", instructions.parse_reply(reply).alias("p"))
    return p.select("doc_id", "p.instruction", "p.output")


def parsed_wide(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    reply = F.concat(F.lit("x {"), F.lit('"instruction": "p'), i, F.lit('", "output": "o"} y'), F.when(F.col("doc_id") % 2 == 0, F.lit(" }")).otherwise(F.lit("")))
    p = docs(spark, sf_dir).select("doc_id", instructions.parse_braces(reply).alias("a"), instructions.parse_first_to_last(reply).alias("b"))
    return p.select("doc_id", F.col("a.instruction").alias("inner_braces"), F.col("b.instruction").alias("widest"))


def marks(spark, sf_dir):
    """Judge, answer and code block of replies made from the ids."""
    n = F.col("doc_id")
    i = n.cast("string")
    verdict = F.when(n % 3 == 0, F.concat(F.lit(" b"), i)).when(n % 3 == 1, F.lit("neither AB here")).otherwise(F.concat(F.lit("none: "), i))
    ans = F.when(n % 4 == 0, F.concat(F.lit("答案：1.2."), i)).otherwise(F.concat(F.lit("so\n答案: "), i, F.lit(".5 \nend")))
    code = F.when(n % 2 == 0, F.concat(F.lit("see ```python\nx = "), i, F.lit("\n``` end"))).otherwise(F.concat(F.lit("  x = "), i))
    return docs(spark, sf_dir).select("doc_id", instructions.judge(verdict).alias("verdict"), instructions.answer(ans).alias("answer"), instructions.code_block(code).alias("code"))


def _two(spark, sf_dir):
    n = F.col("doc_id")
    return docs(spark, sf_dir).select(F.concat(F.lit("task "), n.cast("string")).alias("instruction"), F.concat(F.lit("答案："), (n % 7).cast("string")).alias("reply_a"), F.concat(F.lit("答案："), (n % 5).cast("string"), F.when(n % 11 == 0, F.lit(" apples")).otherwise(F.lit(""))).alias("reply_b"))


def math_pairs(spark, sf_dir):
    return instructions.math_pairs(_two(spark, sf_dir)).select("instruction", "chosen", "rejected", "rule_type", "answer_a", "answer_b")


def code_pairs(spark, sf_dir):
    """20 pairs, by syntax (every third reply is broken) and then by verdict."""
    n = F.col("doc_id")
    d = docs(spark, sf_dir).select(F.format_string("task %09d", n).alias("instruction"), F.concat(F.lit("x = "), F.when(n % 3 == 0, F.lit("(")).otherwise(F.lit("")), n.cast("string")).alias("reply_a"), F.concat(F.lit("y = "), n.cast("string")).alias("reply_b"), F.when(n % 2 == 0, F.lit("A")).when(n % 5 == 0, F.lit("B")).alias("said"))
    return generation.code_pairs(d, "said")


def recent_duplicates(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    return comparison.dedup_recent(p.select("seq", "instruction"), "seq", chunk=64).select("seq", "recent_duplicate")


def consistency(spark, sf_dir):
    c = comparison.consistency_flags(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", threshold=0.3)
    return c.select(F.col("id").alias("vec_id"), F.round("nearest", 6).alias("nearest"), "flagged")


def synth_ids(spark, sf_dir):
    return instructions.with_ids(pairs(spark, sf_dir).withColumn("seq", F.col("conv_id") * 1000 + F.col("turn")), "seq").select("seq", "id")


def resumed(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("seed_id"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seed_id"))
    return instructions.resume(d, done)


def token_cost(spark, sf_dir):
    return generation.cost(docs(spark, sf_dir).select(F.when(F.col("doc_id") % 9 != 0, F.lit("r")).alias("reply"), F.col("n_chars").alias("tokens")))


def pair_ppl(spark, sf_dir):
    s = ngram.score_pairs(pairs(spark, sf_dir), ["conv_id", "turn"])
    return s.select("conv_id", "turn", F.when(F.col("ppl") < float("inf"), F.round("ppl", 3)).alias("ppl"))


def _ifd(spark, sf_dir):
    return scoring.with_ifd(scoring.ngram_losses(pairs(spark, sf_dir), ["conv_id", "turn"]))


def ifd_scores(spark, sf_dir):
    return _ifd(spark, sf_dir).select("conv_id", "turn", F.round("loss_uncond", 4).alias("loss_uncond"), F.round("loss_cond", 4).alias("loss_cond"))


def _difficulty(spark, sf_dir):
    n = F.col("n_chars")
    bad = F.when(n % 11 == 0, F.lit(None).cast("double")).when(n % 13 == 0, F.lit(float("inf"))).when(n % 17 == 0, F.lit(float("nan"))).otherwise(n % 997 / 500.0)
    return docs(spark, sf_dir).select("doc_id", "source", bad.alias("ifd_score"))


def ifd_ratio(spark, sf_dir):
    n = F.col("n_chars")
    cond, un = F.when(n % 5 != 0, n % 89 / 10.0), F.when(n % 7 != 0, n % 31 / 10.0)
    from ..operators.curriculum import ifd

    x = ifd(cond, un)
    return docs(spark, sf_dir).select("doc_id", F.when(x < float("inf"), x).alias("ifd"))


def ifd_summary(spark, sf_dir):
    s = scoring.ifd_summary(_difficulty(spark, sf_dir))
    return s.select("n_valid", F.round("ifd_mean", 9).alias("ifd_mean"), F.round("ifd_median", 9).alias("ifd_median"), "ifd_min", "ifd_max", "n_below", "n_from")


def ifd_by_source(spark, sf_dir):
    return scoring.ifd_summary(_difficulty(spark, sf_dir), ["source"]).select("source", "n_valid", F.round("ifd_mean", 9).alias("ifd_mean"), F.round("ifd_median", 9).alias("ifd_median"))


def pair_profile(spark, sf_dir):
    return scoring.pair_profile(pairs(spark, sf_dir), ["turn"])


def diversity(spark, sf_dir):
    return scoring.cosine_spread(table(spark, sf_dir, "embeddings"))


def diversity_median(spark, sf_dir):
    return scoring.cosine_median(table(spark, sf_dir, "embeddings"))


def length_gap(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return comparison.length_gap(p.filter("conv_id % 2 = 0"), p.filter("conv_id % 2 = 1"))


def top_bigrams(spark, sf_dir):
    return instructions.top_bigrams(docs(spark, sf_dir))


def bigrams_only_in(spark, sf_dir):
    d = docs(spark, sf_dir)
    return comparison.only_in(d.filter("lang = 'en'"), d.filter("lang = 'de'"))


def last_by_id(spark, sf_dir):
    return instructions.last_by_id(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


def seeds_in_both(spark, sf_dir):
    a, b = docs(spark, sf_dir).select(F.col("doc_id").alias("seed_id"), "source"), table(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("seed_id"))
    return comparison.seeds_in_both(a, b)


def log_losses(spark, sf_dir):
    n = F.col("doc_id")
    line = F.when(n % 3 == 0, F.concat(F.lit("step loss: "), n.cast("string"), F.lit(".25, logits_loss: 2.0"))).when(n % 3 == 1, F.lit("loss: 1.0")).otherwise(F.lit("loss: bad, logits_loss: 1"))
    return instructions.training_losses(docs(spark, sf_dir).select("doc_id", line.alias("line"))).select("doc_id", "loss")


QUERIES = [seed_select, seeds_by_noise, prompts, drawn_types, seed_text, evolve_candidates, parsed_replies, parsed_wide, marks, math_pairs, code_pairs, recent_duplicates, consistency, synth_ids, resumed, token_cost, pair_ppl, ifd_scores, ifd_ratio, ifd_summary, ifd_by_source, pair_profile, diversity, diversity_median, length_gap, top_bigrams, bigrams_only_in, last_by_id, seeds_in_both, log_losses]

_SEQ = f"SELECT *, conv_id * 1000 + turn AS seq FROM ({PAIRS})"
_SHARE = count_sql("\\p{Latin}") + " / length(text)"
_NOISY = f"SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 100 AND 500 AND {count_sql('http[s]?://|www\\.|\\.com|\\.cn|[#$%&@*]')} <= 3 AND {_SHARE} >= 0.4 ORDER BY md5('42:' || doc_id), doc_id LIMIT 80"
_TYPES = "['" + "', '".join(instructions.TASK_TYPES) + "']"
_IFD = f"""WITH o AS (SELECT conv_id * 1000 + turn AS k, conv_id, turn, {strip_sql("instruction")} AS ins, {strip_sql("output")} AS o FROM ({PAIRS})), {gram_ctes("SELECT o AS t FROM o", "SELECT k, right(ins || chr(10), 2) || o AS t, length(right(ins || chr(10), 2)) AS skip FROM o WHERE o <> '' UNION ALL SELECT -k - 1, o, 0 FROM o", True)},
m AS (SELECT CASE WHEN k < 0 THEN -k - 1 ELSE k END AS k, k < 0 AS alone, c, pr FROM pr)
SELECT conv_id, turn, round(-avg(ln(pr)) FILTER (alone), 4) AS loss_uncond, round(-avg(ln(0.5::DOUBLE * pr + 0.5::DOUBLE * (length(ins) - length(replace(ins, c, ''))) / greatest(length(ins), 1))) FILTER (NOT alone), 4) AS loss_cond FROM m JOIN o USING (k) GROUP BY conv_id, turn"""
_D = "WITH d AS (SELECT doc_id, source, CASE WHEN n_chars % 11 = 0 OR n_chars % 13 = 0 OR n_chars % 17 = 0 THEN NULL ELSE n_chars % 997 / 500.0::DOUBLE END AS x FROM documents)"
_TOP2 = lambda w: f"SELECT b AS bigram, count(*) AS n FROM (SELECT c || lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE {w})) WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, bigram LIMIT 20"
_EN, _DE = "lang = 'en'", "lang = 'de'"
_COS = "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id)"
_REPLY = "CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || '{\"instruction\":\"q' || doc_id || '\",\"output\":\"a' || doc_id || '\"}' || chr(10) || '```' WHEN 1 THEN 'so {\"instruction\": \"p' || doc_id || '\", \"output\": \"o\"} end' ELSE 'none ' || doc_id END"

SQL = {
    "seed_select": f"WITH d AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN n_chars % 20 ELSE 999 END AS ppl FROM documents) SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id)))::INT AS rank FROM d WHERE length(text) BETWEEN 100 AND 500 AND ppl <= 15 AND {_SHARE} >= 0.5 QUALIFY rank <= 80",
    "seeds_by_noise": f"SELECT doc_id FROM ({_NOISY})",
    "prompts": f"SELECT doc_id::VARCHAR AS seed_id, g::INT AS gen, {_TYPES}[g + 1] AS task_type, 'Make a task of the kind ' || {_TYPES}[g + 1] || ' from this text:' || chr(10) || substr(text, 1, 1200) AS prompt FROM ({_NOISY}), range(5) r(g)",
    "drawn_types": f"SELECT doc_id, {_TYPES}[('0x' || substr(md5('42:' || doc_id), 1, 7))::BIGINT % 5 + 1] AS task_type FROM documents",
    "seed_text": "WITH d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS a, CASE WHEN doc_id % 2 = 0 THEN source END AS b FROM documents) SELECT doc_id, md5(coalesce(nullif(a, ''), nullif(b, ''), nullif(lang, ''), '')) AS three, md5(coalesce(nullif(a, ''), nullif(b, ''), '')) AS two FROM d",
    "evolve_candidates": f"SELECT seq, CASE WHEN seq % 2 = 0 THEN seq::VARCHAR ELSE substr(instruction, 1, 30) END AS parent_id FROM ({_SEQ}) ORDER BY length(instruction), seq LIMIT 150",
    "parsed_replies": f"WITH r AS (SELECT doc_id, regexp_extract({_REPLY}, '(?s)\\{{.*\"instruction\".*\"output\".*\\}}') AS j FROM documents) SELECT doc_id, CASE WHEN j <> '' THEN json_extract_string(j, '$.instruction') END AS instruction, CASE WHEN j <> '' THEN json_extract_string(j, '$.output') END AS output FROM r",
    "parsed_wide": "SELECT doc_id, 'p' || doc_id AS inner_braces, CASE WHEN doc_id % 2 = 1 THEN 'p' || doc_id END AS widest FROM documents",
    "marks": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' END AS verdict, CASE WHEN doc_id % 4 <> 0 THEN (doc_id || '.5')::DOUBLE END AS answer, 'x = ' || doc_id AS code FROM documents",
    "math_pairs": "SELECT 'task ' || doc_id AS instruction, '答案：' || doc_id % 7 AS chosen, '答案：' || doc_id % 5 AS rejected, 'math_answer_verification' AS rule_type, (doc_id % 7)::DOUBLE AS answer_a, (doc_id % 5)::DOUBLE AS answer_b FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> doc_id % 5",
    "code_pairs": "WITH d AS (SELECT doc_id AS n, 'x = ' || CASE WHEN doc_id % 3 = 0 THEN '(' ELSE '' END || doc_id AS a, 'y = ' || doc_id AS b, CASE WHEN doc_id % 3 = 0 THEN false WHEN doc_id % 2 = 0 THEN true WHEN doc_id % 5 = 0 THEN false END AS first FROM documents) SELECT printf('task %09d', n) AS instruction, CASE WHEN first THEN a ELSE b END AS chosen, CASE WHEN first THEN b ELSE a END AS rejected, CASE WHEN n % 3 = 0 THEN 'code_execution' ELSE 'llm_judge' END AS rule_type, 'dpo_code' AS source FROM d WHERE first IS NOT NULL ORDER BY instruction, chosen LIMIT 20",
    "recent_duplicates": f"""WITH RECURSIVE s AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn, list_distinct(string_split(instruction, '')) AS cs FROM ({_SEQ})),
f AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BOOLEAN AS dup, []::VARCHAR[][] AS recent
 UNION ALL SELECT rn, seq, dup, CASE WHEN dup THEN recent ELSE list_slice(list_append(recent, cs), -20, -1) END FROM
 (SELECT s.rn, s.seq, s.cs, f.recent, len(list_filter(f.recent, lambda r: len(list_intersect(r, s.cs)) >= 0.7 * (len(r) + len(s.cs) - len(list_intersect(r, s.cs))) AND len(s.cs) > 0)) > 0 AS dup FROM f JOIN s ON s.rn = f.rn + 1))
SELECT seq, dup AS recent_duplicate FROM f WHERE rn > 0""",
    "consistency": "WITH h AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 30), n AS (SELECT a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS x FROM h a JOIN h b ON a.vec_id <> b.vec_id GROUP BY 1) SELECT vec_id, round(x, 6) AS nearest, x > 0.3 AND (SELECT count(*) FROM h) >= 30 AS flagged FROM n",
    "synth_ids": f"SELECT seq, printf('synth_%04d', row_number() OVER (ORDER BY seq) - 1) AS id FROM ({_SEQ})",
    "resumed": "SELECT doc_id AS seed_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "token_cost": "SELECT count(*) FILTER (doc_id % 9 <> 0) AS n_calls, sum(n_chars)::BIGINT AS tokens, round(sum(n_chars) / 1e6 * 2, 4) AS cost FROM documents",
    "pair_ppl": f"WITH p AS (SELECT *, instruction || chr(10) || output AS t FROM ({_SEQ})), s AS ({ppl_sql('SELECT t FROM p', 'SELECT seq AS k, t FROM p')}) SELECT conv_id, turn, round(ppl, 3) AS ppl FROM p LEFT JOIN s ON k = seq",
    "ifd_scores": _IFD,
    "ifd_ratio": "SELECT doc_id, CASE WHEN n_chars % 5 <> 0 AND n_chars % 7 <> 0 AND n_chars % 31 > 0 THEN round((n_chars % 89 / 10.0::DOUBLE) / (n_chars % 31 / 10.0::DOUBLE), 4) END AS ifd FROM documents",
    "ifd_summary": f"{_D} SELECT count(x) AS n_valid, round(avg(x), 9) AS ifd_mean, round(median(x), 9) AS ifd_median, min(x) AS ifd_min, max(x) AS ifd_max, count(*) FILTER (x < 1) AS n_below, count(*) FILTER (x >= 1) AS n_from FROM d",
    "ifd_by_source": f"{_D} SELECT source, count(x) AS n_valid, round(avg(x), 9) AS ifd_mean, round(median(x), 9) AS ifd_median FROM d GROUP BY source",
    "pair_profile": f"SELECT turn, count(*) AS n, min(length(instruction))::INT AS inst_min, max(length(instruction))::INT AS inst_max, round(avg(length(instruction)), 4) AS inst_mean, min(length(output))::INT AS out_min, max(length(output))::INT AS out_max, round(avg(length(output)), 4) AS out_mean FROM ({PAIRS}) GROUP BY turn",
    "diversity": f"{_COS} SELECT (SELECT count(*) FROM u) AS n, round(avg(c), 4) AS cos_mean, round(stddev_pop(c), 4) AS cos_std, round(1 - avg(c), 4) AS diversity FROM c",
    "diversity_median": f"{_COS} SELECT round(median(c), 4) AS cos_median FROM c",
    "length_gap": f"WITH p AS ({PAIRS}), m AS (SELECT avg(length(instruction)) FILTER (conv_id % 2 = 0) AS ia, avg(length(instruction)) FILTER (conv_id % 2 = 1) AS ib, avg(length(output)) FILTER (conv_id % 2 = 0) AS oa, avg(length(output)) FILTER (conv_id % 2 = 1) AS ob FROM p), x AS (SELECT 'instruction' AS field, ia AS a, ib AS b FROM m UNION ALL SELECT 'output', oa, ob FROM m) SELECT field, round(a, 4) AS mean_a, round(b, 4) AS mean_b, round(abs(a - b) / greatest(a, 1) * 100, 4) AS gap_pct FROM x",
    "top_bigrams": _TOP2("true"),
    "bigrams_only_in": f"WITH a AS ({_TOP2(_EN)}), b AS ({_TOP2(_DE)}) SELECT 'a' AS side, bigram, n FROM a WHERE bigram NOT IN (SELECT bigram FROM b) UNION ALL SELECT 'b', bigram, n FROM b WHERE bigram NOT IN (SELECT bigram FROM a)",
    "last_by_id": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, min(turn) AS first_seq FROM conversations GROUP BY conv_id",
    "seeds_in_both": "SELECT doc_id AS seed_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "log_losses": "SELECT doc_id, doc_id + 0.25::DOUBLE AS loss FROM documents WHERE doc_id % 3 = 0",
}
