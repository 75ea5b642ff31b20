"""What the query modules share: tables, and SQL fragments for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.written import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to all cores."""
    return spread(table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that :data:`CHARS` has: all but those with a null text, which has no characters."""
    return docs(spark, sf_dir).filter("text IS NOT NULL")


def difficulty():
    """A stand-in for a difficulty, as the tables hold none."""
    return (F.col("n_chars") % 997 / 500.0).alias("ifd_score")


NS = T.NON_SPACES
CHARS = "WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, c, count(*) AS n FROM ch GROUP BY ALL) GROUP BY doc_id)"


def count_sql(pattern: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, '{pattern}'))"


LETTERS = count_sql("[\\p{L}\\p{N}]")
HAN = count_sql("[一-鿿]")


def rule_sql(script: str | None = None, most: float = 1.0) -> str:
    """The first rule that rejects ``text`` (``n``: its commonest character's count), with or without the script rule."""
    second = ""
    if script:
        edge = "[^\\p{L}\\p{N}_]"
        names = "API|CPU|GPU|HTTP|JSON|SQL|CSS|HTML|LLM|NLP|AI|ML|DL"
        second = f" WHEN 1 - {count_sql(script)} / length(text) > {most} AND NOT regexp_matches(text, '(^|{edge})({names})($|{edge})') AND NOT regexp_matches(text, '^[A-Z][a-z]+[\\s，、].*[一-鿿]') THEN 'non_chinese'"
    return f"""CASE WHEN length(text) < 10 AND NOT (regexp_matches(text, '^第[一二三四五六七八九十百千]+[条章节]') OR regexp_matches(text, '^[《「].+[》」]$')) OR length(text) > 10000 THEN 'length'{second}
 WHEN n / length(text) > 0.4 THEN 'repeat_char' WHEN {count_sql("https?://" + NS + "+")} > 20 OR {count_sql("<[^>]+>")} > 20 THEN 'html_url'
 WHEN {LETTERS} / length(text) < 0.5 AND NOT regexp_matches(text, '^[一-鿿，、。；：！？]{{3,}}$') THEN 'effective_ratio' ELSE 'passed' END"""


PAIRS = "SELECT conv_id, turn, text AS instruction, output FROM (SELECT *, lead(text) OVER w AS output, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"


def strip_sql(col: str) -> str:
    return f"regexp_replace(coalesce({col}, ''), '^{T.SPACES}+|{T.SPACES}+$', '', 'g')"


def gram_ctes(train: str, score: str, stepwise: bool = False) -> str:
    """CTEs up to ``pr`` (k, c, i, pr): the probability of each character of ``score`` (k, t, skip) after ``skip`` of them, by counts of ``train`` (t)."""
    p2 = "p1" if stepwise else "p0"
    return f"""tr0 AS (SELECT row_number() OVER () AS d, {strip_sql("t")} AS t FROM ({train})),
tr1 AS (SELECT d, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM tr0 WHERE length(t) >= 3),
tr AS (SELECT c, lag(c) OVER w AS b, lag(c, 2) OVER w AS a FROM tr1 WINDOW w AS (PARTITION BY d ORDER BY i)),
n1 AS (SELECT c AS g, count(*) AS n FROM tr GROUP BY 1), n2 AS (SELECT b || c AS g, count(*) AS n FROM tr WHERE b IS NOT NULL GROUP BY 1),
n3 AS (SELECT a || b || c AS g, count(*) AS n FROM tr WHERE a IS NOT NULL GROUP BY 1), tot AS (SELECT sum(n)::DOUBLE AS nn, count(*)::DOUBLE AS vv FROM n1),
sc0 AS (SELECT k, t, skip FROM ({score}) WHERE t <> ''), sc1 AS (SELECT k, skip, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM sc0),
sc AS (SELECT k, skip, i, c, lag(c) OVER w AS b, lag(c, 2) OVER w AS a FROM sc1 WINDOW w AS (PARTITION BY k ORDER BY i)),
p0 AS (SELECT k, i, sc.c, a, b, (coalesce(x1.n, 0) + 0.01::DOUBLE) / (nn + 0.01::DOUBLE * vv) AS p0, x2.n AS c2, y1.n AS k1, x3.n AS c3, y2.n AS k2 FROM sc CROSS JOIN tot LEFT JOIN n1 x1 ON x1.g = sc.c
  LEFT JOIN n2 x2 ON x2.g = b || sc.c LEFT JOIN n1 y1 ON y1.g = b LEFT JOIN n3 x3 ON x3.g = a || b || sc.c LEFT JOIN n2 y2 ON y2.g = a || b WHERE i > skip),
p1 AS (SELECT *, CASE WHEN b IS NOT NULL AND c2 > 0 THEN 0.6::DOUBLE * c2 / k1 + 0.4::DOUBLE * p0 ELSE p0 END AS p1 FROM p0),
pr AS (SELECT k, i, c, CASE WHEN a IS NULL THEN p1 WHEN c3 > 0 THEN 0.6::DOUBLE * c3 / k2 + 0.4::DOUBLE * p1 ELSE {p2} END AS pr FROM p1)"""


def ppl_sql(train: str, score: str) -> str:
    """(k, ppl) of the rows of ``score`` (k, t) with two characters or more."""
    return f"WITH {gram_ctes(train, f'SELECT k, {strip_sql("t")} AS t, 0 AS skip FROM ({score})')} SELECT k, exp(-avg(ln(pr))) AS ppl FROM pr GROUP BY k HAVING count(*) > 1"
