"""Quality rules with host verdicts, all on built-in SQL functions.

Each document gets counts from its whole text. Rule failures are summed by host; a host's rate is shrunk
towards the corpus with a beta prior fitted to the hosts (method of moments); the host's verdict goes back
to its documents. A document goes when it fails a base rule, or when its host is rejected for a rule that
the document itself breaks: clean documents of a bad host stay.

Defined cases: a null text has no words (base_failed). Null hosts are one host. Repeated rows count and are
returned each time. With one host, or hosts of equal rates, the prior has ``default_strength``. An empty
table gives an empty result. Columns other than the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, let, words_text

RULES = ("few_words", "repeats", "symbols", "dup_lines")


@dataclass(frozen=True)
class HostRuleConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: symbols against word characters, and repeated lines against lines with a word
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    #: a host is rejected for a rule whose shrunken failure rate is above this
    max_host_rate: float = 0.3
    default_strength: float = 20.0
    max_strength: float = 10000.0


def _covered(words):
    """Words covered by the three-word windows that an array of words holds twice or more."""

    def of_windows(s):
        starts = F.transform(
            s,
            lambda x, j: F.when(F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)), x["i"]),
        )
        return let(
            F.sort_array(F.filter(starts, lambda p: p.isNotNull())),
            lambda ps: F.aggregate(
                F.transform(ps, lambda p, k: F.least(F.lit(3), p - F.coalesce(F.get(ps, k - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda a, x: a + x
            ),
        )

    def of_words(w):
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        )
        return F.when(F.size(w) >= 4, let(F.sort_array(windows), of_windows)).otherwise(F.lit(0).cast("long"))

    return let(words, of_words)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    clean = words_text(F.col(text_col))
    words = F.split(clean, " +")
    lines = F.filter(F.split(raw, "\n"), lambda x: F.trim(F.translate(x, WS, " " * len(WS))) != "")
    return docs.withColumns(
        {
            "n_words": F.when(clean == "", F.lit(0)).otherwise(F.size(words)).cast("long"),
            "word_chars": F.length(F.translate(raw, WS, "")).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.translate(raw, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _covered(words),
        }
    )


def rule_failures(config: HostRuleConfig) -> dict:
    c = F.col
    return {
        "few_words": c("n_words") < config.min_words,
        "repeats": 100 * c("n_repeat_words") > config.max_repeat_percent * c("n_words"),
        "symbols": 100 * c("n_symbols") > config.max_symbol_percent * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > config.max_dup_line_percent * c("n_lines"),
    }


def host_verdicts(measured: DataFrame, host_col: str, config: HostRuleConfig = HostRuleConfig()) -> DataFrame:
    """A row per host: n_docs and, for each rule, the shrunken rate and whether the host is rejected for it.

    The beta prior of a rule has the mean m and the variance v of the hosts' rates; alpha + beta is
    m (1 - m) / v - 1, held between 1 and ``max_strength``.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.count_if(x).alias(f"k_{r}") for r, x in rule_failures(config).items())
    )
    prior = hosts.agg(
        *(x for r in RULES for x in (F.avg(F.col(f"k_{r}") / F.col("n_docs")).alias(f"m_{r}"), F.var_pop(F.col(f"k_{r}") / F.col("n_docs")).alias(f"v_{r}")))
    )
    out = hosts.crossJoin(F.broadcast(prior))  # one row
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.least(F.lit(config.max_strength), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(config.default_strength)
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + m * strength) / (F.col("n_docs") + strength))
        out = out.withColumn(f"bad_{r}", F.round(F.col(f"rate_{r}"), 9) > config.max_host_rate)
    return out.select("host", "n_docs", *(f"rate_{r}" for r in RULES), *(f"bad_{r}" for r in RULES))


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", config: HostRuleConfig = HostRuleConfig(), columns: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns, those in ``columns``) with the measures, base_failed and kept.

    The measures are computed once and written to the shared folder: the host rates and the documents' own
    verdicts both read them. The join is on the host, against one row per host.
    """
    columns = docs.columns if columns is None else columns
    host = F.col(host_col)
    inner = docs.select(F.struct(*columns).alias("row"), host.alias("host"), F.col(text_col).alias("text"))
    measured = cut(measures(inner).drop("text"), "host-rules")
    verdicts = host_verdicts(measured, "host", config)
    joined = measured.alias("d").join(verdicts.alias("v"), F.col("d.host").eqNullSafe(F.col("v.host")), "left")
    fails = rule_failures(config)
    base = fails["few_words"] | fails["repeats"]
    by_host = F.lit(False)
    for r in RULES:
        by_host = by_host | (F.coalesce(F.col(f"v.bad_{r}"), F.lit(False)) & fails[r])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select("row", *names, base.alias("base_failed"), (~base & ~by_host).alias("kept"))


def filter_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", config: HostRuleConfig = HostRuleConfig()) -> DataFrame:
    """The documents that the rules and their hosts' verdicts keep, with the columns that ``docs`` has."""
    return judged(docs, host_col, text_col, config).filter("kept").select("row.*")
