"""Rule filter: ordered rejection rules as one column.

Defined cases: null texts count as empty, and empty and blank texts pass all rules. Rows are judged one by one, so
repeated rows are each judged; an empty table gives an empty result. ``apply_rules`` replaces columns that have the
names of its own two.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: fixed values: whitelist patterns by rule
WHITELIST = {
    "length": ["^第[一二三四五六七八九十百千]+[条章节]", "^[《「].+[》」]$"],
    "non_chinese": [r"\b(API|CPU|GPU|HTTP|JSON|SQL|CSS|HTML|LLM|NLP|AI|ML|DL)\b", r"^[A-Z][a-z]+[\s，、].*[一-鿿]"],
    "effective_ratio": ["^[一-鿿，、。；：！？]{3,}$"],
}
URL = f"https?://{T.NON_SPACES}+"
TAG = "<[^>]+>"


@dataclass(frozen=True)
class RuleConfig:
    min_length: int = 10
    max_length: int = 10000
    max_non_script: float = 0.55
    max_repeat: float = 0.40
    max_urls: int = 20
    min_effective: float = 0.50
    #: the script whose characters rule 2 asks for
    script: str = T.HAN
    whitelist: dict = field(default_factory=lambda: WHITELIST)
    #: off: empty and blank texts are judged as all others, as SQL without that exception does
    blank_passes: bool = True


#: The same rules for texts in Latin letters.
LATIN = RuleConfig(script=r"[\p{IsLatin}\s\p{P}]")


def whitelisted(col, config: RuleConfig, rule: str):
    found = F.lit(False)
    for p in config.whitelist.get(rule, []):
        found = found | col.rlike(p)
    return found


def effective_ratio(col):
    return T.ratio(T.count_letters(col), col)


def reject_rule(col, config: RuleConfig = RuleConfig()):
    """The first rule that rejects a text, null if none. Blank texts pass all rules, unless the configuration says otherwise."""
    n = F.length(col)
    return (
        F.when((T.strip(col) == "") if config.blank_passes else F.lit(False), F.lit(None).cast("string"))
        .when(((n < config.min_length) & ~whitelisted(col, config, "length")) | (n > config.max_length), "length")
        .when((T.non_script_ratio(col, config.script) > config.max_non_script) & ~whitelisted(col, config, "non_chinese"), "non_chinese")
        .when(T.repeat_ratio(col) > config.max_repeat, "repeat_char")
        .when((T.count_matches(col, URL) > config.max_urls) | (T.count_matches(col, TAG) > config.max_urls), "html_url")
        .when((effective_ratio(col) < config.min_effective) & ~whitelisted(col, config, "effective_ratio"), "effective_ratio")
    )


def reject_reason(col, rule, config: RuleConfig = RuleConfig()):
    """What a rejected text is told, with its figure."""
    n = F.length(col)
    two = lambda x: F.format_string("%.2f", x)
    return (
        F.when((rule == "length") & (n < config.min_length), F.format_string(f"too_short(%d<{config.min_length})", n))
        .when(rule == "length", F.format_string(f"too_long(%d>{config.max_length})", n))
        .when(rule == "non_chinese", F.concat(F.lit("non_chinese("), two(T.non_script_ratio(col, config.script)), F.lit(")")))
        .when(rule == "repeat_char", F.concat(F.lit("repeat_char("), two(T.repeat_ratio(col)), F.lit(")")))
        .when(rule == "html_url", F.lit("too_many_urls_or_tags"))
        .when(rule == "effective_ratio", F.concat(F.lit("low_effective("), two(effective_ratio(col)), F.lit(")")))
    )


def apply_rules(df: DataFrame, text_col: str = "text", config: RuleConfig = RuleConfig()) -> DataFrame:
    """``df`` with reject_rule and reject_reason."""
    col = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("reject_rule", reject_rule(col, config)).withColumn("reject_reason", reject_reason(col, F.col("reject_rule"), config))


def keep(df: DataFrame, text_col: str = "text", config: RuleConfig = RuleConfig()) -> DataFrame:
    return df.filter(reject_rule(F.coalesce(F.col(text_col), F.lit("")), config).isNull())


def rule_stats(df: DataFrame, text_col: str = "text", config: RuleConfig = RuleConfig()) -> DataFrame:
    """Rows by outcome (``passed`` or the rule), most frequent first."""
    rule = F.coalesce(reject_rule(F.coalesce(F.col(text_col), F.lit("")), config), F.lit("passed"))
    return df.groupBy(rule.alias("outcome")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "outcome")
