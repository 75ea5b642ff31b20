"""Seeds, instruction pairs, parsers of generated text, post-filters, comparisons and training formats.

Defined cases: a null text, reply or field counts as missing: it is never a seed, parses to null, and is rejected as an
empty field. Ties of an order go to the smaller id. Repeated rows are each returned. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import row_numbers

#: fixed values: task types, the noise counted in seeds, and what an output that refuses holds
TASK_TYPES = ["推理分析", "知识问答", "文本生成", "代码编写", "多轮对话"]
NOISE = r"http[s]?://|www\.|\.com|\.cn|[#$%&@*]"
REFUSALS = ["作为.?AI", "我不能", "对不起", "我无法", "As an AI", "I cannot", "I'm sorry"]


def select_seeds(df: DataFrame, count: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", max_ppl: float = 15.0, min_script: float = 0.5, script: str = T.HAN) -> DataFrame:
    """Texts of 100 to 500 characters with a fitting perplexity and script share; ``count`` of them in md5 order, with rank."""
    t = F.col(text_col)
    ok = F.length(t).between(100, 500) & (F.coalesce("ppl", F.lit(999.0)) <= max_ppl) & (T.count_matches(t, script) / F.greatest(F.length(t), F.lit(1)) >= min_script)
    head = df.filter(ok).withColumn("_order", T.md5_order(seed, F.col(id_col))).orderBy("_order", id_col).limit(count)
    return head.withColumn("rank", F.row_number().over(Window.orderBy("_order", id_col))).drop("_order")


def select_seeds_by_noise(df: DataFrame, count: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", script: str = T.HAN, min_script: float = 0.4) -> DataFrame:
    t = F.col(text_col)
    noise = T.count_matches(t, NOISE)
    return df.filter(F.length(t).between(100, 500) & (noise <= 3) & (T.count_matches(t, script) / F.length(t) >= min_script)).orderBy(T.md5_order(seed, F.col(id_col)), id_col).limit(count)


def prompts(seeds: DataFrame, template: str, per_seed: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per seed and generation, with a task type in turn and the prompt of the first 1200 characters."""
    types = F.array(*map(F.lit, TASK_TYPES))
    rows = seeds.filter(F.length(text_col) >= 20).withColumn("gen", F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1)))).withColumn("task_type", F.element_at(types, F.col("gen") % len(TASK_TYPES) + 1))
    return rows.withColumn("prompt", F.replace(F.replace(F.lit(template), F.lit("{seed_text}"), F.substring(text_col, 1, 1200)), F.lit("{task_type}"), F.col("task_type"))).withColumn("seed_id", F.col(id_col).cast("string"))


def generate(df: DataFrame, generator: Callable[[list[str]], list[str | None]], prompt_col: str = "prompt", out: str = "reply") -> DataFrame:
    """``df`` with the injected generator's reply to each prompt (null where it fails)."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield b.assign(**{out: generator(b[prompt_col].tolist())})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} string")


def _fields(col):
    """(instruction, output) of a text that is one JSON object with both and nothing after it."""
    got = F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<struct<instruction: string, output: string>>")
    one = F.get(got, F.lit(0))
    return F.when((F.size(got) == 1) & one["instruction"].isNotNull() & one["output"].isNotNull(), one)


def parse_reply(col):
    """(instruction, output) of a reply: code fences off, then JSON, else the widest braces that hold both keys."""
    bare = T.strip(F.regexp_replace(col, r"^\s*```[a-z]*\s*|\s*```\s*$", ""))
    return F.coalesce(_fields(bare), _fields(F.regexp_extract(bare, r'(?s)\{.*"instruction".*"output".*\}', 0)))


def parse_braces(col):
    """(instruction, output) of the first braces without braces in them that are JSON with both keys."""
    found = F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"\{[^{}]*\}"), F.lit(0)), _fields)
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def parse_first_to_last(col):
    """(instruction, output) of what stands from the first opening to the last closing brace."""
    return _fields(F.regexp_extract(col, r"(?s)\{.*\}", 0))


def judge(col):
    """A or B: of the first five characters if only one stands there, else the first in the text; null if none."""
    t = F.upper(T.strip(col))
    head = F.substring(t, 1, 5)
    a, b = F.contains(head, F.lit("A")), F.contains(head, F.lit("B"))
    return F.when(a & ~b, "A").when(b & ~a, "B").otherwise(F.nullif(F.regexp_extract(t, "[AB]", 0), F.lit("")))


def code_block(col):
    found = F.regexp_extract(col, r"(?s)```(?:python)?\n?(.*?)```", 1)
    return T.strip(F.when(found != "", found).otherwise(col))


def answer(col):
    return F.regexp_extract(col, r"(?m)答案[：:]\s*([\d.]+)\s*$", 1).try_cast("double")


def math_pairs(df: DataFrame) -> DataFrame:
    """Rows of (instruction, reply_a, reply_b) whose answers are both there and differ; the first is chosen."""
    x = df.withColumn("answer_a", answer(F.col("reply_a"))).withColumn("answer_b", answer(F.col("reply_b")))
    return x.filter("answer_a IS NOT NULL AND answer_b IS NOT NULL AND answer_a <> answer_b").select("instruction", F.col("reply_a").alias("chosen"), F.col("reply_b").alias("rejected"), F.lit("math_answer_verification").alias("rule_type"), F.lit("dpo_math").alias("source"), "answer_a", "answer_b")


def evolve_candidates(df: DataFrame, most: int = 150, seq: str = "seq") -> DataFrame:
    return df.orderBy(F.length("instruction"), seq).limit(most).withColumn("parent_id", F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.substring("instruction", 1, 30)))


def pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, instruction, output): a user's turn and the assistant's after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = conversations.withColumn("output", F.lead("text").over(w)).withColumn("_next", F.lead("role").over(w))
    return x.filter("role = 'user' AND _next = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "output")


def postfilter_rule(instruction, output, min_instruction: int = 10, min_output: int = 30):
    """Why a pair is rejected, null if it is kept."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(instruction) | empty(output), "empty_field").when(F.length(instruction) < min_instruction, "instruction_too_short").when(F.length(output) < min_output, "output_too_short").when(output.rlike("|".join(REFUSALS)), "reject_template")


def with_ids(df: DataFrame, order: str, prefix: str = "synth") -> DataFrame:
    """``df`` with id, a number of at least four digits by place in ``order`` (an id column is replaced)."""
    numbered = row_numbers(df.drop("id") if order != "id" else df, [order], "_at")
    return numbered.withColumn("id", F.format_string(f"{prefix}_%04d", F.col("_at"))).drop("_at")


def resume(seeds: DataFrame, done: DataFrame, key: str = "seed_id") -> DataFrame:
    """Seeds without finished rows."""
    return seeds.join(done.select(key).distinct(), key, "left_anti")


def distribution_gap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """gap: the sum over all values of the absolute difference of their shares, three places."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select(col, (F.col("n") / F.col("all")).alias(name))

    other = shares(b, "y").withColumnRenamed(col, "_value")
    both = shares(a, "x").join(other, F.col(col).eqNullSafe(F.col("_value")), "full_outer")  # null is a value like others
    return both.agg(F.round(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), 3).alias("gap"))


def top_bigrams(df: DataFrame, text_col: str = "text", n: int = 20, least: int = 3) -> DataFrame:
    t = F.col(text_col)
    b = df.select(F.explode(T.windows(t, 2)).alias("bigram"))
    return b.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "bigram").limit(n)


def last_by_id(df: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the last one's values at the first one's place."""
    rows = df.groupBy(key).agg(F.min(seq).alias("_first"), F.max_by(F.struct(*df.columns), seq).alias("_row"))
    return rows.select("_row.*", F.col("_first").alias("first_seq"))


def to_sft(df: DataFrame, keys: list[str]) -> DataFrame:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.select(*keys, F.array(turn("user", "instruction"), turn("assistant", "output")).alias("conversations"))


def training_losses(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """loss of each log line that holds both ``loss:`` and ``logits_loss:``; other lines go."""
    t = F.col(line_col)
    loss = F.trim(F.regexp_extract(t, r"loss:([^,]*)", 1)).try_cast("double")
    return lines.filter(F.contains(t, F.lit("loss:")) & F.contains(t, F.lit("logits_loss:"))).withColumn("loss", loss).filter("loss IS NOT NULL")


def triplet_loss(real, generated, initial=None, l1: float = 1.0, l2: float = 1.0):
    """-log sigmoid(l1 (real - generated) + l2 (generated - initial)); a missing initial value is real - 0.5."""
    init = F.coalesce(initial, real - 0.5) if initial is not None else real - 0.5
    return F.log1p(F.exp(-(l1 * (real - generated) + l2 * (generated - init))))
