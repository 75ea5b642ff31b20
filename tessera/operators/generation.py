"""Text from injected generators: a client with retries and counts, fan-outs, preference pairs and their checks.

No model is bundled and none is called by itself: a transport is a function from a prompt to a reply, given by the
caller. Code in replies is compiled for its syntax and never run.

Defined cases: a null or failing reply gives a null reply, and pairs without two usable replies are left out. Null and
short seeds are not asked about. Repeated rows are each asked about. Empty tables give empty results.
"""

from __future__ import annotations

import ast
import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as T
from .instructions import code_block, generate, judge, parse_reply, prompts

#: fixed value: price of a million tokens
PRICE_PER_MILLION = 2.0


def http_transport(url: str, model: str, key: str, timeout: float = 60.0, extra: dict | None = None) -> Callable[[str], tuple[str, int]]:
    """A transport that posts one user message to a chat endpoint and returns the reply and its total tokens."""

    def send(prompt: str) -> tuple[str, int]:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], **(extra or {})}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            got = json.load(r)
        return got["choices"][0]["message"]["content"], int(got.get("usage", {}).get("total_tokens", 0))

    return send


@dataclass
class ChatClient:
    """Calls a transport with up to ``retries`` tries, waiting 1, 2, 4, ... seconds between them; None after the last failure.

    With ``retries=1`` it is a client without retries. calls, tokens and failures count what this client did.
    """

    transport: Callable[[str], tuple[str, int]]
    retries: int = 3
    wait: Callable[[float], None] = time.sleep
    calls: int = field(default=0, init=False)
    tokens: int = field(default=0, init=False)
    failures: int = field(default=0, init=False)

    def ask(self, prompt: str) -> tuple[str | None, int]:
        for attempt in range(self.retries):
            try:
                reply, tokens = self.transport(prompt)
            except Exception:  # whatever a transport raises counts as a failed try
                if attempt + 1 < self.retries:
                    self.wait(2.0**attempt)
                continue
            self.calls += 1
            self.tokens += tokens
            return reply, tokens
        self.failures += 1
        return None, 0


def ask_all(df: DataFrame, client: Callable[[], ChatClient], prompt_col: str = "prompt") -> DataFrame:
    """``df`` with reply and tokens of each prompt. ``client`` makes one client per task; counts are sums of the columns."""
    k = df.columns.index(prompt_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", reply string, tokens long"

    def run(batches):
        c = client()
        for b in batches:
            got = [c.ask(p.as_py()) if p.as_py() else (None, 0) for p in b.column(k)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], [*b.schema.names, "reply", "tokens"])

    return df.mapInArrow(run, ddl)


def cost(asked: DataFrame, price: float = PRICE_PER_MILLION) -> DataFrame:
    """(n_calls, tokens, cost): replies that came, their tokens, and what they cost."""
    n = F.coalesce(F.sum("tokens"), F.lit(0))
    return asked.agg(F.count("reply").alias("n_calls"), n.alias("tokens"), F.round(n / 1e6 * price, 4).alias("cost"))


def self_instruct(seeds: DataFrame, template: str, generator, per_seed: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(seed_id, gen, instruction, output, task_type, source): the replies to each seed's prompts that parse."""
    asked = generate(prompts(seeds, template, per_seed, text_col, id_col).select("seed_id", "gen", "task_type", "prompt"), generator)
    parsed = asked.withColumn("p", parse_reply(F.col("reply"))).filter("p IS NOT NULL")
    return parsed.select("seed_id", "gen", "p.instruction", "p.output", "task_type", F.lit("self_instruct").alias("source"))


def hashed_task_type(types: list[str], seed: int, *cols):
    """A task type by a hash of the columns: drawn, and the same in every run."""
    return F.element_at(F.array(*map(F.lit, types)), (F.pmod(F.conv(F.substr(T.md5_order(seed, *cols), F.lit(1), F.lit(7)), 16, 10).cast("long"), F.lit(len(types))) + 1).cast("int"))


def evolution_type(types: list[str], seed: int, *cols):
    """An evolution operator by a hash of the columns."""
    return hashed_task_type(types, seed, *cols)


def evolve(candidates: DataFrame, template: str, types: list[str], generator, seed: int = 42) -> DataFrame:
    """(parent_id, instruction, output, evolution_type, source): candidates rewritten by an operator drawn by hash."""
    kind = evolution_type(types, seed, F.col("parent_id"))
    asked = candidates.select("parent_id", kind.alias("evolution_type"), F.replace(F.replace(F.lit(template), F.lit("{instruction}"), F.col("instruction")), F.lit("{evolution_type}"), kind).alias("prompt"))
    parsed = generate(asked, generator).withColumn("p", parse_reply(F.col("reply"))).filter("p IS NOT NULL")
    return parsed.select("parent_id", "p.instruction", "p.output", "evolution_type", F.lit("evol_instruct").alias("source"))


def _compiles(code: str | None) -> bool:
    if not code or not code.strip():
        return False
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@F.arrow_udf(BooleanType())
def compiles(col: pa.Array) -> pa.Array:
    """Whether a text is Python by its syntax; nothing is run. Null and blank texts are not."""
    return pa.array([_compiles(x.as_py()) for x in col], pa.bool_())


def code_pairs(df: DataFrame, verdict_col: str | None = None, most: int = 20) -> DataFrame:
    """(instruction, chosen, rejected, rule_type, source) of (instruction, reply_a, reply_b), in order of instruction.

    The reply whose code compiles is chosen; where both or none do, the judge's verdict (A or B) decides, if there is
    one. ``most`` pairs are returned: the pair count is the operator's feature.
    """
    x = df.withColumn("_a", compiles(code_block(F.col("reply_a")))).withColumn("_b", compiles(code_block(F.col("reply_b"))))
    said = judge(F.col(verdict_col)) if verdict_col else F.lit(None).cast("string")
    first = F.when(F.col("_a") != F.col("_b"), F.col("_a")).when(said.isNotNull(), said == "A")
    rule = F.when(F.col("_a") != F.col("_b"), "code_execution").otherwise("llm_judge")
    out = x.withColumn("_first", first).withColumn("rule_type", rule).filter("_first IS NOT NULL AND reply_a IS NOT NULL AND reply_b IS NOT NULL")
    pick = lambda yes, no: F.when(F.col("_first"), F.col(yes)).otherwise(F.col(no))
    return out.select("instruction", pick("reply_a", "reply_b").alias("chosen"), pick("reply_b", "reply_a").alias("rejected"), "rule_type", F.lit("dpo_code").alias("source")).orderBy("instruction", "chosen").limit(most)


def without_prompt(reply, prompt):
    """What a model said after the prompt that its output repeats, by the prompt's length."""
    return F.when(F.length(reply) >= F.length(prompt), F.substr(reply, F.length(prompt) + 1, F.length(reply))).otherwise(F.lit(""))
