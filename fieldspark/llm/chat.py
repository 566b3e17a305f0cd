"""Preference formatting: the turns that chosen and rejected share are rendered once, the rest as two masked completions.

Turns are ordered by (turn, role, text), null turn numbers last. The prompt is the longest common prefix of turns equal
in role and text; each completion renders its side's remaining turns. A mask gives runs ``flag:length`` over the
completion's code points: 1 where loss applies (an assistant turn's content and end mark), 0 elsewhere.

Everything is DataFrame and SQL functions. A conversation is one record and is rendered by one task.

Defined results: null role: "user"; null text: empty content; null ``conv_id``: those rows are one conversation
without partner. A side without turns gives an empty completion; equal sides give two empty completions. Repeated
rows are turns of their own. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): one row for each conversation, its turns in order."""
    one = F.struct(
        F.col("turn").isNull().alias("late"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = F.sort_array(F.collect_list(one))
    return turns.groupBy(key).agg(ordered.alias("x")).select(
        key, F.transform("x", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def mask(turns: Column) -> Column:
    """Runs of the rendered completion: header, content with end mark, line end of each turn."""

    def runs(t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN) + 1
        body = F.length(t["text"]) + len(CLOSE)
        flag = F.when(t["role"] == "assistant", "1").otherwise("0")
        return F.concat(F.lit("0:"), head.cast("string"), F.lit(","), flag, F.lit(":"), body.cast("string"), F.lit(",0:1"))

    return F.array_join(F.transform(turns, runs), ",")


def masked_chars(turns: Column) -> Column:
    trained = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.aggregate(trained, F.lit(0).cast("long"), lambda a, t: a + F.length(t["text"]) + len(CLOSE))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` has two columns of turns; they are replaced by the prompt and the masked completions."""
    a, b = F.col(chosen), F.col(rejected)
    shared = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared), lambda x, y: x != y)
    first = F.array_position(both, True).cast("int")
    out = pairs.withColumn("n_prompt_turns", F.when(first > 0, first - 1).otherwise(shared).cast("int"))
    n = F.col("n_prompt_turns")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    out = out.withColumns({"_p": F.slice(a, F.lit(1), n), "_a": rest(a), "_b": rest(b)})
    return out.withColumns(
        {
            "n_prompt_turns": n.cast("long"),
            "prompt": render(F.col("_p")),
            chosen: render(F.col("_a")),
            rejected: render(F.col("_b")),
            "chosen_mask": mask(F.col("_a")),
            "rejected_mask": mask(F.col("_b")),
            "chosen_loss_chars": masked_chars(F.col("_a")),
            "rejected_loss_chars": masked_chars(F.col("_b")),
        }
    ).drop("_p", "_a", "_b")


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is chosen; rejected is the same up to its last assistant turn, which is replaced by the last
    assistant turn of the conversation whose id differs in the lowest bit (dropped if that has none)."""
    convs = conversations(table(spark, sf_dir, "conversations"))
    is_answer = F.transform("turns", lambda t: t["role"] == "assistant")
    at = F.size("turns") - F.array_position(F.reverse(is_answer), True).cast("int") + 1
    at = F.when(F.array_contains(is_answer, True), at).otherwise(F.size("turns") + 1).cast("int")
    convs = convs.withColumn("at", at)
    donors = convs.filter(F.col("at") <= F.size("turns")).select(
        (F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))).alias("conv_id"), F.slice("turns", F.col("at"), F.lit(1)).alias("answer")
    )
    pairs = convs.join(donors, "conv_id", "left").select(
        "conv_id",
        F.col("turns").alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.coalesce("answer", F.slice("turns", F.lit(1), F.lit(0)))).alias("rejected"),
    )
    return format_pairs(pairs)


_RENDER = "coalesce(list_aggregate(list_transform({x}, lambda t: concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10))), 'string_agg', ''), '')"
_MASK = (
    "coalesce(list_aggregate(list_transform({x}, lambda t: concat('0:', length(t.role) + 13, ',', CASE WHEN t.role = 'assistant' THEN '1' ELSE '0' END, ':', "
    "length(t.text) + 10, ',0:1')), 'string_agg', ','), '')"
)
_LOSS = "coalesce(list_sum(list_transform(list_filter({x}, lambda t: t.role = 'assistant'), lambda t: length(t.text) + 10)), 0)::BIGINT"

ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, 'user'), 'text': coalesce(text, '')}} ORDER BY turn IS NULL, turn, coalesce(role, 'user'), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id),
p AS (SELECT *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), len(turns) + 1) AS pos FROM c),
q AS (
  SELECT p.conv_id, p.turns AS a, list_concat(p.turns[1:p.pos - 1], CASE WHEN d.pos <= len(d.turns) THEN d.turns[d.pos:d.pos] ELSE [] END) AS b
  FROM p LEFT JOIN p d ON d.conv_id = xor(p.conv_id, 1)),
n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM q),
r AS (SELECT conv_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM n)
SELECT conv_id, n::BIGINT AS n_prompt_turns, {_RENDER.format(x="p")} AS prompt, {_RENDER.format(x="a")} AS chosen, {_RENDER.format(x="b")} AS rejected,
       {_MASK.format(x="a")} AS chosen_mask, {_MASK.format(x="b")} AS rejected_mask, {_LOSS.format(x="a")} AS chosen_loss_chars, {_LOSS.format(x="b")} AS rejected_loss_chars
FROM r
"""
