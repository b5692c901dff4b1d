"""Conversation memory: which messages of each conversation are kept.

Messages are (conv, pos, role, content). System messages always come first, in their order; ``ord`` numbers what is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import token_estimate


def normal_messages(df: DataFrame, conv: str, pos: str, role: str | None, content: str) -> DataFrame:
    """(conv, pos, role, content): a missing role is ``assistant``, null content is '' [F34]."""
    r = F.coalesce(F.col(role), F.lit("assistant")) if role else F.lit("assistant")
    return df.select(F.col(conv).alias("conv"), F.col(pos).alias("pos"), r.alias("role"), F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"))


def _numbered(kept: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv").orderBy((F.col("role") != "system"), "pos")
    return kept.select("conv", "pos", "role", "content", F.row_number().over(w).alias("ord"))


def keep_all(messages: DataFrame) -> DataFrame:
    """Every message, in order."""
    return messages.select("conv", "pos", "role", "content", F.row_number().over(Window.partitionBy("conv").orderBy("pos")).alias("ord"))


def sliding_window(messages: DataFrame, most: int = 10) -> DataFrame:
    """All system messages, then the last ``most`` others [W1]."""
    if most <= 0:
        raise ValueError("most must be positive")
    back = Window.partitionBy("conv", F.col("role") == "system").orderBy(F.col("pos").desc())
    return _numbered(messages.withColumn("_rn", F.row_number().over(back)).where((F.col("role") == "system") | (F.col("_rn") <= most)))


def token_budget(messages: DataFrame, max_tokens: int, margin: int = 0, tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """System messages, then the longest suffix of the others that fits what they leave of the budget; the newest stays in any case.

    If the system messages alone use up the budget, they are all that is kept [W2].
    """
    budget = max_tokens - margin
    m = messages.withColumn("_t", tokens(F.col("content")))
    conv = Window.partitionBy("conv")
    m = m.withColumn("_sys", F.coalesce(F.sum(F.when(F.col("role") == "system", F.col("_t"))).over(conv), F.lit(0)))
    back = Window.partitionBy("conv", F.col("role") == "system").orderBy(F.col("pos").desc())
    m = m.withColumn("_rn", F.row_number().over(back)).withColumn("_used", F.col("_sys") + F.sum("_t").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("_sys") < budget) & ((F.col("_used") <= budget) | (F.col("_rn") == 1))
    return _numbered(m.where((F.col("role") == "system") | fits))


def checkpoint_summary(messages: DataFrame, keep_recent: int, interval: int, summarise: Callable[[Column], Column] | None = None, most_tokens: int | None = None) -> DataFrame:
    """System messages, one summary of the older part, then the recent messages [W4].

    The first checkpoint covers all older messages; a conversation with no more than keep_recent + 1 others stays as it is, and so
    does any with ``keep_recent`` 0. Each conversation is taken as one call: checkpoints of earlier calls live in
    ``interval``-sized steps of the caller. ``summarise`` makes the text of the array of older contents; by default
    their first 40 characters are joined.
    """
    if keep_recent < 0 or interval < 1:
        raise ValueError("keep_recent must not be negative, interval must be positive")
    make = summarise or (lambda texts: F.array_join(F.transform(texts, lambda t: F.substring(t, 1, 40)), " / "))
    side = Window.partitionBy("conv", F.col("role") == "system")
    m = messages.withColumn("_rn", F.row_number().over(side.orderBy("pos"))).withColumn("_n", F.count(F.when(F.col("role") != "system", 1)).over(Window.partitionBy("conv")))
    short = (F.col("_n") <= keep_recent + 1) | F.lit(keep_recent == 0)
    old = (F.col("role") != "system") & ~short & (F.col("_rn") <= F.col("_n") - keep_recent)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    summary = m.where(old).groupBy("conv").agg(texts.alias("texts"), F.count("*").alias("covered"), F.max("pos").alias("pos"))
    summary = summary.select("conv", "pos", F.lit("summary").alias("role"), F.concat(F.lit("Summary of "), F.col("covered").cast("string"), F.lit(" messages: "), make(F.col("texts"))).alias("content"))
    kept = m.where(~old).select("conv", "pos", "role", "content").unionByName(summary)
    w = Window.partitionBy("conv").orderBy(F.when(F.col("role") == "system", 0).when(F.col("role") == "summary", 1).otherwise(2), "pos")
    return kept.select("conv", "pos", "role", "content", F.row_number().over(w).alias("ord"))


def next_checkpoint(count: Column, last: Column, interval: int) -> Column:
    """Whether ``count`` older messages call for a new checkpoint after one at ``last`` (null: none yet)."""
    return last.isNull() | ((count >= interval) & (count - last >= interval))


def rendered_history(messages: DataFrame, most: int) -> DataFrame:
    """(conv, text): the last ``most`` messages of each conversation, numbered, one per line [W5, H11]."""
    back = Window.partitionBy("conv").orderBy(F.col("pos").desc())
    kept = messages.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= most)
    rows = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    lines = F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["role"], F.lit(": "), x["content"]))
    return kept.groupBy("conv").agg(F.array_join(lines, "\n").alias("text"))


def prompt_pairs(turns: DataFrame, most: int) -> DataFrame:
    """(conv, ord, role, content): the last ``most`` turns (conv, pos, question, answer) as user and assistant messages [H18]."""
    back = Window.partitionBy("conv").orderBy(F.col("pos").desc())
    kept = turns.withColumn("_rn", F.row_number().over(back)).where(F.col("_rn") <= most)
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    flat = kept.select("conv", "pos", F.posexplode(pair).alias("k", "m"))
    return flat.select("conv", F.row_number().over(Window.partitionBy("conv").orderBy("pos", "k")).alias("ord"), "m.role", "m.content")


_STRATEGIES = {
    "none": keep_all, "noop": keep_all, "full": keep_all,
    "sliding_window": sliding_window, "sliding": sliding_window, "window": sliding_window,
    "token_limit": token_budget, "token_budget": token_budget, "tokens": token_budget,
    "summary": checkpoint_summary, "checkpoint_summary": checkpoint_summary,
}


def strategy(spec: str | dict | Callable | None, **options) -> Callable[[DataFrame], DataFrame]:
    """A strategy from a name, a mapping with ``name`` and options, or a function [X14]; unknown names raise."""
    if spec is None:
        return keep_all
    if callable(spec):
        return lambda df: spec(df, **options)
    if isinstance(spec, dict):
        options = {k: v for k, v in spec.items() if k not in ("name", "type")} | options
        spec = spec.get("name") or spec.get("type") or ""
    fn = _STRATEGIES.get(spec.strip().lower().replace("-", "_"))
    if fn is None:
        raise ValueError(f"unknown memory strategy {spec!r}; known: {', '.join(sorted(_STRATEGIES))}")
    return lambda df: fn(df, **options)


def pre_model_messages(messages: DataFrame, spec: str | dict | Callable | None = None, **options) -> DataFrame:
    """(conv, llm_input_messages): what a model gets to see of each conversation, as one array [H19]."""
    kept = strategy(spec, **options)(messages)
    rows = F.array_sort(F.collect_list(F.struct("ord", "role", "content")))
    return kept.groupBy("conv").agg(F.transform(rows, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("llm_input_messages"))
