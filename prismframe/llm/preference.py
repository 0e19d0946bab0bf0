"""Preference formatting: a shared prompt and two masked completions for each pair of conversations.

The longest common prefix of turns (role and text) of the chosen and the rejected conversation is rendered once as the
prompt. What follows in each is a completion; its mask lists the spans of characters that a loss counts: the text and the
end mark of the assistant's turns. Everything is an expression over arrays of turns, so a pair never meets another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, CLOSE, END, GAP = "<|", "|>\n", "<|end|>", "\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    """All turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END + GAP))), "")


def spans(turns: Column) -> Column:
    """Spans "from:to" (characters from 0, the end left out) of the assistant's texts with their end marks, by spaces."""

    def step(so_far: Column, t: Column) -> Column:
        start = so_far["at"] + F.length(_head(t))
        stop = start + F.length(t["text"]) + F.lit(len(END))
        own = F.when(t["role"] == ASSISTANT, F.array(F.concat_ws(":", start, stop))).otherwise(F.array().cast("array<string>"))
        return F.struct((stop + F.lit(len(GAP))).alias("at"), F.concat(so_far["spans"], own).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), step, lambda x: F.array_join(x["spans"], " "))


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are equal in both."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    return F.when(n == 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, n))


def format_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """key, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans for each row of pairs.

    pairs has the key and chosen, rejected: array<struct<role string, text string>>. A null role reads "unknown", a null
    text is empty, and a null turn is both. Equal conversations give two empty completions; conversations without a common turn an empty prompt. A null conversation
    counts as one without turns. Repeated rows stay apart; other columns are not read.
    """
    whole = lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    turns = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")), whole)
    p = pairs.select(key, turns("chosen").alias("_a"), turns("rejected").alias("_b"))
    p = p.withColumn("prompt_turns", common_turns(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    p = p.select(key, "prompt_turns", F.slice("_a", F.lit(1), F.col("prompt_turns")).alias("_p"), rest("_a").alias("_a"), rest("_b").alias("_b"))
    return p.select(
        key, "prompt_turns", rendered(F.col("_p")).alias("prompt"), rendered(F.col("_a")).alias("chosen"), rendered(F.col("_b")).alias("rejected"),
        spans(F.col("_a")).alias("chosen_spans"), spans(F.col("_b")).alias("rejected_spans"))


def pairs_of(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation with an assistant's turn: conv_id, chosen, rejected.

    chosen runs to the last turn of the assistant. In rejected this turn has the text of the assistant's first turn, or
    none if that is the only one. conversations has conv_id, turn, role, text; turns are in order of turn, then role, then text; a
    null role reads "unknown" and a null text is empty. Rows with one conv_id, null included, are one conversation.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    c = c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("t"))
    marks = F.transform("t", lambda x: x["role"] == ASSISTANT)
    c = c.withColumn("last", F.size("t") - F.array_position(F.reverse(marks), True).cast("int") + 1).withColumn("first", F.array_position(marks, True).cast("int"))
    c = c.where("first > 0")
    other = F.when(F.col("first") < F.col("last"), F.element_at("t", F.col("first"))["text"]).otherwise("")
    swapped = F.struct(F.lit(ASSISTANT).alias("role"), other.alias("text"))
    return c.select("conv_id", F.slice("t", F.lit(1), F.col("last")).alias("chosen"), F.concat(F.slice("t", F.lit(1), F.col("last") - 1), F.array(swapped)).alias("rejected"))
