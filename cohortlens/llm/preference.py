"""Preference formatting of paired conversations.

A pair is two conversations, chosen and rejected, as arrays of turns.  Their
longest common turn prefix is rendered once as the prompt; what is left of
each becomes a completion with the character spans that count towards the
loss (the texts and end marks of assistant turns).  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"   # fixed values: turn template
REPLY = "assistant"


def turns_of(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key``, turns: a conversation's (turn, role, text) in order of turn,
    then role, then text.  A conversation is one value, as a document is: its
    prompt is one string, so it must fit Spark's 2 GB for a value.

    Null roles become ``user``, null texts are empty, null turns come first;
    rows that repeat key, turn, role and text count once.  Rows without a key
    belong to no common conversation: each is one of its own and is not grouped."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col(key), turn.alias("t"))
    keyed = rows.filter(F.col(key).isNotNull()).distinct()
    turns = keyed.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.unionByName(rows.filter(F.col(key).isNull()).select(key, F.array("t").alias("turns")))
    return turns.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: up to its last reply a conversation is
    chosen; the same turns with that reply's text replaced by the reply
    before it (by nothing, where there is none) are rejected.
    Conversations without a reply make no pair."""
    turns = F.col("turns")
    at = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == REPLY, i)), lambda i: i.isNotNull())
    found = turns_of(conversations).withColumn("at", at).filter(F.size("at") > 0)
    last = F.element_at("at", -1)
    other = F.when(F.size("at") > 1, turns[F.try_element_at("at", F.lit(-2))]["text"]).otherwise(F.lit(""))
    wrong = F.array(F.struct(F.lit(REPLY).alias("role"), other.alias("text")))
    return found.select("conv_id", F.slice("turns", F.lit(1), last + 1).alias("chosen"),
                        F.concat(F.slice("turns", F.lit(1), last), wrong).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns two conversations begin with alike."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))      # a turn against none differs, too
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(F.size(differs)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE))), "")


def loss_spans(turns: Column) -> Column:
    """(start, length) in characters of what counts towards the loss."""
    empty = F.array().cast("array<struct<start:int,length:int>>")
    seed = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body).alias("at"),
                        F.when(t["role"] == REPLY, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, seed, step)["spans"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """All other columns of ``pairs``, n_prompt_turns, prompt, chosen and
    rejected (rendered completions), chosen_spans, rejected_spans.

    ``pairs``: arrays ``chosen`` and ``rejected`` of (role, text).  Equal
    conversations have empty completions; conversations without a common
    start an empty prompt; a null or empty array is a conversation without
    turns; an empty table gives no rows."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = {s: F.coalesce(F.col(s), none) for s in ("chosen", "rejected")}
    rest = [c for c in pairs.columns if c not in sides]
    whole = pairs.select(*rest, *[c.alias(s) for s, c in sides.items()],
                         common_turns(sides["chosen"], sides["rejected"]).alias("n_prompt_turns"))
    n = F.col("n_prompt_turns")
    left = {s: F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))) for s in sides}
    return whole.select(*rest, n, render(F.slice("chosen", F.lit(1), n)).alias("prompt"),
                        *[render(c).alias(s) for s, c in left.items()],
                        *[loss_spans(c).alias(f"{s}_spans") for s, c in left.items()])
