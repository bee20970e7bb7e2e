"""Preference formatting, with DataFrame and SQL functions only: chosen and rejected conversations become a prompt and two completions.

The longest common turn prefix of the two is found by comparing the turns one by one, and rendered once as the prompt; what
follows is rendered as the completions. A completion's mask lists the spans (code points) that a loss counts: what assistants
say, with the end mark, but neither role headers nor other roles' turns. Marks inside a text are broken up, so no text can
forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.native import bound, offsets

OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
TRAINED = "assistant"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"
MASK = "array<struct<start:int,end:int>>"


def _safe(x: Column) -> Column:
    return F.replace(F.coalesce(x, F.lit("")), F.lit(OPEN), F.lit("< |"))


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(turn["role"]), F.lit(CLOSE + "\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_header(x), _body(x))), "")


def loss_spans(turns: Column) -> Column:
    """Spans of the rendered turns that belong to assistants; a turn starts behind all turns before it."""

    def spans(sized: Column) -> Column:
        at = offsets(F.transform(sized, lambda x: x["head"] + x["body"]))
        each = F.zip_with(at, sized, lambda s, x: F.struct((s + x["head"]).alias("start"), (s + x["head"] + x["body"]).alias("end"), x["own"].alias("own")))
        return F.transform(F.filter(each, lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).cast(MASK)

    return bound(F.transform(turns, lambda x: F.struct(F.length(_header(x)).alias("head"), F.length(_body(x)).alias("body"), F.coalesce(x["role"] == TRAINED, F.lit(False)).alias("own"))), spans)


def common_turns(a: Column, b: Column) -> Column:
    """Turns that two conversations share at their start, by role and text (nulls are equal)."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0).cast("long")) - 1, least.cast("long"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pairs with chosen and rejected (TURNS, in order) and further columns -> n_common, prompt, and chosen and rejected with their masks.

    A null conversation counts as one without turns. A null role or text is rendered empty. If one side is the beginning of the other,
    its completion is empty, with an empty mask.
    """
    none = F.array().cast(TURNS)
    pairs = pairs.withColumns({"_c": F.coalesce("chosen", none), "_r": F.coalesce("rejected", none)}).drop("chosen", "rejected")
    pairs = pairs.withColumn("n_common", common_turns(F.col("_c"), F.col("_r")))
    n = F.col("n_common").cast("int")
    tail = lambda x: F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))
    pairs = pairs.withColumns({"_p": F.slice("_c", F.lit(1), n), "_c": tail(F.col("_c")), "_r": tail(F.col("_r"))})
    out = {"prompt": render(F.col("_p"))}
    for name, own in (("chosen", "_c"), ("rejected", "_r")):
        out |= {name: render(F.col(own)), f"{name}_mask": loss_spans(F.col(own))}
    return pairs.withColumns(out).drop("_p", "_c", "_r")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with each conversation's turns in order; ties of turn are ordered by role and text. Null conv_ids are left out."""
    kept = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast(T.StringType()).alias("text")).alias("t"))
    return kept.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def preferences(conversations: DataFrame) -> DataFrame:
    """Pairs made of a table of conversations, a row for each conv_id: conversations 2n and 2n + 1 are partners, and each is chosen once. The rejected one
    begins with the first half of the chosen turns (the smaller half) and goes on as the partner does behind so many turns; without a partner it ends there.

    conv_id, pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask. Turns of equal number are ordered by role and text, nulls first; repeated rows are turns
    that are said twice. Null conv_ids are left out, an empty table gives an empty one, conversations and texts may be of any length, and other columns, whatever their names, are not read.
    """
    pair = F.floor(F.col("conv_id") / F.lit(2)).cast("long")
    even = F.pmod("conv_id", F.lit(2)) == 0
    pairs = turns_of(conversations).groupBy(pair.alias("pair_id")).agg(F.max(F.when(even, F.col("turns"))).alias("a"), F.max(F.when(~even, F.col("turns"))).alias("b"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("odd"), F.col("a").alias("chosen"), F.col("b").alias("other")), F.struct(F.lit(1).alias("odd"), F.col("b").alias("chosen"), F.col("a").alias("other"))))
    each = pairs.select("pair_id", sides.alias("s")).select((F.col("pair_id") * 2 + F.col("s.odd")).alias("conv_id"), "pair_id", "s.chosen", "s.other").where("chosen IS NOT NULL")
    half = F.floor(F.size("chosen") / F.lit(2)).cast("int")
    begun, rest = F.slice("chosen", F.lit(1), half), F.slice("other", half + 1, F.greatest(F.size("other") - half, F.lit(0)))
    return format_preferences(each.select("conv_id", "pair_id", "chosen", F.when(F.col("other").isNull(), begun).otherwise(F.concat(begun, rest)).alias("rejected")))


def preference_report(conversations: DataFrame) -> DataFrame:
    """The same with digests in place of the texts, and masks as start:end."""
    return _report(preferences(conversations), "conv_id", "pair_id")


def _report(made: DataFrame, *keys: str) -> DataFrame:
    mask = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    texts = {f"{x}_sha256": F.sha2(F.col(x), 256) for x in ("prompt", "chosen", "rejected")}
    return made.select(*keys, "n_common", *(v.alias(k) for k, v in texts.items()), mask("chosen_mask").alias("chosen_mask"), mask("rejected_mask").alias("rejected_mask"))
