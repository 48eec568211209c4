"""Preference formatting with DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of equal turns
is rendered once, as the prompt; what follows in each is its completion, in segments with a
flag for training: headers and other roles' turns are masked, assistant turns are not.

Defined cases: rows with a null conversation id belong to no conversation; turns are ordered
by turn, role and text, nulls first, so ties and repeated rows have a fixed order and all
stay; a null role is ``unknown``, a null text empty; two equal conversations have the whole
as prompt and empty completions; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (role, text) of every conversation, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    rows = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(ordered.alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): every conversation up to its last assistant turn (whole
    without one) is chosen; rejected is the same with that turn replaced by the last reply
    of the neighbour, the conversation whose id differs in the lowest bit (left out if the
    neighbour has none)."""
    rows = conversations(turns)
    places = F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i + 1))
    rows = rows.withColumn("last", F.coalesce(F.array_max(places), F.lit(0)))
    replies = rows.where("last > 0").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("turns", F.col("last")).alias("reply"))
    both = rows.join(replies, "conv_id", "left")
    before = F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))).otherwise(F.col("turns"))
    return both.select(
        F.col("conv_id").alias("pair_id"),
        F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns")).alias("chosen"),
        F.when(F.col("reply").isNull(), before).otherwise(F.concat(before, F.array("reply"))).alias("rejected"),
    )


def _plain(text: Column) -> Column:
    """A text that cannot hold a control mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _segments(turns: Column) -> Column:
    """(text, train) segments: each turn's header, then its body."""

    def parts(x: Column) -> Column:
        header = F.struct(F.concat(F.lit(START), _plain(x["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("train"))
        body = F.struct(F.concat(_plain(x["text"]), F.lit(END + "\n")).alias("text"), (x["role"] == "assistant").alias("train"))
        return F.array(header, body)

    return F.flatten(F.transform(turns, parts))


def _text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, rejected) for (pair_id, chosen, rejected)
    with arrays of turns; the completions are arrays of (text, train)."""
    same = F.zip_with("chosen", "rejected", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    split = F.array_position(same, False)
    rows = pairs.withColumn("shared", F.when(split > 0, split - 1).otherwise(F.size("chosen")).cast("int"))
    rest = lambda c: _segments(F.slice(c, F.col("shared") + 1, F.size(c)))
    return rows.select(
        "pair_id",
        F.col("shared").cast("bigint").alias("prompt_turns"),
        _text(_segments(F.slice("chosen", F.lit(1), F.col("shared")))).alias("prompt"),
        rest("chosen").alias("chosen"),
        rest("rejected").alias("rejected"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the registered query: texts as SHA-256, masks as flag:length lists."""

    def mask(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["train"].cast("int").cast("string"), F.length(x["text"]).cast("string"))), ",")

    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return formatted.select(
        "pair_id",
        "prompt_turns",
        sha(F.col("prompt")).alias("prompt_sha256"),
        sha(_text(F.col("chosen"))).alias("chosen_sha256"),
        sha(_text(F.col("rejected"))).alias("rejected_sha256"),
        mask("chosen").alias("chosen_mask"),
        mask("rejected").alias("rejected_mask"),
    )
