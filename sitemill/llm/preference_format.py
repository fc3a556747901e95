"""Preference formatting of chat conversations.

A pair has a chosen and a rejected conversation. The longest run of equal turns (role and text) that begins both
is rendered once as the prompt; what follows in each is a completion. A completion comes with its mask: the
character ranges (start and end, in code points of the completion) of assistant turns, which alone are trained
on. Everything else, the prompt included, is masked.

Turns are ordered by turn, then role, then text; nulls come last. Repeated rows are repeated turns. A null role is
rendered as user, a null text as empty; nulls equal only nulls in the comparison. A conversation that is the whole
beginning of the other has an empty completion; a pair with one side missing has no turns on that side. Rows with a null pair
are in no pair. Columns beyond pair, turn, role and text are ignored. A pair's turns meet in one row, as its
rendering does; pairs that share turns, or copies, never meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def rendered(turn: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("user")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def _side(turns: DataFrame, name: str) -> DataFrame:
    # missing values sort last, as the flags before them do
    row = F.struct(F.col("turn").isNull().alias("t0"), F.col("turn").cast("long").alias("turn"), F.col("role").isNull().alias("r0"), "role", F.col("text").isNull().alias("x0"), "text")
    return turns.where("pair IS NOT NULL").groupBy("pair").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias(name))


def _completion(turns: Column, common: Column) -> Column:
    rest = F.slice(turns, common + 1, F.greatest(F.size(turns) - common, F.lit(0)))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def add(done: Column, turn: Column) -> Column:
        text = rendered(turn)
        begin = F.length(done["text"]) + F.length(F.concat(F.lit("<|"), turn["role"], F.lit("|>\n")))
        span = F.struct(begin.alias("start"), (F.length(done["text"]) + F.length(text)).alias("end"))
        mask = F.when(turn["role"] == TRAINED, F.concat(done["mask"], F.array(span))).otherwise(done["mask"])
        return F.struct(F.concat(done["text"], text).alias("text"), mask.alias("mask"))

    return F.aggregate(rest, start, add)


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask from turns (pair, turn, role, text) of both sides."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = _side(chosen, "a").join(_side(rejected, "b"), "pair", "full").withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    shorter = F.least(F.size("a"), F.size("b"))
    same = lambda i: F.get("a", i)["role"].eqNullSafe(F.get("b", i)["role"]) & F.get("a", i)["text"].eqNullSafe(F.get("b", i)["text"])
    differing = F.filter(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~same(i))
    both = both.withColumn("n_common", F.coalesce(F.get(differing, F.lit(0)), shorter))
    both = both.withColumns({"left": _completion(F.col("a"), F.col("n_common")), "right": _completion(F.col("b"), F.col("n_common"))})
    prompt = F.array_join(F.transform(F.slice("a", F.lit(1), F.col("n_common")), rendered), "")
    return both.select("pair", "n_common", prompt.alias("prompt"), F.col("left.text").alias("chosen"), F.col("left.mask").alias("chosen_mask"), F.col("right.text").alias("rejected"), F.col("right.mask").alias("rejected_mask"))


def pairs_of_table(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from conversations(conv_id, turn, role, text), which has no preferences of its own.

    Chosen: each conversation. Rejected: the same with its last assistant turn's text replaced by the last assistant
    text of the conversation conv_id + 1 (empty if there is none)."""
    turns = conversations.select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    last = turns.where((F.col("role") == TRAINED) & F.col("pair").isNotNull() & F.col("turn").isNotNull()).groupBy("pair").agg(F.max(F.struct("turn", "text")).alias("last"))
    answers = last.select("pair", F.col("last.turn").alias("last_turn")).join(last.select((F.col("pair") - 1).alias("pair"), F.col("last.text").alias("other")), "pair", "left")
    swapped = turns.join(answers, "pair", "left")
    text = F.when((F.col("role") == TRAINED) & (F.col("turn") == F.col("last_turn")), F.coalesce("other", F.lit(""))).otherwise(F.col("text"))
    return turns, swapped.select("pair", "turn", "role", text.alias("text"))
