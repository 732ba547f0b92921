"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (same role, same text) is rendered once as the prompt; what follows on either
side is rendered as a completion with a mask. A turn is rendered as `<|role|>` + line end + text + `<|end|>` + line end.
A mask lists the stretches of a completion that bear loss, as `start:length` in characters joined by commas: the text
and end mark of assistant turns.

Only built-in expressions are used, and one shuffle brings a pair's turns together. The largest group is one pair.

Defined cases: null roles and texts are rendered as empty and compare equal to each other only; a side that is null
or has no turns gives a null completion and mask, no common prefix, and the other side whole; equal sides give empty
completions; a pair of two empty sides has an empty prompt; equal turn rows are turns of their own, ordered by
turn, role and text; other input columns are kept, but those named like an output are replaced; turns without a conversation id or turn number belong to no conversation and are left out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladetally.llm.columns import put_back, set_apart

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"
OUTPUTS = ("prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask")


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """Number of leading turns that are equal."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    return F.coalesce(F.when(first > 0, first - 1).otherwise(F.size(same)), F.lit(0)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """`start:length` of the stretches that bear loss in the rendered turns."""
    start = F.lit(0).cast("long")
    walked = F.aggregate(turns, F.struct(start.alias("at"), F.array().cast("array<string>").alias("spans")), lambda acc, t: F.struct(
        (acc["at"] + F.char_length(_head(t)) + F.char_length(_body(t)) + 1).alias("at"),
        F.when(t["role"] == role, F.concat(acc["spans"], F.array(F.concat(
            (acc["at"] + F.char_length(_head(t))).cast("string"), F.lit(":"), F.char_length(_body(t)).cast("string")))))
        .otherwise(acc["spans"]).alias("spans")))
    return F.array_join(walked["spans"], ",")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replace the two columns of turns by prompt_turns, prompt, both completions and both masks."""
    plain, names = set_apart(pairs, {chosen, rejected})
    others = {new: old for new, old in names.items() if new not in (chosen, rejected)}
    prefixed = plain.withColumn("__n", common_prefix(F.col(chosen), F.col(rejected)))

    def rest(name):
        turns = F.col(name)
        left = F.slice(turns, F.col("__n") + 1, F.greatest(F.size(turns) - F.col("__n"), F.lit(0)))
        return F.when(F.size(turns) > 0, left)

    rows = prefixed.select(
        *others, F.col("__n").alias("prompt_turns"),
        F.coalesce(render(F.slice(F.col(chosen), 1, F.col("__n"))), F.lit("")).alias("prompt"),
        render(rest(chosen)).alias("chosen"), loss_mask(rest(chosen)).alias("chosen_mask"),
        render(rest(rejected)).alias("rejected"), loss_mask(rest(rejected)).alias("rejected_mask"))
    return put_back(rows, others, OUTPUTS)


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Pairs out of plain conversations: chosen is the conversation up to its last answer, rejected the same
    turns with the last answer of its neighbour (conversations 2i and 2i + 1) in that place.

    Without an answer of its own a conversation is chosen whole and rejected is null, as it is without a
    neighbour's answer."""
    grouped = (turns.where("conv_id is not null and turn is not null")
               .withColumn("couple", F.shiftright("conv_id", 1))
               .groupBy("couple").agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("rows")))
    sides = grouped.select(*[F.sort_array(F.transform(
        F.filter("rows", lambda r: r["conv_id"].bitwiseAND(1) == side),
        lambda r: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text")))).alias(f"side{side}")
        for side in (0, 1)], "couple")
    pair = sides.select(F.explode(F.array(*[F.struct(
        F.when(F.size(f"side{a}") > 0, F.shiftleft("couple", 1) + a).alias("conv_id"), F.col(f"side{a}").alias("own"), F.col(f"side{b}").alias("theirs"))
        for a, b in ((0, 1), (1, 0))])).alias("p")).select("p.*").where("conv_id is not null")
    answer = lambda turns_: F.filter(turns_, lambda t: t["role"] == "assistant")
    bare = lambda turns_: F.transform(turns_, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    last = F.array_max(F.transform("own", lambda t, i: F.when(t["role"] == "assistant", i)))
    their_answer = F.get(F.reverse(answer(F.col("theirs"))), F.lit(0))
    cut = pair.withColumn("last", last).withColumn("answer", their_answer)
    upto = F.when(F.col("last").isNull(), bare(F.col("own"))).otherwise(bare(F.slice("own", 1, F.col("last") + 1)))
    swapped = F.when(F.col("last").isNotNull() & F.col("answer").isNotNull(), F.concat(
        bare(F.slice("own", 1, F.col("last"))), F.array(F.struct(F.col("answer.role").alias("role"), F.col("answer.text").alias("text")))))
    return cut.select("conv_id", upto.alias("chosen"), swapped.alias("rejected"))
