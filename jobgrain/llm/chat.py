"""Preference formatting: one shared prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What surrounds each turn's text: the head ends where the text begins.
HEAD, TAIL = ("<|", "|>\n"), "<|end|>\n"


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), role, F.lit(HEAD[1]), text, F.lit(TAIL))


def preference_pairs(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Turns (pair_id, side, turn, role, text) with side 'chosen' or 'rejected' -> one row a pair: pair_id, prompt,
    n_prompt_turns, chosen, chosen_mask, rejected, rejected_mask.

    The prompt renders the longest common prefix of turns (same role and text, in order) once; each completion renders
    what follows on its side. A mask is an array of {start, end}: the code-point ranges of its completion that a loss
    counts, which are the texts of learn_role's turns with their end marks; the rest is masked out.

    Turns go by turn (null last), then role and text, so ties and repeated rows have one order. A null role renders as
    'unknown', a null text as ''. Equal sides give two empty completions; a missing side gives an empty one, and an empty
    prompt. A null pair_id is one pair of its own. Other sides and other columns are ignored; no turns give no rows.

    All steps partition by pair_id, so there is one shuffle; a pair's turns meet in one row in the end, as its text does.
    """
    clean = turns.where(F.col("side").isin("chosen", "rejected")).select("pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = clean.repartition("pair_id").withColumn("pos", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_last(), "role", "text")))
    on = lambda side: F.max(F.when(F.col("side") == side, F.struct("role", "text"))).alias(side)
    by_pos = numbered.groupBy("pair_id", "pos").agg(on("chosen"), on("rejected"))
    fork = F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("pos"))).over(Window.partitionBy("pair_id"))
    shown = lambda side: F.when(F.col(side).isNotNull(), render_turn(F.col(side)["role"], F.col(side)["text"])).otherwise(F.lit(""))
    placed = by_pos.withColumn("shared", F.col("pos") < F.coalesce(fork, F.lit(2147483647))).withColumns({f"{s}_piece": shown(s) for s in ("chosen", "rejected")})
    before = Window.partitionBy("pair_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda side: F.when(F.col("shared"), 0).otherwise(F.length(f"{side}_piece"))
    offset = placed.withColumns({f"{s}_from": F.coalesce(F.sum(own(s)).over(before), F.lit(0)) for s in ("chosen", "rejected")})

    def joined(piece: str, when: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", F.col(piece).alias("piece"))))), lambda x: x["piece"]), "")

    def mask(side: str) -> Column:
        begin = F.col(f"{side}_from") + F.length(F.col(side)["role"]) + F.lit(len(HEAD[0]) + len(HEAD[1]))
        span = F.struct(begin.cast("long").alias("start"), (F.col(f"{side}_from") + F.length(f"{side}_piece")).cast("long").alias("end"))
        return F.array_sort(F.collect_list(F.when(~F.col("shared") & (F.col(side)["role"] == learn_role), span)))

    return offset.groupBy("pair_id").agg(
        joined("chosen_piece", F.col("shared")).alias("prompt"), F.count_if("shared").alias("n_prompt_turns"),
        joined("chosen_piece", ~F.col("shared")).alias("chosen"), mask("chosen").alias("chosen_mask"),
        joined("rejected_piece", ~F.col("shared")).alias("rejected"), mask("rejected").alias("rejected_mask"))


def repeat_negatives(conversations: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Conversations (conv_id, turn, role, text) -> turns for preference_pairs, one pair a conversation.

    Chosen is the conversation up to its last turn of learn_role; rejected is the same with that turn's text replaced by
    what the role had said first (an answer that only repeats itself), or left out if it has no earlier one.
    A conversation without a turn of learn_role has nothing to learn and gives no pair.
    """
    order = [F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))]
    whole = Window.partitionBy("conv_id")
    n = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").withColumn("n", F.row_number().over(whole.orderBy(*order)))
    learns = F.col("role") == learn_role
    known = n.withColumns({"last": F.max(F.when(learns, F.col("n"))).over(whole), "first": F.min(F.when(learns, F.col("n"))).over(whole), "said": F.min_by(F.coalesce("text", F.lit("")), F.when(learns, F.col("n"))).over(whole)}).where("n <= last")
    worse = F.when((F.col("n") == F.col("last")) & (F.col("first") < F.col("last")), F.col("said")).otherwise(F.col("text"))
    sides = F.filter(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.when((F.col("n") < F.col("last")) | (F.col("first") < F.col("last")), F.struct(F.lit("rejected").alias("side"), worse.alias("text")))), lambda x: x.isNotNull())
    return known.select(F.col("conv_id").alias("pair_id"), F.col("n").alias("turn"), "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")
