"""Preference formatting: the common turns of a chosen and a rejected conversation as one prompt, and two masked completions.

Turns stay rows until the last step. A turn's place is its rank in its conversation, taken by one window whose
partitions are single conversations; the common prefix ends before the least place at which both sides do not
hold the same turn, which is an aggregate over (pair, place). Only rendering brings a conversation into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What stands around a turn's role and text.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"


def _rendered(role: str, text: str) -> tuple[Column, Column]:
    """The header of a turn, which is never trained on, and its body with the end mark."""
    return F.concat(F.lit(HEAD), F.col(role), F.lit(MIDDLE)), F.concat(F.col(text), F.lit(TAIL))


def format_preferences(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, and for each side its completion and its mask.

    `turns` has pair_id, side ('chosen' or 'rejected'), turn, role, text; other columns are not read. Turns are
    ordered by their number, then role and text; a null number comes first. Rows that repeat a turn whole
    count once. A null role is 'unknown', a null text empty. The prompt is rendered from the longest run of
    first turns that both sides share, role and text, and may be empty; each completion is what its side has
    beyond it, and may be empty too, as for a side without turns. Rows of another side or of a null pair are
    no part of any pair. A mask lists the trained stretches of a completion as [start, end) in characters,
    start and end in turn: the bodies, with their end mark, of the turns of `trained_role`. An empty table
    gives no rows.
    """
    read = turns.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')").select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # A conversation's own turns: its size bounds the window, and its text has to fit one row in the end anyway.
    place = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    placed = read.distinct().withColumn("place", F.row_number().over(place))

    # A place is common if both sides hold one turn there and it is the same; the first that is not ends the prompt.
    held = placed.groupBy("pair_id", "place").agg(F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high"))
    apart = (F.col("n") < 2) | (F.col("low") != F.col("high"))
    ends = held.groupBy("pair_id").agg(F.min(F.when(apart, F.col("place"))).alias("parts"), F.max("place").alias("last"))
    ends = ends.select("pair_id", F.coalesce(F.col("parts") - 1, "last").alias("n_prompt_turns"))

    head, body = _rendered("role", "text")
    marked = placed.join(ends, "pair_id").select(
        "pair_id",
        "n_prompt_turns",
        F.struct("place", head.alias("head"), body.alias("body"), (F.col("role") == trained_role).alias("trained")).alias("piece"),
        # The prompt is rendered once, from the chosen side.
        F.when(F.col("place") > F.col("n_prompt_turns"), F.col("side")).when(F.col("side") == "chosen", F.lit("prompt")).alias("part"),
    )
    parts = marked.where("part IS NOT NULL").groupBy("pair_id", "n_prompt_turns")
    pieces = parts.agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == p, F.col("piece")))).alias(p) for p in ("prompt", "chosen", "rejected")])

    def text_of(part: str) -> Column:
        return F.array_join(F.transform(part, lambda p: F.concat(p["head"], p["body"])), "")

    def mask_of(part: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("mask"))

        def step(s: Column, p: Column) -> Column:
            begin = s["at"] + F.char_length(p["head"])
            end = begin + F.char_length(p["body"])
            return F.struct(end.alias("at"), F.when(p["trained"], F.concat(s["mask"], F.array(begin, end))).otherwise(s["mask"]).alias("mask"))

        return F.aggregate(part, start, step, lambda s: s["mask"])

    return pieces.select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        text_of("prompt").alias("prompt"),
        text_of("chosen").alias("chosen"),
        mask_of("chosen").alias("chosen_mask"),
        text_of("rejected").alias("rejected"),
        mask_of("rejected").alias("rejected_mask"),
    )
