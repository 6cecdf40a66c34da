"""Multi-party perspective rotation of dialogues.

For each participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; a mask tells which
characters are the speaker's own. Only built-in functions are used.

A conversation is cut into parts of at most ``part_turns`` turns, whose
renderings follow one another, so that no group is unbounded. The texts are
shuffled once, by conversation and range of turns; who takes part is worked out
on the narrow columns and joined on the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    """A text in which no mark of the format begins."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_role: str = "system",
    part_turns: int = 256,
) -> DataFrame:
    """One row for each conversation, participant and part.

    Columns: conv_id, participant, block (turn number div part_turns), part
    (within the block; 0 unless turn numbers repeat a lot), n_turns, n_own (the
    participant's turns), rendered, mask. The mask is run lengths in
    characters, value:length by commas; 1 covers the participant's texts and
    their closing marks. A conversation's parts in order of block and part make
    up the whole dialogue.

    Marks of the format within texts or roles are broken up (``<|im_`` becomes
    ``<| im_``), and line ends within roles become spaces, so that nothing that
    was said reads as a turn. The mask's lengths are those of the rendering.

    Turns go by number, then role, then text, nulls first, so ties and repeated
    rows have a fixed order and are all kept. Null texts are empty, null roles
    speak as "unknown", null turn numbers come first, in block 0. The system
    role takes no part: its turns are rendered as they are and masked. Turns of
    null conversations are one conversation. A conversation that only the
    system speaks in, or an empty table, gives no rows. Other columns are
    ignored.
    """
    own = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"),
        _plain(F.translate(F.coalesce(turns[role_col], F.lit("unknown")), "\r\n", "  ")).alias("role"), _plain(F.coalesce(turns[text_col], F.lit(""))).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(float(part_turns))), F.lit(0)).cast("long"))
    speakers = own.filter(F.col("role") != system_role).select("conv_id", F.col("role").alias("participant")).distinct()
    blocks = own.select(F.col("conv_id").alias("c"), F.col("block").alias("b")).distinct()
    who = speakers.join(blocks, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", "b", "participant")

    order = Window.partitionBy("conv_id", "block").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    numbered = own.withColumn("n", F.row_number().over(order)).withColumn("part", F.floor((F.col("n") - 1) / part_turns).cast("long"))
    parts = numbered.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("said"))
    rows = parts.join(who, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))

    def name(s):
        return (
            F.when(s["role"] == F.col("participant"), F.lit("assistant"))
            .when(s["role"] == system_role, F.lit("system"))
            .otherwise(F.concat(F.lit("user name="), s["role"]))
        )

    def head(s):
        return F.concat(F.lit(OPEN), name(s), F.lit("\n"))

    def runs(s):
        body = (F.length(s["text"]) + len(CLOSE)).cast("string")
        own_turn = F.when(s["role"] == F.col("participant"), F.lit(",1:")).otherwise(F.lit(",0:"))
        return F.concat(F.lit("0:"), F.length(head(s)).cast("string"), own_turn, body)

    return rows.select(
        "conv_id", "participant", "block", "part", F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda s: s["role"] == F.col("participant"))).cast("long").alias("n_own"),
        F.array_join(F.transform("said", lambda s: F.concat(head(s), s["text"], F.lit(CLOSE))), "").alias("rendered"),
        F.array_join(F.transform("said", runs), ",").alias("mask"),
    )
