"""Chat formatting by rotation of perspective: a dialogue is rendered once for each of its participants.

In a participant's rendering its own turns are the assistant's and the only ones trained on; other participants are
users with their names. System turns are no participant's and stay system turns. A rendering is returned as segments
with their places, so no conversation is ever gathered: joined in the order of positions, they are the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
LINE_ENDS = r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"
#: Turns of a block: running totals are taken within blocks, and over the totals of blocks.
BLOCK = 256


def rotate(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to a row for each turn and participant of its conversation.

    (conv_id, speaker, position, role, name, segment, start, stop, mask_start, mask_stop): position from 1, by turn
    (nulls first), role and text; characters [start, stop) of the rendering hold the segment; characters [mask_start,
    mask_stop), null in turns of others, are trained on: content and end mark. A null role is the participant
    'unknown', a null text is empty, a null conv_id is a conversation of its own; repeated rows are turns each. Marks
    inside a text or a name are broken up by a space, and line ends in a name become one, so neither can open a turn.
    Turns of one number, or without one, are a block that one task orders, spilling. Further columns are not looked
    at. A conversation with system turns alone, or an empty table, has no rendering.
    """
    broken = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    who = F.coalesce("role", F.lit("unknown"))
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), who.alias("who"), broken(F.coalesce("text", F.lit(""))).alias("content"))
    speakers = own.filter(F.col("who") != SYSTEM).select("conv_id", F.col("who").alias("speaker")).distinct()
    met = own.join(speakers.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("who") == SYSTEM, SYSTEM).when(F.col("who") == F.col("speaker"), "assistant").otherwise("user")
    met = met.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("who")))
    head = F.concat(F.lit(START), "role", F.coalesce(F.concat(F.lit(" name="), broken(F.regexp_replace("name", LINE_ENDS, " "))), F.lit("")), F.lit("\n"))
    met = met.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "content", F.lit(END))).withColumn("size", F.length("segment").cast("long"))
    met = met.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    keys = ["conv_id", "speaker", "block"]
    blocks = met.groupBy(keys).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(*[F.col(k).alias("b_" + k) for k in keys], F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("count"))
    within = Window.partitionBy(*keys).orderBy("turn", "who", "content").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("position", F.count("*").over(within)).withColumn("stop", F.sum("size").over(within))
    met = met.join(base, F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("speaker") == F.col("b_speaker")) & (F.col("block") == F.col("b_block")))
    stop = F.col("base") + F.col("stop")
    start = stop - F.col("size")
    trained = F.col("role") == "assistant"
    return met.select(
        "conv_id", "speaker", (F.col("count") + F.col("position")).alias("position"), "role", "name", "segment",
        start.alias("start"), stop.alias("stop"), F.when(trained, start + F.col("head")).alias("mask_start"), F.when(trained, stop).alias("mask_stop"),
    )
