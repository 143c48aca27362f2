"""Multi-party chat formatting by perspective rotation.

Every participant of a conversation gets the whole dialogue rendered from their place: their own turns as
`assistant`, everybody else's as users with a name, system turns as `system`. The mask lists what is to be
learned in each rendering: the assistant's texts with their end marks. A conversation comes in chunks of
consecutive turn numbers, so that one of any length is rendered piece by piece in many tasks; its chunks joined
in order are the dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A chunk holds the turns whose number divided by this has one quotient.
CHUNK_TURNS = 256


def chat_perspectives(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, n_target_turns, text, mask from turns (conv_id, turn, role, text).

    Rows that are equal in all four columns count once; rows of one turn are ordered by role, then text. Null
    turns come first, in chunk -1; null role is the speaker `unknown`; null text is empty; null conv_id is a
    conversation of its own. `<|` in a text or a name becomes `< |`, so that nobody can write a mark. A
    conversation with system turns only has no participant and gives no row; nor does an empty table.
    mask: start:end,... in code points of the chunk's text, empty if the perspective has no turn in the chunk.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    t = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        safe(F.coalesce("role", F.lit("unknown"))).alias("role"),
        safe(F.coalesce("text", F.lit(""))).alias("text"),
    ).distinct()
    t = t.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-1)))
    chunks = t.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    people = t.where(F.col("role") != "system").select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()
    rows = chunks.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")

    def head(x):
        who = F.when(x["role"] == F.col("perspective"), F.lit("assistant")).when(x["role"] == "system", F.lit("system"))
        return F.concat(F.lit(START), who.otherwise(F.concat(F.lit("user name="), x["role"])), F.lit("\n"))

    body = lambda x: F.concat(x["text"], F.lit(END))
    parts = F.transform("turns", lambda x: F.struct(head(x).alias("head"), body(x).alias("body"), (x["role"] == F.col("perspective")).alias("own")))
    rows = rows.withColumn("parts", parts)

    def place(acc, x):
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask"))
    return rows.select(
        "conv_id",
        "perspective",
        "chunk",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda x: x["own"])).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.aggregate("parts", empty, place)["mask"], ",").alias("mask"),
    )
