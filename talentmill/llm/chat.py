"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as
assistant and the others as named users; the loss mask covers the assistant's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns of a conversation that one row renders at most: longer ones go on in further parts.
PART_TURNS = 256
#: Turns before a part that it renders as context, outside its mask.
CONTEXT_TURNS = 32
SYSTEM = "system"


def _head(speaker: Column, perspective: Column) -> Column:
    return (
        F.when(speaker == SYSTEM, F.lit("<|system|>\n"))
        .when(speaker == perspective, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    )


def _tail(text: Column) -> Column:
    return F.concat(text, F.lit("<|end|>\n"))


def _positions(rows: DataFrame) -> DataFrame:
    """Distinct rows with `pos`, their place from 0 among the rows of their conversation and looseness.

    Rows are sorted as a whole, so a conversation of any size, a null one too, and any number
    of rows under one turn spread over tasks; only row counts meet per conversation.
    """
    order = rows.distinct().sort("conv_id", "loose", "turn", "speaker", "text")
    placed = stored(order.withColumn("at", F.monotonically_increasing_id()), "chat-turns")
    # The id has its partition above 33 bits of the place within it.
    placed = placed.withColumn("chunk", F.shiftright("at", 33))
    spans = placed.groupBy("conv_id", "loose", "chunk").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id", "loose").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("conv_id").alias("span_id"), F.col("loose").alias("span_loose"), F.col("chunk").alias("span_chunk"),
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    same = F.col("conv_id").eqNullSafe(F.col("span_id")) & (F.col("loose") == F.col("span_loose")) & (F.col("chunk") == F.col("span_chunk"))
    return placed.join(spans, same).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"))


def _placed(rows: DataFrame, part_turns: int) -> DataFrame:
    """Distinct rows with `pos`; it is 0 throughout where all rows of a conversation fit one part."""
    keys = [F.col("conv_id").alias("long_id"), F.col("loose").alias("long_loose")]
    long = stored(rows.groupBy("conv_id", "loose").count().where(F.col("count") > part_turns).select(*keys), "chat-long")
    if long.isEmpty():
        return rows.distinct().withColumn("pos", F.lit(0).cast("long"))
    same = F.col("conv_id").eqNullSafe(F.col("long_id")) & (F.col("loose") == F.col("long_loose"))
    short = rows.join(long, same, "left_anti").distinct().withColumn("pos", F.lit(0).cast("long"))
    return short.unionByName(_positions(rows.join(long, same, "left_semi")))


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    part_turns: int = PART_TURNS, context_turns: int = CONTEXT_TURNS,
) -> DataFrame:
    """One row per conversation, participant and part, with the rendered text and its mask.

    Columns: conv_id, perspective, part, n_turns, rendered, loss_spans (start:end of the
    trained characters, code points, comma-joined), n_loss_chars.
    Parts are cut by row: the n-th numbered row of a conversation, from 0 and in order of turn,
    role and text, is in part n // part_turns, whatever its turn number. Rows without a
    turn number are numbered by themselves and form the parts -1, -2 and so on. A row never
    gathers more than part_turns turns of its own. It renders before them, outside the mask
    and not counted in n_turns, the last context_turns turns ahead of the part and, ahead of
    those, every earlier system turn of the conversation (of one text, the latest). System
    turns without a number come before all numbered ones; parts of rows without a number
    take all numbered system turns.
    A null role is the speaker "unknown", a null text is empty, a null conv_id is a
    conversation of its own. System turns are instructions in every rendering and never a
    participant; a conversation with system turns only gives no row. Repeated rows
    (same conversation, turn, role and text) count once; several rows of one turn follow
    in order of role and text. Other columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("loose", F.col("turn").isNull())
    nth, reach = F.floor(F.col("pos") / part_turns), F.floor((F.col("pos") + context_turns) / part_turns)
    placed = _placed(rows, part_turns).withColumns({"nth": nth, "reach": reach})
    # A row is context of all parts after its own up to `reach`.
    shown = placed.withColumn("in_part", F.explode(F.sequence("nth", "reach")))
    parts = shown.groupBy("conv_id", "loose", F.col("in_part").alias("nth")).agg(F.sort_array(F.collect_list(
        F.struct("pos", "turn", "speaker", "text", (F.col("in_part") == F.col("nth")).alias("own")))).alias("turns"))
    parts = parts.withColumn("n_turns", F.size(F.filter("turns", lambda t: t.own))).where("n_turns > 0")
    # From the part after `reach` on, a system turn stands ahead of the context.
    system = placed.where(F.col("speaker") == SYSTEM).groupBy("conv_id", "loose", "text", "reach").agg(
        F.max(F.struct("pos", "turn")).alias("at")).groupBy(F.col("conv_id").alias("system_id")).agg(F.sort_array(F.collect_list(
            F.struct((~F.col("loose")).alias("numbered"), "at", "text", "reach"))).alias("system"))
    cast = rows.where(F.col("speaker") != SYSTEM).select(
        F.col("conv_id").alias("cast_id"), F.col("speaker").alias("perspective")).distinct()
    cast = cast.join(system, F.col("cast_id").eqNullSafe(F.col("system_id")), "left")
    me = F.col("perspective")
    per = parts.join(cast, F.col("conv_id").eqNullSafe(F.col("cast_id")))
    earlier = F.transform(F.filter(F.coalesce("system", F.array()), lambda t: (
        t.numbered == F.col("loose")) | (t.reach < F.col("nth"))), lambda t: t.text)
    orders = F.reverse(F.array_distinct(F.reverse(earlier)))
    heads = F.concat(
        F.transform(orders, lambda t: F.struct(
            _head(F.lit(SYSTEM), me).alias("head"), _tail(t).alias("tail"), F.lit(False).alias("mine"))),
        F.transform("turns", lambda t: F.struct(
            _head(t.speaker, me).alias("head"), _tail(t.text).alias("tail"), ((t.speaker == me) & t.own).alias("mine"))))

    def step(acc: Column, s: Column) -> Column:
        start = acc.at + F.length(s.head)
        end = start + F.length(s.tail)
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct(
            end.alias("at"),
            F.when(s.mine, F.array_append(acc.spans, span)).otherwise(acc.spans).alias("spans"),
            (acc.n + F.when(s.mine, F.length(s.tail)).otherwise(0)).alias("n"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("n"))
    return (
        per.select(
            "conv_id", "perspective", F.when(F.col("loose"), -1 - F.col("nth")).otherwise(F.col("nth")).alias("part"),
            F.col("n_turns").cast("long").alias("n_turns"), heads.alias("segments"))
        .select("*", F.aggregate("segments", start, step).alias("mask"))
        .select(
            "conv_id", "perspective", "part", "n_turns",
            F.array_join(F.transform("segments", lambda s: F.concat(s.head, s.tail)), "").alias("rendered"),
            F.array_join("mask.spans", ",").alias("loss_spans"),
            F.col("mask.n").cast("long").alias("n_loss_chars"))
    )
