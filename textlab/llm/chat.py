"""Dialogues rendered once per participant, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK = 1_024


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def shown_name(role: Column) -> Column:
    """The role in letters, digits, - and _, different for different roles: _ is written as __, any
    other sign as the hex digits of its UTF-8 between two _, a null role as _null_."""
    signs = F.regexp_extract_all(role, F.lit("(?s)."), F.lit(0))
    escaped = F.transform(
        signs, lambda c: F.when(c.rlike("^[A-Za-z0-9-]$"), c).when(c == "_", "__").otherwise(F.concat(F.lit("_"), F.lower(F.hex(c)), F.lit("_")))
    )
    return F.coalesce(F.array_join(escaped, ""), F.lit("_null_"))


def rotate(conversations: DataFrame, common: str = "system", block: int = BLOCK) -> DataFrame:
    """One row per turn and participant of its conversation: the turn as that participant sees it.

    Columns: conv_id, perspective, place (from 0), speaker, segment, start, loss_from, loss_to.
    The segments of a (conv_id, perspective) in order of place are the rendered dialogue; start
    is the segment's place in it, loss_from and loss_to bound what is trained on (the text and
    closing mark of the perspective's own turns; null elsewhere). All in code points.

    The participant's own turns are rendered as assistant, turns of ``common`` as system, all
    others as user with the speaker's name (``shown_name``); marks inside a text are broken up with a space. A
    participant is a role other than null and ``common``; a conversation without any has no rows.
    Turns go by turn, role, text, nulls first; repeated rows are turns of their own; null texts
    are empty; rows without conv_id form one conversation. Other columns are not read.

    The result has turns times participants rows, as asked. Places are counted within blocks of
    ``block`` turn numbers and shifted by what the blocks before hold, so a very long
    conversation is many tasks.
    """
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    speakers = turns.where(F.col("role").isNotNull() & (F.col("role") != common)).select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    name = shown_name(F.col("role"))
    kind = F.when(own, "assistant").when(F.col("role") == common, "system").otherwise(F.concat(F.lit("user name="), name))
    head = F.concat(F.lit(OPEN), kind, F.lit("\n"))
    body = F.concat(F.replace("text", F.lit("<|"), F.lit("< |")), F.lit(CLOSE))
    shown = seen.withColumns(
        {
            "head": F.length(head).cast("long"),
            "segment": F.concat(head, body),
            "own": own,
            "block": F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))),
        }
    ).withColumn("size", F.length("segment").cast("long"))

    keys = ["conv_id", "perspective", "block"]
    within = Window.partitionBy(*keys).orderBy(*_order())
    placed = shown.withColumns(
        {
            "place": (F.row_number().over(within) - 1).cast("long"),
            "before": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
        }
    )
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shown.groupBy(*keys).agg(F.count("*").alias("turns"), F.sum("size").alias("length"))
    shifts = blocks.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("length_before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))
    start = F.col("length_before") + F.col("before")
    return placed.join(shifts, same).select(
        "conv_id", "perspective", (F.col("turns_before") + F.col("place")).alias("place"), F.col("role").alias("speaker"), "segment",
        start.alias("start"), F.when(F.col("own"), start + F.col("head")).alias("loss_from"), F.when(F.col("own"), start + F.col("size")).alias("loss_to"),
    )


def sql(common: str = "system") -> str:
    """The same in DuckDB's SQL."""
    return rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{common}'
), s AS (
  SELECT t.*, p.perspective, coalesce(role = perspective, FALSE) AS own, '{OPEN}' || CASE WHEN role = perspective THEN 'assistant'
      WHEN role = '{common}' THEN 'system' ELSE 'user name=' || coalesce(array_to_string(list_transform(regexp_extract_all(role, '(?s).'), lambda c:
        CASE WHEN regexp_full_match(c, '[A-Za-z0-9-]') THEN c WHEN c = '_' THEN '__' ELSE '_' || lower(hex(encode(c))) || '_' END), ''), '_null_') END || chr(10) AS head,
    replace(text, '<|', '< |') || '{CLOSE.strip()}' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, row_number() OVER w - 1 AS place, sum(length(head) + length(body)) OVER w - length(head) - length(body) AS start
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, place::BIGINT AS place, role AS speaker, head || body AS segment, start::BIGINT AS start,
  CASE WHEN own THEN (start + length(head))::BIGINT END AS loss_from, CASE WHEN own THEN (start + length(head) + length(body))::BIGINT END AS loss_to
FROM o
"""
