"""Row numbers, ordered lists and key sets without a single-task sort."""

from __future__ import annotations

import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F


# Types of cuts that a text gives back as they were.
_CUT_TYPES = {int: "bigint", float: "double", datetime.date: "date", Decimal: None}


def _cut_table(cuts: list) -> Column:
    """The cuts as one array: a single text that the planner turns into a constant, so that many
    thousand of them are one expression."""
    kind = _CUT_TYPES.get(type(cuts[0]))
    if kind is None or any(type(c) is not type(cuts[0]) for c in cuts):
        return F.array(*[F.lit(c) for c in cuts])
    return F.split(F.lit(",".join(repr(c) if kind == "double" else str(c) for c in cuts)), ",").cast(f"array<{kind}>")


def slice_of(value: Column, cuts: list) -> Column:
    """Number of the ascending ``cuts`` that are <= value, by binary search; null gives 0."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    table = _cut_table(cuts)

    def step(at: Column, width: Column) -> Column:
        ahead = at + width
        fits = (ahead <= len(cuts)) & (F.element_at(table, F.least(ahead, F.lit(len(cuts)))) <= value)
        return F.when(fits, ahead).otherwise(at)

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), step)


def with_row_id(
    df: DataFrame, key: str, ties: list[str] = (), name: str = "id", start: int = 0,
    rows_per_slice: int = 1_000_000, parts: int | None = None,
) -> DataFrame:
    """Consecutive numbers in the order of a numeric or date key.

    The key range is cut at approximate quantiles into ``parts`` slices, by default of about
    ``rows_per_slice`` when the key is close to unique (as many numbers reach the driver and
    come back as literals, so every stage sees the same cuts); rows are numbered inside a
    slice and shifted by the rows before it.
    """
    parts = parts or -(-df.count() // rows_per_slice)
    cuts = []
    if parts > 1:
        probs = [i / parts for i in range(1, parts)]
        cuts = sorted(set(df.agg(F.percentile_approx(key, probs, max(10_000, 20 * parts))).first()[0] or []))
    sliced = df.withColumn("_slice", slice_of(F.col(key), cuts))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("_slice").orderBy(key, *ties)
    # One offset per slice.
    return (
        sliced.withColumn("_r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, (F.col("_before") + F.col("_r") - 1 + start).cast("bigint"))
        .drop("_slice", "_r", "_before")
    )


def attach_ordered(df: DataFrame, key: str, values: list, name: str, ties: list[str] = ()) -> DataFrame:
    """The i-th value of a list on the i-th row by key; the lengths must agree."""
    n = df.count()
    if n != len(values):
        raise ValueError(f"{len(values)} values for {n} rows")
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["_id", name])
    return with_row_id(df, key, ties, "_id").join(listed, "_id").drop("_id")


def attach_by_position(df: DataFrame, key: str, other: DataFrame, other_key: str, column: str, name: str) -> DataFrame:
    """As ``attach_ordered`` with the list held in a table, in the order of its key."""
    left = with_row_id(df, key, name="_id")
    right = with_row_id(other.select(other_key, F.col(column).alias(name)), other_key, name="_id")
    return left.join(right.drop(other_key), "_id").drop("_id")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with that side; one shuffle of the keys."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    return (
        sides.groupBy(key)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .where("_a <> _b")
        .select(key, F.when(F.col("_a") == 1, "left").otherwise("right").alias("side"))
    )
