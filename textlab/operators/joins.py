"""Join and ranking helpers that stay balanced when one key is hot."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# A word list is broadcast up to these sizes, both counted before.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 32 << 20


def small_copy(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """The table as a local relation if rows and bytes are within the bounds, else None.

    A broadcast passes through the driver anyway; reading one row beyond the bound tells
    whether it may, and the rows read are then not computed a second time.
    """
    rows = small_rows(df, max_rows, max_bytes)
    return None if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def small_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> pa.Table | None:
    """The rows that ``small_copy`` takes, as they reached the driver."""
    rows = df.limit(max_rows + 1).toArrow()
    return None if rows.num_rows > max_rows or rows.nbytes > max_bytes else rows


def lookup_join(tokens: DataFrame, words: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join exploded tokens with a word list.

    The list is broadcast when its counted size allows, so that the tokens are not shuffled;
    beyond that it is an ordinary join, whose hot keys adaptive execution splits.
    """
    small = small_copy(words, max_rows)
    return tokens.join(words if small is None else F.broadcast(small), on, how)


def top_k(
    df: DataFrame,
    partition: list[str],
    order: list[Column],
    k: int,
    spread: list[str],
    rank_col: str | None = None,
    salts: int | None = None,
) -> DataFrame:
    """First ``k`` rows per partition, exactly, without sorting a hot partition in one task.

    Each partition is cut into ``salts`` shares (as many as the session has shuffle partitions)
    by a hash of ``spread``; a row outside the first k of its share cannot be among the first
    k overall.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(*spread), F.lit(salts))
    rank = rank_col or "_rank"
    in_share = Window.partitionBy(*partition, "_share").orderBy(*order)
    overall = Window.partitionBy(*partition).orderBy(*order)
    out = (
        df.withColumn("_share", share)
        .withColumn("_r", F.row_number().over(in_share))
        .where(F.col("_r") <= k)
        .drop("_r", "_share")
        .withColumn(rank, F.row_number().over(overall))
        .where(F.col(rank) <= k)
    )
    return out if rank_col else out.drop(rank)
