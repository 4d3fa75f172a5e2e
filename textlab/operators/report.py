"""Report queries over the term, style and topic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textlab.functions.text import str_trunc


def first_rows(df: DataFrame, keys: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The n largest per group, no ties."""
    best = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).drop("_r")


def first_rows_with_ties(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n largest per group, rows equal to the last one included."""
    best = Window.partitionBy(*keys).orderBy(F.desc(value))
    return df.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= n).drop("_r")


def extreme_row(wide: DataFrame, by: str, tie: str, largest: bool = True) -> DataFrame:
    """The first row by a column; missing values sort last."""
    order = F.desc_nulls_last(by) if largest else F.asc_nulls_last(by)
    return wide.orderBy(order, tie).limit(1)


def longer(wide: DataFrame, ids: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    """Unpivot columns into (name, value) rows with display names."""
    cells = F.array(
        *[F.struct(F.lit(label).alias(name), F.col(f"`{c}`").alias(value)) for c, label in columns.items()]
    )
    return wide.select(*ids, F.inline(cells))


def recode(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    return df.replace(labels, subset=[column])


def group_order_by_median(style: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """Groups ranked by the median over their channels (a style table: few rows)."""
    mid = F.median(value).over(Window.partitionBy(group))
    return style.withColumn("_m", mid).withColumn(
        position, F.dense_rank().over(Window.orderBy("_m", group))
    ).drop("_m")


def rank_within(style: DataFrame, channel: str, value: str, tie: str, position: str) -> DataFrame:
    return style.withColumn(
        position, F.row_number().over(Window.partitionBy(channel).orderBy(value, tie))
    )


def topic_order(mix: DataFrame) -> DataFrame:
    """Topics of all channels in one running order by mean share (k rows per channel)."""
    return (
        mix.groupBy("source", "topic")
        .agg(F.avg("proportion").alias("mean_prop"))
        .withColumn(
            "topic_ord", F.row_number().over(Window.orderBy("source", F.desc("mean_prop"), "topic"))
        )
    )


def topic_mix_labelled(mix: DataFrame, labels: DataFrame, width: int = 35) -> DataFrame:
    return (
        mix.join(labels, ["source", "topic"], "left")
        .join(topic_order(mix), ["source", "topic"], "left")
        .withColumn(
            "topic_lab", F.concat(F.col("topic").cast("string"), F.lit(": "), str_trunc(F.col("label"), width))
        )
    )


def topic_terms(topics: DataFrame, labels: DataFrame, n: int = 6) -> DataFrame:
    best = first_rows_with_ties(topics, ["source", "topic"], "weight", n)
    return best.join(labels, ["source", "topic"], "left")
