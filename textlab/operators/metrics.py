"""Style, sentiment and mention aggregates per (group, channel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.functions.text import mentions, with_fog, word_count
from textlab.operators.stats import grouped_quantiles


def weighted_mean(value: str, weight: str = "weight"):
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def style_means(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, weighted means and population deviations; one map-side-combined aggregate."""
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("n_docs"),
        weighted_mean("sentiment").alias("sentiment_mean"),
        F.stddev_pop("sentiment").alias("sentiment_std"),
        weighted_mean("fog_index").alias("fog_mean"),
        F.stddev_pop("fog_index").alias("fog_std"),
        weighted_mean("word_count").alias("words_mean"),
    )


def fog_means(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fog_mean) of ``style_means`` from texts, which are measured for nothing else."""
    return with_fog(docs.select(*keys, "weight", "text")).groupBy(*keys).agg(weighted_mean("fog_index").alias("fog_mean"))


# Output column → (measure, probability).
STYLE_QUANTILES = {
    "sentiment_median": ("sentiment", 0.5),
    "fog_median": ("fog_index", 0.5),
    "fog_p25": ("fog_index", 0.25),
    "fog_p75": ("fog_index", 0.75),
    "words_median": ("word_count", 0.5),
}


def style_quantiles(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """All measures go through one quantile pass as (keys, measure, value) rows."""
    measures = sorted({m for m, _ in STYLE_QUANTILES.values()})
    long = metrics.select(
        *keys,
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures]
            )
        ),
    )
    quantiles = grouped_quantiles(long, [*keys, "measure"], "x", [0.25, 0.5, 0.75])
    return quantiles.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("measure") == m) & (F.col("prob") == p), F.col("quantile"))).alias(name)
            for name, (m, p) in STYLE_QUANTILES.items()
        ]
    )


def style_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (group, channel), eleven measures.

    ``metrics`` is read by several branches: pass a written table, not the text plan.
    """
    return style_means(metrics, keys).join(style_quantiles(metrics, keys), keys)


def pivot_channels(
    style: DataFrame, group: str, channel: str, value: str, first: str, second: str, diff: str
) -> DataFrame:
    """Wide form of one measure over two channels, and second minus first."""
    wide = style.groupBy(group).pivot(channel, [first, second]).agg(F.first(value))
    return wide.withColumn(diff, F.col(f"`{second}`") - F.col(f"`{first}`"))


def name_counts(docs: DataFrame, group: str, channel: str, needles: list[str]) -> DataFrame:
    """Mentions per 10,000 words per (group, channel)."""
    counted = docs.select(
        group,
        channel,
        *[mentions(F.col("text"), n).alias(n) for n in needles],
        word_count(F.col("text")).alias("words"),
    )
    sums = counted.groupBy(group, channel).agg(
        *[F.sum(c).alias(c) for c in (*needles, "words")]
    )
    return sums.select(
        "*", *[(F.try_divide(F.col(n), F.col("words")) * 10000).alias(f"{n}_per10k") for n in needles]
    )
