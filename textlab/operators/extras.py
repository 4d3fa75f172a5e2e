"""Queries the project outline announces: activity, recipients, similarity and browsing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.operators.stats import share_of_total
from textlab.operators.terms import with_term_hash
from textlab.sources.sinks import materialise


def recipient_heat(df: DataFrame, group: str, recipient: str, texts: str | None = None) -> DataFrame:
    """Texts per (group, recipient) and their share in the group; ``texts`` names a column
    of partial counts."""
    n = df.groupBy(group, recipient).agg((F.sum(texts) if texts else F.count("*")).alias("n"))
    return share_of_total(n, "n", "share", [group])


def activity_timeline(df: DataFrame, when: str, group: str, period: str = "month") -> DataFrame:
    return df.groupBy(F.date_trunc(period, when).cast("date").alias("period"), group).agg(
        F.count("*").alias("n")
    )


def centroid_distances(scores: DataFrame, channel: str, group: str) -> DataFrame:
    """Cosine distance of each group's TF-IDF vector to the mean vector of its channel.

    ``scores``: (channel, group, term, score) with unit vectors. Long-form dot products: the
    mean of a term is a window over its groups, so no vector is ever built.
    """
    per_term = Window.partitionBy("_hash", channel, "term")
    # The centroid's length cancels its 1/n, so sums over groups are enough.
    terms = with_term_hash(scores, channel).withColumn("_c", F.sum("score").over(per_term))
    dots = terms.groupBy(channel, group).agg(F.sum(F.col("score") * F.col("_c")).alias("_dot"))
    # Sum of the dot products over groups is the squared length of the summed vector.
    norm = F.sqrt(F.sum("_dot").over(Window.partitionBy(channel)))
    return dots.select(channel, group, (1 - F.col("_dot") / norm).alias("distance"))


def pairwise_cosine(scores: DataFrame, channel: str, group: str) -> DataFrame:
    """Cosine of every two groups of a channel, 0 for two without a common term.

    All pairs of groups is what is asked: fine for clubs, not for members. A term of the
    bounded vocabulary has at most one row per group, so a key never holds more than that.
    ``scores`` is read several times: pass a written table.
    """
    other = scores.select(channel, "term", F.col(group).alias("other"), F.col("score").alias("_s"))
    dots = (
        scores.join(other, [channel, "term"])
        .where(F.col(group) < F.col("other"))
        .groupBy(channel, group, "other")
        .agg(F.sum(F.col("score") * F.col("_s")).alias("cosine"))
    )
    groups = scores.select(channel, group).distinct()
    pairs = groups.join(groups.withColumnRenamed(group, "other"), channel).where(F.col(group) < F.col("other"))
    return pairs.join(dots, [channel, group, "other"], "left").fillna(0.0, ["cosine"])


def _products(df: DataFrame, channel: str, columns: list[str]) -> dict:
    """Per channel the sums of products of every two columns and of each with 1: one small matrix."""
    n, kind = len(columns) + 1, dict(df.dtypes)[channel]
    flat = n * n

    def run(batches):
        sums: dict = {}
        for batch in batches:
            x = np.stack([*(batch.column(i + 1).to_numpy() for i in range(n - 1)), np.ones(batch.num_rows)], axis=1)
            codes = batch.column(0).dictionary_encode()
            for at, name in enumerate(codes.dictionary.to_pylist()):
                own = x[codes.indices.to_numpy() == at]
                sums[name] = sums.get(name, 0) + own.T @ own
        for name, m in sums.items():
            yield pa.record_batch([pa.array([name] * flat, batch.column(0).type), pa.array(np.arange(flat, dtype=np.int32)), pa.array(m.ravel())], ["c", "at", "p"])

    rows = df.select(channel, *columns).mapInArrow(run, f"c {kind}, at int, p double").groupBy("c", "at").agg(F.sum("p").alias("p")).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["c"], np.zeros((n, n)))[divmod(r["at"], n)] = r["p"]
    return out


def _turned(df: DataFrame, channel: str, keys: list[str], columns: list[str], by: dict, names: list[str]) -> DataFrame:
    """Rows, with a last column of 1, times their channel's matrix; one small row a channel is broadcast."""
    spark, kind = df.sparkSession, dict(df.dtypes)[channel]
    rows = [(c, [[float(v) for v in row] for row in m]) for c, m in by.items()]
    small = spark.createDataFrame(rows, f"`{channel}` {kind}, _m array<array<double>>")
    joined = df.join(F.broadcast(small), channel)

    def value(j: int) -> Column:
        return sum((F.col(c) * F.col("_m")[i][j] for i, c in enumerate(columns)), F.col("_m")[len(columns)][j])

    return joined.select(channel, *keys, *(value(j).alias(name) for j, name in enumerate(names)))


def group_pca(scores: DataFrame, channel: str, group: str, k: int = 2, block: int = 24, max_rounds: int = 200, tolerance: float = 1e-11) -> DataFrame:
    """(channel, group, pc1 .. pck): principal coordinates of the groups of each channel.

    Block subspace iteration in long form: ``block`` columns a group are multiplied with the
    vectors (term, group, score) and back by joins and sums, centred, and made orthonormal, until
    the leading values settle; channels go together. Neither a vector nor a matrix of groups
    is ever built: what reaches the driver is block squared numbers a channel and round. With no
    more groups than columns the first round is exact. Coordinates are the unit eigenvectors times
    the root of their eigenvalue, the largest one of an axis made positive (ties: of the
    first group); axes beyond the rank are 0. ``scores`` is read in every round: pass a
    written table.
    """
    y, z = [f"y{i}" for i in range(block)], [f"z{i}" for i in range(block)]
    groups = scores.select(channel, group).distinct()
    start = [(F.xxhash64(F.lit(i), F.col(group).cast("string")) / float(1 << 62)).alias(c) for i, c in enumerate(y)]
    current, last = groups.select(channel, group, *start), None
    for _ in range(max_rounds):
        # centred and orthonormal; directions without length become 0
        basis, sums = {}, _products(current, channel, y)
        for c, m in sums.items():
            mean = m[:block, block] / m[block, block]
            values, vectors = np.linalg.eigh(m[:block, :block] - m[block, block] * np.outer(mean, mean))
            good = values > max(values[-1], 0) * 1e-11
            turn = vectors * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)
            basis[c] = np.vstack([turn, -mean @ turn])
        unit = materialise(_turned(current, channel, [group], y, basis, y), "plane")
        terms = materialise(scores.join(unit, [channel, group]).groupBy(channel, "term").agg(*(F.sum(F.col("score") * F.col(a)).alias(b) for a, b in zip(y, z))), "plane")
        found = {c: np.linalg.eigh(m[:block, :block]) for c, m in _products(terms, channel, z).items()}
        leading = {c: np.maximum(values[::-1][:k], 0) for c, (values, _) in found.items()}
        if all(m[block, block] <= block for m in sums.values()):
            break
        if last is not None and all(np.allclose(v, last[c], rtol=tolerance, atol=1e-300) for c, v in leading.items()):
            break
        last = leading
        current = scores.join(terms, [channel, "term"]).groupBy(channel, group).agg(*(F.sum(F.col("score") * F.col(b)).alias(a) for a, b in zip(y, z)))
        current = materialise(current, "plane")
    axes = [f"pc{i + 1}" for i in range(k)]
    turn = {}
    for c, (_, vectors) in found.items():
        length = np.sqrt(np.where(leading[c] > 1e-13 * leading[c].max(initial=0), leading[c], 0.0))
        turn[c] = np.vstack([vectors[:, ::-1][:, :k] * length, np.zeros(k)])
    placed = materialise(_turned(unit, channel, [group], y, turn, axes), "plane")
    # rounded, so that two groups of one distance from zero tie
    ends = placed.groupBy(channel).agg(*(F.min_by(a, F.struct(-F.round(F.abs(F.col(a)), 9), F.col(group))).alias(f"e_{a}") for a in axes))
    signed = [(F.col(a) * F.when(F.col(f"e_{a}") < 0, -1.0).otherwise(1.0)).alias(a) for a in axes]
    return placed.join(F.broadcast(ends), channel).select(channel, group, *signed)


def browse(
    df: DataFrame, condition: Column, columns: list[str], order: list
) -> DataFrame:
    """Filtered raw rows in order; the filter reaches the scan."""
    return df.where(condition).select(*columns).orderBy(*order)


def variance_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance")
    )
