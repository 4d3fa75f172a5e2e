"""Connected components of a graph given by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.sources.sinks import materialise


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b): root is its smallest reachable node.

    Large-star and small-star rounds: each replaces links by links to smaller nodes, so paths
    shrink exponentially. A round is two aggregates with map-side combine and two joins whose
    hot keys the session may split; its result is a written table, so a lost executor costs
    one round. Nothing but two numbers a round reaches the driver.
    """
    links = (
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    links = materialise(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        links = materialise(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum((F.col("u") % 1000003).cast("decimal(30,0)"))).first()
    return tuple(r)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    smallest = links.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
    # of a node without smaller neighbours, the smallest is the node itself
    return (
        links.join(smallest, links["u"] == smallest["n"], "left")
        .select("v", F.coalesce("m", "u").alias("u"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    smallest = links.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
    moved = links.join(smallest, links["v"] == smallest["n"]).select(F.col("u").alias("v"), F.col("m").alias("u"))
    own = smallest.select(F.col("n").alias("v"), F.col("m").alias("u"))
    return moved.where("v != u").unionByName(own).distinct()
