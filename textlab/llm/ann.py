"""Nearest neighbours by largest inner product: probed lists scanned dimension by dimension."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textlab.sources.sinks import materialise


class Index(NamedTuple):
    """Fitted on a bounded sample: list centres, how many a query probes, the axes that distances are
    read along, widest first, in blocks, and the share of a distance after each block up to
    which a pair goes on."""

    centroids: np.ndarray
    probes: int
    axes: np.ndarray
    cuts: list[tuple[int, int]]
    shares: np.ndarray


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>), one row per id: the smallest usable vector of the most frequent length.

    Null vectors, zero vectors and those with a null or non-finite component are left out, as
    are rows without an id and vectors of other lengths.
    """
    v = F.col("v")
    rows = (
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda x: F.coalesce((x - x) == 0, F.lit(False))) & F.exists(v, lambda x: x != 0))
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        held = counts > 0
        centers[held] = sums[held] / counts[held, None]
    return centers


def fit(distinct: DataFrame, n: int, k: int = 20, sample_rows: int = 16_384, rows_per_list: int = 1_024, max_lists: int = 4_096, target: float = 0.99, width: int = 8, seed: int = 7) -> Index:
    """Index from at most ``sample_rows`` of the ``n`` distinct vectors, chosen by a hash of their ids.

    The number of probed lists is what finds the share ``target`` of the sample's own
    neighbours; these lie farther off than neighbours among all rows. The rotation is to the
    sample's principal axes, so that the first of the blocks of ``width`` columns tell most of a
    distance. The shares are the hypothesis test: of the sample's pairs of neighbours, ``target``
    have read no more of their distance after each of the blocks.
    """
    rows = distinct.select("uid", "v").orderBy(F.xxhash64("uid"), "uid").limit(sample_rows).toArrow()
    x = np.array(rows.column("v").to_pylist())
    lists = max(1, min(max_lists, len(x) // 8, -(-n // rows_per_list)))
    centers = _kmeans(x, lists, 12, seed)
    home = _lists_of(x, centers)
    stride = max(1, len(x) // 512)
    tries = x[::stride]
    scores = tries @ x.T
    scores[np.arange(len(tries)), np.arange(0, len(x), stride)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(-(tries @ centers.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(order, home[best], axis=1)
    probes = int(np.quantile(ranks, target, method="higher")) + 1 if ranks.size else lists

    d = x.shape[1]
    axes = np.linalg.eigh(np.cov(x.T).reshape(d, d) if len(x) > 1 else np.eye(d))[1][:, ::-1]
    cuts = [(a, min(d, a + width)) for a in range(0, d, width)]
    apart = ((tries[:, None, :] - x[best]) @ axes) ** 2
    read = np.stack([apart[..., :b].sum(axis=-1).ravel() for _, b in cuts], axis=1)
    read = read[read[:, -1] > 0] / read[read[:, -1] > 0, -1:]
    # a neighbour passes all tests with probability target if each fails no more than its part
    shares = np.quantile(read, 1 - (1 - target) / len(cuts), axis=0, method="higher") if len(read) else np.ones(len(cuts))
    return Index(centers, min(lists, probes), axes, cuts, np.append(shares[:-1], 1.0) * (1 + 1e-5))


class Tile:
    """Candidates of one list as rotated vectors in blocks of columns."""

    def __init__(self, vectors: np.ndarray, first_ids: np.ndarray, index: Index):
        order = np.argsort(first_ids, kind="stable")
        self.order, self.vectors, self.index = order, vectors[order], index
        turned = self.vectors @ index.axes
        self.blocks = [np.ascontiguousarray(turned[:, a:b], dtype=np.float32) for a, b in index.cuts]
        self.squares = [(b.astype(np.float64) ** 2).sum(1) for b in self.blocks]
        self.norms = (self.vectors**2).sum(1)
        # pairs tested after each block, and all pairs
        self.tested, self.pairs = np.zeros(len(index.cuts), np.int64), 0

    def best(self, queries: np.ndarray, least: np.ndarray, keep: int, first: int = 256, step: int = 2_048, group: int = 128):
        """Per query (places, scores) of the up to ``keep`` best with a score >= ``least``, best first.

        Squared distance is |q|^2 + |x|^2 - 2 <q, x>, so the score to beat gives each pair a
        distance to stay below. Partial distances in rotated space are tested against it after
        every block of columns; what survives all blocks is scored exactly. Where ``least`` is
        no bound, the first few candidates give one.
        """
        out = []
        starts = [0, *range(first, len(self.vectors), step)]
        for at in range(0, len(queries), group):
            q = queries[at : at + group]
            turned = q @ self.index.axes
            bar = least[at : at + group].copy()
            held = [(np.empty(0, np.int64), np.empty(0)) for _ in q]
            for lo, hi in zip(starts, [*starts[1:], len(self.vectors)]):
                self._scan(q, turned, bar, held, lo, hi, keep)
            out += held
        return out

    def _scan(self, q, turned, bar, held, lo, hi, keep):
        limit = (q**2).sum(1)[:, None] + self.norms[None, lo:hi] - 2 * bar[:, None]
        limit += 1e-9 * (1 + np.abs(limit))
        qi, ci = np.nonzero(limit > 0)
        limit, read = limit[qi, ci], np.zeros(len(qi))
        self.pairs += len(q) * (hi - lo)
        for at, ((a, b), block, squares, share) in enumerate(zip(self.index.cuts, self.blocks, self.squares, self.index.shares)):
            if not len(qi):
                return
            self.tested[at] += len(qi)
            part = turned[:, a:b]
            if 4 * len(qi) > len(q) * (hi - lo):
                products = (part.astype(np.float32) @ block[lo:hi].T).astype(np.float64)[qi, ci]
            else:
                products = np.einsum("ij,ij->i", part[qi], block[lo + ci])
            read = read + (part**2).sum(1)[qi] + squares[lo + ci] - 2 * products
            on = read <= share * limit + 1e-4 * (1 + limit)
            qi, ci, limit, read = qi[on], ci[on], limit[on], read[on]
        starts = np.searchsorted(qi, np.arange(len(q) + 1))
        for i in np.unique(qi):
            places = lo + ci[starts[i] : starts[i + 1]]
            scores = (self.vectors[places] * q[i]).sum(1)
            good = scores >= bar[i]
            places, scores = np.concatenate([held[i][0], places[good]]), np.concatenate([held[i][1], scores[good]])
            best = np.lexsort((places, -scores))[:keep]
            held[i] = places[best], scores[best]
            if len(best) == keep:
                bar[i] = max(bar[i], scores[best[-1]])


def _lists_of(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * v @ centroids.T, axis=1)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 20, rows_per_tile: int = 8_192, queries_per_tile: int = 16_384, **fitting) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``is_query`` holds for.

    Nearness is the inner product in double precision; a row is not its own neighbour; ties go
    to the smaller vec_id. For rows that take part see ``clean``; other columns are not
    read; without rows that take part there is no result. Copies of a vector are searched
    once: of each distinct vector the k + 1 smallest ids go on.

    Every vector is indexed: it belongs to the list of its nearest centre, a query probes the
    lists of the largest inner products with it, and further ones until these hold more than
    ``k`` vectors, so it has its ``k`` rows (all candidates, if fewer). The nearest lists that hold
    enough are scanned first; in further ones, in rounds of four times as many, a vector must beat
    the k-th found before. A list and the queries that probe it are cut
    into tiles of bounded size by counts taken before, so a hot list is many tasks.
    """
    rows = materialise(clean(vectors), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = (
        rows.withColumn("r", F.row_number().over(first))
        .where(F.col("r") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("uid"), "ids", "v")
    )
    distinct = materialise(distinct, "distinct-vectors")
    n = distinct.count()
    schema = "query_id long, vec_id long, score double"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(distinct, n, k, **fitting)
    lists = len(index.centroids)

    def place(batches):
        for batch in batches:
            home = _lists_of(_matrix(batch.column(2)), index.centroids)
            yield pa.record_batch([pa.array(home, pa.int32()), *batch.columns], ["list", "uid", "ids", "v"])

    placed = materialise(distinct.mapInArrow(place, "list int, uid long, ids array<long>, v array<double>"), "lists")

    sizes = dict(placed.groupBy("list").count().collect())
    held = np.array([sizes.get(i, 0) for i in range(lists)])

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if not part.num_rows:
                    continue
                order = np.argsort(-(_matrix(part.column(1)) @ index.centroids.T), axis=1, kind="stable").astype(np.int32)
                before = np.cumsum(held[order], axis=1) - held[order]
                needed = (before <= k).sum(axis=1)
                number = np.maximum(index.probes, needed)
                chosen = [row[:m] for row, m in zip(order, number)]
                columns = [part.column(0), pa.array(chosen, pa.list_(pa.int32())), pa.array(needed.astype(np.int32)), part.column(1)]
                yield pa.record_batch(columns, ["query_id", "lists", "needed", "v"])

    queries = materialise(rows.where(is_query).select("vec_id", "v").mapInArrow(probe, "query_id long, lists array<int>, needed int, v array<double>"), "queries")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = [max(1, -(-sizes.get(i, 0) // rows_per_tile)) for i in range(lists)]

    def tiled(df: DataFrame, key: str, own: str, own_counts: list[int], other: str, other_counts: list[int]) -> DataFrame:
        """Rows dealt by a hash to their own cuts of the list, and copied to all of the other side's."""
        number = F.element_at(F.lit(own_counts).cast("array<int>"), F.col("list") + 1)
        others = F.element_at(F.lit(other_counts).cast("array<int>"), F.col("list") + 1)
        dealt = df.withColumn(own, F.pmod(F.xxhash64(key), number).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))

    def match(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            ids = candidates.column("ids").to_pylist()
            tile = Tile(_matrix(candidates.column("v")), candidates.column("uid").to_numpy(), index)
            asked_ids = queries.column("query_id").to_pylist()
            best = tile.best(_matrix(queries.column("v")), queries.column("least").to_numpy(), k + 1)
            for query_id, (places, scores) in zip(asked_ids, best):
                rows = [(-s, i) for p, s in zip(tile.order[places].tolist(), scores.tolist()) for i in ids[p] if i != query_id]
                for s, i in sorted(rows)[:k]:
                    found[0].append(query_id)
                    found[1].append(i)
                    found[2].append(-s)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    def scanned(asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score, rank): of what each query finds in its lists, the ``k`` best."""
        loads = dict(asked.groupBy("list").count().collect())
        chunks = [max(1, -(-loads.get(i, 0) // queries_per_tile)) for i in range(lists)]
        left = tiled(placed, "uid", "part", parts, "chunk", chunks).groupBy("list", "part", "chunk")
        right = tiled(asked, "query_id", "chunk", chunks, "part", parts).groupBy("list", "part", "chunk")
        return left.cogroup(right).applyInArrow(match, schema).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    # First the nearest lists that hold enough; then rounds over four times as many lists as before, each to
    # beat the k-th score found so far, so that a round finds few rows beyond its results.
    listed = queries.select("query_id", "v", "needed", F.posexplode("lists").alias("at", "list"))
    unbound = F.lit(float("-inf"))
    found = materialise(scanned(listed.where("at < needed").select("query_id", "list", unbound.alias("least"), "v")), "found")
    reach = 1
    while reach < lists:
        bars = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        ring = listed.where((F.col("at") >= F.col("needed") * reach) & (F.col("at") < F.col("needed") * reach * 4)).join(bars, "query_id", "left")
        asked = materialise(ring.select("query_id", "list", F.coalesce("bar", unbound).alias("least"), "v"), "ring")
        both = found.unionByName(scanned(asked)).drop("rank")
        found = materialise(both.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k), "found")
        reach *= 4
    return found.select("query_id", "rank", "vec_id", "score")
