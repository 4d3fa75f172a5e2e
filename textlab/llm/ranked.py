"""Ranked lexical search by dual trees: items and documents are both put into hierarchies whose nodes
hold the maxima of their members' coordinates, and pairs of nodes are left together when
no member can reach what the weakest item of the node already has."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import slices
from textlab.operators.joins import top_k
from textlab.sources.sinks import materialise

# What separates terms is ASCII without letters and digits; only A-Z is lower-cased.
_TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCALE, FLAT, HALF = 1_000_000_000, 20, 50
_ITEM_LEAF, _DOC_LEAF, _FANOUT = 8, 16, 4


def terms(text: str | bytes | None) -> list[bytes]:
    """All terms of a whole text as UTF-8, with repeats."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


def similar_order(features: np.ndarray, leaf: int) -> np.ndarray:
    """Order that brings like rows together: halves along the widest direction, again and again."""
    out: list[np.ndarray] = []
    features = features / (np.abs(features).max(initial=0) or 1)

    def split(rows: np.ndarray) -> None:
        if len(rows) <= leaf:
            out.append(rows)
            return
        x = features[rows] - features[rows].mean(axis=0)
        direction = x[np.argmax((x * x).sum(axis=1))]
        for _ in range(4):
            direction = x.T @ (x @ direction)
            size = np.linalg.norm(direction)
            if size == 0:
                break
            direction = direction / size
        order = rows[np.argsort(x @ direction, kind="stable")]
        # whole leaves on the left, so that leaves stay aligned
        half = -(-len(rows) // (2 * leaf)) * leaf
        split(order[:half])
        split(order[half:])

    split(np.arange(len(features)))
    return np.concatenate(out)


def _hashed(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, width: int = 128) -> np.ndarray:
    out = np.zeros((n, width), np.float32)
    np.add.at(out, (rows, cols * 2654435761 % 4294967296 * width >> 32), values)
    return out


class Level:
    """Nodes of one height over ``members`` places each, with the maxima of their coordinates."""

    def __init__(self, maxima: np.ndarray):
        self.maxima = maxima

    def above(self) -> Level:
        return Level(np.maximum.reduceat(self.maxima, np.arange(0, len(self.maxima), _FANOUT)))


class ItemTree:
    """Items (lists of distinct columns) of a block under nodes that hold the columns of all below."""

    def __init__(self, columns: list[np.ndarray], weights: np.ndarray):
        n = len(columns)
        rows = np.repeat(np.arange(n), [len(c) for c in columns])
        flat = np.concatenate([np.empty(0, np.int64), *columns])
        order = similar_order(_hashed(rows, flat, weights[flat].astype(np.float32), n), _ITEM_LEAF) if n else np.empty(0, np.int64)
        self.order, self.weights = order, weights
        self.items = [columns[i] for i in order]
        leaves = [list(range(at, min(n, at + _ITEM_LEAF))) for at in range(0, n, _ITEM_LEAF)]
        # levels from the leaves up; a node is (item places, columns, children)
        self.levels = [[(places, self._union(self.items[p] for p in places), []) for places in leaves]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            groups = [range(at, min(len(low), at + _FANOUT)) for at in range(0, len(low), _FANOUT)]
            self.levels.append([(sum((low[c][0] for c in g), []), self._union(low[c][1] for c in g), list(g)) for g in groups])

    @staticmethod
    def _union(parts) -> np.ndarray:
        return reduce(np.union1d, parts, np.empty(0, np.int64)).astype(np.int64)


class Best:
    """The k best documents of each item so far: highest score first, equal scores by id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n_items)]
        self.weakest = np.zeros(n_items, np.int64)

    def add(self, item: int, scores: list[int], ids: list) -> None:
        rows = self.rows[item]
        rows.extend((-s, i is None, i) for s, i in zip(scores, ids))
        rows.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
        del rows[self.k :]
        if len(rows) == self.k:
            self.weakest[item] = -rows[-1][0]


class Search:
    """Dual-tree search of blocks of documents for all items of a tree."""

    def __init__(self, tree: ItemTree, k: int):
        self.tree, self.best, self.scored = tree, Best(len(tree.items), k), 0

    def block(self, values: np.ndarray, features: np.ndarray, ids: list) -> None:
        """Documents as rows of ``values`` (int32, by column); exact scores, no pair is lost."""
        if not len(values) or not self.tree.items:
            return
        order = similar_order(features, _DOC_LEAF)
        self.values, self.ids = values[order], [ids[i] for i in order]
        levels = [Level(np.maximum.reduceat(self.values, np.arange(0, len(order), _DOC_LEAF)))]
        while len(levels[-1].maxima) > 1:
            levels.append(levels[-1].above())
        self.levels = levels
        top = len(levels) - 1
        self._pair(len(self.tree.levels) - 1, 0, top, np.arange(len(levels[top].maxima)))

    def _bounds(self, level: int, nodes: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.levels[level].maxima[np.ix_(nodes, columns)].astype(np.int64) @ self.tree.weights[columns]

    @staticmethod
    def _below(nodes: np.ndarray, fanout: int, n: int) -> np.ndarray:
        out = (nodes[:, None] * fanout + np.arange(fanout)).ravel()
        return out[out < n]

    def _pair(self, item_level: int, item_node: int, level: int, nodes: np.ndarray) -> None:
        """An item node against document nodes: those whose bound reaches the weakest k-th score go down."""
        places, columns, children = self.tree.levels[item_level][item_node]
        bounds = self._bounds(level, nodes, columns)
        nodes = nodes[bounds >= max(1, self.best.weakest[places].min())]
        if not len(nodes):
            return
        if level:
            nodes = self._below(nodes, _FANOUT, len(self.levels[level - 1].maxima))
            level -= 1
        elif not item_level:
            for place in places:
                self._leaf(place, nodes)
            return
        for child in children if item_level else [item_node]:
            self._pair(max(0, item_level - 1), child, level, nodes)

    def _leaf(self, place: int, leaves: np.ndarray) -> None:
        columns, least = self.tree.items[place], max(1, self.best.weakest[place])
        leaves = leaves[self._bounds(0, leaves, columns) >= least]
        docs = self._below(leaves, _DOC_LEAF, len(self.values))
        self.scored += len(docs)
        scores = self.values[np.ix_(docs, columns)].astype(np.int64) @ self.tree.weights[columns]
        # equal scores are decided by the id
        hit = np.flatnonzero(scores >= least)
        if len(hit):
            self.best.add(place, scores[hit].tolist(), [self.ids[d] for d in docs[hit]])


def statistics(docs: DataFrame, columns: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and per column the documents that hold it."""

    def run(batches):
        df, n_docs, n_terms = np.zeros(len(columns), np.int64), 0, 0
        for batch in slices(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found = terms(text)
                n_docs += bool(found)
                n_terms += len(found)
                held = [c for c in map(columns.get, set(found)) if c is not None]
                df[held] += 1
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[n_docs, n_terms], df[held]]))], ["c", "n"])

    rows = docs.select("text").mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(columns), np.int64)
    totals = {r["c"]: r["n"] for r in rows}
    for c, n in totals.items():
        if c >= 0:
            df[c] = n
    return totals.get(-2, 0), totals.get(-1, 0), df


def _found(docs: DataFrame, columns: dict[bytes, int], per_item: list[np.ndarray], k: int, id_type: str, rows: int) -> DataFrame:
    """(item, id, score): of each task's documents the k best of every item; item is its number."""
    n_docs, n_terms, df = statistics(docs, columns)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)

    def run(batches) -> Iterator[pa.RecordBatch]:
        search = Search(ItemTree(per_item, weights), k)
        kind = None
        for batch in slices(batches, rows):
            kind = batch.column(0).type
            at, held, seen, ids = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = terms(text)
                flat = 100 - HALF + HALF * len(found) * n_docs // n_terms if found else 0
                own = [(c, tf) for t, tf in Counter(found).items() if (c := columns.get(t)) is not None]
                if own:
                    at += [len(ids)] * len(own)
                    held += [c for c, _ in own]
                    seen += [SCALE * tf // (1000 * tf + FLAT * flat) for _, tf in own]
                    ids.append(doc)
            at, held, seen = np.array(at, np.int64), np.array(held, np.int64), np.array(seen, np.int64)
            values = np.zeros((len(ids), len(columns)), np.int32)
            values[at, held] = seen
            search.block(values, _hashed(at, held, (seen * weights[held]).astype(np.float32), len(ids)), ids)
        out = [(int(search.tree.order[place]), i, -s) for place, kept in enumerate(search.best.rows) for s, _, i in kept]
        if out:
            item, ids, score = zip(*out)
            yield pa.record_batch([pa.array(item, pa.int64()), pa.array(ids, kind), pa.array(score, pa.int64())], ["item", "id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"item long, id {id_type}, score long")


def _blocks(items: DataFrame, max_items: int, max_terms: int) -> Iterator[list[tuple]]:
    """Distinct items in blocks of at most so many items and, beyond the first, distinct terms."""
    block, known = [], set()
    for r in items.distinct().toLocalIterator():
        found = set(terms(r["text"]))
        if block and (len(block) == max_items or len(known | found) > max_terms):
            yield block
            block, known = [], set()
        block.append((r["item_id"], found))
        known |= found
    if block:
        yield block


def search(
    items: DataFrame, docs: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text",
    max_items: int = 512, max_terms: int = 16_384, rows: int = 1_024,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of every item, scores above 0.

    Scores are whole numbers: an item's distinct terms' weights times a saturating count of the term
    in the document, flattened by its length against the mean. Equal scores go by ascending
    id, null ids last. Equal rows of ``items`` are one item, one id with two texts is two;
    repeated rows of ``docs`` are documents of their own. Null and empty texts have no terms, and
    an item without terms or without any document no rows. Texts are read whole; other columns are
    not read; an empty table on either side gives none.

    Items come in blocks of bounded size (``max_items``, ``max_terms``), which travel with the
    task; a block is one pass for the documents' statistics and one for the search. A
    task holds ``rows`` documents at a time and k rows per item, and returns the latter; they
    are ranked in two steps, so no item's rows meet in one task before they are few.
    """
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    docs = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    item_type, id_type = dict(items.dtypes)["item_id"], dict(docs.dtypes)["id"]
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    spark, parts = docs.sparkSession, []
    for block in _blocks(items, max_items, max_terms):
        columns = {t: c for c, t in enumerate(sorted(set().union(*(found for _, found in block))))}
        per_item = [np.array(sorted(columns[t] for t in found), np.int64) for _, found in block]
        found = _found(docs, columns, per_item, k, id_type, rows)
        ranked = materialise(top_k(found, ["item"], order, k, ["id"], "rank"), "ranked")
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item long, item_id {item_type}")
        parts.append(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, {doc_id} {id_type}, score long")
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("item_id", item_id)


def sql(k: int = 50) -> str:
    """The same in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all(translate({{0}}, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {found.format("text")} AS ts FROM documents
), c AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0
), tf AS (
  SELECT r, doc_id, term, n, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n_docs
), i AS (
  SELECT item, item_id, unnest(list_distinct(ts)) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, {found.format("text")} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark))
), s AS (
  SELECT item, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {k}
"""
