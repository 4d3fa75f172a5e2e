"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.common import Forest, in_batches
from textlab.llm.components import components
from textlab.operators.rows import slice_of
from textlab.sources.sinks import materialise

SEED = 42
_CHUNK = 1 << 16
_PAIRS = 1 << 21


def simhash64(text: str | None, words: int = 3) -> int:
    """Fingerprint of a whole text: bit set where over half of its shingles have it.

    ASCII letters are lower-cased, words are separated by ASCII white space. A text of fewer
    words is one shingle; one without words has fingerprint 0.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        last = min(n, at + _CHUNK)
        shingles = zip(*(tokens[at + k : last + k] for k in range(words))) if n > 1 or len(tokens) >= words else [tokens]
        hashes = np.fromiter((digest(s, SEED) for s in map(b" ".join, shingles)), np.uint64, last - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > n))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that tell rows of different id or text apart."""
    return F.struct(F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, key, fp long) of every row; fp is the fingerprint as a signed number. Null text: empty."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((simhash64(t, words) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], [id_col, "key", "fp"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(id_col, row_key(id_col, text_col).alias("key"), text_col)
    return in_batches(rows, kernel, f"{id_col} {kind}, key struct<k1 long, k2 long>, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, shifted so that signed order is the order."""
    r = fp
    for k in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, k))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def turned(fp: Column, bits: int) -> Column:
    """The 64 bits turned left."""
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits)) if bits else fp


class GrayTree:
    """Nodes over fingerprints (or groups of them) in Gray order.

    A node keeps the bits that all below it share (mask) and their values (pattern). A search
    goes down by levels, adds up the differing bits that a node newly fixes, and leaves a
    whole group as soon as the sum passes the radius. ``lead`` are bits that must agree.
    """

    def __init__(self, patterns: np.ndarray, lead: int = 0, fanout: int = 8):
        masks = np.full(len(patterns), ~np.uint64(0))
        self.fanout, self.lead, self.levels = fanout, np.uint64(lead), [(patterns, masks)]
        while len(patterns) > fanout:
            starts = np.arange(0, len(patterns), fanout)
            all_and = np.bitwise_and.reduceat(patterns, starts)
            all_or = np.bitwise_or.reduceat(patterns, starts)
            # a bit is shared where every child fixes it and all agree
            masks = np.bitwise_and.reduceat(masks, starts) & ~(all_and ^ all_or)
            patterns = all_and & masks
            self.levels.append((patterns, masks))
        # what each node fixes beyond its parent
        self.fresh = [
            m & ~np.repeat(self.levels[k + 1][1], fanout)[: len(m)] if k + 1 < len(self.levels) else m
            for k, (_, m) in enumerate(self.levels)
        ]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query places, leaf places) of all pairs that differ in at most ``radius`` shared bits."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        step = max(1, _PAIRS // max(1, n))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(len(queries), at + step))
            yield from self._down(queries, np.repeat(q, n), np.tile(np.arange(n), len(q)), np.zeros(n * len(q), np.uint8), top, radius)

    def _down(self, queries, q, node, acc, level, radius):
        if not len(q):
            return
        if len(q) > _PAIRS:
            half = len(q) // 2
            yield from self._down(queries, q[:half], node[:half], acc[:half], level, radius)
            yield from self._down(queries, q[half:], node[half:], acc[half:], level, radius)
            return
        differ = (queries[q] ^ self.levels[level][0][node]) & self.fresh[level][node]
        acc = acc + np.bitwise_count(differ)
        near = (acc <= radius) & (differ & self.lead == 0)
        q, node, acc = q[near], node[near], acc[near]
        if level == 0:
            if len(q):
                yield q, node
            return
        below = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
        q, acc = np.repeat(q, self.fanout), np.repeat(acc, self.fanout)
        there = below < len(self.levels[level - 1][0])
        yield from self._down(queries, q[there], below[there], acc[there], level - 1, radius)


def _spanning_links(own: np.ndarray, visitors: Iterator[np.ndarray], radius: int, lead: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the same components as all near pairs among ``own`` and with visitors."""
    tree, forest = GrayTree(own, lead), Forest(len(own))
    for q, c in tree.search(own, radius):
        forest.unite(q, c)
    for batch in visitors:
        first = np.full(len(batch), len(own), dtype=np.int64)
        for q, c in tree.search(batch, radius):
            np.minimum.at(first, q, c)
            forest.unite(first[q], c)
        met = first < len(own)
        if met.any():
            yield batch[met], own[first[met]]
    roots = forest.roots(np.arange(len(own)))
    moved = roots != np.arange(len(own))
    yield own[moved], own[roots[moved]]


def near_links(distinct: DataFrame, radius: int = 2, rows_per_part: int = 20_000, max_parts: int = 4096) -> DataFrame:
    """Links (a, b) that join every two fingerprints of ``distinct`` (fp) within ``radius`` bits.

    Not every pair is named: a part of an index yields a spanning set of links, which has the
    same components. There are radius + 1 indexes. Each turns the bits so that another block
    of them leads, and two near fingerprints agree in at least one block. An index is
    range-cut in Gray order into parts of ``rows_per_part`` (quantiles of distinct values, so
    none is hot; more than that beyond ``max_parts`` parts). Where a cut falls between
    fingerprints with one leading block, those before it also visit the later parts,
    unless the part's upper node (bits that all in it share) is too far. A fingerprint is
    thus read radius + 1 times and a little more, at any size.
    """
    blocks = radius + 1
    turns = [64 * t // blocks for t in range(blocks)]
    widths = [64 * (t + 1) // blocks - 64 * t // blocks for t in range(blocks)]
    width = min(widths)
    ranked = distinct.select("fp", *(gray_rank(turned(F.col("fp"), turn)).alias(f"rank{t}") for t, turn in enumerate(turns)))
    parts = max(1, min(max_parts, -(-ranked.count() // rows_per_part)))
    shares = [i / parts for i in range(1, parts)]
    cuts = [[] for _ in turns]
    if shares:
        found = ranked.agg(*(F.percentile_approx(f"rank{t}", shares, 20 * parts) for t in range(blocks))).first()
        cuts = [sorted(set(c)) for c in found]
    owner = F.explode(
        F.array(
            *(
                F.struct((slice_of(F.col(f"rank{t}"), cuts[t]) + t * parts).alias("part"), turned(F.col("fp"), turn).alias("fp"))
                for t, turn in enumerate(turns)
            )
        )
    )
    upper = (
        ranked.select(owner.alias("o"))
        .groupBy("o.part")
        .agg(F.expr("bit_and(o.fp)").alias("all_and"), F.expr("bit_or(o.fp)").alias("all_or"))
        .collect()
    )
    number = blocks * parts
    all_and, mask = np.zeros(number, np.uint64), np.zeros(number, np.uint64)
    for r in upper:
        same = ~(r["all_and"] ^ r["all_or"]) & (2**64 - 1)
        all_and[r["part"]], mask[r["part"]] = r["all_and"] & (2**64 - 1), same
    lead = (2**64 - 1) >> (64 - width) << (64 - width)
    low = np.uint64(2**64 - 1 - lead)

    def route(batches):
        splits = [np.array(c, dtype=np.int64) for c in cuts]
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t, turn in enumerate(turns):
                rank = batch.column(1 + t).to_numpy()
                bits = fp << np.uint64(turn) | fp >> np.uint64(64 - turn) if turn else fp
                own = np.searchsorted(splits[t], rank, side="right")
                # the last part that holds the same leading block; the shift of ranks keeps blocks together
                last = np.searchsorted(splits[t], (rank.view(np.uint64) | low).view(np.int64), side="right")
                part, q = own, np.arange(len(own))
                while len(q):
                    to = part + t * parts
                    away = np.bitwise_count((bits[q] ^ all_and[to]) & mask[to]) <= radius
                    go = away | (part == own[q])
                    yield pa.record_batch(
                        [pa.array(to[go].astype(np.int32)), pa.array(part[go] != own[q[go]]), pa.array(rank[q[go]]), pa.array(bits[q[go]].view(np.int64))],
                        ["part", "visitor", "rank", "fp"],
                    )
                    more = part < last[q]
                    part, q = part[more] + 1, q[more]

    schema = "part int, visitor boolean, rank long, fp long"
    routed = ranked.mapInArrow(route, schema).repartition(number, "part").sortWithinPartitions("part", "visitor", "rank")

    def match(batches):
        for part, runs in _parts(batches):
            turn = turns[part // parts]
            for ends in _spanning_links(next(runs), runs, radius, lead):
                if len(ends[0]):
                    back = (e >> np.uint64(turn) | e << np.uint64(64 - turn) if turn else e for e in ends)
                    yield pa.record_batch([pa.array(e.view(np.int64)) for e in back], ["a", "b"])

    return routed.mapInArrow(match, "a long, b long")


def _parts(batches) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """Per part its number and an iterator: first all of its own fingerprints, then batches of visitors."""

    def slices():
        for batch in batches:
            part, visitor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(3).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(visitor.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
                if hi > lo:
                    yield part[lo], visitor[lo], fp[lo:hi]

    source, held = slices(), []

    def one(part):
        own = []
        while held and held[0][0] == part and not held[0][1]:
            own.append(held.pop()[2])
            held.extend(x for x in [next(source, None)] if x)
        yield np.concatenate(own) if own else np.empty(0, np.uint64)
        while held and held[0][0] == part:
            yield held.pop()[2]
            held.extend(x for x in [next(source, None)] if x)

    held.extend(x for x in [next(source, None)] if x)
    while held:
        yield int(held[0][0]), one(held[0][0])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, rows_per_part: int = 20_000
) -> DataFrame:
    """(id, key, fp, group, component_id) of every row of ``docs``; other columns are not read.

    Rows whose fingerprints differ in at most ``radius`` bits are linked. ``group`` names what
    links reach (by a fingerprint in it), component_id is the smallest id in it, the row
    itself included; ``key`` tells rows of different id or text apart. Rows of one
    fingerprint count once in the search. Null and empty texts share fingerprint 0. Rows with
    a null id take part; component_id is null only if the whole group has no id. Repeated
    rows give repeated results; an empty table gives none.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-distinct")
    linked = components(near_links(distinct.select("fp"), radius, rows_per_part)).withColumnRenamed("node", "fp")
    named = distinct.join(linked, "fp")
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = named.join(lowest, "root").select("fp", "root", "component_id")
    by_print = distinct.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    return prints.join(by_print, "fp").select(id_col, "key", "fp", "group", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest id.

    Groups are those of ``found`` (id, key, group), by default of ``near_duplicates``. Rows
    without an id come last. Of rows that repeat an id and text, one stays.
    """
    found = near_duplicates(docs, id_col, text_col) if found is None else found
    first = F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), "key"))
    chosen = found.groupBy("group").agg(first.alias("first")).select("first.key.k1", "first.key.k2")
    key = row_key(id_col, text_col)
    kept = docs.select(F.struct("*").alias("row"), key["k1"].alias("k1"), key["k2"].alias("k2")).join(chosen, ["k1", "k2"], "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select("row.*")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
