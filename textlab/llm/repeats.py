"""Long repeated passages by prefix-free parsing: triggers cut texts into phrases, suffixes of
distinct phrases and of the parse are ordered together, and only neighbours are compared.

A suffix is needed only as far as ``length`` bytes. So the parse's suffixes (those at triggers)
are told apart by fingerprints of that much of what follows, and one dictionary suffix in front
of a trigger stands for all its copies, however often a passage repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import in_batches, slices
from textlab.llm.simhash import row_key
from textlab.sources.sinks import materialise

TRIGGER = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F)
_digest = xxhash.xxh3_64_intdigest
NEAR, FAR, BARE = 0, 1, 2


class Reach(NamedTuple):
    """How far a window may start before its first trigger, for a match length.

    Windows start less than ``near`` bytes before it (then the ``context(NEAR)`` bytes from the
    trigger on are inside), less than ``far``, or count as bare and stand for themselves.
    """

    length: int
    modulus: int = 56

    @property
    def near(self) -> int:
        return self.length // 3

    @property
    def far(self) -> int:
        return 5 * self.length // 6

    def context(self, kind: int) -> int:
        return (self.length - self.near + 1, self.length - self.far + 1, self.length)[kind]

    def starts(self, kind: int) -> range:
        """Distances from a window's start to its trigger."""
        return (range(self.near), range(self.near, self.far), range(1))[kind]


def triggers(text: bytes, modulus: int) -> np.ndarray:
    """Places whose window of ``TRIGGER`` bytes has a hash below one ``modulus``-th of all."""
    if len(text) < TRIGGER:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    windows = np.lib.stride_tricks.as_strided(raw, (len(raw) - TRIGGER + 1, TRIGGER), (1, 1)).view("<u8").ravel()
    return np.flatnonzero(windows * _FACTOR < np.uint64(2**64 // modulus)).astype(np.int64)


class Records(NamedTuple):
    """Windows of a text by the trigger they start before: all starts from ``at - high`` to ``at - low``."""

    at: np.ndarray
    kind: np.ndarray
    low: np.ndarray
    high: np.ndarray


def records(text: bytes, reach: Reach) -> Records:
    """Every window start of the text, each in one record; bare starts are records of their own."""
    n, length = len(text), reach.length
    none = np.empty(0, np.int64)
    if n < length:
        return Records(none, none, none, none)
    at = triggers(text, reach.modulus)
    before = np.concatenate([[-1], at])
    gap = at - before[:-1]
    parts = []
    for kind in (NEAR, FAR):
        starts = reach.starts(kind)
        low = np.maximum(starts.start, at + length - n)
        high = np.minimum(starts.stop, gap) - 1
        fits = low <= high
        parts.append((at[fits], np.full(fits.sum(), kind), low[fits], high[fits]))
    first, last = before + 1, np.minimum(np.concatenate([at - reach.far, [n]]), n - length)
    long = last >= first
    bare = np.concatenate([none, *(np.arange(a, b + 1) for a, b in zip(first[long], last[long]))])
    zero = np.zeros(len(bare), np.int64)
    parts.append((bare, zero + BARE, zero, zero))
    return Records(*(np.concatenate(column) for column in zip(*parts)))


def prints(text: bytes, found: Records, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """Per record the fingerprint of what follows its trigger, and that of all its windows hold."""
    contexts = [reach.context(kind) for kind in (NEAR, FAR, BARE)]
    rows = list(zip(*(column.tolist() for column in found)))
    context = [_digest(text[at : at + contexts[kind]], kind) for at, kind, _, _ in rows]
    whole = [_digest(text[at - high : at + reach.length - low], 4 * low + kind) for at, kind, low, high in rows]
    return np.array(context, np.uint64).view(np.int64), np.array(whole, np.uint64).view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _concat(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([np.empty(0, np.int64), *parts]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of what the spans cover."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def _followed(docs: DataFrame, reach: Reach) -> DataFrame:
    """(follow, n): fingerprints of what follows a trigger that occur more than once.

    n is 0 where all occurrences agree in every byte of their windows, so that each window is
    a repeat; else their number.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [prints(t, records(t, reach), reach) for t in _texts(batch.column(0))]
        return pa.record_batch([_concat([p[0] for p in pairs]), _concat([p[1] for p in pairs])], ["follow", "whole"])

    rows = in_batches(docs.select("text"), kernel, "follow long, whole long")
    seen = rows.groupBy("follow").agg(F.count("*").alias("n"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    return seen.where("n > 1").select("follow", F.when(F.col("least") == F.col("most"), 0).otherwise(F.col("n")).alias("n"))


def _hits(docs: DataFrame, followed: DataFrame, reach: Reach) -> DataFrame:
    """(k1, hits): per row of ``docs`` the repeated fingerprints it holds."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.unique(prints(t, records(t, reach), reach)[0]) for t in _texts(batch.column(1))]
        keys = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
        return pa.record_batch([pa.array(keys), _concat(own)], ["k1", "follow"])

    rows = in_batches(docs.select("k1", "text"), kernel, "k1 long, follow long")
    return rows.join(followed, "follow").groupBy("k1").agg(F.collect_set(F.struct("follow", "n")).alias("hits"))


def _settled(docs: DataFrame, hits: DataFrame, reach: Reach, kind: str, keep: bool) -> DataFrame:
    """Every row with the spans that agreeing windows cover, and the fingerprints still open.

    Rows without hits are done; their text goes no further unless it is to be kept.
    """
    schema = f"id {kind}, k1 long, k2 long, n_bytes long, sha string, text binary, spans array<struct<s:long,e:long>>, open array<struct<follow:long,n:long>>"
    span, pending = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.struct([("follow", pa.int64()), ("n", pa.int64())]))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        shas, held, spans, left = [], [], [], []
        texts = _texts(batch.column(3))
        for text, found in zip(texts, batch.column(4).to_pylist()):
            sure = np.array([h["follow"] for h in found or () if not h["n"]], np.int64)
            rest = [h for h in found or () if h["n"]]
            rows = records(text, reach) if found else None
            covered = []
            if rows is not None and len(sure):
                agree = np.isin(prints(text, rows, reach)[0], sure)
                at, low, high = rows.at[agree], rows.low[agree], rows.high[agree]
                covered = merged(list(zip((at - high).tolist(), (at - low + reach.length).tolist())))
            shas.append(None if found else hashlib.sha256(text).hexdigest())
            held.append(text if found or keep else None)
            spans.append([{"s": s, "e": e} for s, e in covered])
            left.append(rest)
        size = pa.array([len(t) for t in texts], pa.int64())
        return pa.record_batch(
            [*batch.columns[:3], size, pa.array(shas, pa.string()), pa.array(held, pa.binary()), pa.array(spans, span), pa.array(left, pending)],
            ["id", "k1", "k2", "n_bytes", "sha", "text", "spans", "open"],
        )

    return in_batches(docs.join(hits, "k1", "left").select("id", "k1", "k2", "text", "hits"), kernel, schema, 64)


_OCCURRENCE = "follow long, follow2 long, whole long, n long, kind int, low int, high int, front binary, back binary, k1 long, k2 long, at long"


def _occurrences(held: DataFrame, reach: Reach) -> DataFrame:
    """Records whose fingerprint is open: the dictionary suffix before the trigger (``front``) and what
    may follow the shared context (``back``)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k1, k2, text, still in zip(*(c.to_pylist() for c in batch.columns)):
            wanted = {h["follow"]: h["n"] for h in still}
            found = records(text, reach)
            follow, whole = prints(text, found, reach)
            for i in np.flatnonzero(np.isin(follow, np.array(list(wanted), np.int64))):
                at, kind, low, high = (int(column[i]) for column in found)
                edge = at + reach.context(kind)
                again = _digest(text[at:edge], 7 + kind) - (1 << 63)
                rows.append((follow[i], again, whole[i], wanted[int(follow[i])], kind, low, high, text[at - high : at], text[edge : at + reach.length - low], k1, k2, at))
        types = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 3
        columns = zip(*rows) if rows else [[]] * len(types)
        names = [c.split()[0] for c in _OCCURRENCE.split(", ")]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return in_batches(held.select("k1", "k2", "text", "open"), kernel, _OCCURRENCE, 64)


def _padded(values: list[bytes], width: int, right: bool) -> np.ndarray:
    filled = b"".join(v.rjust(width, b"\0") if right else v.ljust(width, b"\0") for v in values)
    return np.frombuffer(filled, np.uint8).reshape(len(values), width)


def repeated_starts(group: np.ndarray, low: np.ndarray, high: np.ndarray, front: list[bytes], back: list[bytes], kind: int, reach: Reach) -> tuple[np.ndarray, np.ndarray]:
    """First and last start (least and greatest distance before the trigger, -1 if none) of each
    entry at which another entry of its group has the same window.

    For every distance the suffixes of that length are sorted, by the dictionary suffix and then
    by what follows, and neighbours are compared byte by byte.
    """
    n, starts = len(group), reach.starts(kind)
    rest = reach.length - reach.context(kind)
    left, right = _padded(front, starts.stop - 1, True), _padded(back, rest - starts.start, False)
    after = np.zeros((right.shape[1] + 1, n), np.uint64)
    for j in range(right.shape[1]):
        after[j + 1] = (after[j] + right[:, j] + np.uint64(1)) * _BASE
    before = np.zeros(n, np.uint64)
    place = group.astype(np.uint64) * _MIX
    least, most = np.full(n, -1), np.full(n, -1)
    for o in range(starts.stop):
        if o:
            before = (before + left[:, left.shape[1] - o] + np.uint64(1)) * _BASE
        if o < starts.start:
            continue
        may = np.flatnonzero((low <= o) & (o <= high))
        if len(may) < 2:
            continue
        key = ((before[may] ^ place[may]) * _MIX) ^ after[rest - o][may]
        order = may[np.argsort(key, kind="stable")]
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(((before[a] == before[b]) & (group[a] == group[b]) & (after[rest - o][a] == after[rest - o][b])))
        a, b = a[near], b[near]
        same = (left[a, left.shape[1] - o :] == left[b, left.shape[1] - o :]).all(axis=1) & (right[a, : rest - o] == right[b, : rest - o]).all(axis=1)
        hit = np.unique(np.concatenate([a[same], b[same]]))
        least[hit] = np.where(least[hit] < 0, o, least[hit])
        most[hit] = o
    return least, most


def _ordered(entries: DataFrame, reach: Reach, rows: int = 8_192) -> DataFrame:
    """(follow, follow2, whole, least, most) of entries with a repeated window, group by group."""
    names = ["follow", "follow2", "whole", "least", "most"]

    def settle(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        for kind in (NEAR, FAR):
            part = batch.filter(pa.compute.equal(batch["kind"], kind))
            if not part.num_rows:
                continue
            ids = np.stack([part["follow"].to_numpy(), part["follow2"].to_numpy()], axis=1)
            group = np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))])
            low, high = part["low"].to_numpy(), part["high"].to_numpy()
            least, most = repeated_starts(group, low, high, part["front"].to_pylist(), part["back"].to_pylist(), kind, reach)
            hit = most >= 0
            yield pa.record_batch([*(pa.array(part[c].to_numpy()[hit]) for c in names[:3]), pa.array(least[hit], pa.int32()), pa.array(most[hit], pa.int32())], names)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        for batch in slices(batches, 2_048):
            # whole groups only: cut before the last fingerprint of what is held
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            follow = table["follow"].to_numpy()
            cut = int(np.searchsorted(follow, follow[-1]))
            yield from settle(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    columns = ["follow", "follow2", "whole", "kind", "low", "high", "front", "back"]
    dealt = entries.select(columns).repartition("follow").sortWithinPartitions("follow", "follow2")
    return dealt.mapInArrow(run, "follow long, follow2 long, whole long, least int, most int")


def _counted(entries: DataFrame, reach: Reach) -> DataFrame:
    """As ``_ordered`` for groups of any size: a row per start, counted with map-side combine."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for follow, follow2, whole, kind, low, high, front, back in zip(*(c.to_pylist() for c in batch.columns)):
            rest = reach.length - reach.context(kind)
            for o in range(low, high + 1):
                both = xxhash.xxh3_128_intdigest(front[len(front) - o :] + back[: rest - o], o)
                out.append((follow, follow2, whole, o, (both >> 64) - (1 << 63), (both & (2**64 - 1)) - (1 << 63)))
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2
        columns = zip(*out) if out else [[]] * 6
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["follow", "follow2", "whole", "o", "w1", "w2"])

    columns = ["follow", "follow2", "whole", "kind", "low", "high", "front", "back"]
    rows = in_batches(entries.select(columns), kernel, "follow long, follow2 long, whole long, o int, w1 long, w2 long", 64)
    window = ["follow", "follow2", "o", "w1", "w2"]
    again = rows.groupBy(*window).count().where("count > 1").select(window)
    return rows.join(again, window, "left_semi").groupBy("follow", "follow2", "whole").agg(F.min("o").alias("least"), F.max("o").alias("most"))


def repeated_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, max_group: int = 4_096, modulus: int = 56) -> DataFrame:
    """Every row of ``docs`` with the bytes that a repeated string of ``length`` bytes covers.

    Columns: id, n_bytes, removed (maximal runs as structs s, e of UTF-8 byte places, end
    exclusive), kept_sha256 of the bytes outside them, and with ``keep`` the bytes themselves
    (kept, binary). A string is repeated if it starts anywhere else, in the same text too.

    A repeated window has its first trigger at the same distance in all its copies, and the
    bytes from there on are the same. So windows are grouped by the trigger they start
    before and told apart in three steps: triggers whose following bytes occur once are
    left; where all windows of all occurrences agree, they are repeats; the rest, at the ends of
    passages, are ordered as dictionary suffixes with what follows, each distinct one once.
    Within a record only the first and last repeated start are needed, as the windows between
    them are less than ``length`` apart. Groups of more than ``max_group`` occurrences are
    counted window by window instead, so no group has to fit a task.

    Null texts are empty; texts below ``length`` bytes have no windows; repeated rows are texts of
    their own, so long ones go wholly; ids of any kind, null too, are kept; other columns are not
    read; an empty table gives none. A text crosses the network once, those with a repeat twice.
    """
    if length < 64:
        raise ValueError("matches of 64 bytes or more only")
    reach = Reach(length, modulus)
    key = row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key["k1"].alias("k1"), key["k2"].alias("k2"))
    followed = materialise(_followed(rows, reach), "repeats-followed")
    hits = materialise(_hits(rows, followed, reach), "repeats-hits")
    held = materialise(_settled(rows, hits, reach, dict(docs.dtypes)[id_col], keep), "repeats-held")
    found = materialise(_occurrences(held.where("size(open) > 0"), reach), "repeats-open")
    once = [F.first(c).alias(c) for c in ("n", "kind", "low", "high", "front", "back")]
    entries = materialise(found.groupBy("follow", "follow2", "whole").agg(F.count("*").alias("copies"), *once), "repeats-entries")
    own = entries.where("copies > 1").select("follow", "follow2", "whole", F.col("low").alias("least"), F.col("high").alias("most"))
    few, many = entries.where(F.col("n") <= max_group), entries.where(F.col("n") > max_group)
    starts = own.unionByName(_ordered(few, reach)).unionByName(_counted(many, reach))
    span = F.struct((F.col("at") - F.col("most")).alias("s"), (F.col("at") - F.col("least") + length).alias("e"))
    more = found.select("follow", "follow2", "whole", "k1", "k2", "at").join(starts, ["follow", "follow2", "whole"]).groupBy("k1", "k2").agg(F.collect_set(span).alias("more"))

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_bytes long, removed array<struct<s:long,e:long>>, kept_sha256 string" + ", kept binary" * keep
    runs = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, left = [], []
        for text, spans, more in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
            covered = merged([(x["s"], x["e"]) for x in [*spans, *(more or ())]])
            ends = [0, *(e for _, e in covered)]
            left.append(b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in covered), len(text)])))
            removed.append([{"s": s, "e": e} for s, e in covered])
        columns = [batch.column(0), batch.column(1), pa.array(removed, runs), pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())]
        return pa.record_batch(columns + [pa.array(left, pa.binary())] * keep, ["id", "n_bytes", "removed", "kept_sha256", "kept"][: 4 + keep])

    open_rows = held.where("sha is null").join(more, ["k1", "k2"], "left").select("id", "n_bytes", "text", "spans", "more")
    done = held.where("sha is not null").select("id", "n_bytes", F.col("spans").alias("removed"), F.col("sha").alias("kept_sha256"), *([F.col("text").alias("kept")] * keep))
    return done.unionByName(in_batches(open_rows, cut, schema, 64)).withColumnRenamed("id", id_col)


def sql(length: int = 400) -> str:
    """The query's rows in DuckDB's SQL, from all windows of all texts."""
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), piece AS (
  SELECT r, p, substr(x, 2 * p + 1, {2 * (999 + length)}) AS x FROM (SELECT r, x, unnest(range(0, length(x) // 2, 1000)) AS p FROM d)
), w AS (
  SELECT r, p + i AS i, md5(substr(x, 2 * i + 1, {2 * length})) AS h
  FROM (SELECT r, p, x, unnest(range(0, least(1000, greatest(length(x) // 2 - {length} + 1, 0)))) AS i FROM piece)
), hit AS (
  SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
), island AS (
  SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh FROM hit)
), span AS (
  SELECT r, min(i) AS s, max(i) + {length} AS e FROM island GROUP BY r, g
), cut AS (
  SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS kept_from FROM span
), per AS (
  SELECT r, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS tail,
    string_agg(substr(x, 2 * kept_from + 1, 2 * (s - kept_from)), '' ORDER BY s) AS kept
  FROM cut JOIN d USING (r) GROUP BY r
)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * tail + 1), x))) AS kept_sha256
FROM d LEFT JOIN per USING (r)
"""
