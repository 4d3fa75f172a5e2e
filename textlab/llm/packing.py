"""Documents packed into sequences of a fixed length by bounded-space best fit."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from textlab.llm.common import slices, worker_state
from textlab.sources.sinks import materialise


class OpenBins:
    """At most ``limit`` open bins, kept by free space; a bitset tells which spaces occur.

    An item goes to the bin with the least space that holds it, else into a new one. With
    ``limit`` bins open the fullest closes first. A full bin closes at once.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces = 0  # bit s: a bin with s free places is open
        self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of an item."""
        fitting = self.spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        if space > size:
            self.by_space[space - size].append(number)
            self.spaces |= 1 << (space - size)
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return number


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def byte_level_encoder(vocabulary: str):
    """Function from a text to its ids under a byte-level BPE file of the tokenizers library.

    Where the file has no normaliser and its ids follow the order of its merges, the same ids
    come several times faster from the ranks; any other file is left to the library.
    """
    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    letters = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}
    special = {t["content"] for t in file.get("added_tokens", ())}
    tokens = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    in_order = len(tokens) == 256 + len(merged) and all(tokens.get(t) == 256 + k for k, t in enumerate(merged))
    if plain and in_order and not file.get("normalizer") and not model.get("ignore_merges"):
        ranks = {bytes(byte_of[c] for c in t): i for t, i in tokens.items()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row, without the ids."""

    def run(batches):
        encode = worker_state("encoder", vocabulary, lambda: byte_level_encoder(vocabulary))
        for batch in slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = [*encode(text or ""), end_id]
                data = memoryview(np.array(ids, dtype="<u4").tobytes())
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    rows.append((k, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            k, piece, start, length, crc = (list(c) for c in zip(*rows))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [batch.column(0).take(pa.array(k)), *map(pa.array, (piece, start, length, crc), kinds)]
            yield pa.record_batch(columns, [id_col, "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(pieces: DataFrame, capacity: int, open_bins: int = 16_384, pieces_per_part: int = 250_000) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in one sequence, without gaps.

    Short pieces are dealt by a hash of all their columns to parts, each packed alone, the
    longest first; pieces that fill a sequence need no part. A part has at most about
    ``pieces_per_part`` pieces and so few tokens that its sequences stay open until they are
    full: best fit leaves at most one of them under half full, so twice the part's tokens over
    ``capacity`` bounds their number. A part leaves sequences with free space only at its end,
    so the number of parts costs little. ``pieces`` must be a written table: then a repeated
    task gives the same numbers.
    """
    columns = pieces.columns
    short = pieces.where(F.col("length") < capacity)
    counts, tokens = short.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    # a tenth is left for parts that the hash makes larger than others
    bins = min(counts, -(-2 * tokens // capacity))
    parts = max(1, -(-counts // pieces_per_part), -(-10 * bins // (9 * open_bins)))
    dealt = (
        short.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int"))
        .repartition(parts, "_part")
        .sortWithinPartitions("_part", F.desc("length"), *[c for c in columns if c != "length"])
    )
    at_part, at_length = dealt.columns.index("_part"), columns.index("length")

    def run(batches):
        part, bins = None, None
        for batch in batches:
            numbers, offsets = [], []
            for p, n in zip(batch.column(at_part).to_pylist(), batch.column(at_length).to_pylist()):
                if p != part:
                    part, bins = p, OpenBins(capacity, open_bins)
                number, offset = bins.put(n)
                numbers.append(number * parts + p)
                offsets.append(offset)
            kept = batch.select(columns)
            yield pa.record_batch([*kept.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    packed = dealt.mapInArrow(run, schema)
    # full pieces: negative numbers, one each
    full = pieces.where(F.col("length") >= capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 16_384) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    Every row of ``docs`` is one document: its ids, then ``end_id``. A null text counts as
    empty (one piece of one id); a null doc_id stays null; repeated rows are packed each
    on its own. Other columns are not read. An empty table gives none.
    """
    pieces = materialise(tokenized(docs, vocabulary, end_id, capacity), "pieces")
    return best_fit(pieces, capacity, open_bins)
