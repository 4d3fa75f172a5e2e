"""Byte-level BPE as a monoid: halves are encoded apart and joined around their border."""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textlab.llm.common import slices, worker_state


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Recent(dict):
    """A bounded memo: what was asked for since the last turnover stays, in two generations."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def recall(self, key):
        """Value of a key of the older generation, which becomes a young one; or None."""
        value = self.old.get(key)
        return None if value is None else self.keep(key, value)

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class TreeCodec:
    """Encoder and decoder of one rank file.

    The merge rule joins, again and again, the leftmost neighbours of least rank. Under it any
    run of tokens of an encoding is the encoding of its own bytes, and a sequence in which
    every two neighbours encode to themselves is the encoding of the whole. So two encoded
    halves are joined by encoding a window around the border anew: if its first and last
    token come out as they were, every pair of neighbours is proved, and all tokens outside
    stand. Else the window grows on the side that changed.
    """

    LEAF = 16
    CACHE = 150_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.own = list(range(len(self.bytes_of)))  # one object per id, whatever is kept
        self.split = regex.compile(pattern).findall
        self.seen = Recent(self.CACHE)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a short run of bytes by the merge rule itself."""
        n = len(data)
        if n > 64:
            return self._merge_long(data)
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(n)]
        costs = [rank(data[i : i + 2], none) for i in range(n - 1)]
        while costs:
            least = min(costs)
            if least == none:
                break
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.own[rank(p)] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs and linked parts."""
        n, rank = len(data), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
        before = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.own[rank(data[i : end[i]])])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation from the encodings of its two parts."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            window = left[-i:] + right[:j]
            new = self.merge(b"".join([self.bytes_of[t] for t in window]))
            left_holds = i == len(left) or new[0] == window[0]
            right_holds = j == len(right) or new[-1] == window[-1]
            if left_holds and right_holds:
                return left[:-i] + new + right[j:]
            if not left_holds:
                i = min(2 * i, len(left))
            if not right_holds:
                j = min(2 * j, len(right))

    def tree(self, data: bytes) -> list[int]:
        """Tokens of a run of bytes, by halves."""
        if len(data) <= self.LEAF:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.tree(data[:mid]), self.tree(data[mid:]))

    def piece(self, text: str) -> tuple[tuple[int, ...], str]:
        """Ids of one match of the pattern, and the same as decimals; a token of its own is one id."""
        found = self.seen.recall(text)
        if found:
            return found
        data = text.encode()
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(self.tree(data))
        found = ids, ",".join(map(str, ids))
        return self.seen.keep(text, found) if len(text) <= 64 else found

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        seen = self.seen.get
        return [seen(p) or self.piece(p) for p in self.split(text)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up a tree."""
        if len(ids) <= 1024:
            return b"".join([self.bytes_of[t] for t in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids and of the decoded bytes.

    A null text counts as empty (no tokens); repeated rows give repeated results; a null id stays
    null. Other columns are not read. An empty table gives none.
    """

    def run(batches):
        codec = worker_state("codec", f"{path}\n{pattern}", lambda: TreeCodec(load_ranks(path), pattern))
        for batch in slices(batches):
            counts, shas, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                pieces = codec.pieces(text or "")
                ids = list(chain.from_iterable([ids for ids, _ in pieces]))
                counts.append(len(ids))
                shas.append(hashlib.sha256(",".join([names for _, names in pieces]).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
