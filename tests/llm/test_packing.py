import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from conftest import SMALL
from textlab.llm import packing
from textlab.llm.registry import op6_best_fit_packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(sizes, capacity, limit):
    """The same rule over a list of (free space, bin)."""
    open_bins, made, out = [], 0, []
    for size in sizes:
        fitting = [b for b in open_bins if b[0] >= size]
        if fitting:
            space = min(b[0] for b in fitting)
            chosen = [b for b in open_bins if b[0] == space][-1]
            open_bins.remove(chosen)
        else:
            if len(open_bins) >= limit:
                fullest = min(b[0] for b in open_bins)
                open_bins.remove([b for b in open_bins if b[0] == fullest][-1])
            chosen, made = (capacity, made), made + 1
        out.append((chosen[1], capacity - chosen[0]))
        if chosen[0] > size:
            open_bins.append((chosen[0] - size, chosen[1]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(1, 8))
def test_bins(sizes, limit):
    bins = packing.OpenBins(30, limit)
    assert [bins.put(s) for s in sizes] == plain_best_fit(sizes, 30, limit)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17])
def test_pieces(n):
    got = packing.pieces_of(n, 8)
    assert sum(length for _, length in got) == n and all(length == 8 for _, length in got[1:])
    assert [start for start, _ in got] == [sum(length for _, length in got[:i]) for i in range(len(got))]


def test_ranks_give_the_library_ids():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    encode = packing.byte_level_encoder(VOCABULARY)
    texts = ["", "<|endoftext|> it's we'LL  \n\n x\t", *(f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(1, 0x3000))]
    for text in texts:
        assert list(encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check_sequences(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op6_best_fit_packing(spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    total = 0
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in pieces] == packing.pieces_of(len(ids), 2048)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes())
    assert check_sequences(rows, 2048) <= 1.02 * total / 2048 + 1


def test_parts_cost_little(spark):
    rng = random.Random(5)
    pieces = [(i, min(2048, int(rng.lognormvariate(6, 1.2)) + 1)) for i in range(6000)]
    frame = spark.createDataFrame(pieces, "doc_id long, length long")
    rows = packing.best_fit(frame, 2048, 512, 1500).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted(pieces)
    assert check_sequences(rows, 2048) <= 1.02 * sum(n for _, n in pieces) / 2048 + 1


@pytest.mark.parametrize("n, open_bins, most", [(6_000, 256, 1.03), (200_000, 16_384, 1.005)])
def test_no_sequence_closes_early(spark, n, open_bins, most):
    """More bins than may be open at once, with the default part size: several full parts."""
    rng = np.random.default_rng(3)
    sizes = np.minimum(2047, np.exp(rng.normal(6.9, 0.8, n)).astype(int) + 1)
    frame = spark.createDataFrame(list(enumerate(sizes.tolist())), "doc_id long, length long")
    rows = packing.best_fit(frame, 2048, open_bins).select("sequence_id", "offset", "length", "doc_id").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    unbounded = packing.OpenBins(2048, n)
    for size in sorted(sizes.tolist(), reverse=True):
        unbounded.put(size)
    assert check_sequences(rows, 2048) <= most * unbounded.made


def test_edge_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "x", 5), (2, "", 5), (3, "word " * 30_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    got = packing.pack(docs, VOCABULARY).collect()
    assert sorted(r["length"] for r in got if r["doc_id"] in (1, 2)) == [1, 1, 1]
    assert len(got) == 4 + len({r["start"] for r in got if r["doc_id"] == 3})
    check_sequences(got, 2048)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
