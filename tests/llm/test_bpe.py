import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from conftest import SMALL
from textlab.llm.bpe import TreeCodec, encode, load_ranks
from textlab.llm.registry import op4_bpe_tree

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codecs():
    ranks = load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return TreeCodec(ranks, public_tokenizers.PATTERN), library


def plain(data, ranks):
    """The merge rule word for word."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab", min_size=2, max_size=5), max_size=25, unique=True), st.text("ab", max_size=150))
def test_tree_follows_the_merge_rule(merges, text):
    codec = TreeCodec({t.encode(): i for i, t in enumerate(["a", "b", *merges])}, ".+")
    codec.LEAF = 3
    data = text.encode()
    assert codec.tree(data) == codec.merge(data) == codec._merge_long(data) == plain(data, codec.ranks)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_library(codecs, text):
    codec, library = codecs
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_pieces(codecs):
    codec, library = codecs
    rng = random.Random(1)
    for text in ("a" * 5_000, "ab" * 4_000, " " * 3_000, "日本" * 2_000, "".join(rng.choices("etaoin", k=9_000))):
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_memo_turnover(codecs):
    codec = TreeCodec(codecs[0].ranks, public_tokenizers.PATTERN)
    codec.seen.limit = 7
    text = " ".join(f"w{i % 13}x{i % 5}" for i in range(300))
    assert codec.encode(text) == codecs[1].encode_ordinary(text)
    assert len(codec.seen) <= 7 and len(codec.seen.old) <= 7


def test_query(spark, codecs):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op4_bpe_tree(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = codecs[1].encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (None, "x", 2), (2, "", 2), (3, "long " * 50_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in encode(docs, PATH, public_tokenizers.PATTERN).collect())
    assert got[:4] == [(-1, 1), (1, 0), (1, 0), (2, 0)] and got[4][1] >= 50_000
    assert encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
