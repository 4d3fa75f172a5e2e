"""Repeated passages, against every window of every text."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from conftest import SMALL
from textlab.llm import repeats
from textlab.llm.registry import QUERIES, SQL


def brute(texts, length):
    """Per text the maximal runs of bytes covered by a window that starts more than once."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    return [repeats.merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]) for t in raw]


def check(spark, texts, length=64, **options):
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, n int").repartition(3)
    got = {r["doc_id"]: r for r in repeats.repeated_spans(frame, length, keep=True, **options).collect()}
    assert len(got) == len(texts)
    for i, (text, spans) in enumerate(zip(texts, brute(texts, length))):
        raw, r = (text or "").encode(), got[i]
        assert [(x["s"], x["e"]) for x in r["removed"]] == spans, i
        kept = bytes(b for j, b in enumerate(raw) if not any(s <= j < e for s, e in spans))
        assert (r["n_bytes"], bytes(r["kept"]), r["kept_sha256"]) == (len(raw), kept, hashlib.sha256(kept).hexdigest())
    return sum(len(r["removed"]) for r in got.values())


def mosaic(rng, n_texts, alphabet, sizes=(1, 200)):
    """Texts cut together from few sources, so that passages end and begin anywhere."""
    sources = ["".join(rng.choice(alphabet) for _ in range(600)) for _ in range(4)]
    out = []
    for _ in range(n_texts):
        parts = []
        for _ in range(rng.randrange(6)):
            s, n = rng.choice(sources), rng.randint(*sizes)
            at = rng.randrange(len(s) - n)
            parts.append(s[at : at + n] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(n)))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyzäß ", "ab"])
@pytest.mark.parametrize("max_group", [4_096, 3])
def test_against_all_windows(spark, alphabet, max_group):
    texts = mosaic(random.Random(len(alphabet)), 120, alphabet)
    assert check(spark, texts, max_group=max_group) > 30


@pytest.mark.parametrize("modulus", [4, 1000])
def test_short_and_long_phrases(spark, modulus):
    texts = mosaic(random.Random(modulus), 80, "abcdefgh ", (40, 160))
    assert check(spark, texts, modulus=modulus) > 20


def test_odd_texts(spark):
    long = "".join(random.Random(3).choice("abcdef ") for _ in range(3_000))
    texts = [None, "", "short", "a" * 63, "a" * 64, "a" * 65, "ab" * 500, "b" + "ab" * 40, long, long, long[:70], long[1_000:] + long[:1_200], long[5:69], "é" * 40]
    assert check(spark, texts) > 5


def test_repeated_rows_ids_and_empty(spark):
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(90))
    rows = [(None, text), (None, text), (4, text), (4, text + "!"), (4, None)]
    got = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id int, text string"), 64).collect()
    assert sorted((r["n_bytes"], [(x["s"], x["e"]) for x in r["removed"]]) for r in got) == [(0, []), *[(90, [(0, 90)])] * 3, (91, [(0, 90)])]
    assert sum(r["doc_id"] is None for r in got) == 2
    assert repeats.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(spark.createDataFrame(rows, "doc_id int, text string"), 63)


def test_a_passage_in_a_third_of_all_texts(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(100))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + passage * (i % 3 == 0) + str(i) for i in range(300)]
    assert check(spark, texts, max_group=16) == 100


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = con.execute(SQL["op11_prefix_free"])
    names = [d[0] for d in found.description]
    ours = QUERIES["op11_prefix_free"](spark, SMALL)
    assert sorted(ours.columns) == sorted(names)
    rows = sorted(tuple(r) for r in ours.select(names).collect())
    assert rows == sorted(found.fetchall()) and any(r[2] for r in rows)
