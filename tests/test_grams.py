"""Counts of grams with few numbered words, against plain loops, and what their shuffles carry."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textlab.operators import grams, terms as T, topics as L

RNG = random.Random(5)
TEXTS = [(i, RNG.choice(["s", None, "t"]), RNG.choice("xyz"), [f"{'ąbz'[k % 3]}{k}" for k in (int(RNG.paretovariate(0.6)) % 40 for _ in range(RNG.randrange(12)))]) for i in range(300)]
TEXTS += [(500, "s", "x", None), (501, "s", "x", []), (502, "t", "y", ["b" * 90, "b" * 90, "a", "b" * 90])]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, source string, club string, words array<string>").repartition(3).cache()


@pytest.mark.parametrize("numbered", [0, 7, 1_000])
def test_counts_with_few_and_all_words_numbered(listed, numbered):
    num = grams.numbered(listed, numbered)
    got = grams.with_terms(grams.ngrams(num, ["source", "club"], (1, 2, 3, 4), texts=True), num)
    tf, df = Counter(), Counter()
    for _, source, club, words in TEXTS:
        own = [(source, club, " ".join(words[i : i + n]), n) for n in (1, 2, 3, 4) for i in range(len(words or []) - n + 1)]
        tf.update(own)
        df.update(set(own))
    assert {(r.source, r.club, r.term, r.ngram_len): (r.df, r.tf) for r in got.collect()} == {k: (df[k], tf[k]) for k in tf}
    near = Counter(tuple(sorted(p)) for *_, w in TEXTS for d in (1, 2) for p in zip(w or [], (w or [])[d:]) if p[0] != p[1])
    got = grams.with_pairs(grams.near_pairs(num, 2), num)
    assert {(r.word_a, r.word_b): r.tf for r in got.collect()} == near
    both = Counter(p for *_, w in TEXTS for p in combinations(sorted(set(w or [])), 2))
    for held in (5, 1 << 18):
        got = grams.with_pairs(grams.row_pairs(num, held), num)
        assert {(r.word_a, r.word_b): r.tf for r in got.collect()} == both


def test_top_ngrams_are_those_of_all_counts(listed):
    docs = listed.select("source", "club")
    counts = T.ngram_counts(listed, ["source", "club"])
    want = T.tfidf_top(counts, docs, "source", "club", 1, 1.0, 30, 4, ngram_len=True).collect()
    assert want and sorted(map(str, T.tfidf_top_ngrams(listed, docs, "source", "club", 1, 1.0, 30, 4).collect())) == sorted(map(str, want))


def test_words_and_bigrams_of_a_vocabulary(listed):
    want = L.gram_vocabulary(L.grams_of(listed, ["source"]), "source", 2, 0.9, 25).collect()
    assert want and sorted(map(str, L.word_vocabulary(listed, "source", 2, 0.9, 25).collect())) == sorted(map(str, want))


def test_shuffles_carry_numbers(listed):
    """The aggregates of all n-grams hold no term (they held each n-gram as its text before)."""
    found = T.tfidf_top_ngrams(listed, listed, "source", "club", 1, 1.0, 30, 4)
    pairs = T.cooccurrence(listed)
    for df in (found, pairs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [gram#" in plan
    assert pairs.select(F.sum("n")).first()[0] > 0


def test_ngrams_with_a_rare_part_are_not_counted(listed, monkeypatch):
    """Vocabularies count a longer n-gram only where its parts may still reach them."""
    import numpy as np

    seen, count = [], grams.ngrams
    monkeypatch.setattr(grams, "ngrams", lambda *a, **b: seen.append(count(*a, **b)) or seen[-1])
    for max_words in (0, 5, 1_000):
        monkeypatch.setattr(grams, "numbered", lambda df, f=grams.Numbered, n=max_words, g=NUMBERED: g(df, n))
        want = T.tfidf_top(T.ngram_counts(listed, ["source", "club"]), listed, "source", "club", 2, 0.9, 12, 5, ngram_len=True).collect()
        seen.clear()
        found = T.tfidf_top_ngrams(listed, listed, "source", "club", 2, 0.9, 12, 5).collect()
        assert want and sorted(map(str, found)) == sorted(map(str, want))
        counted = [df.agg(F.sum("tf")).first()[0] for df in seen[:3]]
        every = sum(max(len(w or []) - 2, 0) for *_, w in TEXTS)
        assert counted[2] < every
    num = NUMBERED(listed, 1_000)
    few = grams.Parts(np.sort([(int(num.known.index(w).as_py()) + 1) << 42 for w in num.known.to_pylist()[:2]]), num.known.slice(0, 0))
    two = set(num.known.to_pylist()[:2])
    got = grams.with_terms(grams.ngrams(num, [], (2,), within={1: few}), num)
    want = Counter(f"{a} {b}" for *_, w in TEXTS for a, b in zip(w or [], (w or [])[1:]) if {a, b} <= two)
    assert {r.term: r.tf for r in got.collect()} == want


NUMBERED = grams.numbered


def test_pairs_of_rare_words_are_not_made(listed, monkeypatch):
    """Words of fewer than ``min_rows`` rows make no pairs; they were made and left out after the shuffle before."""
    words_in = Counter(w for *_, ws in TEXTS for w in set(ws or []))
    both = Counter(p for *_, w in TEXTS for p in combinations(sorted(set(w or [])), 2))
    made, together = [], grams._together
    monkeypatch.setattr(grams, "_together", lambda held, among=None: made.append(among) or together(held, among))
    for max_words in (0, 7, 1_000):
        num = NUMBERED(listed, max_words)
        got = grams.with_pairs(grams.row_pairs(num, 5, 12), num)
        assert {(r.word_a, r.word_b): r.tf for r in got.collect()} == {p: n for p, n in both.items() if n >= 12}
        assert len(made[-1].numbers) + len(made[-1].texts) == sum(n >= 12 for n in words_in.values()) < len(words_in)
