"""Keyword index, pairs within sentences and n-grams across texts, against plain loops."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from textlab.operators import corpus as C, search as I, terms as T
from textlab.sources.sinks import shared_dir


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    return docs, I.build_keyword_index(docs, ["doc_id"], shared_dir(spark, "test-index"), rows_per_part=1_500)


def test_rows_are_those_of_kwic(spark, indexed):
    docs, index = indexed
    words = ["tion", "the", "ther", "des", "neverseen", "un"]
    want = []
    for w in words:
        want += rows(C.kwic(docs, ["doc_id"], w))
    got = rows(I.keywords_in_context(docs, index, words))
    assert got == sorted(want) and {r[3] for r in got} == set(words) - {"neverseen"}
    assert I.keywords_in_context(docs, index, ["neverseen"]).count() == 0
    assert I.keywords_in_context(docs, index, []).columns == ["doc_id", "pos", "left", "keyword", "right"]


def test_only_files_of_the_words_are_read(spark, indexed):
    _, index = indexed
    assert len(index.ranges) > 20
    found = I.occurrences(spark, index, ["tion", "zz"])
    read = found.inputFiles()
    assert 0 < len(read) < len(spark.read.parquet(index.path).inputFiles()) / 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "")
    # a frequent word goes on over several parts
    assert len(index.parts_of(["the"])) > 1


def test_index_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b a"), (4, "A. b"), (5, "word " * 50_000 + "end")], "doc_id int, text string")
    index = I.build_keyword_index(docs, ["doc_id"], shared_dir(spark, "test-index"))
    assert rows(I.keywords_in_context(docs, index, ["a", "end"], 1)) == [(3, 0, "", "a", "b"), (3, 2, "b", "a", ""), (4, 0, "", "a", "b"), (5, 50_000, "word", "end", "")]
    empty = I.build_keyword_index(docs.limit(0), ["doc_id"], shared_dir(spark, "test-index"))
    assert I.keywords_in_context(docs.limit(0), empty, ["a"]).count() == 0


def test_pairs_of_sets(spark):
    rng = random.Random(2)
    listed = [[f"w{rng.randrange(n)}" for _ in range(n)] for n in (0, 1, 2, 5, 40, 200)] + [["a"], ["b", "a", "b"], None]
    want = Counter(p for words in listed if words for p in combinations(sorted(set(words)), 2))
    for tile in (3, 64):
        got = T.set_pairs(spark.createDataFrame([(w,) for w in listed], "words array<string>"), tile)
        assert {(r.word_a, r.word_b): r.n for r in got.collect()} == want


def test_a_sentence_of_50_000_words(spark):
    words = [f"w{i % 300:03}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, " ".join(words) + ". one two! two one? three… ")], "doc_id int, text string")
    sentences = T.sentence_rows(docs, ["doc_id"])
    listed = sentences.select(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)).alias("words"))
    tiles = T.set_pairs(listed)
    assert tiles.count() == 300 * 299 // 2 + 1
    assert tiles.where("word_a = 'one'").first().n == 2


def plain_ngrams(texts, sizes):
    out = Counter()
    for group in {g for g, _, _ in texts}:
        whole = [w for _, _, ws in sorted((t for t in texts if t[0] == group), key=lambda t: t[1]) for w in ws]
        for n in sizes:
            out.update((group, " ".join(whole[i : i + n]), n) for i in range(len(whole) - n + 1))
    return out


@pytest.mark.parametrize("slices", [1, 4, 37])
def test_ngrams_across_texts(spark, slices):
    rng = random.Random(slices)
    texts = [(g, i, [rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))]) for g in ("x", "y", "zz") for i in range(90 if g == "y" else 12)]
    frame = spark.createDataFrame(texts, "club string, doc_id int, words array<string>").repartition(3)
    for sizes in ((2, 3), (2, 5)):
        got = {(r.club, r.term, r.ngram_len): r.tf for r in T.cross_ngram_counts(frame, ["club"], ["doc_id"], sizes, slices).collect()}
        assert got == plain_ngrams(texts, sizes)


def test_no_window_holds_a_group(spark):
    frame = spark.createDataFrame([("x", 1, ["a", "b"])], "club string, doc_id int, words array<string>")
    plan = T.cross_ngram_counts(frame, ["club"], ["doc_id"], slices=3)._jdf.queryExecution().optimizedPlan().toString()
    keyed = [line for line in plan.splitlines() if re.search(r"\bWindow\b", line)]
    assert keyed and all(re.search(r"\], \[club#\d+, _slice#\d+\]", line) for line in keyed)
