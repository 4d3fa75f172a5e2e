import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from textlab.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


TERMS = ["abba", "cabbage", "cab", "abcabcabca", "caccabaca", "bbbbb"]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=12))
def test_automaton_is_edit_distance(word):
    near = [(distance(word, t), k) for k, t in enumerate(TERMS) if distance(word, t) <= T.allowed_edits(t)]
    assert T.FuzzyLexicon(TERMS).match(word) == (min(near) if near else None)


def test_misspelled_and_quoted():
    scanner = T.Scanner(T.Lexicon(["idiot", "worthless"], [0.9, 0.9], frozenset(["idiom"])))
    assert scanner.features("you are an idi0t, wort*hless")[3] == pytest.approx(np.log1p(2))
    assert scanner.features("an idiom")[3] == 0 and not scanner.features(None).any()
    used, quoted = scanner.features("he is an idiot again"), scanner.features('he wrote "idiot" again')
    assert quoted[0] < used[0] and quoted[1] > used[1] == 0


def planted(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}ord{i * 7919 % 1000}" for i in range(400)]
    bad = ["scoundrel", "blockhead", "vermin"]
    docs, labels = [], []
    for i in range(n):
        text, toxic = rng.choices(words, k=40), int(rng.random() < 0.25)
        if toxic:
            for b in rng.sample(bad, 2):
                text[rng.randrange(40)] = b
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return docs, labels


def test_learns_and_ignores_held_out_labels(spark):
    docs, labels = planted(600)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    flipped = [(i, 1 - t if i in held else t) for i, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    models = [T.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    assert models[0].lexicon == models[1].lexicon and np.array_equal(models[0].coefficients, models[1].coefficients)
    assert set(models[0].lexicon.terms) == {"scoundrel", "blockhead", "vermin"}
    scores = {r["doc_id"]: r["score"] for r in T.score(d, models[0]).collect()}
    assert np.mean([(scores[i] >= 0.3) == bool(t) for i, t in labels if i in held]) > 0.95
    new = spark.createDataFrame([(1, "such verminn and a blokhead here"), (2, "w1ord919 plain words")], "doc_id long, text string")
    assert [r["score"] >= 0.3 for r in T.score(new, models[0]).orderBy("doc_id").collect()] == [True, False]
    kept = T.keep_harmless(new.selectExpr("text", "doc_id", "doc_id as score"), models[0])
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == ["text", "doc_id", "score"]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "x", 0.5), (2, "", 0.5), (2, "", 0.5), (3, "word " * 60_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = T.fit(docs, none)
    assert {r["score"] for r in T.score(docs, model).collect()} == {0.0}
    one = T.fit(docs, spark.createDataFrame([(3, 1), (3, 1), (3, 0)], "doc_id long, toxic int"))
    rows = T.score(docs, one).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert T.score(docs.limit(0), one).count() == 0


def test_each_model_has_its_own_scorer(spark):
    """Equal terms and coefficients, other weights or look-alikes: other scores in the same workers."""
    weights = np.linspace(1.0, 2.0, T.N_FEATURES + 1)
    models = [T.Model(T.Lexicon(["idiot"], [w], frozenset(h)), weights) for w, h in ((0.1, []), (0.9, []), (0.1, ["idiots"]))]
    docs = spark.createDataFrame([(1, "you idiots"), (2, "an idiot")], "doc_id long, text string").repartition(1)
    for model in (*models, models[0]):
        want = T.scorer(model)(["you idiots", "an idiot"]).tolist()
        assert [r["score"] for r in T.score(docs, model).orderBy("doc_id").collect()] == pytest.approx(want, abs=1e-12)
    assert len({tuple(T.scorer(m)(["you idiots", "an idiot"]).tolist()) for m in models}) == 3
