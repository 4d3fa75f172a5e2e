"""Operators against hand-worked rows and brute force."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textlab.operators import corpus as C, extras as K, landing as B, metrics as G, report as J, roster as H, rows as W
from textlab.operators import joins, stats as S, terms as T, topics as L
from textlab.operators.names import name_variants


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_weights_count_unknown_authors(spark):
    details = spark.createDataFrame(
        [(1, ["1", "2", "3"], None, "a"), (2, [], None, "b"), (3, ["x", "2"], None, "c")],
        "num int, `from` array<string>, sentDate date, text string",
    )
    members = spark.createDataFrame([(1, "A"), (2, "B"), (4, None), (3, "")], "mp_id bigint, club string")
    got = rows(C.written_rows(details, members).select("doc_id", "mp_id", "weight"))
    assert got == [("interp_1", 1, 1 / 3), ("interp_1", 2, 1 / 3), ("interp_3", 2, 0.5)]


def test_lexicon_and_sentiment(spark):
    lex = C.lexicon(spark.createDataFrame([("dobry", 1.0), ("Dobry", 3.0), ("zły", -1.0)], "word string, val double"))
    assert rows(lex) == [("dobry", 2.0), ("zły", -1.0)]
    docs = spark.createDataFrame(
        [(1, "Dobry dobry xyz"), (2, "nic tu"), (3, ""), (4, "dobry zły zły")], "doc_id int, text string"
    )
    got = dict(rows(C.doc_sentiment(docs, ["doc_id"], lex)))
    assert got == pytest.approx({1: 2.0, 2: 0.0, 3: 0.0, 4: 0.0})
    full = C.doc_metrics(docs, ["doc_id"], lex).select("doc_id", "sentiment", "word_count")
    assert rows(full) == [(1, 2.0, 3), (2, 0.0, 2), (3, 0.0, 0), (4, 0.0, 3)]


def test_stopwords_and_names_score_nothing(spark):
    lex = spark.createDataFrame([("klub", 5.0), ("tuska", 5.0), ("pracą", 2.0)], "token string, val double")
    names = name_variants((spark.createDataFrame([("Donald Tusk",)], "n string"), "n"))
    docs = spark.createDataFrame([(1, "Klub Tuska pracą")], "doc_id int, text string")
    assert C.doc_sentiment(docs, ["doc_id"], lex, names=names).first()["sentiment"] == 2.0
    kept = C.doc_tokens(docs, ["doc_id"], names=names)
    assert [(r.pos, r.token) for r in kept.collect()] == [(2, "pracą")]


def test_name_variants(spark):
    names = {
        r[0]
        for r in name_variants(
            (spark.createDataFrame([("Paweł Wiśniewski-Nowak",), ("Li Bo",)], "n string"), "n"), extra=()
        ).collect()
    }
    assert {"paweł", "pawel", "pawłowi", "pawlowi", "nowakowi", "wiśniewska", "wisniewskich", "wiśniewscy"} <= names
    assert "li" not in names and "bo" not in names


def test_idf_and_unit_norm(spark):
    assert spark.range(1).select(T.idf(F.lit(10), F.lit(5))).first()[0] == pytest.approx(math.log(11 / 6) + 1)
    docs = spark.createDataFrame(
        [("s", "a", "kot pies kot"), ("s", "b", "kot dom"), ("s", "c", "pies las")],
        "source string, club string, text string",
    )
    counts = T.term_counts(docs, ["source", "club"], stopwords=())
    scores = T.tfidf_top(counts, docs, "source", "club", 1, 1.0, 100, 5, scores_only=True)
    norms = scores.groupBy("club").agg(F.sum(F.col("score") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0) for r in norms)
    top = T.tfidf_top(counts, docs, "source", "club", 1, 1.0, 100, 1)
    assert {r.group: r.term for r in top.collect()} == {"a": "kot", "b": "dom", "c": "las"}


def test_vocabulary_bound_is_by_total_then_term(spark):
    counts = spark.createDataFrame(
        [("s", c, t, n) for c in "ab" for t, n in (("x", 5), ("y", 3), ("z", 3), ("w", 1))],
        "source string, club string, term string, tf bigint",
    )
    docs = counts.select("source", "club").distinct()
    kept = T.tfidf_top(counts, docs, "source", "club", 1, 1.0, 2, 9, scores_only=True)
    assert {r.term for r in kept.collect()} == {"x", "y"}


def test_no_term_left_gives_an_empty_table(spark):
    docs = spark.createDataFrame([("s", "a", "kot")], "source string, club string, text string")
    counts = T.term_counts(docs, ["source", "club"], stopwords=())
    assert T.tfidf_top(counts, docs, "source", "club", 5, 0.6, 10, 3).count() == 0


def test_ngrams_stay_inside_a_text(spark):
    docs = spark.createDataFrame(
        [(1, "s", "a", "jeden dwa trzy"), (2, "s", "a", "cztery")], "doc_id int, source string, club string, text string"
    )
    listed = C.lemma_arrays(docs, ["doc_id", "source", "club"], stopwords=())
    got = {(r.term, r.ngram_len) for r in T.ngram_counts(listed, ["source", "club"]).collect()}
    assert got == {("jeden dwa", 2), ("dwa trzy", 2), ("jeden dwa trzy", 3)}


def test_ngrams_across_texts_are_those_of_the_joined_text(spark):
    rng = random.Random(2)
    texts = [(i, "ab"[rng.random() < 0.4], [f"w{rng.randrange(6)}" for _ in range(rng.randrange(4))]) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id int, club string, words array<string>")
    want = {}
    for club in "ab":
        whole = [w for _, c, ws in texts if c == club for w in ws]
        for n in (2, 3):
            for i in range(len(whole) - n + 1):
                key = club, " ".join(whole[i : i + n]), n
                want[key] = want.get(key, 0) + 1
    got = T.cross_ngram_counts(df, ["club"], ["doc_id"])
    assert {(r.club, r.term, r.ngram_len): r.tf for r in got.collect()} == want


def test_two_authors_of_one_club_are_two_rows(spark):
    details = spark.createDataFrame(
        [(7, ["1", "2"], None, "kot pies kot")], "num int, `from` array<string>, sentDate date, text string"
    )
    members = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "mp_id bigint, club string")
    lex = spark.createDataFrame([("kot", 1.0)], "token string, val double")
    texts, authors = C.written_texts(details), C.written_authors(details, members)
    assert texts.count() == 1
    got = C.corpus_metrics(texts, authors, lex, stopwords=())
    assert rows(got.select("mp_id", "club", "weight", "sentiment", "word_count")) == [(1, "A", 0.5, 1.0, 3), (2, "A", 0.5, 1.0, 3)]
    same = C.corpus(C.written_rows(details, members))
    assert C.doc_metrics(same, ["doc_id", "club", "source", "weight"], lex).count() == 2
    counts = T.term_counts(texts, ["doc_id"], stopwords=())
    assert rows(C.author_counts(counts, authors, ["club"]))[0] == ("A", "kot", 4)
    assert rows(C.author_counts(counts, authors, ["club"], per_author=False))[0] == ("A", "kot", 2)


def test_only_delivered_statements_count(spark):
    index = spark.createDataFrame([(1, 1, None, i, u) for i, u in enumerate([False, True, None])], "memberID bigint, proceedingNum int, date string, statementNum int, unspoken boolean")
    index = index.withColumn("date", F.lit("2024-01-01"))
    texts = index.selectExpr("memberID as mp_id", "proceedingNum", "date", "statementNum", "'x' as text")
    members = spark.createDataFrame([(1, "A")], "mp_id bigint, club string")
    assert [r.doc_id for r in C.spoken_rows(index, members, texts).collect()] == ["trans_1_0"]


def test_kwic_and_cooccurrence(spark):
    docs = spark.createDataFrame([(1, "a b Kot c d e"), (2, "kot"), (3, ""), (4, None), (5, "kot kot kotek")], "doc_id int, text string")
    got = rows(C.kwic(docs, ["doc_id"], "kot", 2))
    assert got == [(1, 2, "a b", "kot", "c d"), (2, 0, "", "kot", ""), (5, 0, "", "kot", "kot kotek"), (5, 1, "kot", "kot", "kotek")]
    listed = spark.createDataFrame([(["a", "b", "a", "c"],), ([],), (["a"],)], "words array<string>")
    assert rows(T.cooccurrence(listed, 2)) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_planted_topics_separate(spark):
    rng = random.Random(9)
    themes = [[f"{a}{i}" for i in range(12)] for a in ("kot", "las", "rok")]
    docs = [(i, "s", f"g{i % 3}", rng.choices(themes[i % 3], k=30)) for i in range(240)]
    grams = spark.createDataFrame(docs, "doc_id int, source string, club string, grams array<string>")
    vocabulary = spark.createDataFrame([("s", w, 9) for theme in themes for w in theme], "source string, term string, total int")
    fit = L.fit_topics(grams, vocabulary, "source", "club", k=3, iterations=40)
    found = {r.topic: {x.term[:3] for x in fit.topics.where(F.col("topic") == r.topic).where("rank <= 10").collect()} for r in fit.topics.select("topic").distinct().collect()}
    assert sorted(map(len, found.values())) == [1, 1, 1] and len(set.union(*found.values())) == 3
    best = {r.club: r.p for r in fit.mix.groupBy("club").agg(F.max("proportion").alias("p")).collect()}
    assert all(p > 0.8 for p in best.values())


def test_cosine_and_plane_of_groups(spark):
    vectors = {"a": {"x": 0.6, "y": 0.8}, "b": {"z": 1.0}, "c": {"x": 1.0}, "d": {"x": 0.8, "z": 0.6}}
    df = spark.createDataFrame([("s", g, t, v) for g, ts in vectors.items() for t, v in ts.items()] + [("t", "a", "x", 1.0)], "source string, club string, term string, score double")
    cosine = {(r.club, r.other): r.cosine for r in K.pairwise_cosine(df, "source", "club").collect()}
    assert len(cosine) == 6 and cosine["a", "b"] == 0.0 and cosine["a", "c"] == pytest.approx(0.6)
    at = {(r.source, r.club): (r.pc1, r.pc2) for r in K.group_pca(df, "source", "club").collect()}
    assert at["t", "a"] == (0.0, 0.0)
    matrix = np.array([[vectors[g].get(t, 0.0) for t in "xyz"] for g in "abcd"])
    u, s, _ = np.linalg.svd(matrix - matrix.mean(0))
    want = u[:, :2] * s[:2]
    got = np.array([at["s", g] for g in "abcd"])
    assert np.allclose(np.abs(got), np.abs(want)) and np.allclose(got.mean(0), 0)
    assert all(got[np.abs(got[:, i]).argmax(), i] > 0 for i in range(2))


def svd_plane(matrix):
    u, s, _ = np.linalg.svd(matrix - matrix.mean(0), full_matrices=False)
    want = u[:, :2] * s[:2]
    return want * np.where(want[np.abs(want).argmax(0), range(2)] < 0, -1, 1)


def test_plane_of_more_groups_than_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((70, 40)) * 0.9 ** np.arange(40) * (rng.random((70, 40)) < 0.6)
    cells = [("s", f"g{i:03}", f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    df = spark.createDataFrame(cells + [("t", f"g{i}", "one", 1.0) for i in range(3)], "source string, club string, term string, score double")
    at = {(r.source, r.club): (r.pc1, r.pc2) for r in K.group_pca(df, "source", "club", block=8).collect()}
    assert np.allclose([at["s", f"g{i:03}"] for i in range(70)], svd_plane(x), atol=1e-5)
    assert [at["t", f"g{i}"] for i in range(3)] == [(0.0, 0.0)] * 3


def test_plane_of_50_000_groups(spark):
    n = 50_000
    base = spark.range(n).select(F.concat(F.lit("g"), "id").alias("club"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    cells = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), v.alias("score")) for t, v in (("x", F.col("a") * 9), ("y", F.col("b") * 4), ("z", F.col("c") * 0.1)))))
    df = base.select(F.lit("s").alias("source"), "club", cells.alias("t")).select("source", "club", "t.term", "t.score").cache()
    got = {r.club: (r.pc1, r.pc2) for r in K.group_pca(df, "source", "club", block=4).collect()}
    rows = {r.club: (r.a * 9, r.b * 4, r.c * 0.1) for r in base.collect()}
    names = sorted(rows)
    assert np.allclose([got[g] for g in names], svd_plane(np.array([rows[g] for g in names])), atol=1e-5)


def test_log_odds(spark):
    counts = spark.createDataFrame(
        [("s", "A", "x", 3), ("s", "B", "y", 1), ("s", "C", "z", 9), ("only", "A", "x", 3)],
        "source string, club string, term string, tf bigint",
    )
    odds = T.log_odds(counts, "source", "club", {"a": ["A"], "b": ["B"]}, min_count=1)
    got = {(r.source, r.term, r.group): r.log_odds for r in odds.collect()}
    assert got == pytest.approx(
        {
            ("s", "x", "a"): math.log((4 / 5) / (1 / 3)),
            ("s", "y", "a"): math.log((1 / 5) / (2 / 3)),
            ("s", "x", "b"): -math.log((4 / 5) / (1 / 3)),
            ("s", "y", "b"): -math.log((1 / 5) / (2 / 3)),
        }
    )
    assert T.log_odds(counts, "source", "club", {"a": ["A"], "b": ["B"]}, min_count=2).count() == 0


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "single", "hot"])
def test_quantiles_match_numpy(spark, kind):
    rng = random.Random(7)
    draw = {
        "normal": lambda: rng.gauss(0, 3),
        "heavy": lambda: math.exp(rng.gauss(0, 4)) * rng.choice((-1, 1)),
        "ties": lambda: float(rng.randint(0, 3)),
        "single": lambda: 2.5,
        "hot": lambda: 1.0 if rng.random() < 0.9 else rng.random() * 1e9,
    }[kind]
    data = [("big" if i % 7 else "small", draw()) for i in range(3000)] + [("one", draw())]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(data, "g string, x double")
    got = {(r.g, r.prob): r.quantile for r in S.grouped_quantiles(df, ["g"], "x", probs).collect()}
    for g in ("big", "small", "one"):
        values = [x for k, x in data if k == g]
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_style_metrics(spark):
    df = spark.createDataFrame(
        [("a", "s", 1.0, 1.0, 10.0, 4), ("a", "s", 0.5, 4.0, 20.0, 8), ("b", "s", 1.0, 2.0, 5.0, 3)],
        "club string, source string, weight double, sentiment double, fog_index double, word_count int",
    )
    row = {r.club: r for r in G.style_metrics(df, ["club", "source"]).collect()}["a"]
    assert row.n_docs == 2 and row.sentiment_mean == pytest.approx(2.0) and row.sentiment_median == 2.5
    assert row.sentiment_std == pytest.approx(1.5) and row.fog_p25 == 12.5 and row.fog_p75 == 17.5
    assert row.words_mean == pytest.approx(8 / 1.5) and row.words_median == 6.0


def test_pivot_delta_is_null_without_both(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 1.0)], "club string, source string, v double")
    assert rows(G.pivot_channels(df, "club", "source", "v", "x", "y", "delta")) == [("a", 1.0, 3.0, 2.0), ("b", 1.0, None, None)]


def test_rank_ties(spark):
    df = spark.createDataFrame([("t", w, s) for w, s in (("a", 3), ("b", 2), ("c", 2), ("d", 1))], "k string, w string, s int")
    assert J.first_rows_with_ties(df, ["k"], "s", 2).count() == 3
    assert [r.w for r in J.first_rows(df, ["k"], "s", "w", 2).orderBy("w").collect()] == ["a", "b"]


def test_topic_labels(spark):
    df = spark.createDataFrame([("s", 1, f"t{i}", i) for i in (5, 3, 1, 2, 4)], "source string, topic int, term string, rank int")
    assert L.topic_labels(df).first().label == "t1, t2, t3, t4"


def test_topic_fit_invariants(spark):
    docs = spark.createDataFrame(
        [(i, "s", "ab"[i % 2], ("kot pies mysz " if i % 2 else "dom las pole ") * 4) for i in range(40)] + [(99, "s", "a", "")],
        "doc_id int, source string, club string, text string",
    )
    keys = ["doc_id", "club", "source"]
    grams = L.gram_arrays(docs, keys, stopwords=())
    vocabulary = spark.createDataFrame([("s", w, 9) for w in ("kot", "pies", "dom", "las")], "source string, term string, total int")
    fit = L.fit_topics(grams, vocabulary, "source", "club", k=2, iterations=4)
    shares = fit.mix.groupBy("club").agg(F.sum("proportion").alias("p")).collect()
    assert all(r.p == pytest.approx(1.0) for r in shares) and len(shares) == 2
    assert fit.topics.count() == 8 and fit.topics.where("weight <= 0").count() == 0


def test_gram_arrays_agree_with_and_without_names(spark):
    docs = spark.createDataFrame([(1, "jeden dwa trzy"), (2, ""), (3, "nazwisko")], "doc_id int, text string")
    names = spark.createDataFrame([("nazwisko",)], "name string")
    plain = {r.doc_id: r.grams for r in L.gram_arrays(docs, ["doc_id"], stopwords=()).collect()}
    joined = {r.doc_id: r.grams for r in L.gram_arrays(docs, ["doc_id"], stopwords=(), names=names).collect()}
    assert plain[1] == joined[1] == ["jeden", "dwa", "trzy", "jeden dwa", "dwa trzy"]
    assert plain[2] == joined[2] == [] and joined[3] == []


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_lookup_join_is_the_same_beyond_the_bound(spark, how):
    rng = random.Random(3)
    left = spark.createDataFrame([(0 if rng.random() < 0.5 else rng.randint(1, 40), i) for i in range(500)], "k int, i int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40, 2)], "k int, v string")
    small = joins.lookup_join(left, right, ["k"], how)
    salted = joins.lookup_join(left, right, ["k"], how, max_rows=5)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, small.collect()), key=key) == sorted(map(tuple, salted.select(small.columns).collect()), key=key)


def test_top_k_is_exact_on_a_hot_group(spark):
    rng = random.Random(5)
    data = [("hot" if i % 3 else "cold", f"t{i}", rng.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, term string, n int")
    got = rows(joins.top_k(df, ["g"], [F.desc("n"), F.asc("term")], 25, ["term"], salts=8))
    expected = []
    for g in ("hot", "cold"):
        expected += sorted([d for d in data if d[0] == g], key=lambda d: (-d[2], d[1]))[:25]
    assert got == sorted(expected)


def test_row_ids_follow_the_key(spark):
    keys = list(range(0, 900, 3))
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert rows(W.with_row_id(df, "k", parts=7).select("k", "id")) == [(3 * i, i) for i in range(300)]
    assert W.with_row_id(df.limit(0), "k").count() == 0


def test_attach_ordered_checks_the_length(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert rows(W.attach_ordered(df, "k", ["a", "b", "c"], "v")) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        W.attach_ordered(df, "k", ["a"], "v")


def test_key_difference(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(W.key_difference(a, b, "k")) == [("x", "left"), ("z", "right")]


def test_overrides_and_places(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id int, c string, n int")
    fixes = spark.createDataFrame([(2, "c", "z"), (2, "n", "9")], "id int, column string, value string")
    assert rows(H.apply_overrides(df, fixes, "id")) == [(1, "a", 5), (2, "z", 9)]
    members = spark.createDataFrame([(1, "Łódź"), (2, " "), (3, "Kraków")], "id int, miejsceUr string")
    cache = spark.createDataFrame([("Łódź", 51.7, 19.4)], "miejsceUr string, miejsceUrLan double, miejsceUrLon double")
    joined, missing = H.place_lookup(members, cache)
    assert rows(missing) == [("Kraków",)]
    assert {r.id: r.miejsceUrLan for r in joined.collect()} == {1: 51.7, 2: None, 3: None}


def test_correlation_is_null_with_a_hole(spark):
    df = spark.createDataFrame([(1, 2, None), (2, 4, 1), (3, 6, 2)], "a int, b int, c int")
    got = {(r.var1, r.var2): r.value for r in S.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "b"] == pytest.approx(1.0) and got["b", "c"] is None and got["c", "c"] == 1.0


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (24, 25, 29, 30, None)], "wiek int")
    assert rows(S.histogram(df, "wiek", 5, 20)) == [(20, 1), (25, 2), (30, 1)]


def test_resume_skips_landed_but_not_empty_files(spark):
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    landed = spark.createDataFrame([(1, 10), (2, 0)], "k int, length int")
    assert rows(B.not_landed(wanted, landed, ["k"])) == [(2,), (3,)]
    assert B.not_landed(wanted, landed, ["k"], force=True).count() == 3


def test_proceeding_days_fall_back_to_the_list(spark):
    listed = spark.createDataFrame(
        [(1, '{"d": "2024-01-01"}', 0), (2, '{"d": "2024-01-02"}', 1), (2, '{"d": "2024-09-09"}', 0), (None, "{}", 0)], "num int, json string, pos int"
    )
    details = spark.createDataFrame([(1, '{"days": ["2024-05-05"]}'), (2, "{}")], "num int, json string")
    assert rows(B.proceeding_days(listed, details)) == [(1, "2024-05-05"), (2, "2024-09-09")]
    with pytest.raises(AnalysisException):
        B.proceeding_days(listed.drop("pos"), details).count()


def plain_dates(value):
    """The date strings of a parsed record."""
    if isinstance(value, str):
        return {value} if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else set()
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(plain_dates, inner))


def test_record_dates_are_those_of_the_parsed_record(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.choice(["date", "date", "text", "number", "list", "map"] if depth < 12 else ["date", "text"])
        day = f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-1{rng.randrange(10)}"
        if kind == "list":
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == "map":
            return {rng.choice(["k", "d", day, f"{day} x"]) + "!" * i: value(depth + 1) for i in range(rng.randrange(4))}
        return {"date": day, "text": rng.choice([f"on {day}", day + "\n", day[:-1], '"' + day + '"', "٢٠٢٤-٠١-٠١", None]), "number": rng.choice([3, 2.5, True, 20240101])}[kind]

    records = [{"a": value(0), "2001-01-01": [value(0), value(1)]} for _ in range(150)]
    deep = "2024-02-29"
    for _ in range(40):
        deep = [deep] if rng.random() < 0.5 else {"2000-01-01": deep}
    texts = [json.dumps(r, ensure_ascii=i % 2 == 0) for i, r in enumerate([*records, deep, "2024-12-31", []])]
    # letters written as escapes, blanks around a key's colon
    texts += ['["2024\\u002d03-0\\u0031"]', '{"2024-01-01" : "2024-01-02"}', "no json", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "num int, json string").repartition(4)
    got = {r.num: r.dates for r in B.record_dates(frame).collect()}
    want = [sorted(plain_dates(r)) for r in [*records, deep, "2024-12-31", [], ["2024-03-01"], {"2024-01-01": "2024-01-02"}]] + [[]] * 3
    assert [got[i] for i in range(len(texts))] == want
    assert B.record_dates(frame.limit(0)).count() == 0


def test_roster_from_landed_members(spark):
    landed = spark.createDataFrame(
        [
            ("Jan Kowalski", "PSL-TD", "1970-05-01", "Kraków", "rolnik", "wyższe", 13, "Kraków", "małopolskie", 10432,
             False, "Zrzeczenie", "mandat posła do Parlamentu Europejskiego"),
            ("Anna Nowak", "KO", "1990-02-02", None, None, "wyższe", 1, "Legnica", "dolnośląskie", 7, True, None, None),
        ],
        "firstLastName string, club string, birthDate string, birthLocation string, profession string,"
        " educationLevel string, districtNum int, districtName string, voivodeship string, numberOfVotes int,"
        " active boolean, inactiveCause string, waiverDesc string",
    )
    profiles = spark.createDataFrame(
        [("Jan Kowalski", "Sejm RP VIII, IX kadencji", "AR - magister inżynier (1995), studia podyplomowe")],
        "name string, staz_parlamentarny string, ukonczona_szkola string",
    )
    sexes = spark.createDataFrame([("Jan Kowalski", "M"), ("Anna Nowak", "K")], "imieNazwisko string, plec string")
    raw = H.raw_roster(H.join_profiles(landed, profiles))
    out = {r.imieNazwisko: r for r in H.published_roster(raw, sexes, "imieNazwisko").collect()}
    jan, anna = out["Jan Kowalski"], out["Anna Nowak"]
    assert (jan.klub, jan.wiek, jan.plec, jan.najwyzszyStopienNaukowy) == ("PSL", 55, "M", "magister inżynier")
    assert (jan.liczbaStudiowPodyplomowych, jan.ktoraKadencja, jan.czyAktywny) == (1, 3, False)
    assert jan.nieaktywnoscKategoria == "Mandat w Parlamencie Europejskim"
    assert (anna.wiek, anna.ktoraKadencja, anna.czyAktywny, anna.nieaktywnoscKategoria) == (35, 1, True, None)
    assert H.load_roster(H.published_roster(raw, sexes, "imieNazwisko")).schema["nrOkreguWyborczego"].dataType.simpleString() == "string"


def test_slice_of(spark):
    cuts = [-5, 0, 3, 10, 11]
    got = spark.range(-8, 15).select("id", W.slice_of(F.col("id"), cuts).alias("s")).collect()
    assert all(r.s == sum(c <= r.id for c in cuts) for r in got)
    assert spark.range(1).select(W.slice_of(F.lit(None).cast("bigint"), cuts)).first()[0] == 0


def test_lemma_arrays_keep_words_in_their_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "Anna kota widzi, Łódź płynie"), (2, None), (3, ""), (4, "anna"), (5, "kota zoe zoé"), (5, "domu anna"), (None, "rzeka"), (None, "morze")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    names = spark.createDataFrame([("anna",), ("zoe",), ("łodz",)], "name string")
    for column in ("lemma", "token"):
        want = C._gathered_arrays(docs, ["doc_id"], (), names, C.LETTERS, column)
        got = C.lemma_arrays(docs, ["doc_id"], (), names, column=column)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select("doc_id", "words").collect()))
    once = C.lemma_arrays(docs.where("doc_id < 5"), ["doc_id"], (), names)
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: len(r.words) for r in once.collect()} == {1: 3, 2: 0, 3: 0, 4: 0}
    assert once.where(F.size("words") == 0).count() == 3


def test_proceeding_days_broadcast_no_side(spark):
    from textlab.operators import landing as B

    listed = spark.createDataFrame([(1, 0, '{"a": "2020-01-02"}'), (2, 0, '{"a": "2020-01-03"}')], "num int, pos int, json string")
    details = spark.createDataFrame([(2, '{"b": ["2021-05-06"]}')], "num int, json string")
    found = B.proceeding_days(listed, details)
    assert sorted(map(tuple, found.collect())) == [(1, "2020-01-02"), (2, "2021-05-06")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_row_term_counts_need_no_shuffle(spark):
    rows = [(1, ["b", "a", "b", "b"]), (2, []), (3, None), (None, ["c"]), (4, ["a"])]
    listed = spark.createDataFrame(rows, "doc_id int, words array<string>")
    found = T.row_term_counts(listed, ["doc_id"])
    assert {tuple(r) for r in found.collect()} == {(1, "a", 1), (1, "b", 3), (None, "c", 1), (4, "a", 1)}
    assert dict(found.dtypes)["tf"] == "bigint"
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
