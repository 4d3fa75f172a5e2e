"""Text functions on hand-worked values."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from textlab.functions import text as X, values as V
from textlab.functions.words import FOLD_SUFFIXES, LETTERS


@pytest.mark.parametrize(
    "value, slug", [("Żółć i Spółka", "zo-c-i-spo-ka"), ("", "unknown"), ("  -- ", "unknown"), ("a" * 100, "a" * 80)]
)
def test_slugify(one, value, slug):
    assert one(X.slugify, x=value) == slug


@pytest.mark.parametrize("value, n", [("12", 12), (" 7 ", 7), ("٣٤", 34), ("1२", 12), ("²", None), ("-3", None), ("", None), ("x", None)])
def test_safe_int(one, value, n):
    assert one(V.safe_int, x=value) == n


def test_integers_pass_safe_int(one):
    assert one(V.safe_int, x=-5) == -5


@pytest.mark.parametrize("value", ["łąóż", "ﬁn ½ № …", "Ångström ﬃ", "①Ⓐ 한글 ﷺ 𝒜", "plain", "ZAŻÓŁĆ gęślą", "Ǆ ǉ ² x"])
def test_ascii_fold_is_nfkd_without_marks(one, value):
    expected = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    assert one(X.ascii_fold, x=value) == expected


@pytest.mark.parametrize(
    "token, lemma", [("polskiego", "pol"), ("owa", "owa"), ("dobrymi", "dobrymi"), ("nowszejszy", "nowsz")]
)
def test_fold_token(one, token, lemma):
    assert one(X.fold_token, x=token) == lemma


def test_fold_token_takes_the_first_listed_ending(spark):
    """Every stem length with every ending, against trying the list in order."""
    words = [stem + s for s in FOLD_SUFFIXES for stem in ("a", "ab", "abc", "abcd", "abski")]

    def in_order(word):
        for s in FOLD_SUFFIXES:
            if word.endswith(s) and len(word) - len(s) >= 3:
                return word[: -len(s)]
        return word

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.fold_token(F.col("w"))).collect()
    assert {r[0]: r[1] for r in rows} == {w: in_order(w) for w in words}


@pytest.mark.parametrize("word, n", [("Kaczyński", 3), ("brr", 1), ("aeiou", 1), ("Ojcowizna", 4)])
def test_syllables(one, word, n):
    assert one(X.syllables, x=word) == n


def fog(spark, text):
    return spark.createDataFrame([(text,)], "text string").transform(X.with_fog).select(*X.FOG_COLUMNS).first()


def test_fog(spark):
    row = fog(spark, "Ala ma kota. To jest polityka!")
    assert (row.word_count, row.sentence_count, row.avg_sentence_len) == (6, 2, 3.0)
    assert row.fog_index == pytest.approx(0.4 * (3 + 100 / 6))


def test_fog_of_no_words_is_zero(spark):
    assert tuple(fog(spark, "")) == (0.0, 0.0, 0, 0)
    assert tuple(fog(spark, "12 34. 5")) == (0.0, 0.0, 0, 0)
    assert tuple(fog(spark, "...")) == (0.0, 0.0, 0, 0)


def test_sentences_split_on_backslash_and_runs(one):
    assert one(X.sentence_count, x="a\\b?! c… \n .d") == 4


def test_complex_words_match_per_word_counts(spark):
    text = "polityka Ojcowizna brr kaczyński x1 ĄŻĘbÓc aeiou bababa, ba-ba-ba"
    import re

    expected = sum(
        len(re.findall("[aeiouyąęó]+", w.lower())) >= 3 for w in re.findall(f"[{LETTERS}]+", text)
    )
    got = spark.createDataFrame([(text,)], "t string").select(X.complex_word_count(F.col("t"))).first()[0]
    assert got == expected


def test_mentions(one):
    assert one(lambda x: X.mentions(x, "tusk"), x="Tuska, tuskowi łtusk") == 2
    assert one(lambda x: X.mentions(x, "kaczynski"), x="Kaczyński i KACZYŃSKIEGO, prokaczyński") == 2


def test_word_case_is_folded_after_matching(one):
    assert one(X.raw_tokens, x="ŻÓŁW İx K9") == ["żółw", "x", "k"]


def test_collapse_and_strip_use_all_whitespace(one):
    assert one(X.collapse_ws, x="  a  b\t\nc ") == "a b c"
    assert one(X.strip_space, x="　 x y\x1f") == "x y"


def test_str_trunc_and_labels(one):
    assert one(lambda x: X.str_trunc(x, 35), x="x" * 36) == "x" * 32 + "..."
    assert one(lambda x: X.str_trunc(x, 35), x="x" * 35) == "x" * 35
    assert one(X.pct_label, p=0.125) == "12%"
    assert one(lambda p: X.pct_label(p, 1), p=0.31525) == "31.5%"


@pytest.mark.parametrize(
    "school, degree",
    [
        ("AGH - magister inżynier (1999)", "magister inżynier"),
        ("UJ - Doktor (2001)", None),
        ("UJ - profesor  nauk, inne", "profesor nauk"),
        ("UJ - lekarz medycyny; x", "lekarz medycyny"),
        ("brak", None),
        (None, None),
    ],
)
def test_highest_degree(one, school, degree):
    assert one(lambda x: V.highest_degree(x.cast("string")), x=school) == degree


@pytest.mark.parametrize("tenure, n", [("Sejm RP VII, VIII kadencji", 3), ("brak", 1), (None, 1), ("poseł IX", 2)])
def test_term_ordinal(one, tenure, n):
    assert one(lambda x: V.term_ordinal(x.cast("string")), x=tenure) == n


@pytest.mark.parametrize("born, age", [("2000-01-11", 26), ("2000-01-12", 25), ("bad", None)])
def test_age_at(one, born, age):
    assert one(lambda x: V.age_at(x, "2026-01-11"), x=born) == age


@pytest.mark.parametrize(
    "comment, label",
    [
        ("objął mandat posła do Parlamentu Europejskiego", "Mandat w Parlamencie Europejskim"),
        ("zmarł 1 maja", "Zgon"),
        ("wymarły", "Inne (z komentarza)"),
        ("inne", "Inne (z komentarza)"),
        ("", None),
    ],
)
def test_comment_bins(one, comment, label):
    assert one(lambda x: V.bin_comment(x)[0], x=comment) == label


@pytest.mark.parametrize("value, truth", [(" Yes ", True), ("1", True), ("T", True), ("no", False), ("", False), (None, False)])
def test_to_bool(one, value, truth):
    assert one(lambda x: V.to_bool(x.cast("string")), x=value) is truth


def test_slug_of_the_start_is_the_slug_of_the_whole(spark):
    from pyspark.sql import functions as F
    from textlab.functions.text import ascii_fold, slugify

    starts = ["", "-- ", "." * 400, "Żółć " * 200, "a." * 40 + "b", "a" * 79 + " ", "a" * 80, "한글 " * 100, "́" * 330 + "x", "ﷺ" * 40, "." * 318 + "ab", "." * 241 + "a" * 79]
    texts = [(a + b,) for a in starts for b in ("", "!", " Zoë", "-", "z" * 300)] + [(None,)]
    df = spark.createDataFrame(texts, "t string")
    dashed = F.regexp_replace(ascii_fold(F.col("t")), "[^A-Za-z0-9]+", "-")
    whole = F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))
    want = F.when(F.coalesce(whole, F.lit("")) == "", "unknown").otherwise(F.substring(whole, 1, 80))
    assert df.where(~slugify(F.col("t")).eqNullSafe(want)).count() == 0
    plan = df.select(slugify(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(t" in plan  # long texts are not folded to their end for it


@pytest.mark.parametrize("letters", ["a-zA-ZąćęłńóśżźĄĆĘŁŃÓŚŻŹ", "a-zäößé", "a-zΣσςİ가-힣ﬁ"])
@pytest.mark.parametrize("column", ["lemma", "token"])
def test_words_cut_in_batches_are_those_of_rows(spark, monkeypatch, letters, column):
    """Rules run once per distinct word of a batch agree with those of Spark's functions."""
    from textlab.operators import corpus as C

    monkeypatch.setattr(C, "_SLICE", 40)
    texts = ["Żółwie piszą pożółkłymi literami", "abc", "Def", None, "", "ß3é łódź한국어 haus Straße", "najlepszego warszawskiego-krakowska ADAMA adamowi",
             "x the und ąę ÓÓÓ ﬁn ΣΑΣ İstanbul 😀abc", "\x00ábc kał tak tak the the aaa", "owego ymego emu skiego", "ą" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    names = spark.createDataFrame([("adama",), ("zolwie",), ("kał",), (None,)], "name string")
    own = {r.doc_id: r.words for r in C.lemma_arrays(docs, ["doc_id"], ["the", "und"], names, letters, column).collect()}
    rows = {r.doc_id: r.words for r in C._gathered_arrays(docs, ["doc_id"], ["the", "und"], names, letters, column).collect()}
    assert own == rows and sum(map(len, own.values())) > 5
    plan = C.lemma_arrays(docs, ["doc_id"], ["the"], names, letters, column)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan
