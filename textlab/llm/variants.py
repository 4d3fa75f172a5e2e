"""Spelling variants of words: asymmetric q-chunks propose pairs one edit apart, the edit distance decides."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from textlab.sources.sinks import materialise

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
FRONT, BACK = 0, 1


def word_counts(docs: DataFrame, every: int = 97, min_chars: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, size): words of at least ``min_chars`` code points found at least ``min_count`` times.

    Words are runs of letters up to U+00FF, A-Z lower-cased. A run whose crc32 of "id:run" is
    divisible by ``every`` loses the code point at that number modulo its length: a stand-in
    for misspelling. A null text has no words, a null id counts as empty text.
    """
    runs = F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    seen = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    hashed = seen.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count).withColumn("size", F.length("word"))


def _chunks(word: Column, size: Column, of_size: Column) -> Column:
    """The two halves that a word of ``of_size`` is cut into, as they lie in ``word``: the front
    at its start, the back at its end, so shifted by the difference of the sizes."""
    half = F.floor(of_size / 2).cast("int")
    front = F.struct(F.lit(FRONT).alias("part"), F.substring(word, F.lit(1), half).alias("gram"))
    back = F.struct(F.lit(BACK).alias("part"), F.substring(word, size - (of_size - half) + 1, of_size - half).alias("gram"))
    return F.array(front, back)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of all words (word, n, size) that differ by exactly one inserted, deleted
    or replaced code point; each pair once.

    The longer word (of equal ones the smaller in code-point order) contributes its two
    disjoint halves, the other word its positional grams of the same lengths. One edit
    leaves a half intact, the front in place and the back shifted by at most one, so of the
    other's grams only those at these places are needed. A pair that shares both is taken
    by its front. Candidates of equal grams are met by an ordinary join, whose hot grams
    the session may split.
    """
    longer = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("of_size"), F.explode(_chunks(F.col("word"), F.col("size"), F.col("size"))).alias("c"))
    targets = words.withColumn("of_size", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    grams = targets.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "of_size", F.explode(_chunks(F.col("word"), F.col("size"), F.col("of_size"))).alias("c"))
    met = longer.select("a", "a_n", "of_size", "c.part", "c.gram").join(grams.select("b", "b_n", "of_size", "c.part", "c.gram"), ["of_size", "part", "gram"])
    half = F.floor(F.col("of_size") / 2).cast("int")
    first = (F.col("part") == FRONT) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    ordered = (F.length("b") < F.col("of_size")) | (F.col("a") < F.col("b"))
    # One edit leaves one half of the rest intact too: a cheap test before the distance.
    start = F.when(F.col("part") == FRONT, half).otherwise(0)
    size = F.when(F.col("part") == FRONT, F.col("of_size") - half).otherwise(half)
    quarter = F.floor(size / 2).cast("int")
    back, shift = start + quarter + 1, F.length("b") - F.col("of_size")
    intact = (F.substring("a", start + 1, quarter) == F.substring("b", start + 1, quarter)) | (
        F.substring("a", back, size - quarter) == F.substring("b", back + shift, size - quarter)
    )
    return met.where(ordered & intact & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def _roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of words with a form: pointers are doubled until none moves. Counts at least
    double along a pointer, so the paths have no circles and at most 63 steps."""
    links = materialise(links.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(max_rounds):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def group(docs: DataFrame, ratio: int = 2, every: int = 97, min_chars: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``word_counts``.

    Words one edit apart are near. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``ratio`` (2 or more) times its own, else
    null; form_n is the form's n; root is where the forms lead, the word itself without a form.

    Null and empty texts have no words; repeated rows count each time; very long texts are read
    whole; an empty table, or one without such words, gives no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    words = materialise(word_counts(docs, every, min_chars, min_count, id_col, text_col), "variant-words")
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = F.min(F.struct((-F.col("p.near_n")).alias("minus_n"), F.col("p.near").alias("near"))).alias("best")
    near = near_pairs(words).select(ways.alias("p")).groupBy(F.col("p.word").alias("word")).agg(F.count("*").alias("n_near"), best)
    chosen = -F.col("best.minus_n") >= ratio * F.col("n")
    formed = materialise(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.minus_n")).alias("form_n"),
        ),
        "variant-forms",
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(every: int = 97, min_chars: int = 5, min_count: int = 3, ratio: int = 2) -> str:
    """The same in DuckDB's SQL: pairs by the words that deletions leave; crc32 by its table."""
    return rf"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), runs AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS keyed, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(hex(encode(keyed)))::BIGINT, 2), lambda p: ('0x' || substr(hex(encode(keyed)), p + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, tab
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % {every} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= {min_chars} GROUP BY word HAVING sum(k) >= {min_count}
), less AS (
  SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {ratio} * n THEN near END AS form, CASE WHEN near_n >= {ratio} * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS here, 0 AS steps FROM formed UNION ALL SELECT p.word, f.form, steps + 1 FROM path p JOIN formed f ON f.word = p.here WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed f JOIN (SELECT word, arg_max(here, steps) AS root FROM path GROUP BY word) USING (word)
"""
