"""Keyword search through a positional inverted index on files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from textlab.functions.text import raw_tokens
from textlab.functions.words import LETTERS
from textlab.operators.joins import small_copy
from textlab.sources.sinks import materialise


class KeywordIndex(NamedTuple):
    """Files of (term, keys, pos) rows, cut by ranges of the term."""

    path: str
    keys: list[str]
    ranges: list[tuple[int, str, str]]  # part, its first and last term

    def parts_of(self, words: list[str]) -> list[int]:
        """The parts that may hold one of the words."""
        return [part for part, low, high in self.ranges if any(low <= w <= high for w in words)]


def build_keyword_index(docs: DataFrame, keys: list[str], path: str, rows_per_part: int = 4_000_000, letters: str = LETTERS) -> KeywordIndex:
    """Every word of every text with its place, written to ``path`` in parts of one range of terms each.

    ``keys`` must tell texts apart. A frequent word goes on over several parts, as the ranges
    are cut by term, text and place. Words are cut out of the texts once and written, as
    they are read three times. One shuffle carries words and places, never a text; two terms a part
    reach the driver.
    """
    listed = materialise(docs.select(*keys, raw_tokens(F.col("text"), letters).alias("_w")), "index-words")
    n = listed.agg(F.sum(F.greatest(F.size("_w"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-n // rows_per_part))
    order = ["term", *keys, "pos"]
    places = listed.select(*keys, F.posexplode("_w").alias("pos", "term"))
    # Led by the part, the order is also the one that writing by parts asks for: rows are sorted once.
    dealt = places.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
    dealt.write.partitionBy("part").parquet(path)
    if not n:
        return KeywordIndex(path, list(keys), [])
    bounds = docs.sparkSession.read.parquet(path).groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high")).collect()
    return KeywordIndex(path, list(keys), sorted((r["part"], r["low"], r["high"]) for r in bounds))


def occurrences(spark: SparkSession, index: KeywordIndex, words: list[str]) -> DataFrame:
    """(term, keys, pos) of the words, from the files that may hold them alone."""
    words = sorted(set(words))
    parts = index.parts_of(words)
    if not parts:
        return spark.createDataFrame([], "term string, pos int").select("term", *(F.lit(None).alias(k) for k in index.keys), "pos")
    found = spark.read.parquet(*(f"{index.path}/part={part}" for part in parts)).where(F.col("term").isin(words))
    return found.select("term", *index.keys, "pos")


def keywords_in_context(docs: DataFrame, index: KeywordIndex, words: list[str], width: int = 3, letters: str = LETTERS) -> DataFrame:
    """(keys, pos, left, keyword, right): every occurrence of any of the words with its neighbours.

    The rows of ``corpus.kwic`` for each word, from one pass over the texts for all of them: the
    index names texts and places, contexts are cut from the words of the matched texts. Matched
    places are broadcast to the texts if their counted size allows, else both sides are
    shuffled. Null and empty texts have no words; a word that does not occur gives no rows.
    """
    keys = index.keys
    hit = occurrences(docs.sparkSession, index, words)
    if not index.parts_of(words):
        return docs.limit(0).select(*keys, F.lit(0).alias("pos"), F.lit("").alias("left"), F.lit("").alias("keyword"), F.lit("").alias("right"))
    per_text = hit.groupBy(*keys).agg(F.collect_list(F.struct("pos", "term")).alias("_hits"))
    small = small_copy(per_text)
    matched = docs.select(*keys, "text").join(per_text if small is None else F.broadcast(small), keys)
    listed = matched.select(*keys, raw_tokens(F.col("text"), letters).alias("_w"), "_hits")
    before = lambda h: F.least(F.lit(width), h["pos"])
    rows = F.transform(
        "_hits",
        lambda h: F.struct(
            h["pos"].alias("pos"),
            F.array_join(F.slice("_w", h["pos"] - before(h) + 1, before(h)), " ").alias("left"),
            h["term"].alias("keyword"),
            F.array_join(F.slice("_w", h["pos"] + 2, F.lit(width)), " ").alias("right"),
        ),
    )
    return listed.select(*keys, F.inline(rows))
