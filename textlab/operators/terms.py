"""Term statistics: counts, TF-IDF, n-grams and log-odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.functions.text import fold_token, words
from textlab.functions.words import LETTERS
from textlab.operators import grams
from textlab.operators.corpus import author_groups, vocabulary_filter
from textlab.operators.joins import lookup_join, top_k
from textlab.sources.sinks import materialise


def term_counts(
    docs: DataFrame,
    keys: list[str],
    stopwords=None,
    names: DataFrame | None = None,
    folded: bool = False,
    letters: str = LETTERS,
) -> DataFrame:
    """(keys, term, tf). Tokens are counted first and the token rules, the name join and
    the stemming run once per distinct word, not once per occurrence."""
    found = (
        docs.select(*keys, F.explode(words(F.col("text"), letters)).alias("_w"))
        .groupBy(*keys, F.lower("_w").alias("token"))
        .agg(F.count("*").alias("tf"))
    )
    kept = vocabulary_filter(found, stopwords, names)
    if not folded:
        return kept.select(*keys, F.col("token").alias("term"), "tf")
    return kept.groupBy(*keys, fold_token(F.col("token")).alias("term")).agg(F.sum("tf").alias("tf"))


def row_term_counts(listed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf) of each row of a ``lemma_arrays`` table, counted in its row, without a shuffle."""
    in_order = listed.select(*keys, F.array_sort("words").alias("_w")).where(F.size("_w") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.coalesce(F.get("_w", i) != F.get("_w", i - 1), F.lit(True)))
    runs = in_order.select(*keys, "_w", begins.alias("_at"))
    tf = lambda i, j: F.coalesce(F.get("_at", j + 1), F.size("_w")) - i
    return runs.select(*keys, F.inline(F.transform("_at", lambda i, j: F.struct(F.get("_w", i).alias("term"), tf(i, j).cast("long").alias("tf")))))


def author_word_counts(listed: DataFrame, authors: DataFrame, keys: list[str], per_author: bool = True) -> DataFrame:
    """``corpus.author_counts`` of the words in a written ``lemma_arrays`` table (doc_id, words).

    Texts meet their groups as rows, before their words are told apart, so that no shuffle tells
    texts' words apart.
    """
    rows = listed.join(author_groups(authors, keys, per_author), "doc_id").select(*keys, "_n", F.explode("words").alias("term"))
    return rows.groupBy(*keys, "term").agg(F.sum("_n").cast("long").alias("tf"))


def ngram_counts(listed: DataFrame, keys: list[str], sizes=(2, 3)) -> DataFrame:
    """(keys, term, ngram_len, tf) of n-grams within each row's ``words``.

    ``listed`` is a ``lemma_arrays`` table, read twice: pass a written table.
    """
    num = grams.numbered(listed)
    return grams.with_terms(grams.ngrams(num, keys, sizes), num).select(*keys, "term", "ngram_len", "tf")


def cross_ngram_counts(listed: DataFrame, group: list[str], order: list[str], sizes=(2, 3), slices: int | None = None, min_tf: int = 1) -> DataFrame:
    """(group, term, ngram_len, tf) of n-grams when a group's texts, in order, are one text.

    To the n-grams within texts come those over borders, from the first and last words of each
    text. These meet in slices: ranges of group and order (``slices`` of them, by default as many
    as the session has shuffle partitions), so a large group is many tasks. A slice also gets
    the first words of the slices after it, as a text has at least one word, of no more than
    the longest n-gram reaches. Texts without words are passed over; ``order`` must tell a
    group's texts apart. n-grams met less than ``min_tf`` times are left out before their words are shown.
    """
    n_edge = max(sizes) - 1
    slices = slices or int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = listed.where(F.size("words") > 0).select(
        *group,
        *order,
        F.slice("words", 1, n_edge).alias("_head"),
        F.slice("words", F.greatest(F.size("words") - n_edge + 1, F.lit(1)), F.lit(n_edge)).alias("_tail"),
    )
    # A group lies in consecutive slices.
    edges = materialise(edges.repartitionByRange(slices, *group, *order).withColumn("_slice", F.spark_partition_id()), "edges")
    in_order = Window.partitionBy(*group, "_slice").orderBy(*order)
    first = edges.withColumn("_r", F.row_number().over(in_order)).where(F.col("_r") <= n_edge)
    heads = first.groupBy(*group, "_slice").agg(F.array_sort(F.collect_list(F.struct("_r", "_head"))).alias("_h"))
    start = heads.select(*group, "_slice", F.slice(F.flatten(F.transform("_h", lambda h: h["_head"])), 1, n_edge).alias("_words"))
    reached = start.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(n_edge))))
    sent = reached.select(*group, (F.col("_slice") - F.col("d")).alias("_slice"), F.struct("d", "_words").alias("_s"))
    guests = sent.groupBy(*group, "_slice").agg(F.flatten(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["_words"])).alias("_head"))
    both = edges.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)), allowMissingColumns=True)
    with_guest = Window.partitionBy(*group, "_slice").orderBy("_guest", *order)
    ahead = F.array_compact(F.array(*[F.lead("_head", i).over(with_guest) for i in range(1, n_edge + 1)]))
    met = both.select(*group, "_guest", "_tail", F.slice(F.flatten(ahead), 1, n_edge).alias("_ahead")).where("_guest = 0")

    def crossing(n: int) -> Column:
        whole = F.concat("_tail", F.slice("_ahead", 1, n - 1))
        first = F.greatest(F.size("_tail") - n + 2, F.lit(1))
        last = F.least(F.size("_tail"), F.size(whole) - n + 1)
        at = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.slice(whole, i, n))

    over = met.select(*group, F.explode(F.concat(*map(crossing, sizes))).alias("words"))
    num = grams.numbered(listed)
    counts = grams.ngrams(num, group, sizes, more=over).where(F.col("tf") >= min_tf)
    return grams.with_terms(counts, num).select(*group, "term", "ngram_len", "tf")


def idf(n: Column, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((n + 1) / (df + 1)) + 1


def tfidf_top(
    counts: DataFrame,
    docs: DataFrame,
    channel: str,
    group: str,
    min_df: int,
    max_df: float,
    max_features: int,
    top: int,
    ngram_len: bool = False,
    scores_only: bool = False,
) -> DataFrame:
    """Top terms per group when all texts of a group form one document, per channel.

    ``counts`` is read twice: pass a written table. Document frequency and total are one row
    per term; the vocabulary, at most ``max_features`` rows per channel, is broadcast back
    to the counts, and norm and rank run over at most that many rows of a group.
    """
    n_groups = docs.groupBy(channel).agg(F.countDistinct(group).alias("n"))
    vocab = vocabulary(counts, n_groups, [channel], min_df, max_df, max_features)
    return _tfidf_ranked(counts, vocab, channel, group, top, ["ngram_len"] if ngram_len else [], scores_only)


def _tfidf_ranked(counts: DataFrame, vocab: DataFrame, channel: str, group: str, top: int, extra: list[str], scores_only: bool = False) -> DataFrame:
    weight = F.col("tf") * idf(F.col("n"), F.col("df"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(channel, group)))
    kept = counts.join(F.broadcast(vocab), [channel, "term"])
    scored = kept.withColumn("_w", weight).withColumn("score", F.col("_w") / norm)
    if scores_only:
        return scored.select(channel, group, "term", *extra, "score")
    best = Window.partitionBy(channel, group).orderBy(F.desc("score"), "term")
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select(F.col(group).alias("group"), "term", *extra, "score", "rank", F.col(channel).alias("source"))
    )


def tfidf_top_ngrams(
    listed: DataFrame,
    docs: DataFrame,
    channel: str,
    group: str,
    min_df: int,
    max_df: float,
    max_features: int,
    top: int,
    sizes=(2, 3),
) -> DataFrame:
    """``tfidf_top`` of the n-grams within the rows of a written ``lemma_arrays`` table.

    The counts of n-grams are not kept: they give the vocabulary, whose n-grams alone are then
    counted again in the rows. n-grams with a part that is too rare for it are not counted.
    """
    num = grams.numbered(listed)
    n_groups = docs.groupBy(channel).agg(F.countDistinct(group).alias("n"))
    bounded = grams.bounded_ngrams(num, channel, group, sizes, min_df, max_features, lambda c: within_bounds(c, n_groups, [channel], min_df, max_df))
    shown = grams.with_terms(bounded.withColumn("_gram", F.col("gram")), num)
    vocab = materialise(most_frequent(shown, [channel], max_features), "gram-vocabulary")
    wanted = vocab.select(F.col("_gram").alias("gram"), F.when(F.col("_gram") < 0, F.col("term")).alias("term"))
    counts = grams.with_terms(grams.ngrams(num, [channel, group], sizes, only=wanted), num)
    return _tfidf_ranked(counts.drop("ngram_len"), vocab.drop("_gram"), channel, group, top, ["ngram_len"])


def with_term_hash(df: DataFrame, channel: str) -> DataFrame:
    """``_hash`` of (channel, term): leading a window's keys it spares the sort most string
    comparisons, which a channel name in front would force."""
    return df.withColumn("_hash", F.xxhash64(channel, "term"))


def vocabulary(
    doc_terms: DataFrame,
    n_docs: DataFrame,
    partition: list[str],
    min_df: int,
    max_df: float,
    max_features: int,
) -> DataFrame:
    """(partition, term, df, total, n) kept by the bounds, from (doc, term, tf) rows.

    Frequencies combine on the map side, so a term found in every document is no hot key.
    """
    terms = doc_terms.groupBy(*partition, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    return bounded_vocabulary(terms, n_docs, partition, min_df, max_df, max_features)


def bounded_vocabulary(terms: DataFrame, n_docs: DataFrame, partition: list[str], min_df: int, max_df: float, max_features: int) -> DataFrame:
    """The rows of ``terms`` (partition, term, df, total) kept by the bounds, with n."""
    return most_frequent(within_bounds(terms, n_docs, partition, min_df, max_df), partition, max_features)


def within_bounds(terms: DataFrame, n_docs: DataFrame, partition: list[str], min_df: int, max_df: float) -> DataFrame:
    """The rows of ``terms`` whose df is within the bounds, with n; terms stay in place while ``n_docs`` may be broadcast."""
    return lookup_join(terms.where(F.col("df") >= min_df), n_docs, partition).where(F.col("df") <= F.lit(max_df) * F.col("n"))


def most_frequent(terms: DataFrame, partition: list[str], max_features: int) -> DataFrame:
    return top_k(terms, partition, [F.desc("total"), F.asc("term")], max_features, ["term"])


def tfidf_group_mean(
    doc_terms: DataFrame,
    docs: DataFrame,
    doc_key: str,
    group: str,
    min_df: int = 5,
    max_df: float = 0.6,
    max_features: int = 8000,
    top: int = 15,
) -> DataFrame:
    """Mean per-document TF-IDF of each term in a group, best ``top``.

    ``doc_terms``: doc_key, group, term, tf. The vocabulary has at most ``max_features``
    rows, which bounds the broadcast.
    """
    everything = F.lit(1).alias("_all")
    n_docs = docs.groupBy(everything).agg(F.count("*").alias("n"))
    vocab = vocabulary(
        doc_terms.select("*", everything), n_docs, ["_all"], min_df, max_df, max_features
    )
    weighted = doc_terms.join(F.broadcast(vocab), "term").select(
        doc_key, group, "term", (F.col("tf") * idf(F.col("n"), F.col("df"))).alias("_w")
    )
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc_key)))
    sums = (
        weighted.withColumn("_s", F.col("_w") / norm)
        .groupBy(group, "term")
        .agg(F.sum("_s").alias("_s"))
    )
    sizes = docs.groupBy(group).agg(F.count("*").alias("_docs"))
    best = Window.partitionBy(group).orderBy(F.desc("score"), "term")
    return (
        sums.join(sizes, group)
        .withColumn("score", F.col("_s") / F.col("_docs"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select(F.col(group).alias("group"), "term", "score", "rank")
    )


def top_words(counts: DataFrame, keys: list[str], top: int = 200) -> DataFrame:
    """Most frequent terms per group. Catalyst limits each map partition before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(F.desc("tf"), "term")
    return (
        counts.withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= top)
        .select(*keys, "term", F.col("tf").alias("count"))
    )


def log_odds(
    counts: DataFrame,
    channel: str,
    group: str,
    blocks: dict[str, list[str]],
    min_count: int = 60,
    alpha: float = 1.0,
) -> DataFrame:
    """Smoothed log-odds of each term between two blocks of groups, both directions.

    ``counts``: (channel, group, term, tf); ``blocks``: name → its groups, two entries. The
    blocks sit side by side in one aggregate, so no outer join is needed. Rare terms are
    cut per block before the totals. Channels where a block has no term left give no rows.
    """
    (name_a, groups_a), (name_b, groups_b) = blocks.items()

    def block(groups: list[str]) -> Column:
        tf = F.sum(F.when(F.col(group).isin(groups), F.col("tf")))
        return F.when(tf >= min_count, tf)

    terms = (
        counts.where(F.col(group).isin([*groups_a, *groups_b]))
        .groupBy(channel, "term")
        .agg(block(groups_a).alias("_a"), block(groups_b).alias("_b"))
        .where("_a is not null or _b is not null")
    )
    totals = terms.groupBy(channel).agg(
        F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"), F.count("*").alias("_v")
    ).where("_ta is not null and _tb is not null")

    def p(n: str, total: str) -> Column:
        return (F.coalesce(F.col(n), F.lit(0)) + alpha) / (F.col(total) + alpha * F.col("_v"))

    odds = F.log(p("_a", "_ta") / p("_b", "_tb"))
    both = F.array(
        F.struct(F.lit(name_a).alias("group"), odds.alias("log_odds")),
        F.struct(F.lit(name_b).alias("group"), (-odds).alias("log_odds")),
    )
    # One totals row per channel: bounded by the number of channels.
    return terms.join(F.broadcast(totals), channel).select(
        F.col(channel).alias("source"), "term", F.inline(both)
    )


def cooccurrence(listed: DataFrame, window: int = 2) -> DataFrame:
    """Unordered pairs of different words at most ``window`` positions apart, with counts.

    Neighbours come from each row's own ``words``, so no text is joined with itself. ``listed`` is
    read twice: pass a written table.
    """
    num = grams.numbered(listed)
    return grams.with_pairs(grams.near_pairs(num, window), num).select("word_a", "word_b", F.col("tf").alias("n"))


def set_pairs(listed: DataFrame, held: int = 1 << 18, min_rows: int = 1) -> DataFrame:
    """Unordered pairs of different words that share a row of ``words``, with the number of such rows.

    A row's pairs are made by the distance of their sorted words, about ``held`` pairs at a time, so a
    very long row is many small steps. Pairs of fewer than ``min_rows`` rows are left out before
    their words are shown, and words of fewer before their pairs are made. ``listed`` is read more
    than once: pass a written table.
    """
    num = grams.numbered(listed)
    pairs = grams.row_pairs(num, held, min_rows)
    return grams.with_pairs(pairs, num).select("word_a", "word_b", F.col("tf").alias("n"))


def sentence_rows(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sentence, text): the texts cut where a sentence ends."""
    parts = F.split(F.coalesce("text", F.lit("")), "[.!?…]+")
    return docs.select(*keys, F.posexplode(parts).alias("sentence", "text"))
