"""Corpus assembly, tokens, sentiment and per-document style metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from textlab.functions.text import (
    FOG_COLUMNS,
    arrow_ascii_fold,
    arrow_fold_token,
    arrow_keep_token,
    arrow_letters,
    arrow_words,
    ascii_fold,
    filtered_tokens,
    fold_token,
    keep_token,
    raw_tokens,
    stopword_list,
    with_fog,
    words,
)
from textlab.functions.values import safe_int, to_bool
from textlab.functions.words import LETTERS
from textlab.operators.joins import lookup_join, small_rows

_SLICE = 1 << 22  # bytes of text, or tokens, taken at a time

AUTHOR_COLUMNS = ["doc_id", "source", "mp_id", "club", "date", "weight"]
CORPUS_COLUMNS = [*AUTHOR_COLUMNS, "text"]


def member_clubs(members: DataFrame) -> DataFrame:
    """mp_id → club for members that have one."""
    return members.where(F.coalesce(F.col("club"), F.lit("")) != "").select("mp_id", "club")


def _written(details: DataFrame, *columns: Column | str) -> DataFrame:
    """Texts with an author, under their document key; ``columns`` are made once per text."""
    return details.where(F.size("from") > 0).select(
        F.concat(F.lit("interp_"), F.col("num").cast("string")).alias("doc_id"), *columns
    )


def _with_authors(texts: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """One row per (text, known author); weight is 1 / number of listed authors.

    Texts stay in place while the counted members may be broadcast.
    """
    authors = texts.select(
        "doc_id",
        F.lit("interpelacja").alias("source"),
        F.col("sentDate").alias("date"),
        (F.lit(1.0) / F.size("from")).alias("weight"),
        *columns,
        F.explode("from").alias("_author"),
    )
    known = authors.withColumn("mp_id", safe_int(F.col("_author"))).where("mp_id is not null")
    return lookup_join(known, member_clubs(members), ["mp_id"]).select(*AUTHOR_COLUMNS, *columns)


def written_authors(details: DataFrame, members: DataFrame) -> DataFrame:
    """One row per (text, known author), without the text.

    ``details``: num, from array<string>, sentDate date.
    """
    return _with_authors(_written(details, "from", "sentDate"), members)


def written_texts(details: DataFrame, clean: Column | None = None) -> DataFrame:
    """(doc_id, text): each text once, from its page in ``html`` by ``clean`` or from ``text``."""
    return _written(details, (F.col("text") if clean is None else clean).alias("text"))


def written_rows(details: DataFrame, members: DataFrame, clean: Column | None = None) -> DataFrame:
    """One row per (text, known author) with the text, which is cleaned before it is copied."""
    text = (F.col("text") if clean is None else clean).alias("text")
    return _with_authors(_written(details, "from", "sentDate", text), members, "text")


def _spoken(index: DataFrame, members: DataFrame) -> DataFrame:
    """Delivered statements of known members; an unknown ``unspoken`` is not delivered."""
    delivered = F.col("unspoken").isNotNull() & ~to_bool(F.col("unspoken"))
    return (
        index.where(delivered & (F.col("memberID") > 0))
        .select(F.col("memberID").alias("mp_id"), "proceedingNum", "date", "statementNum")
        .join(member_clubs(members), "mp_id")
    )


STATEMENT = ["mp_id", "proceedingNum", "date", "statementNum"]


def _statement_id() -> Column:
    return F.concat_ws("_", F.lit("trans"), "proceedingNum", "statementNum")


def spoken_rows(
    index: DataFrame, members: DataFrame, texts: DataFrame, clean: Column | None = None
) -> DataFrame:
    """Delivered statements of known members that have a landed text; weight 1."""
    return _spoken(index, members).join(texts, STATEMENT).select(
        _statement_id().alias("doc_id"),
        F.lit("stenogram").alias("source"),
        "mp_id",
        "club",
        "date",
        F.lit(1.0).alias("weight"),
        (F.col("text") if clean is None else clean).alias("text"),
    )


def corpus(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*CORPUS_COLUMNS)


def lexicon(entries: DataFrame) -> DataFrame:
    """Mean value per lower-cased word."""
    return entries.groupBy(F.lower("word").alias("token")).agg(F.avg("val").alias("val"))


def without_names(df: DataFrame, names: DataFrame | None, column: str = "token") -> DataFrame:
    """Drop rows whose token is a name.

    The name table is closed under folding, so a token is in it, folded or not, exactly
    when its folded form is: one anti-join does both tests.
    """
    if names is None:
        return df
    keyed = names.select(F.col("name").alias("_folded"))
    return lookup_join(
        df.withColumn("_folded", ascii_fold(F.col(column))), keyed, ["_folded"], "left_anti"
    ).drop("_folded")


def vocabulary_filter(df: DataFrame, stopwords=None, names: DataFrame | None = None) -> DataFrame:
    """The token rules applied to any table with a ``token`` column."""
    kept = df.where(keep_token(F.col("token"), stopword_list() if stopwords is None else stopwords))
    return without_names(kept, names)


def doc_tokens(
    docs: DataFrame,
    keys: list[str],
    stopwords=None,
    names: DataFrame | None = None,
    letters: str = LETTERS,
) -> DataFrame:
    """(keys, pos, token, lemma): filtered tokens in text order, one row each."""
    exploded = docs.select(*keys, F.posexplode(words(F.col("text"), letters)).alias("pos", "_w"))
    tokens = exploded.select(*keys, "pos", F.lower("_w").alias("token"))
    return vocabulary_filter(tokens, stopwords, names).withColumn(
        "lemma", fold_token(F.col("token"))
    )


def lemma_arrays(
    docs: DataFrame,
    keys: list[str],
    stopwords=None,
    names: DataFrame | None = None,
    letters: str = LETTERS,
    column: str = "lemma",
) -> DataFrame:
    """(keys, words): the filtered lemmas (or tokens) of each text in order.

    The rules run inside a text's row. A name table that may be broadcast is a set that the rows
    are held against in Arrow batches, so no shuffle carries words. A larger one meets the tokens
    as rows, which are gathered again; so do the rows that share their ``keys``, whose words
    become one row by their places. Texts left without a token keep an empty array.
    """
    stop = stopword_list() if stopwords is None else stopwords
    if names is None:
        kept = filtered_tokens(F.col("text"), stop, letters)
        return docs.select(*keys, (F.transform(kept, lambda w: fold_token(w)) if column == "lemma" else kept).alias("words"))
    few = small_rows(names.select(F.col("name").cast("string")))
    if few is None:
        return _gathered_arrays(docs, keys, stop, names, letters, column)
    known = docs.sparkSession.createDataFrame(few, "name string")
    shared = docs.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    shared_rows = small_rows(shared)
    if shared_rows is None or shared_rows.num_rows:
        if shared_rows is not None:
            shared = F.broadcast(docs.sparkSession.createDataFrame(shared_rows, shared.schema))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        gathered = _gathered_arrays(docs.join(shared, same, "left_semi"), keys, stop, known, letters, column)
        return _arrays_without_names(docs.join(shared, same, "left_anti"), keys, stop, few, letters, column).unionByName(gathered)
    return _arrays_without_names(docs, keys, stop, few, letters, column)


def _arrays_without_names(docs: DataFrame, keys: list[str], stop, names: pa.Table, letters: str, column: str) -> DataFrame:
    """(keys, words) of every row, without the words whose folded form is among ``names``.

    Texts are cut in Arrow batches, a slice of rows at a time; the rules run once per distinct word of a
    slice, whose words then take their form by number. Letters beyond two bytes, and those whose
    lower case hangs on what is around them or is several characters, are cut and lower-cased by Spark.
    """
    plain = arrow_letters(letters)
    text = raw_tokens(F.col("text"), letters) if plain is None else F.make_valid_utf8("text")
    schema = docs.select(*keys).schema.add("words", ArrayType(StringType()))
    known, stopped = names.column(0).combine_chunks().drop_null(), pa.array(sorted(set(stop)), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            size = pc.fill_null(texts.value_lengths() if plain is None else pc.binary_length(texts), 0)
            ends = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // _SLICE)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                part = texts.slice(low, high - low)
                if plain is None:
                    lengths = pc.fill_null(part.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    coded = part.flatten().cast(pa.string()).dictionary_encode()
                    distinct = coded.dictionary
                else:
                    found, lengths = arrow_words(part, plain)
                    coded = found.dictionary_encode()
                    distinct = pc.utf8_lower(coded.dictionary.cast(pa.string()))
                keep = arrow_keep_token(distinct, stopped)
                keep = pc.and_(keep, pc.invert(pc.is_in(arrow_ascii_fold(distinct), value_set=known)))
                shown = arrow_fold_token(distinct) if column == "lemma" else distinct
                code = coded.indices.to_numpy()
                stays = keep.to_numpy(zero_copy_only=False)[code]
                bounds = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], np.cumsum(lengths)])]
                words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), shown.take(pa.array(code[stays])))
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:-1]), words], names=[*keys, "words"])

    return docs.select(*keys, text.alias("_text")).mapInArrow(run, schema)


def _gathered_arrays(docs: DataFrame, keys: list[str], stop, names: DataFrame, letters: str, column: str) -> DataFrame:
    """(keys, words) by way of rows: the tokens meet the names and are gathered by ``keys``."""
    exploded = docs.select(*keys, F.posexplode_outer(words(F.col("text"), letters)).alias("pos", "_w"))
    tokens = exploded.select(*keys, "pos", F.lower("_w").alias("token"))
    keep = F.coalesce(keep_token(F.col("token"), stop), F.lit(False))
    named = names.select(F.col("name").alias("_folded"), F.lit(True).alias("_named"))
    marked = lookup_join(tokens.withColumn("_folded", ascii_fold(F.col("token"))), named, ["_folded"], "left")
    shown = fold_token(F.col("token")) if column == "lemma" else F.col("token")
    wanted = F.when(keep & F.col("_named").isNull(), F.struct("pos", shown.alias("word")))
    in_order = F.array_sort(F.collect_list(wanted))
    return marked.groupBy(*keys).agg(F.transform(in_order, lambda r: r["word"]).alias("words"))


def doc_metrics(
    docs: DataFrame,
    keys: list[str],
    lexicon_words: DataFrame,
    stopwords=None,
    names: DataFrame | None = None,
    letters: str = LETTERS,
) -> DataFrame:
    """Sentiment and readability of every row of ``docs``; rows with equal keys stay apart.

    The token rules are applied to the lexicon, not to the running text: a token scores
    exactly when it is a lexicon word that the rules keep. Texts keep their row even
    without a scored token. The aggregate combines on the map side, so one row per text is
    shuffled. For texts with several authors see ``corpus_metrics``.
    """
    scored = vocabulary_filter(lexicon_words, stopwords, names)
    numbered = docs.select(*keys, "text", F.monotonically_increasing_id().alias("_row"))
    listed = with_fog(numbered, "text", letters, words_as="_list")
    exploded = listed.select(*keys, "_row", *FOG_COLUMNS, F.explode_outer("_list").alias("_w"))
    tokens = exploded.select(*keys, "_row", *FOG_COLUMNS, F.lower("_w").alias("token"))
    return (
        lookup_join(tokens, scored, ["token"], "left")
        .groupBy(*keys, "_row", *FOG_COLUMNS)
        .agg(F.coalesce(F.avg("val"), F.lit(0.0)).alias("sentiment"))
        .drop("_row")
    )


METRICS_COLUMNS = [*AUTHOR_COLUMNS, "sentiment", *FOG_COLUMNS]


def corpus_metrics(texts: DataFrame, authors: DataFrame, lexicon_words: DataFrame, **rules) -> DataFrame:
    """One row per (text, author): each text is measured once, then joined to its authors.

    ``texts``: (doc_id, text), each text once; ``authors``: the corpus columns but the text.
    """
    return authors.join(doc_metrics(texts, ["doc_id"], lexicon_words, **rules), "doc_id").select(*METRICS_COLUMNS)


def author_counts(counts: DataFrame, authors: DataFrame, keys: list[str], per_author: bool = True) -> DataFrame:
    """(keys, term, tf) from term counts of texts (doc_id, term, tf) and their authors.

    A text counts once for each of its authors in a group, or once with ``per_author=False``.
    Authors are counted per (text, group) first, so no text is copied.
    """
    return counts.join(author_groups(authors, keys, per_author), "doc_id").groupBy(*keys, "term").agg(F.sum(F.col("tf") * F.col("_n")).alias("tf"))


def author_groups(authors: DataFrame, keys: list[str], per_author: bool = True) -> DataFrame:
    """(doc_id, keys, _n): how often a text counts in a group."""
    return authors.groupBy("doc_id", *keys).agg((F.count("*") if per_author else F.lit(1)).alias("_n"))


def doc_sentiment(
    docs: DataFrame,
    keys: list[str],
    lexicon_words: DataFrame,
    stopwords=None,
    names: DataFrame | None = None,
    letters: str = LETTERS,
) -> DataFrame:
    scored = vocabulary_filter(lexicon_words, stopwords, names)
    exploded = docs.select(*keys, F.explode_outer(words(F.col("text"), letters)).alias("_w"))
    tokens = exploded.select(*keys, F.lower("_w").alias("token"))
    return (
        lookup_join(tokens, scored, ["token"], "left")
        .groupBy(*keys)
        .agg(F.coalesce(F.avg("val"), F.lit(0.0)).alias("sentiment"))
    )


def kwic(docs: DataFrame, keys: list[str], word: str, width: int = 3, letters: str = LETTERS) -> DataFrame:
    """Each occurrence of a word with its neighbours, cut out of each text's own words."""
    listed = docs.where(F.contains(F.lower("text"), F.lit(word))).select(*keys, raw_tokens(F.col("text"), letters).alias("_w"))
    at = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", i) == word)
    found = listed.where(F.size("_w") > 0).select(*keys, "_w", F.explode(at).alias("pos"))
    before = F.least(F.lit(width), F.col("pos"))
    return found.select(
        *keys,
        "pos",
        F.array_join(F.slice("_w", F.col("pos") - before + 1, before), " ").alias("left"),
        F.lit(word).alias("keyword"),
        F.array_join(F.slice("_w", F.col("pos") + 2, F.lit(width)), " ").alias("right"),
    )
