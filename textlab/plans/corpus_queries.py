"""Text functions, corpus assembly, term statistics and style aggregates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from textlab.functions import text as X
from textlab.functions.values import first_truthy, safe_int
from textlab.operators import corpus as C, extras as K, metrics as G, report as J, terms as T
from textlab.operators import search as I, topics as L
from textlab.operators.names import name_variants
from textlab.operators.stats import box_stats
from textlab.plans.oracle import (
    STOP,
    VOWEL,
    WORD,
    fold_sql,
    keep_sql,
    mention_sql,
    pct_sql,
    quoted,
    sql,
)
from textlab.plans.registry import Registry, rounded
from textlab.plans.tables import BLOCKS, NEEDLES, SPOKEN, STOPWORDS, WRITTEN, Tables
from textlab.sources.layout import read_clustered, write_clustered
from textlab.sources.sinks import materialise, shared_dir

Q = Registry()
GROUP = ["club", "source"]


def rules(t: Tables) -> dict:
    return {"stopwords": STOPWORDS, "names": t.names}


# --- text functions -------------------------------------------------------------------

@Q.add(
    "slugify",
    "SELECT doc_id, CASE WHEN s = '' THEN 'unknown' ELSE left(s, 80) END AS slug FROM (SELECT doc_id,"
    " lower(trim(regexp_replace(strip_accents(text), '[^A-Za-z0-9]+', '-', 'g'), '-')) AS s FROM documents)",
)
def slugify(t: Tables):
    return t.docs.select("doc_id", X.slugify(F.col("text")).alias("slug"))


@Q.add(
    "safe_int",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,"
    " CASE WHEN regexp_full_match(event_type, '[0-9]+') THEN 1 END AS typed,"
    " CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS padded, -user_id AS signed FROM events",
)
def safe_ints(t: Tables):
    padded = F.concat(
        F.when(F.col("user_id") % 3 == 0, "-").otherwise("  "), F.col("user_id").cast("string"), F.lit(" ")
    )
    return t.events.select(
        "event_id",
        safe_int(F.get_json_object("props", "$.k")).alias("k"),
        safe_int(F.col("event_type")).cast("int").alias("typed"),
        safe_int(padded).alias("padded"),
        safe_int(-F.col("user_id")).alias("signed"),
    )


@Q.add(
    "coalesce_keys",
    "SELECT event_id, coalesce(nullif(event_type, 'x'), '') AS kind, CASE WHEN user_id % 2 = 0 THEN"
    " json_extract_string(props, '$.k') ELSE CAST(user_id AS VARCHAR) END AS key FROM events",
)
def coalesce_keys(t: Tables):
    user = F.when(F.col("user_id") % 2 == 0, "").otherwise(F.col("user_id").cast("string"))
    found = first_truthy(F.get_json_object("props", "$.id"), user, F.get_json_object("props", "$.k"))
    return t.events.select("event_id", F.col("event_type").alias("kind"), found.alias("key"))


@Q.add("ascii_fold", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def ascii_fold(t: Tables):
    return t.docs.select("doc_id", X.ascii_fold(F.col("text")).alias("folded"))


@Q.add(
    "tokenize_raw",
    sql("SELECT doc_id, len(w) AS n, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id,"
        f" regexp_extract_all(lower(text), '{WORD}') AS w FROM docs)", "docs"),
)
def tokenize_raw(t: Tables):
    tokens = t.docs.select("doc_id", X.raw_tokens(F.col("text")).alias("w"))
    return tokens.select("doc_id", F.size("w").alias("n"), F.array_join("w", " ").alias("tokens"))


@Q.add("tokenize", sql("SELECT doc_id, pos, token, lemma FROM tok", "tok"))
def tokenize(t: Tables):
    return C.doc_tokens(t.docs, ["doc_id"], **rules(t))


@Q.add(
    "stopword_filter",
    sql(f"SELECT token, count(*) AS n FROM raw_tok WHERE token NOT IN ({STOP}) GROUP BY 1", "raw_tok"),
)
def stopword_filter(t: Tables):
    tokens = t.docs.select(F.explode(X.words(F.col("text"))).alias("w"))
    counts = tokens.groupBy(F.lower("w").alias("token")).agg(F.count("*").alias("n"))
    return counts.where(~F.col("token").isin(list(STOPWORDS)))


@Q.add(
    "fold_token",
    sql(f"SELECT token, {fold_sql('token')} AS lemma FROM (SELECT DISTINCT token || s AS token FROM raw_tok,"
        " (VALUES (''), ('skiego'), ('ami'), ('ejszy'), ('ący')) e(s))", "raw_tok"),
)
def fold_token(t: Tables):
    endings = F.array(*[F.lit(s) for s in ("", "skiego", "ami", "ejszy", "ący")])
    tokens = t.docs.select(F.explode(X.raw_tokens(F.col("text"))).alias("w")).distinct()
    forms = tokens.select(F.explode(F.transform(endings, lambda s: F.concat("w", s))).alias("token"))
    return forms.distinct().select("token", X.fold_token(F.col("token")).alias("lemma"))


@Q.add(
    "syllables",
    sql(f"SELECT DISTINCT token, greatest(1, len(regexp_extract_all(token, '{VOWEL}+'))) AS syllables"
        " FROM raw_tok", "raw_tok"),
)
def syllables(t: Tables):
    tokens = t.docs.select(F.explode(X.words(F.col("text"))).alias("w")).select(F.lower("w").alias("token"))
    return tokens.distinct().select("token", X.syllables(F.col("token")).alias("syllables"))


@Q.add(
    "fog",
    sql("SELECT doc_id, round(fog_index, 8) AS fog_index, round(avg_sentence_len, 8) AS avg_sentence_len,"
        " word_count, sentence_count FROM metrics", "metrics"),
)
def fog(t: Tables):
    return rounded(X.with_fog(t.docs.select("doc_id", "text")).select("doc_id", *X.FOG_COLUMNS))


@Q.add("mentions", sql(f"SELECT doc_id, {mention_sql('the')} AS n FROM docs", "docs"))
def mentions(t: Tables):
    return t.docs.select("doc_id", X.mentions(F.col("text"), "the").alias("n"))


@Q.add(
    "mentions_doc",
    sql("SELECT doc_id, " + ", ".join(f"{mention_sql(n)} AS {n}_cnt" for n in NEEDLES) + " FROM docs", "docs"),
)
def mentions_doc(t: Tables):
    return t.docs.select("doc_id", *[X.mentions(F.col("text"), n).alias(f"{n}_cnt") for n in NEEDLES])


@Q.add("name_variants", sql("SELECT name FROM names", "names"))
def variants(t: Tables):
    return name_variants((t.part, "p_name"), (t.supplier, "s_name"))


@Q.add(
    "canonical_label",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'INDUSTRY' WHEN 'AUTOMOBILE' THEN 'INDUSTRY'"
    " ELSE c_mktsegment END AS segment FROM customer",
)
def canonical_label(t: Tables):
    mapping = {"MACHINERY": "INDUSTRY", "AUTOMOBILE": "INDUSTRY"}
    return t.customer.select("c_custkey", X.canonical_label(F.col("c_mktsegment"), mapping).alias("segment"))


@Q.add(
    "recode",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'Interpelacje' WHEN 'click' THEN 'Stenogramy'"
    " ELSE event_type END AS event_type FROM events",
)
def recode(t: Tables):
    return J.recode(
        t.events.select("event_id", "event_type"), "event_type", {"view": "Interpelacje", "click": "Stenogramy"}
    )


@Q.add(
    "str_trunc",
    "SELECT doc_id, CASE WHEN length(text) > 35 THEN left(text, 32) || '...' ELSE text END AS label FROM documents",
)
def str_trunc(t: Tables):
    return t.documents.select("doc_id", X.str_trunc(F.col("text"), 35).alias("label"))


@Q.add(
    "pct_label",
    f"SELECT l_returnflag, l_linenumber, {pct_sql('n / total')} AS pct0, {pct_sql('n / total', 1)} AS pct1,"
    " l_returnflag || '  (n=' || CAST(n AS VARCHAR) || ')' AS label FROM (SELECT l_returnflag, l_linenumber,"
    " count(*) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2)",
)
def pct_label(t: Tables):
    from textlab.operators.stats import share_of_total

    n = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    return share_of_total(n, "n", "p").select(
        "l_returnflag",
        "l_linenumber",
        X.pct_label(F.col("p")).alias("pct0"),
        X.pct_label(F.col("p"), 1).alias("pct1"),
        X.n_label(F.col("l_returnflag"), F.col("n")).alias("label"),
    )


# --- corpus ---------------------------------------------------------------------------

WRITTEN_SQL = """
SELECT 'interp_' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS doc_id, 'interpelacja' AS source, mp_id,
  club, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, round(1.0::DOUBLE / 3, 8) AS weight,
  l_returnflag || ' ' || l_linestatus AS text
FROM (SELECT *, CAST(unnest([l_suppkey, l_linenumber]) AS BIGINT) AS mp_id FROM lineitem)
JOIN (SELECT s_suppkey AS mp_id, n_name AS club FROM supplier JOIN nation ON n_nationkey = s_nationkey
      WHERE s_acctbal > 0) USING (mp_id)
"""
SPOKEN_SQL = """
SELECT 'trans_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS doc_id, 'stenogram' AS source,
  turn AS mp_id, n_name AS club, '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS date,
  1.0::DOUBLE AS weight, text
FROM conversations JOIN nation ON n_nationkey = turn
WHERE turn > 0 AND role <> 'system' AND n_nationkey <> 3
"""


def written(t: Tables):
    """Line items as co-authored texts: a supplier, a second number and a bad id as authors."""
    details = t.dealt(t.lineitem, "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("num"),
        F.array(
            F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag")
        ).alias("from"),
        F.col("l_shipdate").cast("date").alias("sentDate"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"),
    )
    members = t.supplier.where("s_acctbal > 0").join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    return C.written_rows(
        details, members.select(F.col("s_suppkey").alias("mp_id"), F.col("n_name").alias("club"))
    )


def spoken(t: Tables):
    """Conversation turns as statements, the turn number as speaker."""
    day = F.concat(
        F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0")
    ).cast("date")
    keys = t.conversations.select(
        F.col("turn").alias("memberID"),
        F.col("conv_id").alias("proceedingNum"),
        day.alias("date"),
        F.col("turn").alias("statementNum"),
        # not known for one part of the system turns
        F.when((F.col("role") != "system") | (F.col("conv_id") % 2 == 0), F.col("role") == "system").alias("unspoken"),
        "text",
    )
    members = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("mp_id"),
        F.when(F.col("n_nationkey") != 3, F.col("n_name")).alias("club"),
    )
    texts = keys.select(F.col("memberID").alias("mp_id"), "proceedingNum", "date", "statementNum", "text")
    return C.spoken_rows(keys.drop("text"), members, texts)


@Q.add("corpus_written", WRITTEN_SQL)
def corpus_written(t: Tables):
    return rounded(written(t))


@Q.add("corpus_spoken", SPOKEN_SQL)
def corpus_spoken(t: Tables):
    return rounded(spoken(t))


@Q.add("corpus", f"{WRITTEN_SQL} UNION ALL {SPOKEN_SQL}")
def corpus(t: Tables):
    return rounded(C.corpus(written(t), spoken(t)))


@Q.add("lexicon", sql("SELECT token, round(val, 8) AS val FROM lex", "lex"))
def lexicon(t: Tables):
    return rounded(t.lexicon)


@Q.add(
    "sentiment_doc", sql("SELECT doc_id, round(sentiment, 8) AS sentiment FROM metrics", "metrics")
)
def sentiment_doc(t: Tables):
    return rounded(C.doc_sentiment(t.docs, ["doc_id"], t.lexicon, **rules(t)))


def metrics(t: Tables, *channels: str):
    """Of all texts, or of those in some channels; the choice reaches the scan."""
    docs = t.docs.where(F.col("source").isin(*channels)) if channels else t.docs
    return C.doc_metrics(docs, ["doc_id", "club", "source", "weight"], t.lexicon, **rules(t))


@Q.add(
    "docs_metrics",
    sql("SELECT doc_id, club, source, round(weight, 8) AS weight, round(sentiment, 8) AS sentiment,"
        " round(fog_index, 8) AS fog_index, round(avg_sentence_len, 8) AS avg_sentence_len, word_count,"
        " sentence_count FROM metrics", "metrics"),
)
def docs_metrics(t: Tables):
    return rounded(metrics(t))


# --- term statistics ------------------------------------------------------------------

def unigrams(t: Tables):
    return materialise(T.term_counts(t.docs, ["source", "club"], folded=True, **rules(t)), "term-counts")


def tfidf_sql(counts: str, extra: str, min_df: int, max_df: float, features: int) -> str:
    return (
        f"vocab AS (SELECT source, term, df, n FROM (SELECT *, row_number() OVER"
        f" (PARTITION BY source ORDER BY total DESC, term) AS r FROM"
        f" (SELECT source, term, count(*) AS df, sum(tf) AS total FROM {counts} GROUP BY 1, 2)"
        f" JOIN (SELECT source, count(DISTINCT club) AS n FROM docs GROUP BY 1) USING (source)"
        f" WHERE df >= {min_df} AND df <= {max_df} * n) WHERE r <= {features}),\n"
        f"w AS (SELECT source, club, term{extra}, tf * (ln((n + 1.0) / (df + 1.0)) + 1) AS w"
        f" FROM {counts} JOIN vocab USING (source, term)),\n"
        f"scores_t AS (SELECT source, club, term{extra}, w / sqrt(sum(w * w) OVER"
        f" (PARTITION BY source, club)) AS score FROM w),\n"
        f"ranked AS (SELECT club AS \"group\", term{extra}, score, row_number() OVER"
        f" (PARTITION BY source, club ORDER BY score DESC, term) AS rank, source FROM scores_t)\n"
    )


UNI_SQL = sql("", "docs", "uni").rstrip() + ",\n" + tfidf_sql("uni", "", 5, 0.6, 8000)
GRAM_SQL = sql("", "docs", "grams").rstrip() + ",\n" + tfidf_sql("grams", ", ngram_len", 4, 0.45, 6000)


def top_terms(t: Tables):
    return T.tfidf_top(unigrams(t), t.raw_docs, "source", "club", 5, 0.6, 8000, 20)


def top_ngrams(t: Tables):
    listed = materialise(C.lemma_arrays(t.docs, ["doc_id", "source", "club"], **rules(t)), "words")
    return T.tfidf_top_ngrams(listed, t.raw_docs, "source", "club", 4, 0.45, 6000, 6)


@Q.add(
    "tfidf_top_terms",
    f'{UNI_SQL} SELECT "group", term, round(score, 8) AS score, rank, source FROM ranked WHERE rank <= 20',
)
def tfidf_top_terms(t: Tables):
    return rounded(top_terms(t))


@Q.add(
    "tfidf_top_ngrams",
    f'{GRAM_SQL} SELECT "group", term, ngram_len, round(score, 8) AS score, rank, source FROM ranked WHERE rank <= 6',
)
def tfidf_top_ngrams(t: Tables):
    return rounded(top_ngrams(t))


@Q.add(
    "tfidf_group_mean",
    sql("", "tok").rstrip() + """,
dt AS (SELECT doc_id, club, lemma AS term, count(*) AS tf FROM tok GROUP BY ALL),
vocab AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM dt GROUP BY 1)
  WHERE df >= 5 AND df <= 0.6 * (SELECT count(*) FROM docs) ORDER BY total DESC, term LIMIT 8000),
w AS (SELECT doc_id, club, term, tf * (ln((1.0 + (SELECT count(*) FROM docs)) / (df + 1.0)) + 1) AS w
  FROM dt JOIN vocab USING (term)),
s AS (SELECT club, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS s FROM w),
m AS (SELECT club, term, sum(s) / any_value(n) AS score FROM s JOIN (SELECT club, count(*) AS n FROM docs GROUP BY 1)
  USING (club) GROUP BY 1, 2)
SELECT club AS "group", term, round(score, 8) AS score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY club ORDER BY score DESC, term) AS rank FROM m) WHERE rank <= 15""",
)
def tfidf_group_mean(t: Tables):
    keys = ["doc_id", "club"]
    listed = materialise(C.lemma_arrays(t.docs, keys, **rules(t)), "words")
    return rounded(T.tfidf_group_mean(T.row_term_counts(listed, keys), t.raw_docs, "doc_id", "club"))


def word_count_table(t: Tables):
    return T.top_words(T.term_counts(t.docs, ["source", "club"], **rules(t)), ["source", "club"], 200)


@Q.add(
    "word_counts",
    sql("SELECT source, club, term, count FROM (SELECT *, row_number() OVER"
        " (PARTITION BY source, club ORDER BY count DESC, term) AS r FROM"
        " (SELECT source, club, token AS term, count(*) AS count FROM tok GROUP BY 1, 2, 3)) WHERE r <= 200", "tok"),
)
def word_counts(t: Tables):
    return word_count_table(t)


VOCABULARY_SQL = """SELECT source, term, df, CAST(total AS BIGINT) AS total FROM (SELECT source, term, df, total,
  row_number() OVER (PARTITION BY source ORDER BY total DESC, term) AS r FROM
  (SELECT source, term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (
    SELECT source, doc_id, lemma AS term FROM tok UNION ALL
    SELECT source, doc_id, lemma || ' ' || lead(lemma) OVER (PARTITION BY doc_id ORDER BY pos) FROM tok)
   WHERE term IS NOT NULL GROUP BY 1, 2)
  JOIN (SELECT source, count(*) AS n FROM docs GROUP BY 1) USING (source)
  WHERE df >= 10 AND df <= 0.5 * n) WHERE r <= 4000"""


@Q.add(
    "vocab_1_2gram",
    sql(VOCABULARY_SQL, "tok"),
)
def vocab_1_2gram(t: Tables):
    return gram_vocabulary(t)


def gram_words(t: Tables):
    """The words of every text, written with one folder per channel."""
    return materialise(C.lemma_arrays(t.docs, ["doc_id", "club", "source"], **rules(t)), "words", ["source"])


def gram_vocabulary(t: Tables):
    return L.word_vocabulary(gram_words(t), "source").select("source", "term", "df", "total")


@Q.add(
    "log_odds",
    sql("", "tok").rstrip() + f""",
c AS (SELECT source, CASE WHEN club IN ({quoted(BLOCKS['block_a'])}) THEN 'a' ELSE 'b' END AS block, token AS term,
  count(*) AS n FROM tok WHERE club IN ({quoted(BLOCKS['block_a'] + BLOCKS['block_b'])}) GROUP BY ALL HAVING count(*) >= 60),
a AS (SELECT * FROM c WHERE block = 'a'), b AS (SELECT * FROM c WHERE block = 'b'),
j AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.term, b.term) AS term,
  coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.source = b.source AND a.term = b.term),
v AS (SELECT source, sum(na) AS ta, sum(nb) AS tb, count(*) AS v FROM j GROUP BY 1 HAVING sum(na) > 0 AND sum(nb) > 0),
o AS (SELECT source, term, ln(((na + 1.0) / (ta + v)) / ((nb + 1.0) / (tb + v))) AS x FROM j JOIN v USING (source))
SELECT source, term, 'block_a' AS "group", round(x, 8) AS log_odds FROM o
UNION ALL SELECT source, term, 'block_b', round(-x, 8) FROM o""",
)
def log_odds(t: Tables):
    return rounded(block_odds(t))


def block_odds(t: Tables):
    counts = T.term_counts(t.docs, ["source", "club"], **rules(t))
    return T.log_odds(counts, "source", "club", BLOCKS)


# --- topic models ------------------------------------------------------------------------
# Weights and shares of a fit have no SQL form; what holds for every right fit has.

def topic_fit(t: Tables) -> L.TopicFit:
    return topic_vocabulary_and_fit(t)[1]


def topic_vocabulary_and_fit(t: Tables):
    listed = gram_words(t)
    vocabulary = materialise(L.word_vocabulary(listed, "source"), "gram-vocabulary")
    return vocabulary, L.fit_topics(listed, vocabulary, "source", "club")


@Q.add(
    "lda_fit",
    sql("", "tok").rstrip() + f"""
SELECT source, term, 6 AS topics, total::DOUBLE AS mass FROM ({VOCABULARY_SQL})""",
)
def lda_fit(t: Tables):
    """Occurrences of each term as its topics divide them up: weights less their prior of 1/6."""
    return topic_fit(t).weights.groupBy("source", "term").agg(
        F.count("*").cast("int").alias("topics"), F.round(F.sum(F.col("weight") - 1 / 6), 3).alias("mass")
    )


@Q.add("lda_topics")
def lda_topics(t: Tables):
    return topic_fit(t).topics


@Q.add("lda_topic_mix")
def lda_topic_mix(t: Tables):
    return topic_fit(t).mix


@Q.add(
    "lda_report",
    sql("", "tok").rstrip() + """,
vocab AS (SELECT source, least(12, count(*)) AS terms FROM (""" + VOCABULARY_SQL + """) GROUP BY 1),
clubs AS (SELECT source, club, count(*) AS n FROM docs JOIN vocab USING (source) GROUP BY 1, 2)
SELECT source, club, 6 AS topics, terms * 6 AS terms, 1.0::DOUBLE AS share, 6 AS labels, 21 AS ranks, 0 AS foreign_terms
FROM clubs JOIN vocab USING (source)""",
)
def lda_report(t: Tables):
    """Fit, labels, order and labelled mix of one model, reduced to what holds for any fit:
    six topics per channel and club whose shares add up, with their terms from the vocabulary."""
    vocabulary, fit = topic_vocabulary_and_fit(t)
    labels = L.topic_labels(fit.topics)
    shown = J.topic_mix_labelled(fit.mix, labels)
    order = J.topic_order(fit.mix)
    places = order.groupBy("source").agg(
        (F.sum("topic_ord") - F.count("*") * (F.min("topic_ord") - 1)).cast("int").alias("ranks")
    )
    known = vocabulary.select("source", "term", F.lit(1).alias("_known"))
    terms = (
        fit.topics.join(known, ["source", "term"], "left")
        .groupBy("source")
        .agg(F.count("*").alias("terms"), F.count_if(F.col("_known").isNull()).cast("int").alias("foreign_terms"))
    )
    sums = shown.groupBy("source", "club").agg(
        F.countDistinct("topic").cast("int").alias("topics"),
        F.round(F.sum("proportion"), 6).alias("share"),
        F.countDistinct("topic_lab").cast("int").alias("labels"),
    )
    return sums.join(places, "source").join(terms, "source")


# --- style aggregates -----------------------------------------------------------------

_STYLE = (
    "n_docs sentiment_mean sentiment_median sentiment_std fog_mean fog_median fog_p25 fog_p75 fog_std"
    " words_mean words_median"
).split()


@Q.add(
    "style_metrics",
    sql("SELECT club, source, n_docs, "
        + ", ".join(f"round({c}, 8) AS {c}" for c in _STYLE[1:]) + " FROM style", "style"),
)
def style_metrics(t: Tables):
    per_doc = materialise(metrics(t), "docs-metrics")
    return rounded(G.style_metrics(per_doc, GROUP).select(*GROUP, *_STYLE))


def means(t: Tables, *channels: str):
    return G.style_means(metrics(t, *channels), GROUP)


def dumbbell(t: Tables):
    return G.pivot_channels(means(t, WRITTEN, SPOKEN), "club", "source", "sentiment_mean", WRITTEN, SPOKEN, "delta")


WIDE_SQL = (
    "wide AS (SELECT club, max({v}) FILTER (WHERE source = '" + WRITTEN + "') AS " + WRITTEN
    + ", max({v}) FILTER (WHERE source = '" + SPOKEN + "') AS " + SPOKEN
    + ", max({v}) FILTER (WHERE source = '" + SPOKEN + "') - max({v}) FILTER (WHERE source = '" + WRITTEN
    + "') AS delta FROM style WHERE source IN ('" + WRITTEN + "', '" + SPOKEN + "') GROUP BY 1)\n"
)
DUMBBELL_SQL = sql("", "style").rstrip() + ",\n" + WIDE_SQL.format(v="sentiment_mean")
FOG_SQL = sql("", "style").rstrip() + ",\n" + WIDE_SQL.format(v="fog_mean")
ROUND_WIDE = f"club, round({WRITTEN}, 8) AS {WRITTEN}, round({SPOKEN}, 8) AS {SPOKEN}, round(delta, 8) AS delta"


@Q.add("sentiment_dumbbell", f"{DUMBBELL_SQL} SELECT {ROUND_WIDE} FROM wide")
def sentiment_dumbbell(t: Tables):
    return rounded(dumbbell(t))


_NAME_SUMS = ", ".join(f"CAST(sum({mention_sql(n)}) AS BIGINT) AS {n}" for n in NEEDLES)
NAME_SQL = (
    f"names_t AS (SELECT club, source, {_NAME_SUMS}, CAST(sum(len(regexp_extract_all(text, '{WORD}'))) AS BIGINT)"
    " AS words FROM docs GROUP BY 1, 2)\n"
)


def name_table(t: Tables):
    return G.name_counts(t.docs, "club", "source", list(NEEDLES))


@Q.add(
    "name_counts",
    sql("", "docs").rstrip() + ",\n" + NAME_SQL + "SELECT club, source, "
    + ", ".join(NEEDLES) + ", words, "
    + ", ".join(f"round({n} * 10000.0 / nullif(words, 0), 8) AS {n}_per10k" for n in NEEDLES) + " FROM names_t",
)
def name_counts(t: Tables):
    return rounded(name_table(t))


# --- outline queries on texts -----------------------------------------------------------

@Q.add(
    "kwic",
    sql("", "raw_tok").rstrip() + """,
w AS (SELECT doc_id, pos, token, concat_ws(' ', lag(token, 3) OVER o, lag(token, 2) OVER o, lag(token, 1) OVER o) AS "left",
  concat_ws(' ', lead(token, 1) OVER o, lead(token, 2) OVER o, lead(token, 3) OVER o) AS "right"
  FROM raw_tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, "left", token AS keyword, "right" FROM w WHERE token = 'tion'""",
)
def kwic(t: Tables):
    return C.kwic(t.docs, ["doc_id"], "tion", 3)


@Q.add(
    "cooccurrence",
    sql("""SELECT least(token, other) AS word_a, greatest(token, other) AS word_b, count(*) AS n FROM (
  SELECT token, unnest([lead(token, 1) OVER o, lead(token, 2) OVER o]) AS other FROM tok
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE other IS NOT NULL AND other <> token GROUP BY 1, 2""", "tok"),
)
def cooccurrence(t: Tables):
    return T.cooccurrence(materialise(C.lemma_arrays(t.docs, ["doc_id"], **rules(t), column="token"), "words"), 2)


# Two words of one sentence; a sentence ends with a run of . ! ? …
SENTENCE_SQL = """,
sent AS (SELECT doc_id, unnest(range(len(p))) AS s, unnest(p) AS part FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?…]+') AS p FROM docs)),
st AS (SELECT DISTINCT doc_id, s, lower(w) AS token FROM (SELECT doc_id, s, unnest(regexp_extract_all(part, '{word}')) AS w FROM sent)),
kept AS (SELECT * FROM st WHERE {keep})
SELECT a.token AS word_a, b.token AS word_b, count(*) AS n FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND a.s = b.s AND a.token < b.token
GROUP BY 1, 2 HAVING count(*) >= 3"""


@Q.add("cooccurrence_sentence", sql("", "docs", "names").rstrip() + SENTENCE_SQL.format(word=WORD, keep=keep_sql("token")))
def cooccurrence_sentence(t: Tables):
    """Pairs of words in at least three sentences."""
    sentences = T.sentence_rows(t.docs, ["doc_id"])
    listed = C.lemma_arrays(sentences, ["doc_id", "sentence"], **rules(t), column="token")
    return T.set_pairs(materialise(listed.select("words"), "sentences"), min_rows=3)


@Q.add(
    "cross_ngrams",
    sql("", "tok").rstrip() + """,
l AS (SELECT source, club, lemma, lead(lemma) OVER o AS b, lead(lemma, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY source, club ORDER BY doc_id, pos)),
g AS (SELECT source, club, lemma || ' ' || b AS term, 2 AS ngram_len FROM l UNION ALL SELECT source, club, lemma || ' ' || b || ' ' || c, 3 FROM l)
SELECT source, club, term, ngram_len, count(*) AS tf FROM g WHERE term IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
)
def cross_ngrams(t: Tables):
    """n-grams met twice when a group's texts are read as one."""
    listed = materialise(C.lemma_arrays(t.docs, ["doc_id", "club", "source"], **rules(t)), "lemmas")
    return T.cross_ngram_counts(listed, ["source", "club"], ["doc_id"], min_tf=2)


KEYWORDS_SQL = """(SELECT word FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{word}'))) AS word FROM benchmark)
  ORDER BY length(word) DESC, word LIMIT 1000)"""


@Q.add(
    "kwic_index",
    sql("", "raw_tok").rstrip() + """,
w AS (SELECT doc_id, pos, token, concat_ws(' ', lag(token, 3) OVER o, lag(token, 2) OVER o, lag(token, 1) OVER o) AS "left",
  concat_ws(' ', lead(token, 1) OVER o, lead(token, 2) OVER o, lead(token, 3) OVER o) AS "right"
  FROM raw_tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, "left", token AS keyword, "right" FROM w WHERE token IN """ + KEYWORDS_SQL.format(word=WORD),
)
def kwic_index(t: Tables):
    """The thousand longest words of the items in the context of every text that has them."""
    listed = t.benchmark.select(F.explode(X.raw_tokens(F.col("text"))).alias("word")).distinct()
    words = [r["word"] for r in listed.orderBy(F.desc(F.length("word")), "word").limit(1_000).collect()]
    index = I.build_keyword_index(t.docs, ["doc_id"], shared_dir(t.spark, "keyword-index"))
    return I.keywords_in_context(t.docs, index, words, 3)


def unit_vectors(t: Tables):
    return T.tfidf_top(unigrams(t), t.raw_docs, "source", "club", 5, 0.6, 8000, 20, scores_only=True)


@Q.add(
    "centroid_distance",
    UNI_SQL + """, cen AS (SELECT source, term, sum(score) AS c FROM scores_t GROUP BY 1, 2),
len AS (SELECT source, sqrt(sum(c * c)) AS l FROM cen GROUP BY 1)
SELECT source, club, round(1 - sum(score * c) / any_value(l), 8) AS distance
FROM scores_t JOIN cen USING (source, term) JOIN len USING (source) GROUP BY 1, 2""",
)
def centroid_distance(t: Tables):
    return rounded(K.centroid_distances(unit_vectors(t), "source", "club"))


@Q.add(
    "club_cosine",
    UNI_SQL + """, g AS (SELECT DISTINCT source, club FROM scores_t),
c AS (SELECT a.source, a.club, b.club AS other, sum(a.score * b.score) AS x
  FROM scores_t a JOIN scores_t b ON a.source = b.source AND a.term = b.term AND a.club < b.club GROUP BY 1, 2, 3)
SELECT a.source, a.club, b.club AS other, round(coalesce(x, 0.0), 8) AS cosine
FROM g a JOIN g b ON a.source = b.source AND a.club < b.club
LEFT JOIN c ON c.source = a.source AND c.club = a.club AND c.other = b.club""",
)
def club_cosine(t: Tables):
    return rounded(K.pairwise_cosine(materialise(unit_vectors(t), "vectors"), "source", "club"))


def _axis_sql(matrix: str, n: int) -> str:
    """Leading axis of each source's matrix (i, j, x): by squaring until one direction is left."""
    return f""",
q{n} AS (SELECT 0 AS step, source, i, j, x / sum(CASE WHEN i = j THEN x ELSE 0 END) OVER (PARTITION BY source) AS x
  FROM {matrix} WHERE source IN (SELECT source FROM {matrix} WHERE i = j GROUP BY 1 HAVING sum(x) > 1e-12)
  UNION ALL SELECT step + 1, source, i, j, x / sum(CASE WHEN i = j THEN x ELSE 0 END) OVER (PARTITION BY source)
  FROM (SELECT a.step, a.source, a.i, b.j, sum(a.x * b.x) AS x FROM q{n} a JOIN q{n} b ON a.source = b.source AND a.j = b.i WHERE a.step < 18 GROUP BY ALL)),
c{n} AS (SELECT source, arg_max(i, x) AS c, max(x) AS top FROM q{n} WHERE step = 18 AND i = j GROUP BY 1),
v{n} AS (SELECT source, i, x / sqrt(top) AS v FROM q{n} JOIN c{n} USING (source) WHERE step = 18 AND j = c),
l{n} AS (SELECT source, sum(a.v * x * b.v) AS l FROM {matrix} m JOIN v{n} a USING (source, i) JOIN (SELECT source, i AS j, v FROM v{n}) b USING (source, j) GROUP BY 1),
e{n} AS (SELECT source, sign(first(v ORDER BY -round(abs(v * sqrt(l)), 9), i)) AS s FROM v{n} JOIN l{n} USING (source) GROUP BY 1),
pc{n} AS (SELECT source, i AS club, v * s * sqrt(greatest(l, 0)) AS pc FROM v{n} JOIN l{n} USING (source) JOIN e{n} USING (source))"""


PCA_SQL = UNI_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
gr AS (SELECT DISTINCT source, club FROM scores_t),
dots AS (SELECT a.source, a.club AS i, b.club AS j, sum(a.score * b.score) AS x FROM scores_t a JOIN scores_t b ON a.source = b.source AND a.term = b.term GROUP BY ALL),
grid AS (SELECT p.source, p.club AS i, q.club AS j, coalesce(x, 0.0) AS x FROM gr p JOIN gr q ON p.source = q.source
  LEFT JOIN dots d ON d.source = p.source AND d.i = p.club AND d.j = q.club),
m1 AS (SELECT source, i, j, x - avg(x) OVER (PARTITION BY source, i) - avg(x) OVER (PARTITION BY source, j) + avg(x) OVER (PARTITION BY source) AS x FROM grid)""" + _axis_sql("m1", 1) + """,
m2 AS (SELECT m.source, m.i, m.j, x - coalesce(l * a.v * b.v, 0) AS x FROM m1 m LEFT JOIN l1 USING (source) LEFT JOIN v1 a ON a.source = m.source AND a.i = m.i
  LEFT JOIN v1 b ON b.source = m.source AND b.i = m.j)""" + _axis_sql("m2", 2) + """
SELECT source, club, round(coalesce(a.pc, 0.0), 6) + 0.0 AS pc1, round(coalesce(b.pc, 0.0), 6) + 0.0 AS pc2
FROM gr LEFT JOIN pc1 a USING (source, club) LEFT JOIN pc2 b USING (source, club)"""


@Q.add("club_pca", PCA_SQL)
def club_pca(t: Tables):
    """Positions of the clubs of each channel in a plane of their own."""
    at = K.group_pca(materialise(unit_vectors(t), "vectors"), "source", "club")
    return at.select("source", "club", *((F.round(c, 6) + 0.0).alias(c) for c in ("pc1", "pc2")))


@Q.add(
    "club_pca_center",
    UNI_SQL + """, n AS (SELECT source, count(DISTINCT club) AS clubs, count(DISTINCT club) > 1 AS spread FROM scores_t GROUP BY 1)
SELECT source, clubs, 0.0::DOUBLE AS mean1, 0.0::DOUBLE AS mean2 FROM n""",
)
def club_pca_center(t: Tables):
    """What holds for any such plane: one point per club, around zero."""
    at = K.group_pca(materialise(unit_vectors(t), "vectors"), "source", "club").groupBy("source")
    means = [(F.round(F.avg(f"pc{i}"), 6) + 0.0).alias(f"mean{i}") for i in (1, 2)]
    return at.agg(F.count("*").alias("clubs"), *means)


@Q.add(
    "sentiment_box",
    sql("", "metrics").rstrip() + """,
h AS (SELECT club, quantile_cont(sentiment, 0.25) AS q1, quantile_cont(sentiment, 0.5) AS median,
  quantile_cont(sentiment, 0.75) AS q3, count(*) AS n FROM metrics GROUP BY 1),
j AS (SELECT h.*, sentiment AS x, sentiment BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS near
  FROM metrics JOIN h USING (club))
SELECT club, any_value(n) AS n, round(min(x) FILTER (WHERE near), 8) AS whisker_low, round(any_value(q1), 8) AS q1,
  round(any_value(median), 8) AS median, round(any_value(q3), 8) AS q3,
  round(max(x) FILTER (WHERE near), 8) AS whisker_high, count(*) FILTER (WHERE NOT near) AS outliers FROM j GROUP BY 1""",
)
def sentiment_box(t: Tables):
    scores = C.doc_sentiment(t.docs, ["doc_id", "club"], t.lexicon, **rules(t))
    return rounded(box_stats(materialise(scores, "sentiment"), ["club"], "sentiment"))


@Q.add(
    "sentiment_variance",
    sql("SELECT source, count(*) AS n, round(avg(sentiment), 8) AS mean, round(var_samp(sentiment), 8) AS variance"
        " FROM metrics GROUP BY 1", "metrics"),
)
def sentiment_variance(t: Tables):
    scores = C.doc_sentiment(t.docs, ["doc_id", "source"], t.lexicon, **rules(t))
    return rounded(K.variance_by(scores, "source", "sentiment"))


@Q.add(
    "browse",
    "SELECT doc_id, source, lang, n_chars, text FROM documents WHERE source IN ('src1', 'src2') AND"
    " lang IN ('en', 'fr') AND n_chars BETWEEN 500 AND 5000",
)
def browse(t: Tables):
    condition = (
        F.col("source").isin("src1", "src2")
        & F.col("lang").isin("en", "fr")
        & F.col("n_chars").between(500, 5000)
    )
    return K.browse(
        t.documents, condition, ["doc_id", "source", "lang", "n_chars", "text"], [F.desc("n_chars"), "doc_id"]
    )


@Q.add(
    "browse_dates",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus FROM orders"
    " WHERE o_orderstatus IN ('F', 'O') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'",
)
def browse_dates(t: Tables):
    """Rows of some kinds within a range of days."""
    rows = t.orders.withColumn("day", F.col("o_orderdate").cast("date"))
    condition = F.col("o_orderstatus").isin("F", "O") & F.col("o_orderdate").between(
        F.lit("1995-03-01").cast("timestamp"), F.lit("1995-06-30 23:59:59.999999").cast("timestamp")
    )
    return rounded(K.browse(rows, condition, ["o_orderkey", "day", "o_orderstatus"], ["day", "o_orderkey"]))


@Q.add(
    "browse_clustered",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus, o_custkey FROM orders"
    " WHERE o_custkey BETWEEN 100 AND 160 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'",
)
def browse_clustered(t: Tables):
    """Some customers within a range of days, from files that lie by both."""
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", "o_custkey")
    path = write_clustered(rows, shared_dir(t.spark, "clustered"), ["o_custkey", "day"], 64)
    bounds = {"o_custkey": (100, 160), "day": (date(1995, 3, 1), date(1995, 6, 30))}
    return rounded(read_clustered(t.spark, path, rows.schema, bounds))
