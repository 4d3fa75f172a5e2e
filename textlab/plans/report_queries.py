"""Report queries on the term, style and topic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.operators import report as J
from textlab.operators.topics import rank_terms, topic_labels
from textlab.plans import corpus_queries as C
from textlab.plans.oracle import sql
from textlab.plans.registry import Registry, rounded
from textlab.plans.tables import NEEDLES, SPOKEN, WRITTEN, Tables

Q = Registry()
CHANNEL_LABELS = {WRITTEN: "Interpelacje", SPOKEN: "Stenogramy"}
_RECODE = f"CASE source WHEN '{WRITTEN}' THEN 'Interpelacje' WHEN '{SPOKEN}' THEN 'Stenogramy' ELSE source END"
STYLE = sql("", "style").rstrip()


@Q.add(
    "report_top_terms",
    f'{C.UNI_SQL} SELECT "group", term, round(score, 8) AS score, rank, source FROM ranked WHERE rank <= 10',
)
def report_top_terms(t: Tables):
    return rounded(J.first_rows(C.top_terms(t), ["source", "group"], "score", "term", 10))


@Q.add(
    "report_top_ngrams",
    f'{C.GRAM_SQL} SELECT "group", term, ngram_len, round(score, 8) AS score, rank, source FROM ranked WHERE rank <= 6',
)
def report_top_ngrams(t: Tables):
    return rounded(J.first_rows(C.top_ngrams(t), ["source", "group"], "score", "term", 6))


@Q.add(
    "delta_top",
    f"{C.DUMBBELL_SQL} SELECT {C.ROUND_WIDE} FROM wide ORDER BY wide.delta DESC NULLS LAST, club LIMIT 1",
)
def delta_top(t: Tables):
    return rounded(J.extreme_row(C.dumbbell(t), "delta", "club"))


def fog_wide(t: Tables):
    """Weighted FOG of two channels; other channels' texts are not read for words, nor any for sentiment."""
    shown = F.when(F.col("source").isin(WRITTEN, SPOKEN), F.col("text"))
    means = C.G.fog_means(t.docs.withColumn("text", shown), C.GROUP)
    return C.G.pivot_channels(means, "club", "source", "fog_mean", WRITTEN, SPOKEN, "delta")


@Q.add("fog_gap", f"{C.FOG_SQL} SELECT {C.ROUND_WIDE} FROM wide ORDER BY wide.delta ASC NULLS LAST, club LIMIT 1")
def fog_gap(t: Tables):
    return rounded(J.extreme_row(fog_wide(t), "delta", "club", largest=False))


@Q.add(
    "dumbbell_long",
    f"{C.DUMBBELL_SQL} SELECT club, 'Interpelacje' AS source, round({WRITTEN}, 8) AS sent, round(delta, 8) AS delta FROM wide"
    f" UNION ALL SELECT club, 'Stenogramy', round({SPOKEN}, 8), round(delta, 8) FROM wide",
)
def dumbbell_long(t: Tables):
    return rounded(J.longer(C.dumbbell(t), ["club", "delta"], CHANNEL_LABELS, "source", "sent"))


@Q.add(
    "sentiment_rank",
    STYLE + f""", m AS (SELECT club, median(sentiment_mean) AS m FROM style GROUP BY 1)
SELECT club, {_RECODE} AS source, round(sentiment_mean, 8) AS sentiment_mean, ord FROM style
JOIN (SELECT club, row_number() OVER (ORDER BY m, club) AS ord FROM m) USING (club)""",
)
def sentiment_rank(t: Tables):
    style = C.means(t).select("club", "source", "sentiment_mean")
    ordered = J.group_order_by_median(style, "club", "sentiment_mean", "ord")
    return rounded(J.recode(ordered, "source", CHANNEL_LABELS))


@Q.add("fog_pivot", f"{C.FOG_SQL} SELECT {C.ROUND_WIDE.replace('AS delta', 'AS diff')} FROM wide")
def fog_pivot(t: Tables):
    return rounded(fog_wide(t).withColumnRenamed("delta", "diff"))


@Q.add(
    "fog_rank",
    sql(f"SELECT club, {_RECODE} AS source, round(fog_median, 8) AS fog_median,"
        " row_number() OVER (PARTITION BY source ORDER BY fog_median, club) AS position FROM style", "style"),
)
def fog_rank(t: Tables):
    per_doc = C.materialise(C.metrics(t), "docs-metrics")
    medians = C.G.style_quantiles(per_doc, ["club", "source"]).select("club", "source", "fog_median")
    ranked = J.rank_within(medians, "source", "fog_median", "club", "position")
    return rounded(J.recode(ranked, "source", CHANNEL_LABELS))


@Q.add(
    "fog_vs_sentiment",
    sql("SELECT club, source, round(fog_mean, 8) AS fog_mean, round(sentiment_mean, 8) AS sentiment_mean,"
        " round(corr(fog_mean, sentiment_mean) OVER (), 8) AS r FROM style", "style"),
)
def fog_vs_sentiment(t: Tables):
    """Pairs of means with their overall correlation (a window over one row per group)."""
    from pyspark.sql import Window

    pairs = C.means(t).select("club", "source", "fog_mean", "sentiment_mean")
    return rounded(pairs.withColumn("r", F.corr("fog_mean", "sentiment_mean").over(Window.partitionBy())))


# --- topic tables: relational stand-ins with the shape of the model output -----------------

def topics(t: Tables):
    """Topic = line number, channel = return flag, term = part name, weight = quantity.

    Quantities are summed per part before the join, so a popular part is a few rows.
    """
    sums = t.lineitem.groupBy(
        F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("topic"), "l_partkey"
    ).agg(F.sum("l_quantity").alias("q"))
    weights = (
        sums.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("source", "topic", F.col("p_name").alias("term"))
        .agg(F.sum("q").alias("weight"))
    )
    return rank_terms(weights)


def mix(t: Tables):
    """Share of a line number in the quantity of a (channel, club)."""
    from pyspark.sql import Window

    sums = t.lineitem.groupBy(
        F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("club"),
        F.col("l_linenumber").alias("topic"),
    ).agg(F.sum("l_quantity").alias("q"))
    total = F.sum("q").over(Window.partitionBy("source", "club"))
    return sums.select("source", "club", "topic", (F.col("q") / total).alias("proportion"))


TOPICS_SQL = """WITH tw AS (SELECT l_returnflag AS source, l_linenumber AS topic, p_name AS term, sum(l_quantity) AS weight
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
topics AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, topic ORDER BY weight DESC, term) AS rank FROM tw)
  WHERE rank <= 12),
labels AS (SELECT source, topic, string_agg(term, ', ' ORDER BY rank) AS label FROM topics WHERE rank <= 4 GROUP BY 1, 2),
mix AS (SELECT source, club, topic, q / sum(q) OVER (PARTITION BY source, club) AS proportion FROM (SELECT l_returnflag AS source,
  l_linestatus AS club, l_linenumber AS topic, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)),
ord AS (SELECT source, topic, m AS mean_prop, row_number() OVER (ORDER BY source, m DESC, topic) AS topic_ord FROM
  (SELECT source, topic, avg(proportion) AS m FROM mix GROUP BY 1, 2))
"""


@Q.add("topic_labels", f"{TOPICS_SQL} SELECT source, topic, label FROM labels")
def labels(t: Tables):
    return topic_labels(topics(t))


@Q.add("topic_order", f"{TOPICS_SQL} SELECT source, topic, round(mean_prop, 8) AS mean_prop, topic_ord FROM ord")
def topic_order(t: Tables):
    return rounded(J.topic_order(mix(t)))


@Q.add(
    "topic_mix_labelled",
    f"""{TOPICS_SQL} SELECT source, topic, club, round(proportion, 8) AS proportion, label, round(mean_prop, 8) AS mean_prop,
  topic_ord, CAST(topic AS VARCHAR) || ': ' || CASE WHEN length(label) > 35 THEN left(label, 32) || '...' ELSE label END AS topic_lab
FROM mix LEFT JOIN labels USING (source, topic) LEFT JOIN ord USING (source, topic)""",
)
def topic_mix_labelled(t: Tables):
    return rounded(J.topic_mix_labelled(mix(t), topic_labels(topics(t))))


@Q.add(
    "topic_terms",
    f"""{TOPICS_SQL} SELECT source, topic, term, round(weight, 8) AS weight, rank, label FROM (SELECT *,
  rank() OVER (PARTITION BY source, topic ORDER BY weight DESC) AS r FROM topics) LEFT JOIN labels USING (source, topic) WHERE r <= 6""",
)
def topic_terms(t: Tables):
    ranked = topics(t)
    return rounded(J.topic_terms(ranked, topic_labels(ranked)))


ODDS_SQL = C.Q["log_odds"].sql


@Q.add(
    "log_odds_top",
    f"""SELECT source, term, "group", log_odds FROM (SELECT *, rank() OVER (PARTITION BY source, "group"
  ORDER BY log_odds DESC) AS r FROM ({ODDS_SQL})) WHERE r <= 15""",
)
def log_odds_top(t: Tables):
    """Ties are judged on the rounded values, as in the written table the report reads."""
    return J.first_rows_with_ties(rounded(C.block_odds(t)), ["source", "group"], "log_odds", 15)


_LONG = " UNION ALL ".join(
    f"SELECT club, {_RECODE} AS source, '{n.title()}' AS name, round({n} * 10000.0 / nullif(words, 0), 8) AS per10k FROM names_t"
    for n in NEEDLES
)


@Q.add("mentions_long", sql("", "docs").rstrip() + ",\n" + C.NAME_SQL + _LONG)
def mentions_long(t: Tables):
    columns = {f"{n}_per10k": n.title() for n in NEEDLES}
    long = J.longer(C.name_table(t), ["club", "source"], columns, "name", "per10k")
    return rounded(J.recode(long, "source", CHANNEL_LABELS))
