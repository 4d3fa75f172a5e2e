"""The corpus chain end to end: landed pages and statements to metrics, style and terms.

Texts are kept apart from their (text, author) rows; two authors of one club share a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.functions import markup as M
from textlab.operators import corpus as C, metrics as G, terms as T
from textlab.plans.corpus_queries import _STYLE, rules, tfidf_sql
from textlab.plans.oracle import PARTS, quoted, sql
from textlab.plans.registry import Registry, rounded
from textlab.plans.tables import Tables
from textlab.sources.sinks import materialise

Q = Registry()
GROUP = ["club", "source"]
CHAIN_BLOCKS = {"first": ["club0", "club1"], "second": ["club2", "club4"]}

CLEAN_SQL = (
    "SELECT 'interp_' || CAST(page_id AS VARCHAR) AS doc_id, text FROM ({clean})"
    " UNION ALL SELECT 'trans_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text FROM conversations"
    " WHERE role <> 'system' AND (conv_id + turn) % 25 NOT IN (0, 3)"
)
AUTHORS_SQL = """
SELECT 'interp_' || CAST(page_id AS VARCHAR) AS doc_id, 'interpelacja' AS source, mp_id, 'club' || CAST(mp_id % 5 AS VARCHAR) AS club,
  '2024-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS date, 1.0::DOUBLE / 3 AS weight
FROM (SELECT page_id, unnest([page_id % 25, (page_id + 5) % 25]) AS mp_id FROM pages) WHERE mp_id <> 3
UNION ALL SELECT 'trans_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), 'stenogram', (conv_id + turn) % 25,
  'club' || CAST((conv_id + turn) % 25 % 5 AS VARCHAR), '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0'), 1.0::DOUBLE
FROM conversations WHERE role <> 'system' AND (conv_id + turn) % 25 NOT IN (0, 3)
"""


def _clean_pages_sql() -> str:
    from textlab.plans.landing_queries import Q as landing

    return landing["clean_text"].sql


DOCS_SQL = f"SELECT doc_id, 'c' AS club, 'l' AS source, 1.0::DOUBLE AS weight, text FROM ({CLEAN_SQL.format(clean=_clean_pages_sql())})"


def chain_sql(body: str, *needs: str, more: str = "") -> str:
    return sql("", *needs, docs=DOCS_SQL).rstrip() + f",\nauthors AS ({AUTHORS_SQL}){more}\n{body}"


def members(t: Tables) -> DataFrame:
    """One member per nation, five clubs; one member has none."""
    key = F.col("n_nationkey").cast("bigint")
    return t.nation.select(
        key.alias("mp_id"), F.when(key != 3, F.concat(F.lit("club"), (key % 5).cast("string"))).alias("club")
    )


def chain(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(texts, authors): pages as written texts with two members of one club, and a third name
    that is none; conversation turns as statements."""
    day = lambda month, key: F.concat(F.lit(f"2024-{month}-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).cast("date")
    page = F.col("page_id")
    details = t.dealt(t.pages, "page_id").select(
        page.alias("num"),
        F.array((page % 25).cast("string"), ((page + 5) % 25).cast("string"), F.lit("x")).alias("from"),
        day("02", page).alias("sentDate"),
        "html",
    )
    keys = t.conversations.select(
        ((F.col("conv_id") + F.col("turn")) % 25).alias("memberID"),
        F.col("conv_id").alias("proceedingNum"),
        day("01", F.col("conv_id")).alias("date"),
        F.col("turn").alias("statementNum"),
        F.when((F.col("role") != "system") | (F.col("conv_id") % 2 == 0), F.col("role") == "system").alias("unspoken"),
        "text",
    )
    landed = keys.select(F.col("memberID").alias("mp_id"), "proceedingNum", "date", "statementNum", "text")
    spoken = C.spoken_rows(keys.drop("text"), members(t), landed)
    authors = C.written_authors(details, members(t)).unionByName(spoken.select(*C.AUTHOR_COLUMNS))
    # A statement has one speaker, so its row is its text.
    texts = C.written_texts(details, M.clean_text(F.col("html"))).unionByName(spoken.select("doc_id", "text"))
    return texts, authors


_MEASURES = "sentiment fog_index avg_sentence_len".split()


@Q.add(
    "corpus_metrics",
    chain_sql(
        "SELECT a.doc_id, a.source, a.mp_id, a.club, a.date, round(a.weight, 8) AS weight, "
        + ", ".join(f"round({m}, 8) AS {m}" for m in _MEASURES)
        + ", word_count, sentence_count FROM metrics m JOIN authors a ON a.doc_id = m.doc_id",
        "metrics",
    ),
)
def corpus_metrics(t: Tables):
    texts, authors = chain(t)
    return rounded(C.corpus_metrics(texts, authors, t.lexicon, **rules(t)))


@Q.add(
    "corpus_style",
    chain_sql(
        "SELECT club, source, n_docs, " + ", ".join(f"round({c}, 8) AS {c}" for c in _STYLE[1:]) + " FROM cstyle",
        "metrics",
        more=",\ncm AS (SELECT m.* REPLACE (a.club AS club, a.source AS source, a.weight AS weight)"
        " FROM metrics m JOIN authors a ON a.doc_id = m.doc_id)"
        f",\ncstyle AS ({PARTS['style'][0].replace('FROM metrics', 'FROM cm')})",
    ),
)
def corpus_style(t: Tables):
    texts, authors = chain(t)
    per_author = materialise(C.corpus_metrics(texts, authors, t.lexicon, **rules(t)), "corpus-metrics")
    return rounded(G.style_metrics(per_author, GROUP).select(*GROUP, *_STYLE))


def group_counts(t: Tables, folded: bool, per_author: bool = True) -> tuple[DataFrame, DataFrame]:
    texts, authors = chain(t)
    listed = C.lemma_arrays(texts, ["doc_id"], **rules(t), column="lemma" if folded else "token")
    return T.author_word_counts(materialise(listed, "words"), authors, ["source", "club"], per_author), authors


_TERMS = ",\ncounts AS (SELECT a.source, a.club, {word} AS term, {n} AS tf FROM tok t JOIN {who} a ON a.doc_id = t.doc_id GROUP BY ALL)"


@Q.add(
    "corpus_tfidf",
    chain_sql(
        'SELECT "group", term, round(score, 8) AS score, rank, source FROM ranked WHERE rank <= 20',
        "tok",
        more=_TERMS.format(word="t.lemma", n="count(*)", who="authors")
        + ",\n" + tfidf_sql("counts", "", 2, 0.8, 8000).replace("FROM docs", "FROM authors"),
    ),
)
def corpus_tfidf(t: Tables):
    counts, authors = group_counts(t, folded=True)
    return rounded(T.tfidf_top(materialise(counts, "corpus-counts"), authors, "source", "club", 2, 0.8, 8000, 20))


@Q.add(
    "corpus_log_odds",
    chain_sql(
        """SELECT source, term, 'first' AS "group", round(x, 8) AS log_odds FROM o
UNION ALL SELECT source, term, 'second', round(-x, 8) FROM o""",
        "tok",
        more=_TERMS.format(word="t.token", n="count(*)", who="authors")
        + f""",
c AS (SELECT source, CASE WHEN club IN ({quoted(CHAIN_BLOCKS['first'])}) THEN 'a' ELSE 'b' END AS block, term, sum(tf) AS n
  FROM counts WHERE club IN ({quoted(CHAIN_BLOCKS['first'] + CHAIN_BLOCKS['second'])}) GROUP BY ALL HAVING sum(tf) >= 20),
a AS (SELECT * FROM c WHERE block = 'a'), b AS (SELECT * FROM c WHERE block = 'b'),
j AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.term, b.term) AS term,
  coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON a.source = b.source AND a.term = b.term),
v AS (SELECT source, sum(na) AS ta, sum(nb) AS tb, count(*) AS v FROM j GROUP BY 1 HAVING sum(na) > 0 AND sum(nb) > 0),
o AS (SELECT source, term, ln(((na + 1.0) / (ta + v)) / ((nb + 1.0) / (tb + v))) AS x FROM j JOIN v USING (source))""",
    ),
)
def corpus_log_odds(t: Tables):
    counts, _ = group_counts(t, folded=False)
    return rounded(T.log_odds(counts, "source", "club", CHAIN_BLOCKS, min_count=20))


@Q.add(
    "corpus_word_counts",
    chain_sql(
        "SELECT source, club, term, count FROM (SELECT source, club, term, tf AS count, row_number() OVER"
        " (PARTITION BY source, club ORDER BY tf DESC, term) AS r FROM counts) WHERE r <= 50",
        "tok",
        more=_TERMS.format(word="t.token", n="count(*)", who="(SELECT DISTINCT doc_id, source, club FROM authors)"),
    ),
)
def corpus_word_counts(t: Tables):
    """A co-authored text counts once per club."""
    counts, _ = group_counts(t, folded=False, per_author=False)
    return T.top_words(counts, ["source", "club"], 50)
