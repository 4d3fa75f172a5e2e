"""I-Match document fingerprints, from built-in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.llm.common import quantile_splits
from textlab.operators.rows import slice_of

# Share of the lexicon in each randomised subset, in 256ths. Dense subsets tell close texts
# apart, thin ones survive large edits.
SHARES = (*(64,) * 4, *(4,) * 4, *(1,) * 24)
SUBSETS = len(SHARES)
_SEPARATORS = r"[\x00-\x60\x7b-\x7f]+"


def terms(text: Column) -> Column:
    """Distinct terms: lower-cased runs of letters and of all signs beyond ASCII."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _SEPARATORS)), "")


def lexicon(docs: DataFrame, n_docs: int, idf_low: float = 2.0, idf_high: float = 7.0, text_col: str = "text") -> DataFrame:
    """(term, digest, members) of the terms whose ln(n_docs / df) lies in the band.

    ``digest`` stands for the term in the hashes; bit k of ``members`` says whether the term
    is in randomised subset k. A band has at most exp(idf_high) times the mean number of
    distinct terms of a text, however many texts there are: it may be broadcast.
    """
    df = docs.select(F.explode(terms(F.coalesce(text_col, F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, high = n_docs * math.exp(-idf_high), n_docs * math.exp(-idf_low)
    members = sum(
        (F.when(F.substring("sha", 2 * k + 1, 2) < f"{share:02x}", 1 << k).otherwise(0).cast("long") for k, share in enumerate(SHARES)),
        F.lit(0).cast("long"),
    )
    digest = F.conv(F.substring(F.md5("term"), 1, 15), 16, 10).cast("long")
    return df.where(F.col("df").between(low, high)).withColumn("sha", F.sha2("term", 256)).select("term", digest.alias("digest"), members.alias("members"))


def _hashes(ordered: Column) -> Column:
    """Hash of each subset's sorted digests, null for a subset without any.

    Subsets of one share are read from the terms that are in at least one of them.
    """

    def one(terms: Column, bit: Column) -> Column:
        inside = F.filter(terms, lambda t: t["members"].bitwiseAND(bit) != 0)
        joined = F.array_join(F.transform(inside, lambda t: t["digest"].cast("string")), ",")
        return F.substring(F.md5(F.nullif(joined, F.lit(""))), 1, 16)

    def of_share(share: int) -> Column:
        bits = [1 << k for k, s in enumerate(SHARES) if s == share]
        mask, table = F.lit(sum(bits)).cast("long"), F.lit(bits).cast("array<long>")
        some = F.filter(ordered, lambda t: t["members"].bitwiseAND(mask) != 0)
        # an array of one, so that the selection is made once
        return F.element_at(F.transform(F.array(some), lambda terms: F.transform(table, lambda bit: one(terms, bit))), 1)

    return F.concat(*map(of_share, dict.fromkeys(SHARES)))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms of; if there are
    none, 1 for equal fingerprints and 0 else."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(used > 0, equal / used).otherwise(same.cast("double"))


def fingerprints(docs: DataFrame, rows_per_bucket: int = 2_000, max_buckets: int = 32_768, idf_low: float = 2.0, idf_high: float = 7.0) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness; rows as documented.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is that of the next doc_id (equal ids: by text; null ids come first;
    after the last the first). A fingerprint is the list of the subsets' hashes, "-" for
    a subset without terms; a text without any lexicon term has the hash of all its
    terms. Null texts count as empty; repeated rows are documents of their own; other
    columns are not read. An empty table gives none.

    The texts cross the network once, dealt by ranges of doc_id; the first row of a range
    is also sent to the range before it, so that a window within a range sees every next
    text. Terms are told from the rest by a broadcast lexicon of bounded size.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_docs = docs.count()
    splits = quantile_splits(docs, "doc_id", max(1, min(max_buckets, n_docs // rows_per_bucket)))
    placed = docs.withColumn("bucket", slice_of(F.col("doc_id"), splits))
    heads = (
        placed.groupBy("bucket")
        .agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("unnamed"))
        .orderBy("bucket")
        .collect()
    )
    first, before = [None] * (len(splits) + 1), [0] * (len(splits) + 1)
    for k, r in enumerate(heads):
        first[r["bucket"]] = None if r["unnamed"] else r["first"]
        before[r["bucket"]] = heads[k - 1]["bucket"]
    at = F.col("bucket") + 1
    is_head = F.element_at(F.lit(first).cast("array<long>"), at).eqNullSafe(F.col("doc_id"))
    guest = F.element_at(F.lit(before).cast("array<int>"), at)
    own_place = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    places = F.when(is_head, F.array(own_place, F.struct(guest.alias("bucket"), F.lit(1).alias("guest")))).otherwise(F.array(own_place))
    dealt = placed.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.bucket", "p.guest")

    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    texts = dealt.select(
        "bucket", "guest", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next")
    ).select("bucket", "guest", "place", "doc_id", n_chars.cast("long").alias("n_chars"), "text", edited.alias("edited"))

    split = texts.select(
        "bucket", "place", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"),
        terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("changed"),
    )

    def all_terms(t: str) -> Column:
        return F.substring(F.md5(F.array_join(F.sort_array(t), " ")), 1, 16)

    # One row per term, as narrow as can be; role 2 carries what the document's row needs besides.
    def roled(t: str, role: int) -> Column:
        return F.transform(t, lambda term: F.struct(F.lit(role).alias("role"), term.alias("term")))

    carried = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("guest", "doc_id", "n_chars", "sha")]
    rest = F.concat_ws(":", *carried, all_terms("own"), all_terms("changed"))
    first_row = F.array(F.struct(F.lit(2).alias("role"), rest.alias("term")))
    rows = split.select(
        "bucket", "place", F.explode(F.concat(first_row, roled("own", 0), roled("changed", 1))).alias("t")
    ).select("bucket", "place", "t.role", "t.term")
    known = rows.join(F.broadcast(lexicon(docs, n_docs, idf_low, idf_high)), "term", "left").where("role = 2 or digest is not null")

    def found(role: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("digest", "members"))))

    per_text = known.groupBy("bucket", "place").agg(
        found(0).alias("own"), found(1).alias("changed"), F.split(F.max(F.when(F.col("role") == 2, F.col("term"))), ":").alias("rest")
    )

    def shown(hashes: str, rest: int) -> Column:
        some = F.exists(hashes, lambda h: h.isNotNull())
        return F.when(some, F.array_join(hashes, ":", "-")).otherwise(F.element_at("rest", rest))

    hashed = per_text.withColumns({"own": _hashes(F.col("own")), "changed": _hashes(F.col("changed"))})
    named = hashed.select(
        "bucket", "place", "own", "changed", F.element_at("rest", 1).alias("guest"),
        F.nullif(F.element_at("rest", 2), F.lit("")).cast("long").alias("doc_id"), F.element_at("rest", 3).cast("long").alias("n_chars"),
        F.element_at("rest", 4).alias("edited_sha256"), shown("own", 5).alias("fingerprint"), shown("changed", 6).alias("edited_fingerprint"),
    )
    in_order = Window.partitionBy("bucket").orderBy("place")
    seen = named.withColumn("following", F.lead(F.struct("own", "fingerprint")).over(in_order)).where("guest = '0'")
    return seen.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("changed"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("own"), F.col("following.own"), F.col("fingerprint") == F.col("following.fingerprint")).alias("near_next"),
    )


def sql(idf_low: float = 2.0, idf_high: float = 7.0) -> str:
    """The same in DuckDB's SQL."""
    bounds = ", ".join(f"'{s:02x}'" for s in SHARES)
    words = r"list_distinct(list_filter(string_split_regex(lower({0}), '[\x00-\x60\x7b-\x7f]+'), lambda w: w <> ''))"
    return rf"""
WITH d AS (
  SELECT row_number() OVER o AS place, doc_id, text, length(text) AS n,
    coalesce(lead(text) OVER o, first_value(text) OVER o) AS next
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
  WINDOW o AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT *, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM d
), t AS (
  SELECT place, 0 AS role, {words.format("text")} AS ws FROM e
  UNION ALL SELECT place, 1, {words.format("edited")} FROM e
), lex AS (
  SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS digest, sha256(term) AS sha
  FROM (SELECT unnest(ws) AS term FROM t WHERE role = 0) GROUP BY term
  HAVING count(*) BETWEEN (SELECT count(*) FROM d) * exp(-{idf_high}) AND (SELECT count(*) FROM d) * exp(-{idf_low})
), member AS (
  SELECT term, digest, k FROM lex, (SELECT unnest(range({SUBSETS})) AS k) WHERE substr(sha, 2 * k::INT + 1, 2) < [{bounds}][k + 1]
), hashed AS (
  SELECT place, role, k, substr(md5(string_agg(digest::VARCHAR, ',' ORDER BY digest)), 1, 16) AS h
  FROM (SELECT place, role, unnest(ws) AS term FROM t) JOIN member USING (term) GROUP BY place, role, k
), grid AS (
  SELECT t.place, t.role, list(h ORDER BY g.k) AS hs, any_value(substr(md5(array_to_string(list_sort(t.ws), ' ')), 1, 16)) AS plain
  FROM t CROSS JOIN (SELECT unnest(range({SUBSETS})) AS k) g LEFT JOIN hashed USING (place, role, k) GROUP BY t.place, t.role
), f AS (
  SELECT place, role, hs, CASE WHEN len(list_filter(hs, lambda h: h IS NOT NULL)) > 0
    THEN array_to_string(list_transform(hs, lambda h: coalesce(h, '-')), ':') ELSE plain END AS fp FROM grid
), x AS (
  SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, o.fp AS fingerprint, c.fp AS edited_fingerprint,
    o.hs AS own, c.hs AS changed, nx.hs AS following, nx.fp AS next_fp
  FROM e JOIN f o ON o.place = e.place AND o.role = 0 JOIN f c ON c.place = e.place AND c.role = 1
  JOIN f nx ON nx.role = 0 AND nx.place = CASE WHEN e.place = (SELECT max(place) FROM d) THEN 1 ELSE e.place + 1 END
)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(list_filter(list_zip(own, changed), lambda p: p[1] IS NOT NULL OR p[2] IS NOT NULL)) > 0
    THEN len(list_filter(list_zip(own, changed), lambda p: p[1] = p[2])) / len(list_filter(list_zip(own, changed), lambda p: p[1] IS NOT NULL OR p[2] IS NOT NULL))
    ELSE (fingerprint = edited_fingerprint)::INT::DOUBLE END AS near_edited,
  CASE WHEN len(list_filter(list_zip(own, following), lambda p: p[1] IS NOT NULL OR p[2] IS NOT NULL)) > 0
    THEN len(list_filter(list_zip(own, following), lambda p: p[1] = p[2])) / len(list_filter(list_zip(own, following), lambda p: p[1] IS NOT NULL OR p[2] IS NOT NULL))
    ELSE (fingerprint = next_fp)::INT::DOUBLE END AS near_next
FROM x
"""
