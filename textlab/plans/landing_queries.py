"""Landing-zone transforms, page cleaning and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import markup as M
from textlab.functions.text import collapse_ws
from textlab.operators import landing as B
from textlab.operators.corpus import lexicon
from textlab.operators.rows import with_row_id
from textlab.plans.oracle import sql
from textlab.plans.registry import Registry, rounded
from textlab.plans.tables import Tables
from textlab.sources import readers as R, sinks as S

Q = Registry()
TERM = 10

# --- landed records ---------------------------------------------------------------------

# Orders as proceeding records: JSON texts with dates among values, keys and prose.
PROCEEDINGS = """
SELECT o_orderkey AS num, 0 AS pos,
  '{{"num": ' || CAST(o_orderkey AS STRING) || ', "1999-01-01": 1, "note": "seen 1998-02-02 at noon", "day": "'
    || CAST(CAST(o_orderdate AS DATE) AS STRING) || '", "days": ["'
    || CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS STRING) || '", ["'
    || CAST(CAST(o_orderdate AS DATE) AS STRING) || '"], "said \\\\"2001-01-01", "\\\\"2002-02-02\\\\""]}}' AS json
FROM {orders}
UNION ALL SELECT o_orderkey, 1, '{{"again": "2003-03-03"}}' FROM {orders} WHERE o_orderkey % 5 = 0
"""
DETAILS = """
SELECT o_orderkey AS num,
  CASE WHEN o_orderkey % 2 = 0 THEN '{{"title": "' || o_orderpriority || '"}}'
       ELSE '{{"sittings": [{{"at": "' || CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS STRING)
            || '"}}]}}' END AS json
FROM {orders} WHERE o_orderstatus <> 'P'
"""
_DAY = "CAST(o_orderdate AS DATE)"


@Q.add(
    "extract_dates",
    f"SELECT o_orderkey AS num, strftime({_DAY}, '%Y-%m-%d') || ',' || strftime({_DAY} + INTERVAL 7 DAY, '%Y-%m-%d')"
    " AS dates FROM orders",
)
def dates(t: Tables):
    rows = t.spark.sql(PROCEEDINGS, orders=t.orders).where("pos = 0")
    return B.record_dates(rows).select("num", F.array_join("dates", ",").alias("dates"))


@Q.add(
    "proceeding_days",
    f"SELECT o_orderkey AS num, strftime(unnest(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 1 THEN"
    f" [{_DAY} + INTERVAL 1 DAY] ELSE [{_DAY} + INTERVAL 0 DAY, {_DAY} + INTERVAL 7 DAY] END), '%Y-%m-%d') AS day FROM orders",
)
def proceeding_days(t: Tables):
    return B.proceeding_days(
        t.spark.sql(PROCEEDINGS, orders=t.orders), t.spark.sql(DETAILS, orders=t.orders)
    )


def member_list(t: Tables):
    """Customers as listed members, the id under one of three keys, names partly blank."""
    key = F.col("c_custkey").cast("string")
    part = F.col("c_custkey") % 3
    return t.customer.select(
        F.when(part == 0, key).otherwise("").alias("id"),
        F.when(part == 1, key).alias("alt_id"),
        F.when(part == 2, key).alias("mpId"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("firstLastName"),
        F.lit("").alias("name"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).otherwise("").alias("club"),
    )


def member_details(t: Tables):
    joined = t.customer.where("c_acctbal >= 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("mp_id"),
        F.concat(F.col("c_name"), F.lit(" D")).alias("firstLastName"),
        F.col("c_mktsegment").alias("club"),
        F.col("n_name").alias("districtName"),
        F.lit("").alias("voivodeship"),
        F.lit("1970-05-01").alias("birthDate"),
        F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("birthPlace"),
        F.when(F.col("c_custkey") % 2 == 0, "wyższe").otherwise("").alias("educationLevel"),
        F.lit("średnie").alias("education"),
        F.lit(None).cast("string").alias("profession"),
    )


@Q.add(
    "dim_mp",
    """SELECT c_custkey AS mp_id,
  CASE WHEN c_custkey % 4 <> 0 THEN c_name WHEN c_acctbal >= 0 THEN c_name || ' D' END AS name,
  CASE WHEN c_custkey % 5 <> 0 OR c_acctbal >= 0 THEN c_mktsegment END AS club,
  CASE WHEN c_acctbal >= 0 THEN n_name END AS "districtName",
  CAST(NULL AS VARCHAR) AS voivodeship,
  CASE WHEN c_acctbal >= 0 THEN '1970-05-01' END AS "birthDate",
  CASE WHEN c_acctbal >= 0 THEN 'P' || CAST(c_nationkey AS VARCHAR) END AS "birthPlace",
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'wyższe' ELSE 'średnie' END AS "educationLevel",
  CAST(NULL AS VARCHAR) AS profession
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey <> 0""",
)
def dim_mp(t: Tables):
    return rounded(B.dim_members(member_list(t), member_details(t)))


@Q.add(
    "dim_club",
    """SELECT n_name AS club_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Club ' || CAST(n_nationkey AS VARCHAR) END AS name,
  nullif(count(c_custkey) FILTER (WHERE c_acctbal > 9000), 0) AS "membersCount"
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
)
def dim_club(t: Tables):
    sizes = t.customer.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    clubs = t.nation.join(sizes, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("n_name").alias("id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Club "), F.col("n_nationkey").cast("string")))
        .otherwise("")
        .alias("name"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("membersCount"),
    )
    return B.dim_clubs(clubs)


def supplier_slugs(t: Tables):
    return B.member_slugs(t.supplier.select(F.col("s_suppkey").alias("mp_id"), F.col("s_name").alias("name")))


@Q.add(
    "dim_slug",
    "SELECT s_suppkey AS mp_id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug FROM supplier",
)
def dim_slug(t: Tables):
    return supplier_slugs(t)


def day_files(t: Tables):
    """Each conversation turn as a day file of two statements, some without number or date."""

    def statement(num, member, unspoken):
        return F.struct(
            num.cast("int").alias("num"),
            member.cast("int").alias("memberID"),
            F.col("role").alias("name"),
            F.lit("").alias("function"),
            unspoken.alias("unspoken"),
            F.lit("2024-01-01T10:00:00").alias("startDateTime"),
            F.lit(None).cast("string").alias("endDateTime"),
            F.lit(None).cast("boolean").alias("rapporteur"),
            F.lit(False).alias("secretary"),
        )

    turn = F.col("turn")
    return t.conversations.select(
        F.col("conv_id").cast("int").alias("proceedingNum"),
        F.when(
            turn != 5, F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"))
        ).otherwise("").alias("date"),
        F.array(
            statement(turn * 2, turn, F.lit(False)), statement(turn * 2 + 1, F.lit(0), F.lit(True))
        ).alias("statements"),
    )


INDEX_SQL = """
idx AS (SELECT 10 AS term, CAST(conv_id AS INT) AS "proceedingNum",
  '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS date, CAST(turn * 2 + i AS INT) AS "statementNum",
  CAST(CASE WHEN i = 0 THEN turn ELSE 0 END AS BIGINT) AS "memberID", role AS name, i = 1 AS unspoken
  FROM conversations, (VALUES (0), (1)) s(i) WHERE conv_id <> 0 AND turn <> 5)
"""


@Q.add(
    "statement_index",
    f"""WITH {INDEX_SQL} SELECT term, "proceedingNum", date, "statementNum", "memberID", name,
  CAST(NULL AS VARCHAR) AS function, '2024-01-01T10:00:00' AS "startDateTime", CAST(NULL AS VARCHAR) AS "endDateTime",
  CAST(NULL AS BOOLEAN) AS rapporteur, false AS secretary, unspoken FROM idx""",
)
def statement_index(t: Tables):
    return B.statement_index(day_files(t), TERM)


@Q.add(
    "statement_route",
    f"""WITH {INDEX_SQL} SELECT "proceedingNum", date, "statementNum", CASE WHEN "memberID" > 0 THEN 'html_by_mp/'
  || lpad(CAST("memberID" AS VARCHAR), 3, '0') || '-' || coalesce(lower(replace(s_name, '#', '-')), name)
  ELSE 'html_non_mp' END || '/p' || CAST("proceedingNum" AS VARCHAR) || '/d' || date || '/s'
  || CAST("statementNum" AS VARCHAR) || '.html' AS path
FROM idx LEFT JOIN supplier ON s_suppkey = "memberID" AND s_acctbal > 5000""",
)
def statement_route(t: Tables):
    rich = t.supplier.where("s_acctbal > 5000")
    slugs = B.member_slugs(rich.select(F.col("s_suppkey").alias("mp_id"), F.col("s_name").alias("name")))
    return B.statement_routes(B.statement_index(day_files(t), TERM), slugs)


def text_details(t: Tables):
    """Line items as text records with authors, replies and attachments in one row."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    even = F.col("l_linenumber") % 2 == 0
    attachment = F.struct(
        F.when(flag != "R", F.concat(F.lit("http://files.example/"), flag, F.col("l_orderkey").cast("string")))
        .otherwise("")
        .alias("URL"),
        F.when(even, F.concat(status, F.lit(".pdf"))).alias("name"),
    )
    reply = F.struct(
        F.when(status == "O", F.concat(flag, F.col("l_linenumber").cast("string"))).alias("key"),
        F.array(attachment).alias("attachments"),
    )
    own = F.struct(F.lit("K").alias("key"), F.array(attachment, attachment).alias("attachments"))
    return t.dealt(t.lineitem, "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("num"),
        F.array(F.col("l_suppkey").cast("string"), flag).alias("from"),
        F.array(reply, own).alias("replies"),
    )


@Q.add(
    "author_pointers",
    """SELECT l_suppkey AS mp_id, l_orderkey * 10 + l_linenumber AS num, 'interpellations/by_author_ptr/'
  || CASE WHEN l_suppkey < 1000 THEN lpad(CAST(l_suppkey AS VARCHAR), 3, '0') ELSE CAST(l_suppkey AS VARCHAR) END
  || '-' || lower(replace(s_name, '#', '-')) || '/i' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || '.json' AS ptr_path
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""",
)
def author_pointers(t: Tables):
    return B.author_pointers(text_details(t), supplier_slugs(t), "interpellations", "i")


_NUM = "l_orderkey * 10 + l_linenumber AS num"
_REPLY = "l_returnflag || CAST(l_linenumber AS VARCHAR)"


@Q.add(
    "replies_flat",
    f"""SELECT num, key, 'api/' || CAST(num AS VARCHAR) || '/reply/' || key || '/body' AS url FROM (
  SELECT {_NUM}, 'K' AS key FROM lineitem UNION ALL
  SELECT {_NUM}, {_REPLY} AS key FROM lineitem WHERE l_linestatus = 'O')""",
)
def replies_flat(t: Tables):
    return B.reply_rows(text_details(t), "api")


@Q.add(
    "attachments_flat",
    f"""SELECT num, key, url, name FROM (SELECT {_NUM}, key,
  'http://files.example/' || l_returnflag || CAST(l_orderkey AS VARCHAR) AS url,
  CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus || '.pdf' ELSE 'attachment.bin' END AS name
  FROM (SELECT *, unnest(['K', 'K', CASE WHEN l_linestatus = 'O' THEN {_REPLY} END]) AS key FROM lineitem)
  WHERE l_returnflag <> 'R' AND key IS NOT NULL)""",
)
def attachments_flat(t: Tables):
    return B.attachment_rows(text_details(t))


@Q.add(
    "committee_pairs",
    "SELECT DISTINCT p_brand AS code, CAST(p_size AS BIGINT) AS num FROM part WHERE p_partkey % 4 <> 3",
)
def committee_pairs(t: Tables):
    which, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    entries = t.part.select(
        F.col("p_brand").alias("code"),
        F.when(which == 0, size).alias("num"),
        F.when(which == 1, size).otherwise("").alias("number"),
        F.when(which == 2, size).when(which == 3, "x").alias("id"),
    )
    return B.numbered_pairs(entries, "code", ["num", "number", "id"])


@Q.add(
    "load_summary",
    """SELECT kind, count(*) AS files FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'statement pages'
  WHEN 'N' THEN 'text bodies' ELSE 'other json' END AS kind FROM lineitem) GROUP BY 1
UNION ALL SELECT 'all html', count(*) FROM lineitem WHERE l_returnflag <> 'R'""",
)
def load_summary(t: Tables):
    key = F.col("l_orderkey").cast("string")
    path = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("transcripts/html_by_mp/"), key, F.lit("/s1.html")))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("interpellations/by_num/"), key, F.lit("/body.html")))
        .otherwise(F.concat(F.lit("mp/details/"), key, F.lit(".json")))
    )
    kinds = {
        "statement pages": "html_by_mp/.*[.]html$",
        "text bodies": "by_num/[^/]+/body[.]html$",
        "other json": "[.]json$",
        "all html": "[.]html$",
    }
    return B.load_summary(t.lineitem.select(path.alias("path")), kinds)


@Q.add(
    "pages_distinct_num",
    "SELECT DISTINCT o_custkey AS num FROM orders WHERE o_orderstatus <> 'P' ORDER BY 1",
)
def pages_distinct_num(t: Tables):
    num = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_custkey").cast("string"))
    return B.distinct_numbers(t.orders.select(num.alias("num")), "num")


@Q.add(
    "incremental_antijoin",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)",
)
def incremental_antijoin(t: Tables):
    landed = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") - 40).alias("length"))
    return B.not_landed(t.orders.select("o_orderkey"), landed, ["o_orderkey"])


# --- pages ------------------------------------------------------------------------------

def pages(t: Tables):
    return t.dealt(t.pages, "page_id")


TEXT_SQL = (
    "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g'),"
    " '<[!/?a-zA-Z][^>]*>', chr(10), 'g')"
)
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    TEXT_SQL = f"replace({TEXT_SQL}, '{_entity}', '{_char}')"


@Q.add("html_text", f"SELECT page_id, {TEXT_SQL} AS text FROM pages")
def html_text(t: Tables):
    return pages(t).select("page_id", M.html_text(F.col("html")).alias("text"))


@Q.add(
    "strip_stage",
    "SELECT doc_id, '  ' || text || ' (' || source || ') ' AS text FROM documents",
)
def strip_stage(t: Tables):
    """Texts framed by stage directions and by a harmless parenthesis."""
    framed = F.concat(
        F.lit("(Głosy, OKLASKI "), "source", F.lit(") "), "text", F.lit(" ("), "source",
        F.lit(")"), F.lit("(dzwonek)"),
    )
    return t.dealt(t.documents, "doc_id").select("doc_id", M.strip_stage(framed).alias("text"))


@Q.add(
    "strip_brackets",
    "SELECT doc_id, regexp_replace(lang || ' [' || source || '] ' || text || ' []', '\\[[^\\]]+\\]', ' ', 'g') AS text FROM documents",
)
def strip_brackets(t: Tables):
    framed = F.concat("lang", F.lit(" ["), "source", F.lit("] "), "text", F.lit(" []"))
    return t.dealt(t.documents, "doc_id").select("doc_id", M.strip_brackets(framed).alias("text"))


STARTS, PHRASES = ("the ", "de ", "und"), ("tion the", "er de")
KEPT_SQL = (
    "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(x)),"
    " lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(?:the |de |und)|tion the|er de'))"
)


@Q.add(
    "drop_procedural",
    f"SELECT doc_id, len({KEPT_SQL}) AS lines, array_to_string({KEPT_SQL}, '|') AS kept FROM documents",
)
def drop_procedural(t: Tables):
    kept = t.dealt(t.documents, "doc_id").select(
        "doc_id", M.kept_lines(F.col("text"), starts=STARTS, phrases=PHRASES).alias("k")
    )
    return kept.select("doc_id", F.size("k").alias("lines"), F.array_join("k", "|").alias("kept"))


@Q.add(
    "clean_text",
    "SELECT page_id, trim(regexp_replace(array_to_string(list_filter(list_transform("
    f"regexp_split_to_array(regexp_replace({TEXT_SQL}, '\\[[^\\]]+\\]', ' ', 'g'), '\\r\\n|\\n|\\r'), lambda x: trim(x)),"
    " lambda x: x <> ''), ' '), '\\s+', ' ', 'g')) AS text FROM pages",
)
def clean_text(t: Tables):
    return pages(t).select("page_id", M.clean_text(F.col("html")).alias("text"))


@Q.add(
    "blocked_pages",
    "SELECT page_id, contains(lower(html), 'tion that') OR contains(lower(html), 'ad 7 ') AS blocked FROM pages",
)
def blocked_pages(t: Tables):
    return t.pages.select("page_id", M.is_blocked(F.col("html"), (*M.BLOCKED_MARKERS, "tion THAT", "Ad 7 ")).alias("blocked"))


@Q.add(
    "collapse_ws",
    "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents",
)
def collapse(t: Tables):
    return t.dealt(t.documents, "doc_id").select("doc_id", collapse_ws(F.col("text")).alias("text"))


def _tag_sql(tag: str) -> str:
    inner = f"regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        inner = f"replace({inner}, '{entity}', '{char}')"
    return f"nullif(trim(regexp_replace({inner}, '\\s+', ' ', 'g')), '')"


HEADING_SQL = (
    f"coalesce(CASE WHEN length({_tag_sql('h1')}) <= 40 AND NOT contains({_tag_sql('h1')}, 'que')"
    f" THEN {_tag_sql('h1')} END, {_tag_sql('title')})"
)


@Q.add("page_heading", f"SELECT page_id, {HEADING_SQL} AS name FROM pages")
def page_heading(t: Tables):
    return pages(t).select("page_id", M.page_heading(F.col("html"), 40, "que").alias("name"))


def _label_sql(label: str) -> str:
    return f"nullif(regexp_extract(html, '<li><a [^>]*>{label}</a></li><li><a [^>]*>([^<]*)</a></li>', 1), '')"


@Q.add("label_value", f"SELECT page_id, {_label_sql('The')} AS value FROM pages")
def label_value(t: Tables):
    return pages(t).select("page_id", M.label_value(F.col("html"), "The").alias("value"))


@Q.add(
    "profile_rows",
    f"""SELECT mp_num, url, name, staz_parlamentarny, ukonczona_szkola, CASE WHEN name IS NULL AND
  staz_parlamentarny IS NULL AND ukonczona_szkola IS NULL THEN 'no fields' END AS error FROM (
  SELECT page_id AS mp_num, url, nullif({_tag_sql('h1')}, 'x') AS name, {_label_sql('The')} AS staz_parlamentarny,
    {_label_sql('and')} AS ukonczona_szkola FROM pages)""",
)
def profile_rows(t: Tables):
    return M.profile(pages(t), "page_id", "The", "and", max_len=1_000_000, banned="\x00")


# --- files ------------------------------------------------------------------------------

def folder(t: Tables, name: str) -> str:
    return S.shared_dir(t.spark, name)


CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@Q.add("src_json", CUSTOMER_SQL)
def src_json(t: Tables):
    path = S.write_json_arrays(t.customer, folder(t, "json"), "c_custkey", 100)
    return R.read_json_arrays(t.spark, path, CUSTOMER)


@Q.add(
    "src_json_dir",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(s_suppkey // 50 AS INT) AS file_num FROM supplier",
)
def src_json_dir(t: Tables):
    rows = t.supplier.withColumn("num", F.floor(F.col("s_suppkey") / 50))
    path = S.write_json(rows, folder(t, "json-dir"), ["num"])
    schema = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    return R.read_json_objects(t.spark, path, schema, r"/num=(\d+)/")


@Q.add("src_csv", CUSTOMER_SQL.replace("c_mktsegment", "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN"
    " '  \"' || c_mktsegment || '\",' || chr(10) || ' x ' ELSE c_mktsegment END AS c_mktsegment"))
def src_csv(t: Tables):
    """Some values hold blanks at both ends, quotes, separators and line breaks."""
    odd = F.concat(F.lit('  "'), F.col("c_mktsegment"), F.lit('",\n x '))
    part = F.col("c_custkey") % 9
    rows = t.customer.withColumn("c_mktsegment", F.when(part == 1, odd).when(part != 0, F.col("c_mktsegment")))
    path = S.write_csv(rows, folder(t, "csv"), rows.columns)
    return R.read_csv(t.spark, path, CUSTOMER)


@Q.add("src_tsv_lexicon", sql("SELECT token, round(val, 8) AS val FROM lex", "lex"))
def src_tsv_lexicon(t: Tables):
    blank = F.lit("x")
    entries = t.lexicon_entries.select(
        "word", *[blank.alias(c) for c in ("pos", "emo1", "emo2", "emo3")], "val"
    )
    path = S.write_csv(entries, folder(t, "lexicon"), entries.columns, sep="\t", header=False)
    return rounded(lexicon(R.read_lexicon(t.spark, path)))


PAGE_PATH = r"/num=(\d+)/"


def page_files(t: Tables, name: str):
    """One file per page, its number in the path."""
    rows = pages(t).select(F.col("page_id").alias("num"), F.col("html").alias("value"))
    path = S.write_text_files(rows, folder(t, name), ["num"])
    return R.read_pages(t.spark, path, {"num": PAGE_PATH})


@Q.add("src_html_tree", f"SELECT CAST(page_id AS INT) AS num, {TEXT_SQL} AS text FROM pages")
def src_html_tree(t: Tables):
    files = page_files(t, "html")
    return files.select("num", F.regexp_replace(M.html_text(F.col("html")), r"\n\z", "").alias("text"))


@Q.add(
    "src_pair_details_body",
    "SELECT CAST(page_id AS INT) AS num, url AS title, 2 AS n_authors, length(html) AS size FROM pages WHERE url LIKE 'https%'",
)
def src_pair_details_body(t: Tables):
    schema = "num int, title string, `from` string"
    records = t.pages.where("url LIKE 'https%'").select(
        F.col("page_id").alias("num"),
        F.col("url").alias("title"),
        F.array(F.col("page_id"), F.col("page_id") + 1).alias("from"),
    )
    details = R.read_json_arrays(t.spark, S.write_json(records, folder(t, "details")), schema)
    paired = R.pair_details_bodies(details, page_files(t, "bodies"))
    return paired.select(
        "num",
        "title",
        F.size(R.author_list(F.col("from"))).alias("n_authors"),
        F.length(F.regexp_replace("html", r"\n\z", "")).alias("size"),
    )


@Q.add(
    "sink_csv",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN ' ' || o_orderpriority || chr(10) || '\"' ELSE o_orderpriority END, '')"
    " AS o_orderpriority, o_orderstatus FROM orders",
)
def sink_csv(t: Tables):
    part, odd = F.col("o_orderkey") % 3, F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit('\n"'))
    rows = t.orders.withColumn("o_orderpriority", F.when(part == 1, odd).when(part != 0, F.col("o_orderpriority")))
    path = S.write_csv(rows, folder(t, "sink-csv"), ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    return R.read_csv(t.spark, path, "o_orderkey string, o_orderpriority string, o_orderstatus string")


@Q.add(
    "sink_rowid",
    "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS id, o_orderkey, o_custkey FROM orders",
)
def sink_rowid(t: Tables):
    rows = with_row_id(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("id", "o_orderkey", "o_custkey")
    path = S.write_csv(rows, folder(t, "rowid"), ["id", "o_orderkey", "o_custkey"])
    return R.read_csv(t.spark, path, "id bigint, o_orderkey bigint, o_custkey bigint")


@Q.add("sink_parquet", "SELECT doc_id, text, lang FROM documents")
def sink_parquet(t: Tables):
    path = S.write_parquet(t.documents, folder(t, "parquet"), ["doc_id", "text", "lang"], ["lang"])
    return t.spark.read.schema("doc_id bigint, text string, lang string").parquet(path)


@Q.add(
    "sink_json_ptr",
    f"""SELECT CAST(l_suppkey AS INT) AS mp_id, 'interpellation' AS type, num,
  'interpellations/by_num/' || CAST(num AS VARCHAR) AS target FROM (SELECT l_suppkey, {_NUM} FROM lineitem
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier))""",
)
def sink_json_ptr(t: Tables):
    """Pointer files in one folder per thousand authors, read back with their author."""
    records = S.pointer_records(author_pointers(t), "interpellation", "interpellations")
    path = S.write_json(
        records.withColumn("block", F.floor(F.col("mp_id") / 1000)), folder(t, "ptr"), ["block"]
    )
    return R.read_json_arrays(t.spark, path, "mp_id int, type string, num bigint, target string").select(
        "mp_id", "type", "num", "target"
    )
