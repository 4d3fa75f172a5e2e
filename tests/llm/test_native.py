"""Operators of built-in functions alone, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from textlab.llm import imatch, urls
from textlab.llm.registry import QUERIES, RULES, SQL
from test_queries import canonical, plan_of


def compare(df, table, frame):
    con = duckdb.connect()
    con.register("given", frame.toArrow())
    con.execute(f"create view {table} as select * from given")
    result = con.execute(SQL[df])
    names = [d[0] for d in result.description]
    ours = QUERIES_ON[df](frame)
    assert sorted(ours.columns) == sorted(names)
    theirs = result.fetchall()
    rows = [tuple(r) for r in ours.collect()]
    assert canonical(rows, range(len(names))) == canonical(theirs, [names.index(c) for c in ours.columns])
    return ours, rows


QUERIES_ON = {
    "op3_imatch": lambda f: imatch.fingerprints(f, rows_per_bucket=23),
    "op9_host_reputation": lambda f: urls.judge(f, RULES),
}


def test_imatch_matches_sql(spark):
    compare("op3_imatch", "documents", spark.read.parquet(f"{SMALL}/documents.parquet"))


ODD_TEXTS = [
    (5, "same text here", "x"), (5, "same text here", "x"), (5, "another same text", "x"), (None, "unnamed é", "y"), (7, None, None),
    (7, "", "z"), (-3, "... 12 !?", "z"), (9, "word " * 30_000 + "end", "z"), (None, None, "z"),
]


@pytest.mark.parametrize("rows", [ODD_TEXTS, ODD_TEXTS[:1], ODD_TEXTS[7:8]])
def test_imatch_of_odd_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    _, got = compare("op3_imatch", "documents", frame)
    assert len(got) == len(rows)


def test_imatch_of_many_ranges_with_hot_ids(spark):
    rows = [(1000, f"hot {i % 3} common words", "x") for i in range(60)] + [(i, f"t{i} common words of {i % 7}", "x") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, guest string").repartition(5)
    _, got = compare("op3_imatch", "documents", frame)
    assert len(got) == 260


def test_equal_texts_have_equal_fingerprints(spark):
    rows = QUERIES["op3_imatch"](spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    seen = {}
    for r in rows:
        assert seen.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.8 * len(rows)


URLS = [
    (1, "http://A.example.ORG/es/x?y", 1), (2, "https://example.org/en/12#z", 1), (3, "x://org", 1), (4, "x://org/", 1), (5, None, 1), (6, "no host", 1),
    (7, "http://www.b.com/fr/", 1), (8, "http://b.com/de/1", 1), (9, "http://b.com?/fr/", 1), (10, "http://sub.b.com/en/", 1), (10, "http://sub.b.com/en/", 1),
    (None, "http://c.net", 1), (12, "://", 1), (13, "http://notorg/", 1), (14, "http://example.org.net/es/#", 1), (15, "http://ÉA.org/\n/x", 1), (16, "", 1),
]


@pytest.mark.parametrize("rows", [URLS, URLS[4:6], URLS[11:12]])
def test_urls_of_odd_rows(spark, rows):
    _, got = compare("op9_host_reputation", "pages", spark.createDataFrame(rows, "page_id long, url string, host long"))
    assert len(got) == len(rows)


def test_urls_match_sql(spark):
    _, rows = compare("op9_host_reputation", "pages", spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_rules(spark):
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judge(spark.createDataFrame(URLS, "page_id long, url string, x long"), RULES).collect()}
    assert rows[1] == ("a.example.org", "/es/x", "example.org/es/")
    assert rows[2] == ("example.org", "/en/12", "example.org/en/1")
    assert rows[3] == ("org", "", None) and rows[4] == ("org", "/", "org/")
    assert rows[5] == rows[6] == ("", "", None) and rows[9] == ("b.com", "", None)
    assert rows[13] == ("notorg", "/", None)


def test_empty(spark):
    assert imatch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


@pytest.mark.parametrize("key", ["op3_imatch", "op9_host_reputation"])
def test_no_python_and_narrow_scans(spark, key):
    plan = plan_of(QUERIES[key](spark, SMALL))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "html" not in plan and "lang" not in plan


def test_registered_domains(spark):
    hosts = ["a.co.uk", "x.b.co.uk:80", "www.c.org", "10.0.0.1:8080", "10.0.0.2", "co.uk", "org", "[::1]:80", "", "d.com.au", "e.com"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("*", *(c.alias(n) for n, c in urls.levels_of(F.col("host")).items())).collect()
    assert [(r["domain"], r["suffix"]) for r in got] == [
        ("a.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("c.org", "org"), ("10.0.0.1", "10.0.0.1"), ("10.0.0.2", "10.0.0.2"), ("co.uk", "co.uk"), ("org", "org"),
        ("[::1]", "[::1]"), ("", ""), ("d.com.au", "com.au"), ("e.com", "com"),
    ]
    rows = [(i, f"http://{h}/p", 1) for i, h in enumerate(hosts * 2)] + [(90, "http://x.example.org/es/", 1), (91, "http://q.org/", 1)]
    compare("op9_host_reputation", "pages", spark.createDataFrame(rows, "page_id long, url string, host long"))
