"""Ranked search, against scores of every pair and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from conftest import SMALL
from textlab.llm import ranked
from textlab.llm.registry import QUERIES, SQL


def plain_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def brute(items, docs, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    with_terms = [c for _, c in held if c]
    n_docs, n_terms = len(with_terms), sum(sum(c.values()) for c in with_terms)
    df = Counter(t for c in with_terms for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in held:
            score = 0
            for t in set(plain_terms(text)):
                if c[t]:
                    m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def check(spark, items, docs, k=5, **options):
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(4)
    got = ranked.search(queries, frame, k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == brute(items, docs, k)
    return rows


def made(rng, n, vocabulary, most):
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(rng.randrange(n), " ".join(rng.choices(vocabulary, weights, k=rng.randrange(most)))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"max_items": 7}, {"max_terms": 40, "rows": 50}])
def test_against_all_pairs(spark, options):
    rng = random.Random(1)
    vocabulary = [f"w{k}é" if k % 3 else f"W{k}" for k in range(120)]
    docs = made(rng, 400, vocabulary, 60) + [(1000 + k, "tie tie w1é") for k in range(20)]
    items = made(rng, 40, vocabulary, 12) + [(77, "Tie"), (78, "nowhere")]
    assert len(check(spark, items, docs, **options)) > 150


def test_odd_rows(spark):
    docs = [(3, None), (None, "alpha beta"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, ""), (6, "-- !"), (7, "Alpha " * 20_000 + "end"), (8, "ÄRGER\x85x a_b"), (9, "ärger")]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta end"), (None, "ÄRGER\x85x b"), (2, None), (3, ""), (4, "ALPHA beta alpha")]
    rows = check(spark, items, docs, k=4)
    assert any(r[2] is None for r in rows) and any(r[0] is None for r in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(items, "item_id int, text string")
    assert ranked.search(some, empty).count() == 0
    assert ranked.search(some.limit(0), spark.createDataFrame(docs, "doc_id long, text string")).count() == 0


def test_pairs_of_nodes_are_left():
    """Documents of other themes are never scored once an item has its k."""
    rng = np.random.default_rng(2)
    n_themes, per = 16, 30
    columns = [np.sort(rng.choice(per, 8, replace=False) + per * (i % n_themes)) for i in range(128)]
    weights = rng.integers(100, 9_000, n_themes * per)
    search = ranked.Search(ranked.ItemTree(columns, weights), 10)
    n = 4_096
    values = np.zeros((n, n_themes * per), np.int32)
    for d in range(n):
        values[d, rng.choice(per, 10, replace=False) + per * rng.integers(n_themes)] = rng.integers(1, 1_000_000, 10)
    for at in range(0, n, 1_024):
        search.block(values[at : at + 1_024], values[at : at + 1_024].astype(np.float32), list(range(at, at + 1_024)))
    assert search.scored < 0.25 * len(columns) * n
    for place, own in enumerate(search.tree.items):
        scores = values[:, own].astype(np.int64) @ weights[own]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:10]
        assert [(s, i) for s, _, i in search.best.rows[place]] == want


def test_query_against_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found = con.execute(SQL["op12_dual_tree"])
    names = [d[0] for d in found.description]
    ours = QUERIES["op12_dual_tree"](spark, SMALL)
    assert sorted(ours.columns) == sorted(names)
    rows = sorted(map(tuple, ours.select(names).collect()))
    assert rows == sorted(found.fetchall()) and len(rows) > 1_000
