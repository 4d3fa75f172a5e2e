import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from textlab.llm.common import Forest
from textlab.llm.components import components
from textlab.llm.registry import op10_simhash_gray
from textlab.llm.simhash import GrayTree, gray_rank, near_duplicates, near_links, simhash64


def plain(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\né ", max_size=60))
def test_fingerprint(text):
    assert simhash64(text) == plain(text)


def brute(fps, radius):
    fps = np.array(fps, dtype=np.uint64)
    f = Forest(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius)
        f.unite(np.full(len(near), i), near)
    return f.roots(np.arange(len(fps)))


def crowd(n, seed):
    """Random values, some balls of near values and chains between them."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    out = [*rng.integers(0, 1 << 63, n, dtype=np.uint64), *centers]
    for c in centers:
        for _ in range(n // 12):
            c = c ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
            out.append(c)
    return sorted({int(x) for x in out})


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_tree_finds_exactly_the_near_pairs(radius):
    fps = np.array(crowd(300, 1), dtype=np.uint64)
    rank = [int(f) for f in fps]
    for k in (1, 2, 4, 8, 16, 32):
        rank = [r ^ (r >> k) for r in rank]
    fps = fps[np.argsort(rank)]
    found = {(int(a), int(b)) for q, c in GrayTree(fps).search(fps, radius) for a, b in zip(q, c)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius}


def test_gray_rank_steps_by_one_bit(spark):
    rows = spark.range(64).select("id", gray_rank(F.expr("id ^ (id >> 1)")).alias("r")).collect()
    assert [r["r"] + (1 << 63) for r in rows] == [r["id"] for r in rows]


@pytest.mark.parametrize("rows_per_part", [7, 100, 10_000])
def test_components_do_not_depend_on_parts(spark, rows_per_part):
    fps = crowd(240, 2)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, rows_per_part)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    groups, want = {}, {}
    for f, w in zip(signed, brute(fps, 2)):
        groups.setdefault(root.get(f, f), set()).add(f)
        want.setdefault(w, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, groups.values())) > 3


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = components(edges.unionByName(spark.createDataFrame([(None, 5), (7, 7), (900, 901)], "a long, b long"))).collect()
    assert {r["node"]: r["root"] for r in rows} == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_edge_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "x"), (3, text.upper(), "x"), (9, None, None), (8, "", "y"), (7, " \n", "y"), (None, text, "z"), (5, text, "x"),
            (1, "solo", "q"), (2, "w " * 70_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = sorted((r["doc_id"] or -1, r["component_id"]) for r in near_duplicates(df).collect())
    assert out == [(-1, 3), (1, 1), (2, 2), (3, 3), (5, 3), (5, 3), (7, 7), (8, 7), (9, 7)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    """Whole texts and every pair; near copies of some texts are added as further documents."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in op10_simhash_gray(spark, SMALL).collect()}
    ids = sorted(docs)
    prints = [plain(docs[i]) for i in ids]
    roots = brute(prints, 2)
    lowest = {}
    for i, root in zip(ids, roots):
        lowest[root] = min(lowest.get(root, i), i)
    for i, root, fp in zip(ids, roots, prints):
        assert rows[i]["fingerprint"] == f"{fp:016x}" and rows[i]["component_id"] == lowest[root]


def test_near_copies_of_long_texts(spark):
    rng = np.random.default_rng(8)
    texts = []
    for k in range(30):
        words = [f"w{rng.integers(3000)}" for _ in range(2000)]
        for copy in range(4):
            changed = list(words)
            for at in rng.choice(2000, copy * 3, replace=False):
                changed[at] = "x"
            texts.append((4 * k + copy, " ".join(changed)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), rows_per_part=11).collect()}
    roots = brute([plain(t) for _, t in texts], 2)
    want = {i: min(j for j, other in zip(range(120), roots) if other == root) for i, root in zip(range(120), roots)}
    assert got == want and sum(got[i] != i for i in got) > 20
