import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from textlab.llm import ann
from textlab.llm.registry import op1_adaptive_scan


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return found / sum(map(len, want.values()))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    got, want = results(op1_adaptive_scan(spark, SMALL)), brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    score = {(q, i): (x[q] * x[i]).sum() for q in want for i in range(len(ids))}
    assert all(abs(s - score[q, i]) < 1e-12 for q, hits in got.items() for i, s in hits)


@pytest.mark.parametrize("scale", [False, True])
def test_many_lists_and_tiles(spark, scale):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 24))[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 24))
    if scale:
        x *= rng.lognormal(0, 1, (3000, 1))
    x[1000:1800] = x[1000]  # a hot vector
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = results(ann.search(df, F.col("vec_id") % 20 == 0, 20, rows_per_tile=64, queries_per_tile=16, sample_rows=1000, rows_per_list=100))
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    assert [i for i, _ in got[1000]][:20] == [i for i, _ in want[1000]] or scale


@pytest.mark.parametrize("sample_rows", [16_384, 1_000])
def test_every_query_gets_all_its_rows(spark, sample_rows):
    """Only some lists are probed, and some hold fewer vectors than are asked for."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((80, 24))[rng.integers(0, 80, 4000)] + 0.45 * rng.standard_normal((4000, 24))
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    distinct = df.selectExpr("vec_id uid", "array(vec_id) ids", "embedding v")
    index = ann.fit(distinct, 4000, 20, sample_rows=sample_rows, rows_per_list=50)
    assert index.probes < len(index.centroids)
    got = results(ann.search(df, F.col("vec_id") % 4 == 0, 20, sample_rows=sample_rows, rows_per_list=50))
    assert {q: len(hits) for q, hits in got.items()} == {q: 20 for q in ids[ids % 4 == 0]}
    want = brute(ids, x, ids[ids % 4 == 0], 20)
    assert recall(got, want) >= 0.95
    # one list of a few vectors after the other, until there are 20
    got = results(ann.search(df.where("vec_id < 90"), F.col("vec_id") % 4 == 0, 20, rows_per_list=5, target=0.0))
    assert {q: len(hits) for q, hits in got.items()} == {q: 20 for q in range(0, 90, 4)}


def table(spark, x):
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))


def test_a_sample_much_smaller_than_the_table(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((500, 32))[rng.integers(0, 500, 50_000)] + 0.4 * rng.standard_normal((50_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = results(ann.search(table(spark, x), F.col("vec_id") % 100 == 0, 20, sample_rows=2_000))
    want = brute(np.arange(50_000), x, range(0, 50_000, 100), 20)
    assert all(len(hits) == 20 for hits in got.values()) and got.keys() == want.keys()
    assert recall(got, want) >= 0.95


def test_results_come_from_the_scan(spark, monkeypatch):
    x = np.random.default_rng(3).standard_normal((300, 16))
    assert len(results(ann.search(table(spark, x), F.col("vec_id") % 20 == 0, 20))) == 15
    monkeypatch.setattr(ann.Tile, "_scan", lambda *args: None)
    assert ann.search(table(spark, x), F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("decay, most", [(0.85, 0.35), (0.93, 0.6)])
def test_scan_abandons_most_pairs(spark, decay, most):
    """Components of falling spread, turned at random: the share of columns read, and what is lost."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    x = (rng.standard_normal((8_000, 64)) * decay ** np.arange(64)) @ turn
    x /= np.linalg.norm(x, axis=1)[:, None]
    distinct = table(spark, x[:2_000]).selectExpr("vec_id uid", "embedding v")
    tile = ann.Tile(x, np.arange(len(x)), ann.fit(distinct, len(x), 20, sample_rows=2_000))
    found = tile.best(x[:50], np.full(50, -np.inf), 21)
    want = np.argsort(-(x[:50] @ x.T), axis=1)[:, :21]
    assert np.mean([len(set(tile.order[p]) & set(w)) for (p, _), w in zip(found, want)]) > 20.5
    assert tile.tested.sum() / (tile.pairs * len(tile.blocks)) < most


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (0, [2.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [1.0, None]),
            (100, [inf, 1.0]), (120, [1.0]), (None, [1.0, 1.0]), (140, []), (160, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 5.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = results(ann.search(df, F.col("vec_id") % 20 == 0, 20))
    assert got == {0: [(1, 2.0), (2, 2.0), (160, -1.5)], 160: [(1, -1.0), (2, -1.0), (0, -1.5)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
