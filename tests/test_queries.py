"""Registered queries against their SQL, and the shape of their plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from textlab.plans.tables import Tables

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
# Every query of the library that has SQL; those of the optional parts are tested there.
KEYS = [key for key in entry._ALL if key in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def canonical(rows, order):
    def cell(v):
        if isinstance(v, float):
            return None if v != v else round(v, 7) + 0.0
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, key):
    df = entry.queries()[key](spark, SMALL)
    result = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    theirs = result.fetchall()
    ours = [tuple(r) for r in df.collect()]
    assert len(ours) > 0
    assert canonical(ours, range(len(df.columns))) == canonical(theirs, [names.index(c) for c in df.columns])


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[:3] == ["club", "source", "n_docs"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["docs_metrics", "tfidf_top_terms", "log_odds", "corpus_written", "degree_grid", "name_counts"])
def test_plans_have_no_products_and_no_python(spark, key):
    plan = plan_of(entry.queries()[key](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


def test_scans_read_only_the_needed_columns(spark):
    plan = plan_of(entry.queries()["activity_timeline"](spark, SMALL))
    assert "ReadSchema: struct<l_returnflag:string,l_shipdate:timestamp" in plan
    browse = plan_of(entry.queries()["browse"](spark, SMALL))
    assert "PushedFilters: [In(source" in browse or "In(lang" in browse


def test_texts_are_scanned_and_shuffled_once(spark):
    plan = plan_of(entry.queries()["docs_metrics"](spark, SMALL))
    assert plan.count("FileScan parquet") == 1
    assert "text" not in [line for line in plan.split("\n") if "Exchange hashpartitioning" in line][0]


def test_roster_shares_sum_to_one(spark):
    from textlab.operators import roster_report as I

    roster = Tables(spark, SMALL).roster
    for df, column in (
        (I.degree_bins(roster), "p"),
        (I.postgraduate_any(roster), "odsetek"),
        (I.postgraduate_distribution(roster), "odsetek"),
    ):
        assert df.agg({column: "sum"}).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("parts", [None, "5"])
@pytest.mark.parametrize("key", ["kwic", "cooccurrence", "vocab_1_2gram", "tfidf_top_ngrams", "docs_metrics", "tokenize"])
def test_no_shuffle_carries_texts(spark, key, parts):
    """As scanned, texts stay where they are; only dealing them out on demand moves them."""
    if parts:
        spark.conf.set("spark.textlab.partitions", parts)
    try:
        plans = executed_plans(spark, lambda: entry.queries()[key](spark, SMALL).collect())
    finally:
        spark.conf.unset("spark.textlab.partitions")
    carried = [shuffle for plan in plans for shuffle in shuffles(plan) if "text" in shuffle]
    assert all("REPARTITION_BY_NUM" in c for c in carried) if parts else not carried


def test_tfidf_ranks_no_counts_by_channel_alone(spark):
    plans = executed_plans(spark, lambda: entry.queries()["tfidf_top_terms"](spark, SMALL).collect())
    wide = [s for plan in plans for s in shuffles(plan) if "hashpartitioning(source" in s and "tf#" in s]
    assert all("club" in s.split("hashpartitioning(")[1].split(")")[0] or "term" in s.split("hashpartitioning(")[1].split(")")[0] for s in wide)


def executed_plans(spark, run) -> list[str]:
    """Texts of the physical plans of all SQL executions in ``run``."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    listed = store.executionsList()
    return [listed.apply(i).physicalPlanDescription() for i in range(int(before), listed.size())]


def shuffles(plan: str) -> list[str]:
    """Each shuffle with the columns that go into it."""
    out, blocks = [], plan.split("\n\n")
    for block in blocks:
        if "Exchange" in block.split("\n")[0] and "Broadcast" not in block.split("\n")[0]:
            out.append(block)
    return out
