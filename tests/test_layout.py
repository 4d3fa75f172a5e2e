"""Clustered files: the same rows from few of the files."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from textlab.sources.layout import read_clustered, write_clustered

SCHEMA = "club string, day date, n int"


def made(spark, n=20_000):
    rng = random.Random(5)
    clubs = [f"club{k:02}" for k in range(30)]
    rows = [(rng.choice(clubs), date(2020, 1, 1) + timedelta(rng.randrange(1_000)), i) for i in range(n)]
    return spark.createDataFrame(rows + [(None, date(2020, 5, 5), -1), ("club01", None, -2)], SCHEMA).repartition(4)


def test_few_files_are_read(spark, tmp_path):
    df = made(spark)
    path = write_clustered(df, str(tmp_path / "z"), ["club", "day"], 100)
    every = spark.read.schema(SCHEMA).parquet(path)
    assert every.count() == 20_002 and len(every.inputFiles()) > 80
    low, high = date(2021, 3, 1), date(2021, 5, 1)
    found = read_clustered(spark, path, SCHEMA, {"club": ("club03", "club05"), "day": (low, high)})
    want = df.where(F.col("club").between("club03", "club05") & F.col("day").between(low, high))
    assert sorted(r.n for r in found.collect()) == sorted(r.n for r in want.collect()) and found.count() > 50
    assert len(found.inputFiles()) < len(every.inputFiles()) / 10
    # one column alone also leaves most files unread
    one = read_clustered(spark, path, SCHEMA, {"day": (None, date(2020, 2, 1))})
    assert one.count() == df.where(F.col("day") <= date(2020, 2, 1)).count() and len(one.inputFiles()) < len(every.inputFiles()) / 4
    assert read_clustered(spark, path, SCHEMA, {"club": ("x", None)}).count() == 0


def test_hot_values_and_no_rows(spark, tmp_path):
    hot = spark.range(5_000).select(F.lit("one").alias("club"), F.lit(date(2020, 1, 1)).alias("day"), F.col("id").cast("int").alias("n"))
    path = write_clustered(hot, str(tmp_path / "hot"), ["club", "day"], 8)
    found = read_clustered(spark, path, SCHEMA, {"club": ("one", "one")})
    assert found.count() == 5_000 and len(found.inputFiles()) == 8
    path = write_clustered(hot.limit(0), str(tmp_path / "none"), ["club", "day"], 8)
    assert read_clustered(spark, path, SCHEMA, {"club": ("one", "one")}).count() == 0
