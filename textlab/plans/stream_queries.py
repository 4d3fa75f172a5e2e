"""Streams over the given tables as they would land: file by file, stopped and resumed in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.operators.landing import not_landed
from textlab.plans.registry import Registry
from textlab.plans.tables import Tables
from textlab.sources.sinks import shared_dir
from textlab.streaming.ingest import land_activity, land_new_files

Q = Registry()


def _arrive(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


@Q.add(
    "stream_resume",
    "SELECT o_orderkey, o_orderstatus, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS day FROM orders",
)
def stream_resume(t: Tables):
    """Orders land in two deliveries; each run takes the files that no run took before. The second
    delivery brings the orders that the first has not landed."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    schema = "o_orderkey bigint, o_orderstatus string, day string"
    inbox, out, checkpoint = (shared_dir(t.spark, name) for name in ("inbox", "landed", "stream"))
    _arrive(rows.where("o_orderkey % 3 != 1"), inbox)
    land_new_files(t.spark, inbox, schema, out, checkpoint, "parquet")
    landed = t.spark.read.parquet(out).select("o_orderkey", F.lit(1).alias("length"))
    _arrive(not_landed(rows, landed, ["o_orderkey"]), inbox)
    land_new_files(t.spark, inbox, schema, out, checkpoint, "parquet", files_per_batch=1)
    return t.spark.read.parquet(out).select("o_orderkey", "o_orderstatus", "day")


@Q.add(
    "stream_activity",
    """SELECT strftime(period, '%Y-%m-%d %H:%M:%S') AS period, event_type, n FROM (
SELECT date_trunc('day', ts) AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE period + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""",
)
def stream_activity(t: Tables):
    """Events per day and type from files in order of time, two runs: the days that are over."""
    events = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    inbox, out, checkpoint = (shared_dir(t.spark, name) for name in ("inbox", "activity", "stream"))
    cuts = events.agg(F.percentile_approx(F.col("ts").cast("double"), [0.3, 0.6])).first()[0] or [0.0, 0.0]
    second = F.col("ts").cast("double")
    schema = "ts timestamp, event_type string"
    for wanted in (second <= cuts[0], (second > cuts[0]) & (second <= cuts[1]), second > cuts[1]):
        _arrive(events.where(wanted), inbox)
        land_activity(t.spark, inbox, schema, out, checkpoint, "ts", "event_type")
    done = t.spark.read.schema("period timestamp, event_type string, n long").parquet(out)
    return done.select(F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), "event_type", "n")
