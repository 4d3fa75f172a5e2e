"""Streams that stop, resume, fail and meet late rows."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from textlab.streaming.ingest import land_activity

SCHEMA = "ts timestamp, club string"


def arrive(spark, path, rows):
    df = spark.createDataFrame([(f"2024-01-{day:02} {time}:00", club) for day, time, club in rows], "ts string, club string")
    df.select(F.col("ts").cast("timestamp").alias("ts"), "club").coalesce(1).write.mode("append").parquet(path)


def counted(spark, out):
    done = spark.read.schema("period timestamp, club string, n long").parquet(out)
    return sorted((r.period.day, r.club, r.n) for r in done.collect())


def test_late_rows_and_open_days(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))

    def run():
        land_activity(spark, src, SCHEMA, out, ckpt, "ts", "club", "1 day", "2 hours", files_per_batch=1)

    arrive(spark, src, [(1, "10:00", "a"), (1, "23:00", "a"), (2, "00:30", "b")])
    run()
    # the second day has begun, but rows of the first may still come
    assert counted(spark, out) == []
    arrive(spark, src, [(1, "22:50", "a"), (1, "01:00", "b"), (2, "03:00", "a")])
    run()
    assert counted(spark, out) == [(1, "a", 3), (1, "b", 1)]
    # a row of a day that was written is left out, those of open days count
    arrive(spark, src, [(1, "12:00", "a"), (2, "04:00", "a"), (3, "09:00", "c")])
    run()
    run()
    assert counted(spark, out) == [(1, "a", 3), (1, "b", 1), (2, "a", 2), (2, "b", 1)]


def test_a_failed_batch_is_repeated_once(spark, tmp_path):
    src, ckpt, wall = (str(tmp_path / d) for d in ("in", "ckpt", "wall"))
    out = f"{wall}/out"
    arrive(spark, src, [(1, "10:00", "a"), (1, "11:00", "a")])
    arrive(spark, src, [(2, "10:00", "a"), (5, "11:00", "b")])
    (tmp_path / "wall").write_text("no folder")
    with pytest.raises(StreamingQueryException):
        land_activity(spark, src, SCHEMA, out, ckpt, "ts", "club", files_per_batch=1)
    (tmp_path / "wall").unlink()
    for _ in range(2):
        land_activity(spark, src, SCHEMA, out, ckpt, "ts", "club", files_per_batch=1)
        assert counted(spark, out) == [(1, "a", 2), (2, "a", 1)]
