"""Readers, writers and streams on small landed files."""

import json

import pytest
from pyspark.sql import functions as F

from textlab.sources import readers as R, schemas, sinks as S
from textlab.streaming.ingest import activity_stream, land_new_files


def test_pretty_printed_array(spark, tmp_path):
    (tmp_path / "clubs.json").write_text(json.dumps([{"id": "A", "membersCount": 3}, {"id": "B"}], indent=2))
    df = R.read_json_arrays(spark, str(tmp_path), schemas.CLUBS, multiline=True)
    assert sorted((r.id, r.membersCount) for r in df.collect()) == [("A", 3), ("B", None)]


def test_object_files_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "7.json").write_text('{"mp_num": 7, "name": "Ż"}')
    (tmp_path / "8.json").write_text("not json")
    tolerant = R.read_json_objects(spark, str(tmp_path), schemas.PROFILE)
    assert [(r.file_num, r.name) for r in tolerant.collect()] == [(7, "Ż")]
    with pytest.raises(Exception):
        R.read_json_objects(spark, str(tmp_path), schemas.PROFILE, strict=True).collect()


def test_csv_round_trip_keeps_quotes_and_blanks(spark, tmp_path):
    given = [('a "b", c', 1), (None, 2), ("  a ", 3), ('x\n"y', 4)]
    df = spark.createDataFrame(given, "t string, id int")
    path = S.write_csv(df, str(tmp_path / "x"), ["t", "id"])
    assert sorted(map(tuple, R.read_csv(spark, path, "t string, id int").collect()), key=lambda r: r[1]) == given
    (tmp_path / "bad.csv").write_text("t,id\nx,1\ny,zwei\n")
    with pytest.raises(Exception, match="MALFORMED"):
        R.read_csv(spark, str(tmp_path / "bad.csv"), "t string, id int").collect()
    assert R.read_csv(spark, str(tmp_path / "bad.csv"), "t string, id int", mode="DROPMALFORMED").collect() == [("x", 1)]


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("dobry\tp\tx\ty\tz\t1.5\nzły\tp\tx\ty\tz\t-2\n")
    assert [(r.word, r.val) for r in R.read_lexicon(spark, str(tmp_path)).collect()] == [("dobry", 1.5), ("zły", -2.0)]


def test_statement_pages_take_keys_from_the_path(spark, tmp_path):
    page = tmp_path / "html_by_mp" / "007-jan" / "p3" / "d2024-01-02" / "s5.html"
    page.parent.mkdir(parents=True)
    page.write_bytes("<p>zdanie\nż</p>".encode() + b"\xff")
    other = tmp_path / "html_by_mp" / "x.html"
    other.write_text("no keys")
    (row,) = R.read_statement_pages(spark, str(tmp_path)).collect()
    assert (row.mp_id, row.proceedingNum, str(row.date), row.statementNum) == (7, 3, "2024-01-02", 5)
    assert row.html == "<p>zdanie\nż</p>"


@pytest.mark.parametrize("value, authors", [("[1, 2]", ["1", "2"]), ("5", ["5"]), ('["7"]', ["7"]), ("", None), (None, None)])
def test_author_list(one, value, authors):
    assert one(lambda x: R.author_list(x.cast("string")), x=value) == authors


def test_partitioned_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, source string")
    path = S.write_parquet(df, str(tmp_path / "p"), ["n", "source"], ["source"])
    assert spark.read.parquet(path).where("source = 'b'").first().n == 2
    pointers = S.pointer_records(spark.createDataFrame([(3, 9)], "mp_id int, num int"), "interpellation", "r")
    assert tuple(pointers.first()) == (3, "interpellation", 9, "r/by_num/9")


def test_stream_lands_each_file_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"n": 1}\n{"n": 2}\n')
    assert land_new_files(spark, src, "n int", out, ckpt) == 2
    assert land_new_files(spark, src, "n int", out, ckpt) == 0
    (tmp_path / "in" / "b.json").write_text('{"n": 3}\n')
    land_new_files(spark, src, "n int", out, ckpt)
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_activity_stream_counts_days(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 12:00:00", "a"), ("2024-01-02 01:00:00", "b"), ("2024-01-09 00:00:00", "b")]
    spark.createDataFrame(rows, "ts string, club string").select(F.col("ts").cast("timestamp").alias("ts"), "club").write.parquet(src)
    stream = activity_stream(spark.readStream.schema("ts timestamp, club string").parquet(src), "ts", "club")
    query = stream.writeStream.format("memory").queryName("activity").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(str(r.period)[:10], r.club): r.n for r in spark.table("activity").collect()}
    assert got == {("2024-01-01", "a"): 2, ("2024-01-02", "b"): 1, ("2024-01-09", "b"): 1}


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert S.shared_dir(spark, "x").startswith(f"{root}/textlab/x-")
    kept = S.materialise(spark.range(3).toDF("n"), "n")
    assert sorted(r.n for r in kept.collect()) == [0, 1, 2]
    assert kept.inputFiles()[0].startswith(f"file://{root}")
