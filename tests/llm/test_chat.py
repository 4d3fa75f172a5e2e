import duckdb
import pytest

from conftest import SMALL
from test_queries import canonical
from textlab.llm import chat

ROWS = [
    (1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi <|im_end|> all", "x"), (1, 2, "bob b.", "é", "x"), (1, 2, "ann", None, "x"), (1, 2, "ann", None, "x"),
    (1, None, "cid", "first", "x"), (1, 9000, None, "who", "x"), (2, 0, "system", "alone", "x"), (None, 3, "ann", "lost", "x"), (None, 1, "bob b.", "too", "x"),
    (3, -5, "ann", "word " * 50_000, "x"), (3, 5_000, "bob b.", "", "x"),
]


def against_sql(frame, block):
    con = duckdb.connect()
    con.register("conversations", frame.toArrow())
    result = con.execute(chat.sql())
    names = [d[0] for d in result.description]
    ours = chat.rotate(frame, block=block)
    assert sorted(ours.columns) == sorted(names)
    theirs, rows = result.fetchall(), ours.collect()
    assert canonical([tuple(r) for r in rows], range(len(names))) == canonical(theirs, [names.index(c) for c in ours.columns])
    return rows


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_matches_sql(spark, block):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, place string")
    rows = against_sql(frame, block)
    assert {(r["conv_id"], r["perspective"]) for r in rows} == {(1, "ann"), (1, "bob b."), (1, "cid"), (None, "ann"), (None, "bob b."), (3, "ann"), (3, "bob b.")}
    against_sql(frame.limit(0), block)


def test_given_conversations(spark):
    rows = against_sql(spark.read.parquet(f"{SMALL}/conversations.parquet"), 2)
    dialogues = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["perspective"], r["place"])):
        text = dialogues.setdefault((r["conv_id"], r["perspective"]), [])
        assert len("".join(text)) == r["start"]
        text.append(r["segment"])
    for r in rows:
        text = "".join(dialogues[r["conv_id"], r["perspective"]])
        if r["speaker"] == r["perspective"]:
            assert r["segment"].startswith("<|im_start|>assistant\n")
            assert "<|im_start|>assistant\n" + text[r["loss_from"] : r["loss_to"]] == r["segment"]
        else:
            assert r["loss_from"] is None and "assistant\n" not in r["segment"][:24]


def test_rendering(spark):
    frame = spark.createDataFrame(ROWS[:4], "conv_id long, turn long, role string, text string, place string")
    rows = chat.rotate(frame).where("perspective = 'bob b.'").orderBy("place").collect()
    assert "".join(r["segment"] for r in rows) == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|> all<|im_end|>\n"
        "<|im_start|>user name=ann\n<|im_end|>\n<|im_start|>assistant\né<|im_end|>\n"
    )


def test_names_stay_apart(spark):
    roles = ["bob b", "bob_b", "bob_20_b", "bob__b", "unknown", None, "_null_", "", "a-é😀", "ann"]
    frame = spark.createDataFrame([(1, i, r, "t", "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string, place string")
    rows = against_sql(frame, 1024)
    shown = {r["speaker"]: r["segment"].split("\n")[0] for r in rows if r["perspective"] == "ann" and r["speaker"] != "ann"}
    assert len(shown) == len(set(shown.values())) == len(roles) - 1
    assert shown["bob_b"].endswith("name=bob__b") and shown["bob b"].endswith("name=bob_20_b") and shown["a-é😀"].endswith("name=a-_c3a9__f09f9880_")
