"""Spelling variants, against plain loops and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from conftest import SMALL
from textlab.llm import variants
from textlab.llm.registry import QUERIES, SQL


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def ours(frame, **options):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in variants.group(frame, **options).collect())


@pytest.mark.parametrize("every", [97, 2])
def test_against_plain_loops(spark, every):
    rng = random.Random(every)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaab", "Straße", "ÀÿÀÿÀ", "bbbbbbb", "bbbbbbbb"]
    rows = [(rng.randrange(50) if rng.random() < 0.9 else None, " ".join(rng.choices(base, [1 / (k % 7 + 1) ** 2 for k in range(len(base))], k=80)) + rng.choice(["", ", X-RAYED 1a2", None or "!"])) for _ in range(40)]
    rows += [(1, None), (2, ""), rows[0], rows[0]]
    frame = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int")
    want = brute(rows, every)
    assert ours(frame, every=every) == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)


def test_chain_of_forms_and_ties(spark):
    words = {"wordaaaa": 3, "wordaaab": 6, "wordaabb": 12, "wordabbb": 24, "wordbbbb": 48, "tiesame": 4, "tiesama": 9, "tiesamb": 9, "doubble": 3, "double": 7}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    got = {r[0]: r for r in ours(spark.createDataFrame([(5, text)], "doc_id long, text string"), every=1 << 40)}
    assert got["wordaaaa"][2] == "wordbbbb" and got["wordaaaa"][1] == "wordaaab" and got["wordbbbb"][1] == ""
    assert got["tiesame"][1] == "tiesama" and got["tiesame"][4] == 2 and got["doubble"][1] == "double" and got["double"][4] == 1


def test_none(spark):
    assert variants.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.group(spark.createDataFrame([(None, None), (1, "ab cd")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants.group(spark.createDataFrame([], "doc_id long, text string"), ratio=1)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    found = con.execute(SQL["op13_spelling_variants"])
    names = [d[0] for d in found.description]
    frame = QUERIES["op13_spelling_variants"](spark, SMALL)
    assert sorted(frame.columns) == sorted(names)

    def plain(rows):
        return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)

    rows = plain(frame.select(names).collect())
    assert rows == plain(found.fetchall()) and len(rows) > 500
