import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from textlab.llm import personal, simhash, toxicity


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SMALL).cache()
        assert now.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            kept = {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.3").collect()}
        elif name == "near_duplicates":
            kept = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert now.exceptAll(before).count() == 0
        else:
            texts = [r["text"] for r in now.collect()]
            assert not any(personal.base_spans(t) for t in texts) and any("[email]" in t or "[card]" in t for t in texts)
        assert sorted(r["doc_id"] for r in now.select("doc_id").collect()) == sorted(kept)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in now.collect()}
    assert all(r["offset"] + r["length"] <= 2048 for r in rows)


def test_one_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "a"), (5, "other text", "b"), (3, text, "c"), (3, text, "c"), (None, "lonely words", "d"), (None, None, "e"), (7, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["key"]) for r in kept.collect()) == [(-1, "d"), (3, "c"), (5, "b"), (7, "f")]
    assert simhash.one_per_group(docs.limit(0)).count() == 0


def test_odd_tables_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (1, None, None, None, 3), (None, "a@b.org", "x", "y", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for part in (docs, docs.limit(0)):
        now = part
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path)).cache()
        assert now.count() == (2 if part is docs else 0)


def test_stages_against_plain_versions(spark):
    """Each stage on its own input: groups by comparing every two fingerprints, personal data by
    the plain patterns, pieces by the tokenizer library."""
    from test_personal import brute as plain_spans
    from test_simhash import brute as plain_groups, plain as plain_print

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    roots = plain_groups([plain_print(texts[i]) for i in ids], 2)
    first = {}
    for i, root in zip(ids, roots):
        first.setdefault(root, i)
    kept = stages["near_duplicates"](spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(first.values())

    for r in stages["personal_data"](spark, docs, SMALL).collect():
        left = texts[r["doc_id"]]
        found = [left[s:e] for _, s, e in plain_spans(left)]
        assert not any(span in r["text"] for span in found if len(span) > 7)
        assert r["n_chars"] == len(r["text"])
        if not re.search("[0-9@]|token|secret|key|pass", left):
            assert r["text"] == left

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = set()
    for i, text in texts.items():
        codes = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        cut = len(codes) % 2048 or min(2048, len(codes))
        starts = [0, *range(cut, len(codes), 2048)]
        for piece, start in enumerate(starts):
            part = codes[start : (starts + [len(codes)])[piece + 1]]
            want.add((i, piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    packed = stages["packing"](spark, docs, SMALL).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == want and len(packed) == len(want)
    fill = {}
    for r in packed:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    from test_toxicity import planted

    docs, labels = planted(600)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, frame, str(tmp_path)).collect()}
    wrong = [i for i, toxic in labels if (i in kept) == bool(toxic)]
    assert len(wrong) <= 6
