"""Queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from textlab.llm import ann, bpe, chat, html, imatch, packing, personal, ranked, repeats, simhash, toxicity, urls, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.spans(_table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(kind) for kind in personal.BASE_KINDS),
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
    )


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op10_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(_table(spark, sf_dir, "documents"), length=400)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=50)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_adaptive_scan,
        op2_personal_data,
        op3_imatch,
        op4_bpe_tree,
        op5_site_style_tree,
        op6_best_fit_packing,
        op7_toxicity,
        op8_perspective_rotation,
        op9_host_reputation,
        op10_simhash_gray,
        op11_prefix_free,
        op12_dual_tree,
        op13_spelling_variants,
    )
}
SQL: dict[str, str] = {
    "op3_imatch": imatch.sql(),
    "op8_perspective_rotation": chat.sql(),
    "op9_host_reputation": urls.sql(RULES),
    "op11_prefix_free": repeats.sql(),
    "op12_dual_tree": ranked.sql(),
    "op13_spelling_variants": variants.sql(),
}
