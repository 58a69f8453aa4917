"""The queries of this package: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, common, decontaminate, gam, html, outliers, packing, pitman_yor, quotes, resample, simhash, toxicity, trie, warc


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents")).drop("fp")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    scored = gam.score(documents, gam.fit_labels(documents, common.table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(common.table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(common.table(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(common.table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    index = toxicity.fit_labels(documents, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, index, ["doc_id"])
    return scored.select(
        "doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", F.col("neighbours").alias("evidence")
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = outliers.reject(common.table(spark, sf_dir, "documents"))
    return judged.drop("lang", "source")


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = common.remainder("doc_id", 7) == 2
    documents = common.table(spark, sf_dir, "documents").withColumn("train", ~held)
    scored = pitman_yor.score(documents)
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(common.table(spark, sf_dir, "documents"), path, ["doc_id"], decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(common.table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_main_text": op3_main_text,
    "op4_quotes": op4_quotes,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_outliers": op9_outliers,
    "op10_pitman_yor": op10_pitman_yor,
    "op11_bpe": op11_bpe,
    "op12_resample": op12_resample,
    "op13_trie": op13_trie,
}

SQL: dict[str, str] = {
    "op4_quotes": quotes.SQL,
    "op12_resample": resample.SQL,
    "op13_trie": trie.SQL,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
}
