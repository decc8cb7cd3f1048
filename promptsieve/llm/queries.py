"""Registered queries of the training-data operators: name -> (build(spark, sf_dir), check SQL)."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsieve.llm import (context_mixing, decontaminate, exact_dedup, hard_negatives, link_trust, packing, periods,
                             pii, quality, secrets, simhash, toxicity, warc)
from promptsieve.session import configure


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(build):
    return lambda spark, sf_dir: build(table(spark, sf_dir, "documents"))


def _with(other: str, build):
    return lambda spark, sf_dir: build(table(spark, sf_dir, "documents"), table(spark, sf_dir, other))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Labels of the query: where vec_id is divisible by 7, (label + 1) % 10."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of the query: by a hash of doc_id, every tenth text repeats a stretch to its end."""
    hashed = zlib.crc32(str(doc_id).encode())
    if doc_id is None or hashed % 10 or not words:
        return words
    seed = hashed // 10
    at = seed % len(words)
    rest = len(words) - at
    period = 1 + rest // (3 + seed % 8)
    return words[:at] + [words[at + i % period] for i in range(rest)]


ENTRIES = {
    "op1_simhash_near_dedup": (_docs(simhash.near_duplicates), None),
    "op2_secret_scan": (_docs(lambda d: secrets.digests(secrets.secrets(d))), None),
    "op3_toxicity": (_with("labels", toxicity.toxicity), None),
    "op4_lm_scoring": (_docs(context_mixing.scores), None),
    "op5_exact_dedup": (_docs(exact_dedup.exact_dedup), exact_dedup.SQL),
    "op6_quality": (_with("labels", quality.quality), None),
    "op7_packing": (_docs(lambda d: packing.digests(packing.pack(d, vocabulary_path()))), None),
    "op8_pii": (_docs(lambda d: pii.digests(pii.personal_data(d))), None),
    "op9_warc": (lambda spark, sf_dir: warc.captured(table(spark, sf_dir, "pages")), None),
    "op10_decontamination": (_with("benchmark", lambda d, b: decontaminate.contamination(d, b).drop("key")), decontaminate.SQL),
    "op11_url_filter": (lambda spark, sf_dir: link_trust.verdicts(table(spark, sf_dir, "pages")), link_trust.SQL),
    "op12_hard_negatives": (
        lambda spark, sf_dir: hard_negatives.hard_negatives(relabelled(table(spark, sf_dir, "embeddings"))), hard_negatives.SQL),
    "op13_periodic_runs": (_docs(lambda d: periods.digests(periods.periodic_runs(d, rewrite=repeating))), None),
}
