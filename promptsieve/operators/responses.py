"""Leak scanning of model responses, whole or as chunk streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.text import sse_data
from promptsieve.operators.fusion import best_of
from promptsieve.operators.signatures import RuleSet

MODES = ("passthrough", "buffered", "full")


def scan_responses(
    df: DataFrame, text: str, rules: RuleSet, categories=(), enabled: bool = True
) -> DataFrame:
    """Append blocked, response_category, response_signature_id, response_details,
    hit_count, scanned_length.

    Only rules for responses count; the category slug stays as written, and policy plays no
    part.
    """
    kept = rules.for_responses(categories) if enabled else RuleSet(())
    scanned = (
        df.withColumn("_text", F.col(text)).select("*", kept.gates("_text").alias("_gates"))
        .withColumn("_regex", kept.candidates("_text", "_gates", normalize=False))
    )
    names = {
        "action": "_action", "category": "response_category",
        "signature_id": "response_signature_id", "details": "_details", "matches": "_matches",
    }
    inner = scanned.select(
        F.struct(*df.columns).alias("_row"), "_regex",
        F.length("_text").alias("scanned_length"),
    )
    return (
        best_of(inner, ["_regex"]).withColumnsRenamed(names)
        .select(
            "_row.*",
            (F.col("_action") == "block").alias("blocked"),
            "response_category", "response_signature_id",
            F.concat(F.lit("Detected: "), F.substring("_details", len("pattern:") + 1, 2147483647))
            .alias("response_details"),
            F.coalesce(F.size("_matches"), F.lit(0)).alias("hit_count"),
            "scanned_length",
        )
    )


def response_outcome(df: DataFrame, body: str, rules: RuleSet, categories=()) -> DataFrame:
    """Scan BINARY response bodies and append outcome_type, event_type, metric_action, status.

    A body that is not UTF-8 is passed unscanned. Only a detection blocks; a scan that fails
    never does.
    """
    readable = F.when(F.is_valid_utf8(F.col(body).cast("string")), F.col(body).cast("string"))
    scanned = scan_responses(df.withColumn("_body", readable), "_body", rules, categories)
    hit = F.col("hit_count") > 0
    return scanned.drop("_body").withColumns({
        "outcome_type": F.when(F.col("blocked"), "response_blocked"),
        "event_type": F.when(hit, "response_detection"),
        "metric_action": F.when(F.col("blocked"), "block").when(hit, "warn"),
        "status": F.when(F.col("blocked"), 502).otherwise(200),
    })


def scan_stream_table(
    chunks: DataFrame, rules: RuleSet, mode: str = "buffered",
    buffer_size: int = K.STREAM_BUFFER_CHARS, categories=(), is_sse: bool = True,
    max_bytes: int = K.MAX_RESPONSE_BYTES,
) -> DataFrame:
    """Scan recorded streams (stream_id, seq, chunk); the batch form of the stream scan.

    passthrough: one row per chunk with a payload, each scanned by itself.
    buffered: one row per stream; the payloads up to and including the chunk that fills the
    buffer are joined and scanned, the rest is released unscanned.
    full: one row per stream, all payloads joined and scanned. ``error_type`` tells beside the
    result that a stream is larger than a response may be (``response_too_large``).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    payload = sse_data("chunk") if is_sse else F.col("chunk")
    parts = chunks.select("stream_id", "seq", payload.alias("payload"))
    if mode == "passthrough":
        return scan_responses(parts.where("payload <> ''"), "payload", rules, categories).drop("payload")
    if mode == "buffered":
        # Every chunk has a character, so the buffer is full after as many chunks: Spark limits
        # each stream to them before the shuffle, and the running sum is over a bounded group.
        order = Window.partitionBy("stream_id").orderBy("seq")
        first = parts.where("payload <> ''").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= buffer_size)
        ahead = F.coalesce(F.sum(F.length("payload")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        head = first.withColumn("_before", ahead).where(F.col("_before") < buffer_size)
    else:
        head = parts
    joined = head.groupBy("stream_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda p: p.payload), "")
        .alias("content")
    )
    too_large = F.lit(mode == "full") & (F.octet_length("content") > max_bytes)
    joined = joined.withColumn("error_type", F.when(too_large, "response_too_large"))
    return scan_responses(joined, "content", rules, categories).drop("content")
