"""Sinks: events, JSON log lines, Prometheus text, public verdicts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from promptsieve import constants as K
from promptsieve.functions.text import redact, redact_headers
from promptsieve.operators.signatures import Rule, RuleSet

if TYPE_CHECKING:
    from promptsieve.sources.delivery import DeliveryLedger

RETRY_STATUS = frozenset({408, 429})


class TransientSendError(RuntimeError):
    """Delivery failed for a reason that may pass: the task, and with it the batch, reruns."""


def with_event_groups(events: DataFrame) -> DataFrame:
    """Usage and detection events go to separate groups and days, so a reader of one group
    never opens the other."""
    return events.withColumns({
        "kind": F.when(F.col("event_type") == "usage", "usage").otherwise("detection"),
        "date": F.to_date("ts"),
    })


def send_batches(
    rows: Iterator[Row], send: Callable[[list[dict]], int], size: int = K.EVENT_BATCH
) -> tuple[int, int]:
    """Deliver one partition in batches -> (sent, dropped).

    ``send`` returns an HTTP status. 5xx, 408 and 429 raise, so Spark reruns the task;
    receivers drop repeats by event_id. Other 4xx are final: that batch is dropped.
    """
    sent = dropped = 0
    batch: list[dict] = []

    def deliver() -> None:
        nonlocal sent, dropped
        if not batch:
            return
        status = send(list(batch))
        if status in RETRY_STATUS or status >= 500:
            raise TransientSendError(f"receiver answered {status}")
        if status >= 400:
            dropped += len(batch)
        else:
            sent += len(batch)
        batch.clear()

    for row in rows:
        batch.append(row.asDict(recursive=True))
        if len(batch) >= size:
            deliver()
    deliver()
    return sent, dropped


def post_events(events: DataFrame, send: Callable[[list[dict]], int], folder: str | None = None, attempts: int = 3) -> DeliveryLedger:
    """Send events from the executors, detection and usage groups apart, in up to ``attempts``
    attempts -> the ledger of what became of them."""
    from promptsieve.sources.delivery import OPEN, DeliveryLedger

    ledger = DeliveryLedger(events.sparkSession, folder)
    for _ in range(attempts):
        if not ledger.deliver(events, send).get(OPEN):
            break
    return ledger


def write_events(events: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Write events as Parquet partitioned by kind and date.

    A stream needs ``checkpoint`` and returns its query; the file sink commits each batch
    once. A batch frame is appended.
    """
    grouped = with_event_groups(events)
    if not events.isStreaming:
        grouped.write.mode("append").partitionBy("kind", "date").parquet(path)
        return None
    return (
        grouped.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).partitionBy("kind", "date")
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


def _redacted(df: DataFrame, name: str) -> Column:
    """Keys masked in a text column, secret headers in a map of texts; others as they are."""
    kind = df.schema[name].dataType
    if isinstance(kind, StringType):
        return redact(F.col(name)).alias(name)
    if isinstance(kind, MapType) and isinstance(kind.keyType, StringType) and isinstance(kind.valueType, StringType):
        return F.transform_values(redact_headers(F.col(name)), lambda _, v: redact(v)).alias(name)
    return F.col(name)


def to_json_log(
    df: DataFrame, level: Column, logger: Column, message: Column, ts: Column, redact_keys: bool = True,
) -> DataFrame:
    """One JSON line per row: timestamp, level, logger, message, then the other columns. Keys
    and secret headers are masked unless ``redact_keys`` is off."""
    head = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
        F.lower(level).alias("level"), logger.alias("logger"),
        (redact(message) if redact_keys else message).alias("message"),
    ]
    taken = {"timestamp", "level", "logger", "message"}
    rest = [_redacted(df, c) if redact_keys else F.col(c) for c in df.columns if c not in taken]
    return df.select(F.to_json(F.struct(*head, *rest), {"ignoreNullFields": "false"}).alias("value"))


def escape_label(c: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def to_prometheus(metrics: DataFrame) -> DataFrame:
    """Metric rows (name, help, type, labels MAP<STRING,STRING>, value) -> ordered exposition
    lines (ordinal, value): HELP and TYPE once per metric, then its samples."""
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")),
        lambda e: F.concat(e.key, F.lit('="'), escape_label(e.value), F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
    whole = F.col("value") == F.floor("value")
    number = F.when(whole, F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    line = lambda part, *text: F.struct(F.lit(part).alias("part"), F.concat(*text).alias("value"))
    # One pass over the metrics: each row brings its heads along, and equal lines are counted.
    lines = metrics.select("name", F.inline(F.array(
        line(0, F.lit("# HELP "), "name", F.lit(" "), "help"), line(1, F.lit("# TYPE "), "name", F.lit(" "), "type"),
        line(2, "name", F.coalesce(labels, F.lit("")), F.lit(" "), number),
    ))).groupBy("name", "part", "value").agg(F.count("*").cast("int").alias("n"))
    times = F.when(F.col("part") < 2, 1).otherwise(F.col("n"))
    return lines.select("name", "part", F.explode(F.array_repeat("value", times)).alias("value")).orderBy(
        "name", "part", "value").select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def public_verdicts(df: DataFrame, rules: RuleSet, keep: tuple[str, ...] = ()) -> DataFrame:
    """The verdict as shown to clients: action, category, signature name, confidence. Neither
    pattern nor id leaves; the names are one literal map."""
    names: dict[str, Rule] = {r.id: r for r in rules.rules}  # the last of repeated ids wins
    if names:
        literal = F.from_json(F.lit(json.dumps({k: r.name for k, r in names.items()})), "map<string,string>")
        name = F.try_element_at(literal, F.col("signature_id"))
    else:
        name = F.lit(None).cast("string")
    return df.select(*keep, "action", "category", name.alias("signature_name"), "confidence")


def write_verdicts(df: DataFrame, rules: RuleSet, path: str, keep: tuple[str, ...] = ()) -> None:
    public_verdicts(df, rules, keep).write.mode("append").parquet(path)
