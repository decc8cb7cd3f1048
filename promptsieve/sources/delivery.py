"""Delivery of events to a receiver, with a ledger of what became of every one.

Tasks send batches and write a row for each: the ids, the outcome, the receiver's status. Batches
are of one group, usage or detection. What the receiver refuses for good is kept whole as a dead
letter; what it could not take now stays open, and the next attempt sends only that. Nothing is
thrown away silently: every event is sent, dead or open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from promptsieve import constants as K
from promptsieve.session import shared_folder
from promptsieve.sources.sinks import RETRY_STATUS, with_event_groups

ROWS = "kind string, event_ids array<string>, outcome string, status int"
SENT, DEAD, OPEN = "sent", "dead", "open"


def _send(send: Callable[[list[dict]], int], size: int):
    schema = pa.schema([("kind", pa.string()), ("event_ids", pa.list_(pa.string())), ("outcome", pa.string()), ("status", pa.int32())])

    def outcome(batch: list[dict]) -> tuple[str, int | None]:
        try:
            status = send(batch)
        except Exception:  # noqa: BLE001 - whatever the network does, the events stay open
            return OPEN, None
        if status in RETRY_STATUS or status >= 500:
            return OPEN, status
        return (DEAD if status >= 400 else SENT), status

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[dict]] = {}
        closed: set[str] = set()

        def row(kind: str) -> pa.RecordBatch:
            batch = held.pop(kind)
            ids = [str(e["event_id"]) for e in batch]
            # After a failure that may pass, this attempt leaves the rest of the group to the next.
            result = (OPEN, None) if kind in closed else outcome([{k: v for k, v in e.items() if k != "_kind"} for e in batch])
            if result[0] == OPEN:
                closed.add(kind)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((kind, ids, *result), schema)], schema=schema)

        for batch in batches:
            for event in batch.to_pylist():
                kind = event["_kind"]
                held.setdefault(kind, []).append(event)
                if len(held[kind]) >= size:
                    yield row(kind)
        for kind in list(held):
            yield row(kind)
    return run


class DeliveryLedger:
    """Attempts below ``folder``, which all executors see. Events are told apart by ``event_id``, so
    they need one; those without are never sent and stay open."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.attempts = spark, folder or shared_folder(spark, "deliveries"), 0

    def batches(self) -> DataFrame:
        """attempt, kind, event_ids, outcome, status of every batch."""
        if not self.attempts:
            return self.spark.createDataFrame([], f"{ROWS}, attempt int")
        return self.spark.read.schema(f"{ROWS}, attempt int").parquet(f"{self.folder}/batches")

    def settled(self) -> DataFrame:
        """event_id, outcome, attempt, status of the events that are sent or dead."""
        return self.batches().where(F.col("outcome") != OPEN).select(
            F.explode("event_ids").alias("event_id"), "outcome", "attempt", "status")

    def deliver(self, events: DataFrame, send: Callable[[list[dict]], int], size: int = K.EVENT_BATCH) -> dict[str, int]:
        """One attempt to send the events that are not settled -> number of events by outcome.

        ``send`` gets up to ``size`` events and returns an HTTP status. 408, 429, 5xx and errors leave
        the rest of its group and task open; other 4xx are final. A task that is lost is run again,
        so a batch may be sent twice: receivers drop repeats by event_id. The attempt counts when its
        ledger is written.
        """
        named = events.where(F.col("event_id").isNotNull())
        todo = named.join(
            self.settled().select(F.col("event_id").alias("_id")), F.col("event_id").cast("string") == F.col("_id"), "left_anti")
        grouped = with_event_groups(todo).withColumnRenamed("kind", "_kind").drop("date")
        grouped.mapInArrow(_send(send, size), ROWS).write.mode("overwrite").parquet(f"{self.folder}/batches/attempt={self.attempts + 1}")
        self.attempts += 1
        now = self.batches().where(F.col("attempt") == self.attempts)
        counts = {r.outcome: r.n for r in now.groupBy("outcome").agg(F.sum(F.size("event_ids")).alias("n")).collect()}
        if counts.get(DEAD):
            dead = now.where(F.col("outcome") == DEAD).select(F.explode("event_ids").alias("_id"), F.col("status").alias("refused_with"))
            named.join(dead, F.col("event_id").cast("string") == F.col("_id")).drop("_id").write.mode("overwrite").parquet(
                f"{self.folder}/dead/attempt={self.attempts}")
        return counts

    def dead_letters(self, events: DataFrame) -> DataFrame:
        """The refused events as they were, with ``refused_with`` (status) and ``attempt``."""
        schema = StructType([*events.schema, StructField("refused_with", IntegerType()), StructField("attempt", IntegerType())])
        if not self.settled().where(F.col("outcome") == DEAD).limit(1).count():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/dead")
