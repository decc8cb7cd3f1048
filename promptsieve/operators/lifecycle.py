"""Signature bundles, manifests and licences over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve.session import saved


def _unexpired(now: Column) -> Column:
    return F.col("expires_at").isNull() | (now <= F.col("expires_at"))


def active_signatures(bundles: DataFrame, now: Column, order: str = "bundle_id") -> DataFrame:
    """Signatures of the bundles that have not expired, in bundle order."""
    return bundles.where(_unexpired(now)).select(
        order, F.posexplode("signatures").alias("pos", "signature")
    ).select(F.col(order).alias("bundle_order"), "pos", "signature.*")


def earliest_expiration(bundles: DataFrame, now: Column) -> DataFrame:
    return bundles.where(_unexpired(now)).agg(F.min("expires_at").alias("earliest_expiration"))


def expiring_soon(bundles: DataFrame, now: Column, hours: float = 24, past: bool = False) -> DataFrame:
    """Bundles with less than ``hours`` left. Expired ones count only if ``past`` (the rule
    for renewing licences)."""
    left = F.col("expires_at").cast("timestamp").cast("double") - now.cast("timestamp").cast("double")
    soon = left < hours * 3600
    return bundles.where(soon if past else (soon & (left > 0)))


def bundle_counts(bundles: DataFrame, now: Column) -> DataFrame:
    """Signature totals, active totals, and the applied version (highest as text)."""
    size = F.size("signatures").cast("bigint")
    return bundles.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("total_signatures"),
        F.coalesce(F.sum(F.when(_unexpired(now), size)), F.lit(0)).alias("active_signatures"),
        F.max("version").alias("version"),
    )


def by_category(signatures: DataFrame, category: str) -> DataFrame:
    return signatures.where(F.col("category") == category)


def by_id(signatures: DataFrame) -> DataFrame:
    """One row per id; of repeated ids the last wins."""
    rest = [c for c in signatures.columns if c != "id"]
    return signatures.groupBy("id").agg(
        F.max_by(F.struct(*rest), F.col("ordinal")).alias("_s")).select("id", "_s.*")


def manifest_hash(bundles: Column, previous_hash: Column, sequence: Column, version: Column) -> Column:
    """SHA-256 of the manifest as JSON with sorted members."""
    doc = F.to_json(F.struct(
        bundles.alias("bundles"), previous_hash.alias("previous_hash"),
        sequence.alias("sequence"), version.alias("version")))
    return F.sha2(F.to_json(F.parse_json(doc)), 256)


def audit_manifests(history: DataFrame, blocks: int = 256) -> DataFrame:
    """Judge each manifest of a channel in arrival order -> channel, arrival, valid, error.

    history: channel, arrival, sequence, previous_hash, manifest_hash, signature. A manifest
    must be signed, not fall below the sequence of the last valid one, and, where both sides
    are known, name its hash.

    What a manifest is judged by, the greatest sequence of the valid ones before it and the hash of
    the last, is a running maximum and a running last, each in two levels: per block of arrivals,
    and over a channel's blocks (``blocks`` of equal width from the first to the last arrival). So a
    channel is spread over its blocks. Which ones are valid is found by repetition: from a first
    guess all are judged, then again by what was found, until nothing changes. Each round settles
    at least the first manifest that was wrong, and all that do not depend on it; without named
    hashes the first guess is right. Rounds are written to the shared folder.
    """
    rows = history.select(
        "channel", "arrival", F.col("sequence").cast("bigint").alias("sequence"), F.nullif("previous_hash", F.lit("")).alias("previous_hash"),
        F.nullif("manifest_hash", F.lit("")).alias("manifest_hash"), (F.coalesce("signature", F.lit("")) != "").alias("signed"))
    timed = history.schema["arrival"].dataType.typeName() == "timestamp"
    place = F.unix_micros("arrival") if timed else F.col("arrival").cast("bigint")
    span = rows.agg(F.min(place).alias("low"), F.max(place).alias("high")).first()
    if span.low is None:
        return rows.select("channel", "arrival", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("error"))
    width = max(1, (span.high - span.low) // blocks + 1)
    rows = rows.withColumn("block", F.floor((place - span.low) / width))
    # The guess: every signed manifest counts, and one that names a hash names the one before it.
    guess = F.col("signed") & F.coalesce(F.col("previous_hash") == F.col("last.hash"), F.lit(True)) & ~F.coalesce(
        F.col("sequence") < F.col("greatest"), F.lit(False))
    state = saved(_before(rows.withColumn("valid", F.col("signed"))).select(*rows.columns, guess.alias("valid")), "manifests")
    error = (
        F.when(~F.col("signed"), "missing signature")
        .when(F.col("sequence") < F.coalesce("greatest", F.lit(0)), "sequence rollback")
        .when(F.col("previous_hash") != F.col("last.hash"), "previous_hash mismatch"))
    while True:
        judged = _before(state).withColumn("error", error)
        state = saved(judged.select(*rows.columns, F.col("error").isNull().alias("valid"), "error", (
            F.col("error").isNull() != F.col("valid")).alias("changed")), "manifests")
        if not state.where("changed").limit(1).count():
            return state.select("channel", "arrival", "valid", "error")
        state = state.drop("error", "changed")


def _before(rows: DataFrame) -> DataFrame:
    """Append ``greatest``, the greatest sequence of the valid rows before, and ``last``, the last of
    them, in two levels."""
    own = F.when(F.col("valid"), F.struct("arrival", F.col("manifest_hash").alias("hash")))
    top = F.when(F.col("valid"), F.col("sequence"))
    order = Window.partitionBy("channel").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("channel", "block").agg(F.max(top).alias("top"), F.max(own).alias("own")).select(
        "channel", "block", F.max("top").over(order).alias("top_before"), F.max("own").over(order).alias("own_before"))
    within = Window.partitionBy("channel", "block").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(earlier, ["channel", "block"]).withColumns({
        "greatest": F.greatest("top_before", F.max(top).over(within)),
        "last": F.coalesce(F.max(own).over(within), F.col("own_before"))}).drop("top_before", "own_before")


def license_status(licenses: DataFrame, now: Column, instance_id: str | None = None) -> DataFrame:
    """Append ``valid`` and ``reason`` (expiry and instance binding)."""
    bound = F.nullif("bound_instance_id", F.lit(""))
    reason = (
        F.when(now > F.col("expires_at"), "expired")
        .when(bound.isNotNull() & F.lit(not instance_id), "no instance id")
        .when(bound != F.lit(instance_id or ""), "bound to other instance")
        .otherwise("valid")
    )
    return licenses.withColumn("reason", reason).withColumn("valid", F.col("reason") == "valid")


def bundle_inventory(files: DataFrame, licenses: DataFrame, now: Column) -> DataFrame:
    """Stored bundle files (path, length; one folder per bundle) with their licences ->
    total_bundles, total_bytes, expired_bundles.

    ``files`` may be a ``binaryFile`` source: only its metadata is read.
    """
    stored = files.groupBy(F.element_at(F.split("path", "/"), -2).alias("bundle_id")).agg(
        F.sum("length").alias("bytes"))
    joined = stored.join(licenses.select("bundle_id", "expires_at"), "bundle_id", "left")
    gone = F.coalesce(now > F.col("expires_at"), F.lit(False))
    return joined.agg(
        F.count("*").alias("total_bundles"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.count_if(gone).alias("expired_bundles"),
    )


def expired_bundles(files: DataFrame, licenses: DataFrame, now: Column) -> DataFrame:
    """Ids of stored bundles to purge."""
    stored = files.select(F.element_at(F.split("path", "/"), -2).alias("bundle_id")).distinct()
    return stored.join(licenses.where(now > F.col("expires_at")).select("bundle_id"), "bundle_id", "left_semi")
