"""Counters, histograms and percentiles. All aggregates combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsieve import constants as K


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("upstream", "method", "status").agg(F.count("*").alias("n"))


def scan_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("scanner", "result").agg(F.count("*").alias("n"))


def detection_counts(detections: DataFrame, subtotals: bool = False) -> DataFrame:
    """Detections by category and action; the signature is left out to keep the number of
    series small. With ``subtotals`` NULL stands for all."""
    cat = F.coalesce("category", F.lit("unknown")).alias("category")
    base = detections.select(cat, "action")
    grouped = base.cube("category", "action") if subtotals else base.groupBy("category", "action")
    return grouped.agg(F.count("*").alias("n"))


def routing_counts(routed: DataFrame) -> DataFrame:
    return (
        routed.where("metric_result is not null")
        .groupBy(F.col("metric_mode").alias("mode"), F.col("metric_result").alias("result"))
        .agg(F.count("*").alias("n"))
    )


def duration_histogram(
    df: DataFrame, value: str, by: tuple[str, ...] = (), buckets=K.REQUEST_BUCKETS
) -> DataFrame:
    """Cumulative buckets: one row per group and bound ``le`` (and ``+Inf``), with the number
    of values up to it and the group's sum and count. One pass, one conditional count per
    bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    totals = df.groupBy(*by).agg(*counts, F.count(value).alias("count"), F.sum(value).alias("sum"))
    rows = F.array(
        *[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(buckets)],
        F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")),
    )
    return totals.select(*by, F.inline(rows), "count", "sum")


def latency_percentiles(
    df: DataFrame, value: str = "value", order: tuple[str, ...] = ("ts",), last_n: int = 1000,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """p50, p90, p99 of the last ``last_n`` values: the element at ``int((n-1)*q)``; the
    largest for p90 below 10 values and for p99 below 100; 0 without values.

    Without ``by`` the last values are a distributed top-n. With ``by`` Spark limits each
    group before the shuffle, so at most ``last_n`` rows per group and task move.
    """
    latest = [F.col(o).desc() for o in order]
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*latest))
        recent = df.withColumn("_rank", rank).where(F.col("_rank") <= last_n)
    else:
        recent = df.orderBy(*latest).limit(last_n)
    v = F.sort_array(F.collect_list(value))
    grouped = recent.groupBy(*by).agg(v.alias("_v")).withColumn("n", F.size("_v"))

    def at(q: float, least: int) -> Column:
        index = F.floor((F.col("n") - 1) * F.lit(q)).cast("int") + 1
        index = F.when(F.col("n") >= least, index).otherwise(F.col("n"))
        return F.coalesce(F.try_element_at("_v", index), F.lit(0.0))

    return grouped.select(
        *by, "n",
        F.when(F.col("n") > 0, at(0.50, 0)).otherwise(0.0).alias("p50"),
        F.when(F.col("n") > 0, at(0.90, 10)).otherwise(0.0).alias("p90"),
        F.when(F.col("n") > 0, at(0.99, 100)).otherwise(0.0).alias("p99"),
    )


def prediction_counts(log: DataFrame) -> DataFrame:
    """Totals of a classifier log (kind: prediction, error, model_load, license_refresh;
    action; success)."""
    is_ = lambda k: F.col("kind") == k
    return log.agg(
        F.count_if(is_("prediction")).alias("predictions_total"),
        F.count_if(is_("prediction") & (F.col("action") == "block")).alias("predictions_blocked"),
        F.count_if(is_("prediction") & (F.col("action") != "block")).alias("predictions_allowed"),
        F.count_if(is_("error")).alias("errors_total"),
        F.count_if(is_("model_load")).alias("model_loads_total"),
        F.count_if(is_("model_load") & ~F.col("success")).alias("model_load_failures"),
        F.count_if(is_("license_refresh")).alias("license_refreshes"),
        F.count_if(is_("license_refresh") & ~F.col("success")).alias("license_failures"),
    )


def predictions_by_category(log: DataFrame) -> DataFrame:
    return log.where("kind = 'prediction'").groupBy("category").agg(F.count("*").alias("n"))


def signatures_loaded(bundles: DataFrame) -> DataFrame:
    return bundles.groupBy("tier").agg(F.sum(F.size("signatures").cast("bigint")).alias("signatures"))


def last_sync(syncs: DataFrame) -> DataFrame:
    """Time of the last successful sync."""
    return syncs.where("success").agg(F.max("ts").alias("last_sync"))


def dominant_action(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent action, the lowest name on ties."""
    return df.groupBy(*by).agg(F.mode("action", True).alias("dominant_action"))
