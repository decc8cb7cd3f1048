"""Policy: from scan verdicts to final actions and outcomes.

The joins carry no broadcast hints. Category policies and small allowlists are broadcast by
Spark because their measured size is below the threshold; a large allowlist becomes a shuffle
join whose hot clients adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.variant import kind, text_at


def effective_threshold(threshold: Column, sensitivity: Column) -> Column:
    """``1 - sensitivity`` within [0, 1] if a sensitivity is set, else the threshold, else 0."""
    # greatest and least skip NULLs, so a missing sensitivity must not reach them.
    strict = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - sensitivity.cast("double")))
    return F.coalesce(F.when(sensitivity.isNotNull(), strict), threshold.cast("double"), F.lit(0.0))


def allowlist_sets(allowlist: DataFrame) -> DataFrame:
    """One row per client with the set of its allowed categories; repeated clients merge."""
    return (
        allowlist.select("client_id", F.explode("categories").alias("allowed"))
        .groupBy("client_id").agg(F.collect_set("allowed").alias("allowed"))
    )


def is_allowlisted(df: DataFrame, allowlist: DataFrame, output: str = "allowlisted") -> DataFrame:
    """Flag rows whose client is allowed their category or ``*``. Exact client match."""
    category = F.coalesce("category", F.lit("unknown"))
    hit = F.array_contains("allowed", "*") | F.array_contains("allowed", category)
    return (
        df.join(allowlist_sets(allowlist), "client_id", "left")
        .withColumn(output, F.coalesce(hit, F.lit(False)))
        .drop("allowed")
    )


def resolve_policy(
    scans: DataFrame, category_policy: DataFrame, allowlist: DataFrame,
    default_action: str = "block",
) -> DataFrame:
    """Append ``final_action``.

    ``allow`` stays; an allowlisted (client, category) is allowed; a confidence below the
    category's threshold is allowed; else the category's action or the default decides, also
    where it is stronger than the scan's own action.
    """
    if default_action not in K.ACTION_RANK:
        raise ValueError(f"unknown action {default_action!r}, expected one of {list(K.ACTION_RANK)}")
    rules = category_policy.select(
        F.col("category").alias("_category"), F.col("action").alias("_action"),
        effective_threshold(F.col("threshold"), F.col("sensitivity")).alias("_threshold"),
    )
    joined = is_allowlisted(scans, allowlist, "_listed").join(
        rules, F.coalesce("category", F.lit("unknown")) == F.col("_category"), "left"
    )
    final = (
        F.when((F.col("action") == "allow") | F.col("_listed"), "allow")
        .when(F.col("confidence") < F.coalesce("_threshold", F.lit(0.0)), "allow")
        .otherwise(F.coalesce("_action", F.lit(default_action)))
    )
    return joined.select(*scans.columns, final.alias("final_action"))


def most_common(values: Column) -> Column:
    """Most frequent element of an array, the lowest on ties."""
    ordered = F.array_sort(F.array_distinct(values))
    counted = F.transform(ordered, lambda a, i: F.struct(
        F.size(F.filter(values, lambda x: x == a)).alias("n"), (-i).alias("at"), a.alias("a")))
    return F.array_max(counted)["a"]


def translate_policy(policies: DataFrame) -> DataFrame:
    """Cloud policies -> one row per (policy_id, category): action, threshold, default_action.

    Input columns: policy_id, detection MAP<STRING, STRUCT<enabled, action, threshold>>,
    categories MAP<STRING, STRUCT<enabled, action>>, thresholds STRUCT<block_score,
    warn_score>. A non-empty ``detection`` wins over ``categories``. Disabled categories are
    dropped; the default action is the most common one.
    """
    by_detection = F.coalesce(F.size("detection") > 0, F.lit(False))
    entry = lambda e, threshold: F.struct(
        e.key.alias("category"), e.value.enabled.alias("enabled"), e.value.action.alias("action"),
        threshold.cast("double").alias("threshold"),
    )
    entries = F.when(
        by_detection, F.transform(F.map_entries("detection"), lambda e: entry(e, e.value.threshold))
    ).otherwise(F.transform(F.map_entries("categories"), lambda e: entry(e, F.lit(None))))
    enabled = F.filter("_entries", lambda e: F.coalesce(e.enabled, F.lit(True)))
    actions = F.transform("_enabled", lambda e: F.coalesce(e.action, F.lit("block")))
    action = F.coalesce("_entry.action", "default_action")
    by_score = F.when(action == "block", F.coalesce("thresholds.block_score", F.lit(0.8))).otherwise(
        F.coalesce("thresholds.warn_score", F.lit(0.5)))
    return (
        policies.withColumn("_entries", entries).withColumn("_enabled", enabled)
        .withColumn("default_action", F.coalesce(most_common(actions), F.lit("block")))
        .withColumn("_entry", F.explode("_enabled"))
        .select(
            "policy_id", F.col("_entry.category").alias("category"), action.alias("action"),
            F.when(by_detection, F.coalesce("_entry.threshold", F.lit(0.5))).otherwise(by_score)
            .alias("threshold"),
            "default_action",
        )
    )


def validate_check(df: DataFrame, body: str = "body") -> DataFrame:
    """Append ``text`` and ``error_type`` for a detection request ``{"text": ...}``."""
    parsed = F.try_parse_json(F.col(body))
    text = text_at(F.col("_json"), "$.text")
    error = (
        F.when(F.col("_json").isNull(), "invalid_json")
        .when(~kind(F.col("_json")).startswith("OBJECT"), "invalid_request")
        .when(F.coalesce(F.length("text"), F.lit(0)) == 0, "invalid_request")
    )
    return (
        df.withColumn("_json", parsed).withColumn("text", text)
        .withColumn("error_type", error).drop("_json")
    )


def validate_sizes(
    df: DataFrame, request: str = "body", response: str | None = None,
    max_request: int = K.MAX_REQUEST_BYTES, max_response: int = K.MAX_RESPONSE_BYTES,
) -> DataFrame:
    """Append ``error_type``: payload_too_large, response_too_large or NULL."""
    error = F.when(F.octet_length(request) > max_request, "payload_too_large")
    if response is not None:
        error = error.when(F.octet_length(response) > max_response, "response_too_large")
    return df.withColumn("error_type", error)


def apply_failure_mode(df: DataFrame, mode: str = "open") -> DataFrame:
    """Rows without a scan result: ``open`` lets them pass, ``closed`` fails them (503)."""
    if mode not in ("open", "closed"):
        raise ValueError(f"unknown failure mode {mode!r}")
    failed = F.col("action").isNull()
    error = F.when(failed, "scanner_error") if mode == "closed" else F.lit(None).cast("string")
    return df.withColumns({
        "action": F.coalesce("action", F.lit("allow" if mode == "open" else "block")),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "failure": error,
    })


# error type -> HTTP status
_STATUS = {
    "invalid_json": 400, "invalid_request": 400, "content_blocked": 400,
    "unknown_router_task": 400, "no_route": 400, "not_found": 404, "payload_too_large": 413,
    "response_too_large": 502, "response_blocked": 502, "upstream_error": 502,
    "scanner_error": 503, "scanner_timeout": 503,
}


def outcome(df: DataFrame) -> DataFrame:
    """Append ``outcome_type``, ``outcome_code``, ``status``.

    Reads whichever of these columns exist: error_type (validation), provider (NULL means
    unknown), failure, final_action, response_blocked, response_category, upstream_status.
    Earlier checks win, in that order.
    """
    have = set(df.columns)
    kind_ = F.lit(None).cast("string")
    late: list[Column] = []
    if "provider" in have:
        late.append(F.when(F.col("provider").isNull(), "not_found"))
    if "error_type" in have:
        late.append(F.col("error_type"))
    if "failure" in have:
        late.append(F.col("failure"))
    if "final_action" in have:
        late.append(F.when(F.col("final_action") == "block", "content_blocked"))
    if "response_blocked" in have:
        late.append(F.when(F.col("response_blocked"), "response_blocked"))
    kind_ = F.coalesce(*late, F.lit(None).cast("string"))
    status = F.col("upstream_status") if "upstream_status" in have else F.lit(200)
    for name, code in _STATUS.items():
        status = F.when(F.col("outcome_type") == name, code).otherwise(status)
    category = lambda c: F.concat(F.coalesce(c, F.lit("None")), F.lit("_detected"))
    code = F.lit(None).cast("string")
    if "category" in have:
        code = F.when(F.col("outcome_type") == "content_blocked", category(F.col("category")))
    if "response_category" in have:
        code = F.coalesce(code, F.when(
            F.col("outcome_type") == "response_blocked", category(F.col("response_category"))))
    return (
        df.withColumn("outcome_type", kind_).withColumn("outcome_code", code)
        .withColumn("status", status.cast("int"))
    )
