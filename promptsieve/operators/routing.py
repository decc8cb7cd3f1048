"""Model routing: task aliases, downgrades, retries.

Task and downgrade tables are configuration; the joins leave the choice of a broadcast to
Spark's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.text import sanitize_label
from promptsieve.functions.variant import child, items_at, kind, present, text_at, truthy
from promptsieve.operators.complexity import complexity, downgrade_eligible, prompt_text


def capability_ok(body: Column) -> Column:
    """Whether a VARIANT request is plain enough for any model: no tools, functions, response
    format, streaming, or content part that is not text."""
    empty = F.array().cast("array<variant>")

    def other_part(message: Column) -> Column:
        parts = F.coalesce(items_at(message, "$.content"), empty)
        return F.exists(parts, lambda p: kind(p).startswith("OBJECT") & present(p, "$.type")
                        & F.coalesce(text_at(p, "$.type") != "text", F.lit(True)))

    ok = ~truthy(body, "$.stream")
    for key in K.ROUTING_EXCLUSIONS:
        ok = ok & ~present(body, f"$.{key}")
    return ok & ~F.exists(F.coalesce(items_at(body, "$.messages"), empty), other_part)


def router_task(model: Column) -> Column:
    """Task of a ``router:<task>`` alias, NULL for other models and blank tasks."""
    task = F.trim(F.substring(model, len(K.ROUTER_PREFIX) + 1, 2147483647))
    return F.when(model.startswith(K.ROUTER_PREFIX), F.nullif(task, F.lit("")))


def select_route(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """Resolve aliases of rows with ``model`` and ``capable``.

    Appends task, chosen, retry_plan, route_error. Capable requests draw from the pool and
    then the fallback models, others from the fallback models alone.
    """
    table = tasks.select(
        F.col("task").alias("_task"), "ordered_pool", "fallback", F.lit(True).alias("_known"))
    joined = df.withColumn("task", router_task(F.col("model"))).join(
        table, F.col("task") == F.col("_task"), "left")
    none = F.array().cast("array<string>")
    fallback = F.coalesce("fallback", none)
    pool = F.when(F.col("capable"), F.coalesce("ordered_pool", none)).otherwise(none)
    plan = F.array_distinct(F.array_compact(F.concat(pool, fallback)))
    error = (
        F.when(F.col("task").isNull(), None)
        .when(F.col("_known").isNull(), "unknown_router_task")
        .when(F.size("_plan") == 0, "no_route")
    )
    routed = F.col("task").isNotNull() & (F.size("_plan") > 0)
    return joined.withColumn("_plan", plan).select(
        *df.columns, "task",
        F.when(routed, F.try_element_at("_plan", F.lit(1))).alias("chosen"),
        F.when(routed, F.slice("_plan", 2, 2147483647)).alias("retry_plan"),
        error.alias("route_error"),
    )


def downgrade_targets(downgrades: DataFrame) -> DataFrame:
    """First usable pair per (provider, from)."""
    usable = downgrades.where(F.trim("to") != "")
    return usable.groupBy("provider", "from").agg(
        F.min_by(F.trim("to"), "ordinal").alias("target"))


def select_downgrade(df: DataFrame, downgrades: DataFrame) -> DataFrame:
    """Append ``target``: the cheaper model of rows with provider, model and ``eligible``."""
    table = downgrade_targets(downgrades).select(
        F.col("provider").alias("_provider"), F.col("from").alias("_from"), "target")
    match = (F.col("provider") == F.col("_provider")) & (F.col("model") == F.col("_from"))
    return (
        df.join(table, match, "left")
        .withColumn("target", F.when(F.col("eligible"), F.col("target")))
        .drop("_provider", "_from")
    )


def plan_routes(
    requests: DataFrame, tasks: DataFrame, downgrades: DataFrame, dry_run: bool = True
) -> DataFrame:
    """Routing of requests with ``provider`` and ``body_json`` (VARIANT).

    Appends requested_model, routed_model, routing_mode, served_model, retry_plan,
    routing_note, route_error, and the (metric_mode, metric_result) pair to count.
    """
    staged = requests.withColumns({
        "model": text_at(F.col("body_json"), "$.model"), "capable": capability_ok(F.col("body_json")),
        "_prompt": prompt_text(F.col("body_json")),
    })
    aliased = select_route(staged, tasks)
    is_alias = F.col("task").isNotNull()
    considered = F.col("model").isNotNull() & ~is_alias
    asked = considered & F.col("capable") & (F.trim("_prompt") != "")
    paired = select_downgrade(aliased.withColumn("eligible", F.coalesce(asked, F.lit(False))), downgrades)
    # Only a prompt that a cheaper model is named for is scored: nothing else is read off its score.
    in_question = paired.withColumn("_prompt", F.when(F.col("target").isNotNull(), F.col("_prompt")))
    scored = complexity(in_question, "_prompt").withColumn("target", F.when(downgrade_eligible(), F.col("target")))
    target = F.col("target")
    note = sanitize_label(F.format_string(
        "would-route %s->%s tier=%s score=%s", "model", target, "complexity.tier",
        F.col("complexity.score").cast("string")))
    applied = F.lit("dry_run" if dry_run else "applied")
    result = (
        F.when(F.col("route_error") == "unknown_router_task", "unknown_task")
        .when(F.col("route_error") == "no_route", "no_route").when(is_alias, "routed")
        .when(~considered, None).when(~F.col("capable"), "skipped_excluded")
        .when(target.isNull(), "skipped").otherwise("dry_run" if dry_run else "routed")
    )
    routed = F.coalesce("chosen", target)
    return scored.select(
        *requests.columns,
        F.when(routed.isNotNull(), F.left("model", F.lit(K.MODEL_LIMIT))).alias("requested_model"),
        routed.alias("routed_model"),
        F.when(F.col("chosen").isNotNull(), "applied").when(target.isNotNull(), applied)
        .alias("routing_mode"),
        F.coalesce("chosen", *([] if dry_run else [target]), "model").alias("served_model"),
        "retry_plan",
        (F.when(target.isNotNull(), note) if dry_run else F.lit(None).cast("string")).alias("routing_note"),
        "route_error",
        F.when(is_alias, "alias").when(considered, "downgrade").alias("metric_mode"),
        result.alias("metric_result"),
    )


def served_attempt(attempts: DataFrame) -> DataFrame:
    """Attempt log (request_id, attempt from 0, model, status or NULL on a connection error,
    plan_size) -> the served attempt per request.

    The first attempt that is no 5xx and no connection error, else the last one within the
    plan. An aggregate with map-side combine; no ordering of groups.
    """
    failed = F.col("status").isNull() | F.col("status").between(500, 599)
    rank = F.struct(failed.alias("failed"), F.when(failed, -F.col("attempt")).otherwise(F.col("attempt")).alias("at"))
    pick = F.min_by(F.struct("attempt", "model", "status"), rank)
    return (
        attempts.where(F.col("attempt") <= F.col("plan_size"))
        .groupBy("request_id").agg(pick.alias("_a")).select("request_id", "_a.*")
    )


def with_member(body: Column, key: str, value: Column) -> Column:
    """JSON object text with a top-level member set; NULL if the body is no object."""
    members = F.from_json(body, "map<string,variant>")
    return F.to_json(F.map_concat(members, F.create_map(F.lit(key), value)))


def rewrite_model(body: Column, model: Column) -> Column:
    """Body with its ``model`` replaced. Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``."""
    return with_member(body, "model", child(F.parse_json(F.to_json(F.struct(model.alias("m")))), "$.m"))
