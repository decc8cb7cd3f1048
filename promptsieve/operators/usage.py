"""Billed tokens, telemetry events, spend and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.text import tokens_estimate
from promptsieve.functions.variant import count_at, parse_body

EVENT_COLUMNS = {
    "event_id": "string", "ts": "timestamp", "event_type": "string", "category": "string",
    "signature_id": "string", "latency_ms": "bigint", "provider": "string",
    "endpoint": "string", "model": "string", "input_tokens": "bigint",
    "output_tokens": "bigint", "requested_model": "string", "routed_model": "string",
    "routing_mode": "string", "cache_read_tokens": "bigint", "cache_hit": "boolean",
    "cached_input_tokens": "bigint", "cached_output_tokens": "bigint", "instance_id": "string",
}


def billed_tokens(response: Column) -> Column:
    """STRUCT<input_tokens, output_tokens, cache_read_tokens> of a VARIANT response body.

    NULL means unknown, never zero. A bad cache-read count is 0.
    """
    counts = F.struct(
        count_at(response, "$.usage.prompt_tokens").alias("prompt"),
        count_at(response, "$.usage.completion_tokens").alias("completion"),
        count_at(response, "$.usage.input_tokens").alias("given"),
        count_at(response, "$.usage.output_tokens").alias("made"),
        count_at(response, "$.usage.cache_read_input_tokens").alias("read"),
    )
    zero = F.lit(0).cast("bigint")
    shape = lambda i, o, r: F.struct(
        i.alias("input_tokens"), o.alias("output_tokens"), r.alias("cache_read_tokens"))

    def pick(c: Column) -> Column:
        return F.when(
            c.prompt.isNotNull() & c.completion.isNotNull(), shape(c.prompt, c.completion, zero)
        ).when(
            c.given.isNotNull() & c.made.isNotNull(), shape(c.given, c.made, F.coalesce(c.read, zero)))

    # The one-element array binds the counts, so each is read once.
    return F.transform(F.array(counts), pick)[0]


def model_label(body: Column) -> Column:
    """Model name as text, cut to its limit; a name that is no string keeps its JSON text."""
    return F.left(F.try_variant_get(body, "$.model", "string"), F.lit(K.MODEL_LIMIT))


def as_events(df: DataFrame) -> DataFrame:
    """Project onto the event columns; what is missing becomes NULL (cache_hit false)."""
    have = set(df.columns)
    return df.select(*[
        (F.col(n).cast(t) if n in have else F.lit(False if n == "cache_hit" else None).cast(t)).alias(n)
        for n, t in EVENT_COLUMNS.items()
    ])


def usage_events(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Usage events of answered requests.

    requests: request_id, ts, provider, endpoint, instance_id and, if routed, requested_model,
    routed_model, routing_mode. responses: request_id, status, body, latency_ms. Only 2xx with
    recognised usage count, blocked answers too. Both sides are unique per request, so the
    join has no hot key. The counts come out of an outer generator on purpose: the filter on them would
    else be taken below, and build and parse the body once for each count that it tests.
    """
    billed = (
        responses.where(F.col("status").between(200, 299))
        .withColumn("_json", parse_body(F.col("body")))
        .select("request_id", "latency_ms", F.explode_outer(F.array(billed_tokens(F.col("_json")))).alias("_billed"),
                model_label(F.col("_json")).alias("model"))
        .where("_billed is not null")
    )
    joined = requests.join(billed, "request_id").withColumns({
        "event_type": F.lit("usage"), "category": F.lit("usage"),
        "event_id": F.concat(F.lit("usage-"), F.col("request_id").cast("string")),
        "input_tokens": F.col("_billed.input_tokens"), "output_tokens": F.col("_billed.output_tokens"),
        "cache_read_tokens": F.nullif("_billed.cache_read_tokens", F.lit(0).cast("bigint")),
    })
    return as_events(joined)


def cache_hit_events(hits: DataFrame) -> DataFrame:
    """Usage events of answers served from the cache (stored model, input_tokens,
    output_tokens, status, blocked): nothing was spent, the stored tokens were avoided.
    A blocked hit served nothing and gives no event."""
    served = hits.where(F.col("status").between(200, 299) & ~F.coalesce("blocked", F.lit(False)))
    return as_events(served.withColumns({
        "event_type": F.lit("usage"), "category": F.lit("usage"), "cache_hit": F.lit(True),
        "event_id": F.concat(F.lit("hit-"), F.col("request_id").cast("string")),
        "cached_input_tokens": F.col("input_tokens"), "cached_output_tokens": F.col("output_tokens"),
        "input_tokens": F.lit(0), "output_tokens": F.lit(0),
    }))


def detection_events(scans: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Detection events of resolved scans (final_action, category, signature_id, body) and of
    scanned responses (hit_count, response_category, response_signature_id).

    Only blocks report the model and a token estimate of the text.
    """
    block = F.col("final_action") == "block"
    found = scans.where(F.col("final_action").isin("block", "warn", "log")).withColumns({
        "event_type": F.col("final_action"),
        "category": F.coalesce("category", F.lit("unknown")),
        "event_id": F.concat(F.lit("scan-"), F.col("request_id").cast("string")),
        "model": F.when(block, model_label(parse_body(F.col("body")))),
        "input_tokens": F.when(block & F.try_parse_json("body").isNotNull(), tokens_estimate("body")),
    })
    events = as_events(found)
    if responses is None:
        return events
    leaked = responses.where("hit_count > 0").withColumns({
        "event_type": F.lit("response_detection"),
        "category": F.coalesce("response_category", F.lit("unknown")),
        "signature_id": F.col("response_signature_id"),
        "event_id": F.concat(F.lit("response-"), F.col("request_id").cast("string")),
    })
    return events.unionByName(as_events(leaked))


def _price(name: str) -> Column:
    """Prices are per million tokens. Money is added up in decimals: the sum is exact and does
    not depend on how the rows are partitioned."""
    return F.col(name).cast("decimal(18,6)")


def _cost(side: str, inputs: str, outputs: str) -> Column:
    """Cost in millionths of a dollar."""
    zero = F.lit(0).cast("bigint")
    return (
        F.coalesce(inputs, zero) * _price(f"{side}.input_price")
        + F.coalesce(outputs, zero) * _price(f"{side}.output_price"))


def _share(tokens: str, side: str, share: str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.coalesce(tokens, zero) * _price(f"{side}.input_price") * F.lit(share).cast("decimal(2,1)")


def _dollars(total: Column) -> Column:
    return total.cast("double") / 1e6


def usage_rollup(events: DataFrame, prices: DataFrame, by=("provider", "model", "instance_id")) -> DataFrame:
    """Requests, tokens and spend with subtotals (rollup); ``level`` counts the rolled-up keys."""
    joined = events.where("event_type = 'usage'").alias("e").join(
        prices.alias("p"), F.col("e.model") == F.col("p.model"), "left")
    cost = _cost("p", "e.input_tokens", "e.output_tokens") + _share("e.cache_read_tokens", "p", "0.1")
    staged = joined.select("e.*", cost.alias("_spend"))
    return staged.rollup(*by).agg(
        F.bit_count(F.grouping_id()).alias("level"),
        F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.coalesce(_dollars(F.sum("_spend")), F.lit(0.0)).alias("spend_usd"),
    )


def savings(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Savings per source and state, one row each.

    routing: (price of the requested - price of the routed model) x billed tokens, realised
    if applied, projected if dry_run; aliases have no price and save nothing.
    prompt_cache: cache reads at a tenth of the input price. response_cache: the avoided
    tokens at full price.
    """
    e, p = events.where("event_type = 'usage'").alias("e"), prices
    priced = (
        e.join(p.alias("q"), F.col("e.requested_model") == F.col("q.model"), "left")
        .join(p.alias("r"), F.col("e.routed_model") == F.col("r.model"), "left")
        .join(p.alias("m"), F.col("e.model") == F.col("m.model"), "left")
    )
    routed = _cost("q", "e.input_tokens", "e.output_tokens") - _cost("r", "e.input_tokens", "e.output_tokens")
    is_routed = F.col("e.routing_mode").isNotNull() & ~F.coalesce(
        F.col("e.requested_model").startswith(K.ROUTER_PREFIX), F.lit(True))
    item = lambda kind, state, amount: F.struct(
        F.lit(kind).alias("source"), state.alias("state"),
        amount.cast("decimal(38,7)").alias("millionths"))
    sources = F.array_compact(F.array(
        F.when(is_routed & routed.isNotNull(), item(
            "routing", F.when(F.col("e.routing_mode") == "applied", "realized").otherwise("projected"), routed)),
        F.when(F.col("e.cache_read_tokens") > 0, item(
            "prompt_cache", F.lit("realized"),
            _share("e.cache_read_tokens", "m", "0.9"))),
        F.when(F.col("e.cache_hit"), item(
            "response_cache", F.lit("realized"),
            _cost("m", "e.cached_input_tokens", "e.cached_output_tokens"))),
    ))
    return (
        priced.select(F.inline(sources)).groupBy("source", "state")
        .agg(F.count("*").alias("requests"), _dollars(F.sum("millionths")).alias("saved_usd"))
    )
