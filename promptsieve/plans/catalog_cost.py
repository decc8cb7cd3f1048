"""Registered queries: complexity, routing, repeats, tokens, spend, savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions.variant import parse_body
from promptsieve.operators import repeats as R
from promptsieve.operators import routing as G
from promptsieve.operators import usage as U
from promptsieve.operators.complexity import complexity, downgrade_eligible
from promptsieve.plans import traffic as X
from promptsieve.plans.catalog_detection import LEAK_RULES
from promptsieve.plans.catalog_policy import RESOLVED, _resolved
from promptsieve.plans.catalog_text import TOKENS, occurrences_sql

BODY = lambda: parse_body(F.col("body"))
VALID = "body NOT LIKE 'no json%'"
PROMPT = (
    f"CASE WHEN {VALID} THEN CASE conv_id % 5 WHEN 0 THEN 'Be brief.' || chr(10) WHEN 1 THEN 'Be kind.' || chr(10) ELSE '' END || "
    "CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'Explain why, step by step: ' WHEN 2 THEN 'Compare the design of ' ELSE 'hello ' END || text END"
)
CAPABLE = "NOT (conv_id % 11 = 0 OR conv_id % 7 = 0 OR (conv_id % 3 <> 0 AND conv_id % 17 = 1))"


def _score_ctes(source: str, text: str) -> str:
    count = lambda words: occurrences_sql("low", words)
    return f"""counted AS (SELECT *, lower({text}) AS low FROM {source}),
dims AS (SELECT *, coalesce(len(regexp_extract_all({text}, '{TOKENS}')), 0) AS n_tokens,
  contains({text}, '```') OR regexp_matches({text}, {X.quoted(K.CODE_HINTS)}) AS has_code,
  {count(K.REASONING_MARKERS)} AS n_reasoning, {count(K.TECHNICAL_TERMS)} AS n_technical, {count(K.ANALYSIS_VERBS)} AS n_analysis,
  {count(K.SIMPLE_INDICATORS)} AS n_simple, regexp_matches({text}, {X.quoted(K.MULTISTEP)}, 'is') AS has_steps,
  length({text}) - length(replace({text}, '?', '')) + {count(K.DEEP_QUESTIONS)} AS n_question FROM counted),
blend AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  least(n_tokens / 2000.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + has_code::INT * 0.20::DOUBLE + least(n_reasoning / 2.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE
  + least(n_technical / 3.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + least(n_analysis / 1.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE + has_steps::INT * 0.10::DOUBLE
  + least(n_question / 3.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE - least(n_simple / 2.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE)) AS blended FROM dims),
scored AS (SELECT *, CASE WHEN n_reasoning >= 2 THEN greatest(blended, 0.6::DOUBLE) ELSE blended END AS raw_score,
  CASE WHEN n_reasoning >= 2 THEN 'strong' WHEN blended < 0.15 THEN 'trivial' WHEN blended < 0.35 THEN 'simple' WHEN blended < 0.6 THEN 'moderate' ELSE 'strong' END AS tier,
  has_code OR n_reasoning > 0 OR n_technical > 0 OR n_analysis > 0 OR has_steps AS has_signal FROM blend)"""


def _complexity(spark, sf):
    base = X.prompts(spark, sf).select("request_id", "text")
    c = F.col("complexity")
    return complexity(base).select(
        "request_id", c.tier.alias("tier"), F.round(c.raw_score, 6).alias("score"),
        c.reasoning_markers.cast("bigint").alias("reasoning_markers"), c.has_complexity_signal.alias("has_signal"),
        *[c.breakdown[n].alias(f"part_{n}") for n in K.COMPLEXITY_WEIGHTS])


def _tiers(spark, sf):
    base = X.table(spark, sf, "documents").select("text")
    scored = complexity(base).select(F.col("complexity.tier").alias("tier"), downgrade_eligible().alias("eligible"))
    return scored.groupBy("tier", "eligible").agg(F.count("*").alias("n"))


def _capable(spark, sf):
    return X.chat(spark, sf).select("request_id", F.coalesce(G.capability_ok(BODY()), F.lit(True)).alias("capable"))


def _task(spark, sf):
    model = F.try_variant_get(BODY(), "$.model", "string")
    return X.chat(spark, sf).select("request_id", G.router_task(model).alias("task"))


def _requests(spark, sf):
    return X.chat(spark, sf).select("request_id", "provider", BODY().alias("body_json"))


def _plans(dry_run: bool):
    def build(spark, sf):
        routed = G.plan_routes(_requests(spark, sf), X.dimension(spark, "tasks"), X.dimension(spark, "downgrades"), dry_run)
        return routed.select(
            "request_id", "requested_model", "routed_model", "routing_mode", "served_model",
            F.array_join("retry_plan", ",").alias("retry_plan"), "route_error", "metric_mode", "metric_result")

    return build


def _route_ctes(dry_run: bool) -> str:
    mode, served = ("dry_run", "NULL") if dry_run else ("applied", "target")
    done = "dry_run" if dry_run else "routed"
    return f"""{X.CHAT}, texts AS (SELECT *, {PROMPT} AS prompt, {VALID} AS valid, {CAPABLE} AS capable,
  CASE WHEN {VALID} THEN json_extract_string(body, '$.model') END AS model FROM chat), {_score_ctes('texts', 'prompt')},
aliased AS (SELECT *, CASE WHEN starts_with(model, 'router:') THEN substr(model, 8) END AS task,
  CASE WHEN model = 'router:chat' THEN CASE WHEN capable THEN 'mini' ELSE 'max' END END AS chosen,
  CASE WHEN model = 'router:chat' THEN CASE WHEN capable THEN 'mid,max' ELSE '' END END AS retry_plan,
  CASE WHEN model = 'router:nope' THEN 'unknown_router_task' WHEN model = 'router:empty' THEN 'no_route' END AS route_error FROM scored),
targets AS (SELECT *, CASE WHEN task IS NULL AND model IS NOT NULL AND capable AND trim(prompt) <> '' AND tier IN ('trivial', 'simple') AND NOT has_signal THEN
  CASE WHEN provider = 'openai' AND model = 'gpt-4o' THEN 'gpt-4o-mini' WHEN provider = 'anthropic' AND model = 'claude-big' THEN 'claude-small' END END AS target FROM aliased),
routed AS (SELECT *, CASE WHEN coalesce(chosen, target) IS NOT NULL THEN model END AS requested_model, coalesce(chosen, target) AS routed_model,
  CASE WHEN chosen IS NOT NULL THEN 'applied' WHEN target IS NOT NULL THEN '{mode}' END AS routing_mode,
  coalesce(chosen, {served}, model) AS served_model,
  CASE WHEN task IS NOT NULL THEN 'alias' WHEN model IS NOT NULL THEN 'downgrade' END AS metric_mode,
  CASE WHEN route_error = 'unknown_router_task' THEN 'unknown_task' WHEN route_error IS NOT NULL THEN 'no_route' WHEN task IS NOT NULL THEN 'routed'
   WHEN model IS NULL THEN NULL WHEN NOT capable THEN 'skipped_excluded' WHEN target IS NULL THEN 'skipped' ELSE '{done}' END AS metric_result FROM targets)"""


_ROUTE_COLUMNS = "request_id, requested_model, routed_model, routing_mode, served_model, retry_plan, route_error, metric_mode, metric_result"


def _select_route(spark, sf):
    base = X.chat(spark, sf).select("request_id", F.try_variant_get(BODY(), "$.model", "string").alias("model"),
                                    F.coalesce(G.capability_ok(BODY()), F.lit(True)).alias("capable"))
    return G.select_route(base, X.dimension(spark, "tasks")).select(
        "request_id", "task", "chosen", F.array_join("retry_plan", ",").alias("retry_plan"), "route_error")


def _routing_note(spark, sf):
    routed = G.plan_routes(_requests(spark, sf), X.dimension(spark, "tasks"), X.dimension(spark, "downgrades"))
    return routed.select("request_id", F.regexp_replace("routing_note", " score=.*", "").alias("note"))


def _attempts(spark, sf):
    """Three attempts per order line group: status by quantity, some connection errors."""
    lines = X.table(spark, sf, "lineitem")
    log = lines.select(
        F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") - 1).alias("attempt"),
        F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
        F.expr("case when l_returnflag = 'A' then 503 when l_returnflag = 'R' then null when l_linestatus = 'O' then 200 else 429 end").alias("status"),
        F.lit(3).alias("plan_size"))
    first = log.groupBy("request_id", "attempt").agg(F.min_by(F.struct("model", "status", "plan_size"), F.coalesce("status", F.lit(0))).alias("a"))
    return G.served_attempt(first.select("request_id", "attempt", "a.*")).select(
        "request_id", F.col("attempt").cast("bigint").alias("attempt"), "model", F.col("status").cast("bigint").alias("status"))


_ATTEMPTS = """WITH log AS (SELECT l_orderkey AS request_id, l_linenumber - 1 AS attempt, 'm' || l_linenumber AS model,
  CASE WHEN l_returnflag = 'A' THEN 503 WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' THEN 200 ELSE 429 END AS status FROM lineitem),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, attempt ORDER BY coalesce(status, 0)) AS rn FROM log) WHERE rn = 1 AND attempt <= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY (status IS NULL OR status BETWEEN 500 AND 599),
  CASE WHEN status IS NULL OR status BETWEEN 500 AND 599 THEN -attempt ELSE attempt END) AS pick FROM first)
SELECT request_id, attempt::BIGINT AS attempt, model, status::BIGINT AS status FROM ranked WHERE pick = 1"""


def _rewritten(spark, sf):
    body = G.rewrite_model(F.when(F.col("body").startswith("{"), F.col("body")), F.concat(F.lit("new-"), "provider"))
    v = F.try_parse_json(body)
    return X.chat(spark, sf).select(
        "request_id", F.try_variant_get(v, "$.model", "string").alias("model"),
        F.try_variant_get(v, "$.messages[0].role", "string").alias("role"))


REPEATABLE = f"({VALID} AND conv_id % 11 <> 0 AND conv_id % 7 <> 0 AND turn % 3 <> 1 AND conv_id % 3 <> 0 AND conv_id % 17 <> 1)"


def _repeatable(spark, sf):
    return X.chat(spark, sf).select("request_id", F.coalesce(R.is_repeatable(BODY()), F.lit(False)).alias("repeatable"))


def _fingerprint(spark, sf):
    key = R.request_fingerprint(F.lit("tenant"), F.col("provider"), F.col("path"), F.col("body"))
    return X.chat(spark, sf).select("request_id", key.alias("fingerprint"))


# The canonical body: members sorted, as the request was put together.
_CANON = (
    "'{\"messages\":[{\"content\":\"' || " + X._OPENING + " || " + X._ESCAPED + " || '\",\"role\":\"' || role || '\"}],\"model\":\"' || model || '\"' "
    "|| CASE WHEN turn % 3 = 2 THEN ',\"seed\":7' ELSE '' END "
    "|| CASE conv_id % 5 WHEN 0 THEN ',\"system\":\"Be brief.\"' WHEN 1 THEN ',\"system\":[{\"text\":\"Be kind.\",\"type\":\"text\"}]' ELSE '' END "
    "|| CASE WHEN turn % 3 = 0 THEN ',\"temperature\":0' ELSE '' END || '}'"
)
_GLOBS = ["/openai/*", "*/mess?ges"]


def _route_allowed(spark, sf):
    return X.chat(spark, sf).select("request_id", R.route_allowed(F.col("path"), _GLOBS).alias("allowed"))


def _gate(spark, sf):
    requests = X.chat(spark, sf).select("request_id", (F.col("conv_id") % 10).alias("policy_id"))
    categories = X.table(spark, sf, "labels").selectExpr("doc_id % 10 as policy_id", "case when toxic = 1 and quality = 0 and doc_id % 3 = 0 then 'pii' when quality = 0 then 'phi-like' else 'jailbreak' end as category")
    return R.sensitive_policy_gate(requests, categories)


def _events(spark, sf):
    return X.table(spark, sf, "events").selectExpr(
        "event_id as request_id", "ts", "event_type || ':' || props as key", "event_type")


def _hits(spark, sf):
    return R.repeat_hits(_events(spark, sf), 3600, storable=F.col("event_type") != "error").select("request_id", "is_hit")


_CHAIN = """ev AS (SELECT event_id, event_type || ':' || props AS key, epoch_ms(ts) AS t, event_type <> 'error' AS storable FROM events),
chain AS (SELECT key, min(t) AS t FROM ev WHERE storable GROUP BY key
  UNION ALL SELECT c.key, min(e.t) FROM chain c JOIN ev e ON e.key = c.key AND e.storable AND e.t >= c.t + 3600000 GROUP BY c.key),
stores AS (SELECT c.key, c.t, min(e.event_id::VARCHAR) AS id FROM chain c JOIN ev e ON e.key = c.key AND e.t = c.t AND e.storable GROUP BY ALL),
hits AS (SELECT e.event_id, EXISTS (SELECT 1 FROM stores s WHERE s.key = e.key AND s.t <= e.t AND e.t - s.t < 3600000
  AND (e.t > s.t OR e.event_id::VARCHAR > s.id)) AS is_hit FROM ev e)"""


def _rewrite(spark, sf):
    base = X.chat(spark, sf).select(
        "request_id", "provider", "body", F.concat(F.lit("https://api.example.com"), "path").alias("url"))
    out = R.prompt_cache_rewrite(base)
    v = F.try_parse_json(F.col("outbound_body"))
    return out.select(
        "request_id", "prompt_cached", F.col("prefix_length").cast("bigint").alias("prefix_length"),
        F.try_variant_get(v, "$.system[0].cache_control.type", "string").alias("marker"),
        F.try_variant_get(v, "$.messages[0].role", "string").alias("role"))


def _billed(spark, sf):
    return X.responses(spark, sf).select("request_id", U.billed_tokens(BODY()).alias("b")).select(
        "request_id", "b.input_tokens", "b.output_tokens", "b.cache_read_tokens")


BILLED = """billed AS (SELECT *, CASE WHEN conv_id6 IN (0, 1, 2) THEN length(text) % 500 END AS input_tokens,
  CASE WHEN conv_id6 IN (0, 1, 2) THEN turn + 1 END AS output_tokens,
  CASE conv_id6 WHEN 0 THEN 0 WHEN 1 THEN length(text) % 500 WHEN 2 THEN 0 END AS cache_read,
  CASE conv_id6 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-big' WHEN 2 THEN 'claude-big' END AS answer_model
  FROM (SELECT r.*, (request_id // 1000) % 6 AS conv_id6, request_id % 1000 AS turn FROM responses r))"""


def usage_events(spark, sf):
    """Usage events of the chat traffic, routing decided in dry run."""
    routed = G.plan_routes(
        X.chat(spark, sf).select("request_id", "provider", "path", BODY().alias("body_json")),
        X.dimension(spark, "tasks"), X.dimension(spark, "downgrades"))
    requests = routed.selectExpr(
        "request_id", "timestamp_seconds(1704067200 + request_id) as ts", "provider", "path as endpoint",
        "'i' || (request_id % 2) as instance_id", "requested_model", "routed_model", "routing_mode")
    return U.usage_events(requests, X.responses(spark, sf))


USAGE = f"""{_route_ctes(True)}, {X.RESPONSES}, {BILLED},
usage AS (SELECT r.request_id, r.provider, r.path AS endpoint, 'i' || (r.request_id % 2) AS instance_id, b.answer_model AS model,
  b.input_tokens, b.output_tokens, nullif(b.cache_read, 0) AS cache_read_tokens, b.latency_ms, r.requested_model, r.routed_model, r.routing_mode
  FROM routed r JOIN billed b USING (request_id) WHERE b.status BETWEEN 200 AND 299 AND b.input_tokens IS NOT NULL)"""


def _usage(spark, sf):
    return usage_events(spark, sf).select(
        F.col("event_id"), "provider", "endpoint", "instance_id", "model", "input_tokens", "output_tokens",
        "cache_read_tokens", "latency_ms", "requested_model", "routed_model", "routing_mode")


def _cache_hits(spark, sf):
    """Repeats of the events, answered from stored responses of fixed size."""
    hits = R.repeat_hits(_events(spark, sf), 3600, storable=F.col("event_type") != "error").where("is_hit")
    stored = hits.selectExpr(
        "request_id", "ts", "'openai' as provider", "event_type as endpoint", "'gpt-4o' as model", "100L as input_tokens",
        "20L as output_tokens", "200 as status", "event_type = 'click' as blocked", "'i0' as instance_id")
    return U.cache_hit_events(stored)


def _cache_hit_rows(spark, sf):
    return _cache_hits(spark, sf).select(
        "event_id", "endpoint", "model", "input_tokens", "output_tokens", "cached_input_tokens", "cached_output_tokens", "cache_hit")


_CACHE_HITS = f"""WITH RECURSIVE {_CHAIN} SELECT 'hit-' || event_id AS event_id, split_part(key, ':', 1) AS endpoint, 'gpt-4o' AS model,
0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, 100::BIGINT AS cached_input_tokens, 20::BIGINT AS cached_output_tokens, true AS cache_hit
FROM hits JOIN ev USING (event_id) WHERE is_hit AND split_part(key, ':', 1) <> 'click'"""


def _detections(spark, sf):
    from promptsieve.operators.responses import scan_responses

    scans = _resolved(spark, sf).withColumns({
        "body": F.to_json(F.struct(F.lit("gpt-4o").alias("model"), F.col("text").alias("prompt"))),
        "provider": F.lit("openai"), "endpoint": F.lit("/v1")})
    leaks = scan_responses(X.table(spark, sf, "documents").selectExpr("doc_id as request_id", "text"), "text", LEAK_RULES)
    return U.detection_events(scans, leaks).groupBy("event_type", "category", "signature_id", "model").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"))


def _detections_sql() -> str:
    from promptsieve.plans.catalog_detection import RANK, _OUTPUTS, matches_cte, rules_cte

    kept = LEAK_RULES.for_responses()
    leak = rules_cte(kept).replace("rules AS", "leak_rules AS", 1) + ", " + matches_cte(kept, "outputs").replace("matches AS", "leak_matches AS", 1)
    body = "'{\"model\":\"gpt-4o\",\"prompt\":' || to_json(text)::VARCHAR || '}'"
    return f"""{RESOLVED}, {_OUTPUTS}, {leak},
leaks AS (SELECT * FROM (SELECT request_id, category, id, row_number() OVER (PARTITION BY request_id ORDER BY {RANK.format('action')} DESC, ord) AS rn
  FROM leak_matches JOIN leak_rules USING (ord)) WHERE rn = 1),
events_out AS (SELECT final_action AS event_type, coalesce(category, 'unknown') AS category, signature_id,
  CASE WHEN final_action = 'block' THEN 'gpt-4o' END AS model, CASE WHEN final_action = 'block' THEN len(regexp_extract_all({body}, '{TOKENS}')) END AS tokens
  FROM resolved WHERE final_action <> 'allow'
  UNION ALL SELECT 'response_detection', category, id, NULL, NULL FROM leaks)
SELECT event_type, category, signature_id, model, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM events_out GROUP BY ALL"""


_PRICES = X.values("prices", "model, input_price, output_price", X.PRICES)


def _rollup(spark, sf):
    return U.usage_rollup(usage_events(spark, sf), X.dimension(spark, "prices")).select(
        "provider", "model", "instance_id", F.col("level").cast("bigint").alias("level"), "requests",
        "input_tokens", "output_tokens", "spend_usd")


_ROLLUP = f"""WITH {USAGE}, {_PRICES}, costed AS (SELECT u.*, coalesce(input_tokens, 0) * input_price::DECIMAL(18,6) + coalesce(output_tokens, 0) * output_price::DECIMAL(18,6)
  + coalesce(cache_read_tokens, 0) * input_price::DECIMAL(18,6) * 0.1 AS cost FROM usage u LEFT JOIN prices p USING (model))
SELECT provider, model, instance_id, (grouping(provider) + grouping(model) + grouping(instance_id))::BIGINT AS level, count(*) AS requests,
sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, coalesce(sum(cost)::DOUBLE / 1e6, 0.0) AS spend_usd
FROM costed GROUP BY ROLLUP (provider, model, instance_id)"""


def _savings(spark, sf):
    events = usage_events(spark, sf).unionByName(_cache_hits(spark, sf))
    return U.savings(events, X.dimension(spark, "prices")).select(
        "source", "state", "requests", "saved_usd")


_SAVINGS = f"""WITH RECURSIVE {USAGE}, {_PRICES}, {_CHAIN},
cached AS (SELECT count(*) AS n FROM hits JOIN ev USING (event_id) WHERE is_hit AND split_part(key, ':', 1) <> 'click'),
parts AS (SELECT 'routing' AS source, 'projected' AS state, (input_tokens * (q.input_price::DECIMAL(18,6) - r.input_price::DECIMAL(18,6))
  + output_tokens * (q.output_price::DECIMAL(18,6) - r.output_price::DECIMAL(18,6)))::DECIMAL(38,7) AS millionths
  FROM usage u JOIN prices q ON u.requested_model = q.model JOIN prices r ON u.routed_model = r.model WHERE routing_mode = 'dry_run'
  UNION ALL SELECT 'prompt_cache', 'realized', (cache_read_tokens * input_price::DECIMAL(18,6) * 0.9)::DECIMAL(38,7) FROM usage u LEFT JOIN prices p ON u.model = p.model WHERE cache_read_tokens > 0)
SELECT source, state, count(*) AS requests, sum(millionths)::DOUBLE / 1e6 AS saved_usd FROM parts GROUP BY ALL
UNION ALL SELECT 'response_cache', 'realized', n, (n * (100 * 2.5 + 20 * 10.0))::DOUBLE / 1e6 FROM cached WHERE n > 0"""

#: Parts of the score at 3 places; a tie in the tokens' part (thousandths are halves) goes to the even side.
_BREAKDOWN = ", ".join([
    "least(n_tokens // 2 + (n_tokens % 2) * (n_tokens // 2 % 2), 1000) / 1000.0::DOUBLE AS part_tokens",
    "has_code::INT::DOUBLE AS part_code", "has_steps::INT::DOUBLE AS part_multistep",
    *[f"round(least(n_{n} / {bound}.0::DOUBLE, 1.0::DOUBLE), 3) AS part_{n}" for n, bound in (
        ("reasoning", 2), ("technical", 3), ("analysis", 1), ("simple", 2), ("question", 3))]])

ENTRIES = {
    "cst_complexity": (
        _complexity,
        f"WITH {X.PROMPTS}, {_score_ctes('prompts', 'text')} SELECT request_id, tier, round(raw_score, 6) AS score, "
        f"n_reasoning::BIGINT AS reasoning_markers, has_signal, {_BREAKDOWN} FROM scored"),
    "cst_downgrade_eligible": (
        _tiers,
        f"WITH {_score_ctes('documents', 'text')} SELECT tier, tier IN ('trivial', 'simple') AND NOT has_signal AS eligible, count(*) AS n FROM scored GROUP BY ALL"),
    "cst_capability_ok": (_capable, f"WITH {X.CHAT} SELECT request_id, NOT ({VALID}) OR {CAPABLE} AS capable FROM chat"),
    "cst_router_task": (
        _task, f"WITH {X.CHAT} SELECT request_id, CASE WHEN {VALID} AND (conv_id + turn) % 6 IN (1, 4, 5) THEN "
        "substr(json_extract_string(body, '$.model'), 8) END AS task FROM chat"),
    "cst_select_route": (
        _select_route,
        f"WITH {_route_ctes(True)} SELECT request_id, task, chosen, retry_plan, route_error FROM routed"),
    "cst_plan_routes_dry_run": (_plans(True), f"WITH {_route_ctes(True)} SELECT {_ROUTE_COLUMNS} FROM routed"),
    "cst_plan_routes_applied": (_plans(False), f"WITH {_route_ctes(False)} SELECT {_ROUTE_COLUMNS} FROM routed"),
    "cst_routing_note": (
        _routing_note,
        f"WITH {_route_ctes(True)} SELECT request_id, CASE WHEN target IS NOT NULL THEN 'would-route ' || model || '->' || target || ' tier=' || tier END AS note FROM routed"),
    "cst_served_attempt": (_attempts, _ATTEMPTS),
    "cst_rewrite_model": (
        _rewritten, f"WITH {X.CHAT} SELECT request_id, CASE WHEN {VALID} THEN 'new-' || provider END AS model, CASE WHEN {VALID} THEN role END AS role FROM chat"),
    "cst_is_repeatable": (_repeatable, f"WITH {X.CHAT} SELECT request_id, {REPEATABLE} AS repeatable FROM chat"),
    "cst_request_fingerprint": (
        _fingerprint,
        f"WITH {X.CHAT}, m AS (SELECT *, CASE WHEN {VALID} THEN json_extract_string(body, '$.model') END AS model FROM chat) SELECT request_id, "
        f"CASE WHEN {REPEATABLE} THEN 'repeat:tenant:' || provider || ':' || path || ':' || sha256({_CANON}) END AS fingerprint FROM m"),
    "cst_route_allowed": (
        _route_allowed,
        f"WITH {X.CHAT} SELECT request_id, split_part(path, '?', 1) GLOB '/openai/*' OR split_part(path, '?', 1) GLOB '*/mess?ges' AS allowed FROM chat"),
    "cst_sensitive_policy_gate": (
        _gate,
        f"WITH {X.CHAT} SELECT request_id, conv_id % 10 AS policy_id FROM chat WHERE conv_id % 10 NOT IN "
        "(SELECT doc_id % 10 FROM labels WHERE toxic = 1 AND quality = 0 AND doc_id % 3 = 0)"),
    "cst_repeat_hits": (_hits, f"WITH RECURSIVE {_CHAIN} SELECT event_id AS request_id, is_hit FROM hits"),
    "cst_prompt_cache_rewrite": (
        _rewrite,
        f"WITH {X.CHAT}, f AS (SELECT *, {VALID} AND provider = 'anthropic' AND conv_id % 5 = 0 AND split_part(path, '?', 1) LIKE '%/messages' AS hit FROM chat) "
        f"SELECT request_id, hit AS prompt_cached, CASE WHEN hit THEN 9 END::BIGINT AS prefix_length, CASE WHEN hit THEN 'ephemeral' END AS marker, "
        f"CASE WHEN {VALID} THEN role END AS role FROM f"),
    "cst_billed_tokens": (
        _billed,
        f"WITH {X.RESPONSES}, {BILLED} SELECT request_id, input_tokens, output_tokens, cache_read AS cache_read_tokens FROM billed"),
    "cst_usage_events": (
        _usage,
        f"WITH {USAGE} SELECT 'usage-' || request_id AS event_id, provider, endpoint, instance_id, model, input_tokens, output_tokens, cache_read_tokens, "
        "latency_ms, requested_model, routed_model, routing_mode FROM usage"),
    "cst_cache_hit_events": (_cache_hit_rows, _CACHE_HITS),
    "cst_detection_events": (_detections, _detections_sql()),
    "cst_usage_rollup": (_rollup, _ROLLUP),
    "cst_savings": (_savings, _SAVINGS),
}
