"""Registered queries: policy, validation, outcomes, identity, upstreams, request source."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptsieve.functions.variant import child, kind, text_at
from promptsieve.operators import identity as I
from promptsieve.operators import policy as P
from promptsieve.plans import traffic as X
from promptsieve.plans.catalog_detection import VERDICTS, verdicts
from promptsieve.sources.requests import with_body
from promptsieve.session import local_table

_POLICY = X.values("category_policy", "category, action, threshold, sensitivity", X.CATEGORY_POLICY)
_LISTS = X.values("lists", "client_id, categories", X.ALLOWLIST)
_THRESHOLD = (
    "CASE WHEN sensitivity IS NOT NULL THEN greatest(0.0, least(1.0, 1.0 - sensitivity::DOUBLE)) "
    "WHEN threshold IS NOT NULL THEN threshold::DOUBLE ELSE 0.0 END"
)


def _resolved(spark, sf, default_action: str = "block"):
    return P.resolve_policy(
        verdicts(spark, sf), X.dimension(spark, "category_policy"), X.dimension(spark, "allowlist"),
        default_action)


RESOLVED = (
    f"{VERDICTS}, {_POLICY}, {_LISTS}, allowed AS (SELECT client_id, unnest(categories) AS cat FROM lists), "
    "resolved AS (SELECT v.*, CASE WHEN v.action = 'allow' THEN 'allow' "
    "WHEN EXISTS (SELECT 1 FROM allowed a WHERE a.client_id = v.client_id AND a.cat IN ('*', v.category)) THEN 'allow' "
    f"WHEN v.confidence < coalesce((SELECT {_THRESHOLD} FROM category_policy p WHERE p.category = v.category), 0.0) THEN 'allow' "
    "ELSE coalesce((SELECT p.action FROM category_policy p WHERE p.category = v.category), 'block') END AS final_action FROM verdicts v)"
)


def _resolve(spark, sf):
    return _resolved(spark, sf).select("request_id", "client_id", "action", "category", "final_action")


def _allowlisted(spark, sf):
    base = verdicts(spark, sf).select("request_id", "client_id", "category")
    return P.is_allowlisted(base, X.dimension(spark, "allowlist"))


def _thresholds(spark, sf):
    """Threshold per document label with sensitivities and thresholds read off the row."""
    base = X.table(spark, sf, "labels").selectExpr(
        "doc_id as request_id", "case when quality = 1 then doc_id % 5 / 4.0D - 0.1D end as sensitivity",
        "case when toxic = 1 then 0.8D end as threshold")
    return base.select(
        "request_id", F.round(P.effective_threshold(F.col("threshold"), F.col("sensitivity")), 6).alias("effective"))


def _translated(spark, sf):
    """Cloud policies derived from the events: one per user, a category per event type."""
    per_type = X.table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.max("value").alias("top"))
    entry = F.struct(
        F.col("event_type").alias("key"),
        F.struct((F.col("n") % 5 != 0).alias("enabled"),
                 F.when(F.col("n") % 3 == 0, None).when(F.col("n") % 3 == 1, "warn").otherwise("block").alias("action"),
                 F.when(F.col("n") % 2 == 0, F.col("n") / 100.0).alias("threshold")).alias("value"))
    entries = F.map_from_entries(F.collect_list(entry))  # five event types per user
    policies = per_type.groupBy("user_id").agg(entries.alias("m")).select(
        F.col("user_id").alias("policy_id"),
        F.when(F.col("user_id") % 2 == 0, F.col("m")).alias("detection"),
        F.when(F.col("user_id") % 2 == 1, F.transform_values("m", lambda k, v: F.struct(v.enabled.alias("enabled"), v.action.alias("action")))).alias("categories"),
        F.when(F.col("user_id") % 3 == 0, F.struct(F.lit(0.9).alias("block_score"), F.lit(None).cast("double").alias("warn_score"))).alias("thresholds"),
    )
    return P.translate_policy(policies)


_TRANSLATED = """WITH per_type AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
entries AS (SELECT user_id AS policy_id, event_type AS category, CASE n % 3 WHEN 0 THEN NULL WHEN 1 THEN 'warn' ELSE 'block' END AS action,
  CASE WHEN n % 2 = 0 THEN n / 100.0 END AS threshold FROM per_type WHERE n % 5 <> 0),
counted AS (SELECT policy_id, coalesce(action, 'block') AS action, count(*) AS k FROM entries GROUP BY ALL),
defaults AS (SELECT policy_id, action AS default_action FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY k DESC, action) AS rn FROM counted) WHERE rn = 1)
SELECT policy_id, category, coalesce(action, default_action) AS action,
  (CASE WHEN policy_id % 2 = 0 THEN coalesce(threshold, 0.5)
   WHEN coalesce(action, default_action) = 'block' THEN CASE WHEN policy_id % 3 = 0 THEN 0.9 ELSE 0.8 END ELSE 0.5 END)::DOUBLE AS threshold,
  default_action FROM entries JOIN defaults USING (policy_id)"""


def _check_bodies(spark, sf):
    """Chat texts as detection requests, in every valid and invalid shape."""
    return X.chat(spark, sf).selectExpr(
        "request_id",
        "case request_id % 6 when 0 then '{\"text\":\"' || request_id || '\"}' when 1 then '{\"text\":\"\"}' "
        "when 2 then '{\"text\":5}' when 3 then '[1]' when 4 then '{\"other\":\"x\"}' else text end as body")


def _validated(spark, sf):
    return P.validate_check(_check_bodies(spark, sf)).select("request_id", "text", "error_type")


_VALIDATED = f"""WITH {X.CHAT} SELECT request_id, CASE request_id % 6 WHEN 0 THEN request_id::VARCHAR WHEN 1 THEN '' END AS text,
CASE request_id % 6 WHEN 0 THEN NULL WHEN 5 THEN 'invalid_json' ELSE 'invalid_request' END AS error_type FROM chat"""


def _sizes(spark, sf):
    base = X.table(spark, sf, "pages").selectExpr("page_id as request_id", "url", "html")
    return P.validate_sizes(base, "url", "html", max_request=40, max_response=5000).select("request_id", "error_type")


def _failures(mode: str):
    def build(spark, sf):
        scans = verdicts(spark, sf).select(
            "request_id", F.expr("case when label = 'benign' then null else action end").alias("action"),
            F.expr("case when label = 'benign' then null else confidence end").alias("confidence"))
        return P.apply_failure_mode(scans, mode)

    return build


def _failures_sql(mode: str) -> str:
    fail = "'block'" if mode == "closed" else "'allow'"
    error = "CASE WHEN label = 'benign' THEN 'scanner_error' END" if mode == "closed" else "NULL::VARCHAR"
    return (f"{VERDICTS} SELECT request_id, CASE WHEN label = 'benign' THEN {fail} ELSE action END AS action, "
            f"CASE WHEN label = 'benign' THEN 0.0 ELSE confidence END::DOUBLE AS confidence, {error} AS failure FROM verdicts")


def _outcomes(spark, sf):
    resolved = _resolved(spark, sf).select("request_id", "client_id", "category", "final_action", "text")
    sized = P.validate_sizes(resolved, "text", max_request=20000)
    routed = sized.withColumn("provider", F.when(F.col("client_id") != "src5", "openai"))
    return P.outcome(routed).select("request_id", "outcome_type", "outcome_code", F.col("status").cast("bigint").alias("status"))


_OUTCOMES = f"""{RESOLVED}, typed AS (SELECT *, CASE WHEN client_id = 'src5' THEN 'not_found'
  WHEN octet_length(text::BLOB) > 20000 THEN 'payload_too_large' WHEN final_action = 'block' THEN 'content_blocked' END AS outcome_type FROM resolved)
SELECT request_id, outcome_type, CASE WHEN outcome_type = 'content_blocked' THEN category || '_detected' END AS outcome_code,
CASE outcome_type WHEN 'not_found' THEN 404 WHEN 'payload_too_large' THEN 413 WHEN 'content_blocked' THEN 400 ELSE 200 END::BIGINT AS status FROM typed"""


def _identity(method: str, **options):
    def build(spark, sf):
        requests = X.chat(spark, sf).withColumn("headers", I.normalize_headers(F.col("headers")))
        who = I.client_id(F.col("headers"), F.col("remote_addr"), F.concat(F.lit("cn-"), "conv_id"), method, **options)
        return requests.select("request_id", who.alias("client_id"))

    return build


def _identity_sql(expr: str) -> str:
    return f"WITH {X.CHAT} SELECT request_id, {expr} AS client_id FROM chat"


_UPSTREAMS = X.values("upstreams", "provider, url, auth_header, timeout", X.UPSTREAMS)


def _by_path(spark, sf):
    routed = I.route_by_path(X.chat(spark, sf).select("request_id", "path"), X.dimension(spark, "upstreams"))
    return routed.withColumn("timeout", F.col("timeout").cast("bigint"))


def _hosts(spark):
    return local_table(
        spark, [("alpha", "https://thther.example.org/x", "a", 10), ("beta", "http://m.ththth.example.net:8080", None, 20)],
        "provider string, url string, auth_header string, timeout int")


_HOSTS = X.values("hosts", "host, provider, auth_header, timeout", (
    ("thther.example.org", "alpha", "a", 10), ("m.ththth.example.net", "beta", None, 20)))
_HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


def _by_host(spark, sf):
    pages = X.table(spark, sf, "pages").select("page_id", "url")
    return I.route_by_host(pages, _hosts(spark)).select(
        "page_id", "host", "provider", "auth_header", F.col("timeout").cast("bigint").alias("timeout"), "host_allowed")


def _off_list(spark, sf):
    pages = X.table(spark, sf, "pages").select("page_id", "url")
    return I.off_list_hosts(pages, _hosts(spark)).select("page_id", "host")


def _requests(spark, sf):
    v = F.col("body_json")
    return with_body(X.chat(spark, sf)).select(
        "request_id", v.isNotNull().alias("parsed"), text_at(v, "$.model").alias("model"),
        kind(child(v, "$.system")).alias("system_kind"))


_REQUESTS = f"""WITH {X.CHAT} SELECT request_id, body NOT LIKE 'no json%' AS parsed,
CASE WHEN body NOT LIKE 'no json%' THEN json_extract_string(body, '$.model') END AS model,
CASE WHEN body LIKE 'no json%' THEN NULL WHEN conv_id % 5 = 0 THEN 'STRING' WHEN conv_id % 5 = 1 THEN 'ARRAY<OBJECT<text: STRING, type: STRING>>' END AS system_kind FROM chat"""


def _header_keys(spark, sf):
    return X.chat(spark, sf).select("request_id", F.array_join(F.array_sort(F.map_keys(I.normalize_headers(F.col("headers")))), ",").alias("keys"))


ENTRIES = {
    "pol_resolve_policy": (_resolve, f"{RESOLVED} SELECT request_id, client_id, action, category, final_action FROM resolved"),
    "pol_effective_threshold": (
        _thresholds,
        f"WITH t AS (SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 5 / 4.0::DOUBLE - 0.1::DOUBLE END AS sensitivity, "
        f"CASE WHEN toxic = 1 THEN 0.8::DOUBLE END AS threshold FROM labels) SELECT doc_id AS request_id, round({_THRESHOLD}, 6)::DOUBLE AS effective FROM t"),
    "pol_is_allowlisted": (
        _allowlisted,
        f"{VERDICTS}, {_LISTS}, allowed AS (SELECT client_id, unnest(categories) AS cat FROM lists) SELECT request_id, client_id, category, "
        "EXISTS (SELECT 1 FROM allowed a WHERE a.client_id = v.client_id AND a.cat IN ('*', coalesce(v.category, 'unknown'))) AS allowlisted FROM verdicts v"),
    "pol_translate_policy": (_translated, _TRANSLATED),
    "pol_validate_check": (_validated, _VALIDATED),
    "pol_validate_sizes": (
        _sizes, "SELECT page_id AS request_id, CASE WHEN octet_length(url::BLOB) > 40 THEN 'payload_too_large' "
        "WHEN octet_length(encode(html)) > 5000 THEN 'response_too_large' END AS error_type FROM pages"),
    "pol_failure_open": (_failures("open"), _failures_sql("open")),
    "pol_failure_closed": (_failures("closed"), _failures_sql("closed")),
    "pol_outcome": (_outcomes, _OUTCOMES.replace("text::BLOB", "encode(text)")),
    "idn_client_by_header": (
        _identity("header", fallback_header="X-Forwarded-For"),
        _identity_sql("coalesce(nullif(h_client, ''), trim(split_part(h_forwarded, ',', 1)))")),
    "idn_client_by_ip": (_identity("ip"), _identity_sql("remote_addr")),
    "idn_client_by_forwarded_ip": (_identity("ip", trust_forwarded=True), _identity_sql("split_part(h_forwarded, ',', 1)")),
    "idn_client_by_token": (
        _identity("token"),
        _identity_sql("CASE WHEN h_auth = '' THEN 'unknown' ELSE left(sha256(regexp_replace(h_auth, '^Bearer ', '')), 32) END")),
    "idn_client_by_certificate": (_identity("mtls"), _identity_sql("'cn-' || conv_id")),
    "idn_route_by_path": (
        _by_path,
        f"WITH {X.CHAT}, {_UPSTREAMS} SELECT request_id, path, u.provider, rtrim(u.url, '/') || substr(path, length(u.provider) + 2) AS upstream_url, "
        "auth_header, timeout::BIGINT AS timeout FROM (SELECT request_id, path, split_part(path, '/', 2) AS first FROM chat) c LEFT JOIN upstreams u ON lower(c.first) = u.provider"),
    "idn_route_by_host": (
        _by_host,
        f"WITH {_HOSTS} SELECT page_id, p.host, coalesce(h.provider, p.host) AS provider, auth_header, coalesce(timeout, 60)::BIGINT AS timeout, "
        f"h.host IS NOT NULL AS host_allowed FROM (SELECT page_id, {_HOST} AS host FROM pages) p LEFT JOIN hosts h ON p.host = h.host"),
    "idn_off_list_hosts": (
        _off_list, f"WITH {_HOSTS} SELECT page_id, {_HOST} AS host FROM pages WHERE {_HOST} NOT IN (SELECT host FROM hosts)"),
    "src_requests": (_requests, _REQUESTS),
    "src_normalize_headers": (
        _header_keys, f"WITH {X.CHAT} SELECT request_id, 'authorization,x-client-id,x-forwarded-for' AS keys FROM chat"),
}
