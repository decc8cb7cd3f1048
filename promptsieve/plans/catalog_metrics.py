"""Registered queries: counters, histograms, percentiles, evaluation, limits, metric text."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.operators import evaluation as V
from promptsieve.operators import limits as L
from promptsieve.operators import metrics as M
from promptsieve.operators import routing as G
from promptsieve.plans import traffic as X
from promptsieve.plans.catalog_cost import _requests, _route_ctes
from promptsieve.plans.catalog_detection import VERDICTS, verdicts
from promptsieve.plans.catalog_policy import RESOLVED, _resolved
from promptsieve.sources.delivery import DeliveryLedger
from promptsieve.sources.sinks import to_prometheus, write_events
from promptsieve.session import local_table, shared_folder

_LOG = (
    "event_type as upstream", "case when user_id % 2 = 0 then 'POST' else 'GET' end as method",
    "case event_type when 'error' then 500 when 'view' then 404 else 200 end as status",
    "value / 50 as seconds", "event_id", "ts", "user_id", "value",
)


def _log(spark, sf):
    return X.table(spark, sf, "events").selectExpr(*_LOG)


LOG = "log AS (SELECT " + ", ".join(_LOG) + " FROM events)"


def _request_counts(spark, sf):
    return M.request_counts(_log(spark, sf)).withColumn("status", F.col("status").cast("bigint"))


def _scan_counts(spark, sf):
    scans = verdicts(spark, sf).select(F.lit("check").alias("scanner"), F.col("action").alias("result"))
    return M.scan_counts(scans)


def _detections(spark, sf):
    return _resolved(spark, sf).where("final_action <> 'allow'").select("category", F.col("final_action").alias("action"))


def _routing_counts(spark, sf):
    routed = G.plan_routes(_requests(spark, sf), X.dimension(spark, "tasks"), X.dimension(spark, "downgrades"))
    return M.routing_counts(routed)


def _histogram(spark, sf):
    h = M.duration_histogram(_log(spark, sf), "seconds", ("upstream",))
    return h.withColumn("sum", F.round("sum", 4))


def _histogram_sql() -> str:
    parts = [f"SELECT upstream, '{b:g}' AS le, count(*) FILTER (seconds <= {b}) AS bucket_count, count(*) AS count, round(sum(seconds), 4) AS sum FROM log GROUP BY upstream"
             for b in K.REQUEST_BUCKETS]
    parts.append("SELECT upstream, '+Inf', count(*), count(*), round(sum(seconds), 4) FROM log GROUP BY upstream")
    return f"WITH {LOG} " + " UNION ALL ".join(parts)


def _scan_histogram(spark, sf):
    h = M.duration_histogram(_log(spark, sf).withColumn("s", F.col("value") / 5000), "s", (), K.SCAN_BUCKETS)
    return h.select("le", "bucket_count", "count")


def _scan_histogram_sql() -> str:
    parts = [f"SELECT '{b:g}' AS le, count(*) FILTER (value / 5000 <= {b}) AS bucket_count, count(*) AS count FROM events" for b in K.SCAN_BUCKETS]
    return " UNION ALL ".join([*parts, "SELECT '+Inf', count(*), count(*) FROM events"])


def _percentiles(by: tuple[str, ...] = (), last_n: int = 1000):
    def build(spark, sf):
        p = M.latency_percentiles(_log(spark, sf), "value", ("ts", "event_id"), last_n, by)
        return p.withColumn("n", F.col("n").cast("bigint"))

    return build


def _percentiles_sql(by: str = "", last_n: int = 1000) -> str:
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    at = lambda q, least: f"v[CASE WHEN n >= {least} THEN floor((n - 1) * {q}::DOUBLE)::BIGINT + 1 ELSE n END]"
    return (f"WITH {LOG}, recent AS (SELECT *, row_number() OVER ({part}ORDER BY ts DESC, event_id DESC) AS rn FROM log), "
            f"g AS (SELECT {key}count(*) AS n, list(value ORDER BY value) AS v FROM recent WHERE rn <= {last_n} {group}) "
            f"SELECT {key}n, {at('0.5', 0)} AS p50, {at('0.9', 10)} AS p90, {at('0.99', 100)} AS p99 FROM g")


_KINDS = (
    "case event_type when 'error' then 'error' when 'view' then 'model_load' when 'login' then 'license_refresh' else 'prediction' end as kind",
    "case when user_id % 3 = 0 then 'block' else 'warn' end as action", "user_id % 5 <> 0 as success", "event_type as category", "ts",
)


def _predictions(spark, sf):
    return X.table(spark, sf, "events").selectExpr(*_KINDS)


KINDS = "kinds_log AS (SELECT " + ", ".join(_KINDS) + " FROM events)"


def _last_sync(spark, sf):
    synced = M.last_sync(_predictions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return synced.select(F.unix_micros("last_sync").alias("last_sync_us"))


def _judged(spark, sf):
    return verdicts(spark, sf).select(
        "request_id", "label", (F.col("label") != "benign").alias("attack"),
        F.col("action").isin("block", "warn").alias("predicted"), "action", "confidence")


_JUDGED = f"{VERDICTS}, judged AS (SELECT *, label <> 'benign' AS attack, action IN ('block', 'warn') AS predicted FROM verdicts)"
RATES = (
    "tp, fp, tn, fn, tp / nullif(tp + fn, 0) AS tpr, tn / nullif(tn + fp, 0) AS tnr, tp / nullif(tp + fp, 0) AS precision, "
    "2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_score"
)


def _counts(y: str, p: str) -> str:
    return (f"count(*) FILTER ({y} AND {p}) AS tp, count(*) FILTER (NOT {y} AND {p}) AS fp, "
            f"count(*) FILTER (NOT {y} AND NOT {p}) AS tn, count(*) FILTER ({y} AND NOT {p}) AS fn")


def _rounded(df):
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, 9) for c in doubles})


def _evaluate(spark, sf):
    return V.evaluate(_judged(spark, sf), "attack", "predicted")


def _evaluate_toxic(spark, sf):
    """The quality flag as a predictor of toxicity, with the text length as the latency."""
    base = X.table(spark, sf, "labels").join(X.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = base.select((F.col("toxic") == 1).alias("label"), (F.col("quality") == 0).alias("predicted"), "n_chars")
    return V.evaluate(rows, latency="n_chars").withColumn("mean_latency", F.round("mean_latency", 6))


_THRESHOLDS = [0.0, 0.65, 0.8, 0.87, 0.95]


def _sweep(spark, sf):
    return V.threshold_sweep(_judged(spark, sf), _THRESHOLDS, "attack")


def _sweep_sql() -> str:
    found = "(action <> 'allow' AND confidence >= {})"
    rows = [f"SELECT {t}::DOUBLE AS threshold, {_counts('attack', found.format(t))} FROM judged" for t in _THRESHOLDS]
    return f"{_JUDGED}, sweep AS (" + " UNION ALL ".join(rows) + f") SELECT threshold, {RATES} FROM sweep"


def _compare(spark, sf):
    results = V.threshold_sweep(_judged(spark, sf), _THRESHOLDS, "attack").withColumn("version_order", F.col("threshold"))
    compared = V.compare_versions(results.withColumn("version", F.format_string("t%.2f", "threshold")))
    return _rounded(compared.select("version", "tpr_change", "tnr_change", "balanced_score_change", "comparable"))


def _compare_mix(spark, sf):
    """Versions with different class mixes: the labels of each residue class of ids."""
    rows = X.table(spark, sf, "labels").select(
        (F.col("doc_id") % 4).alias("version_order"), (F.col("toxic") == 1).alias("label"), (F.col("quality") == 0).alias("predicted"))
    results = V.evaluate(rows, by=("version_order",)).withColumn("version", F.col("version_order").cast("string"))
    return _rounded(V.compare_versions(results).select("version", "tpr_change", "comparable"))


def _dominant(spark, sf):
    return M.dominant_action(_resolved(spark, sf).select("client_id", F.col("final_action").alias("action")), ("client_id",))


def _intervals(spark, sf):
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 30000000).cast("bigint"))
    return X.table(spark, sf, "events").select(
        F.col("event_type").alias("client"), F.col("ts").alias("started_at"), end.alias("ended_at"))


def _concurrency(spark, sf):
    return L.concurrency(_intervals(spark, sf), limit=3).withColumn("max_open", F.col("max_open").cast("bigint"))


_CONCURRENCY = """WITH iv AS (SELECT event_type AS client, epoch_us(ts) AS s, epoch_us(ts) + round(value * 30000000)::BIGINT AS e FROM events),
d AS (SELECT client, t, sum(d) AS d FROM (SELECT client, s AS t, 1 AS d FROM iv UNION ALL SELECT client, e, -1 FROM iv) GROUP BY ALL),
r AS (SELECT client, sum(d) OVER (PARTITION BY client ORDER BY t) AS open FROM d)
SELECT client, max(open)::BIGINT AS max_open, max(open) > 3 AS over_limit FROM r GROUP BY client"""

RATE, BURST = 0.0005, 2


def limited_events(spark, sf):
    return X.table(spark, sf, "events").selectExpr("event_id", "ts", "event_type as client")


def _rate_limit(spark, sf):
    return L.rate_limit(limited_events(spark, sf), rate=RATE, burst=BURST).select("event_id", "client", "decision")


RATE_LIMITED = f"""WITH RECURSIVE ev AS (SELECT event_id, event_type AS client, epoch_ms(ts) AS t FROM events),
tick AS (SELECT client, t, count(*) AS n, row_number() OVER (PARTITION BY client ORDER BY t) AS rn FROM ev GROUP BY client, t),
walk AS (SELECT client, 0::BIGINT AS rn, NULL::BIGINT AS t, {BURST}.0::DOUBLE AS tokens, 0::BIGINT AS taken FROM tick WHERE rn = 1
  UNION ALL SELECT client, rn, t, filled - taken, taken FROM (
    SELECT client, rn, t, filled, least(n, floor(filled + 1e-9::DOUBLE)::BIGINT) AS taken FROM (
      SELECT w.client, k.rn, k.t, k.n, least({BURST}.0::DOUBLE, w.tokens + coalesce(k.t - w.t, 0) * {RATE}::DOUBLE / 1000.0::DOUBLE) AS filled
      FROM walk w JOIN tick k ON k.client = w.client AND k.rn = w.rn + 1))),
nth AS (SELECT *, row_number() OVER (PARTITION BY client, t ORDER BY event_id) AS i FROM ev)
SELECT event_id, client, CASE WHEN i <= taken THEN 'allowed' ELSE 'limited' END AS decision FROM nth JOIN walk USING (client, t)"""


def _lists(spark):
    return local_table(
        spark, [("block", "10.0.1.0/24"), ("allow", "10.0.2.3"), ("allow", "10.0.0.0/30"), ("block", "10.0.3.4/31")],
        "list string, cidr string")


def _rate_limit_lists(spark, sf):
    calls = X.chat(spark, sf).selectExpr(
        "request_id as event_id", "timestamp_seconds(1704067200 + request_id) as ts", "remote_addr as client")
    return L.rate_limit(calls, rate=100, burst=200, lists=_lists(spark)).select("event_id", "client", "decision")


_LISTED = f"""WITH {X.CHAT} SELECT request_id AS event_id, remote_addr AS client, CASE
WHEN remote_addr LIKE '10.0.1.%' OR remote_addr IN ('10.0.3.4', '10.0.3.5') THEN 'blocked'
WHEN remote_addr IN ('10.0.2.3', '10.0.0.0', '10.0.0.1', '10.0.0.2', '10.0.0.3') THEN 'listed' ELSE 'allowed' END AS decision FROM chat"""


def _prometheus(spark, sf):
    counts = M.request_counts(_log(spark, sf))
    metrics = counts.select(
        F.lit("requests_total").alias("name"), F.lit("Requests processed").alias("help"), F.lit("counter").alias("type"),
        F.create_map(F.lit("upstream"), F.concat("upstream", F.lit('"x\\')), F.lit("method"), "method",
                     F.lit("status"), F.col("status").cast("string")).alias("labels"), F.col("n").cast("double").alias("value"))
    return to_prometheus(metrics)


_PROMETHEUS = rf"""WITH {LOG}, c AS (SELECT upstream, method, status, count(*) AS n FROM log GROUP BY ALL)
SELECT '# HELP requests_total Requests processed' AS value UNION ALL SELECT '# TYPE requests_total counter'
UNION ALL SELECT 'requests_total{{method="' || method || '",status="' || status || '",upstream="' || upstream || '\"x\\"}} ' || n FROM c"""

def _event_sink(spark, sf):
    """Events written by kind and day, read back and counted."""
    events = X.table(spark, sf, "events").selectExpr(
        "event_id", "cast(ts as timestamp) as ts", "case event_type when 'click' then 'usage' else event_type end as event_type")
    folder = shared_folder(spark, "events")
    write_events(events, folder)
    return spark.read.parquet(folder).groupBy("kind", F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_EVENT_SINK = """SELECT CASE event_type WHEN 'click' THEN 'usage' ELSE 'detection' END AS kind, strftime(ts, '%Y-%m-%d') AS date,
count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL"""


def _deliveries(spark, sf):
    """Events sent in two attempts to a receiver that is down for detections at first, and refuses the
    detections that it gets with the second; joined with the dead letters that are left of them."""
    events = X.table(spark, sf, "events").selectExpr(
        "event_id", "cast(ts as timestamp) as ts", "case event_type when 'click' then 'usage' else event_type end as event_type", "props")
    ledger = DeliveryLedger(spark)
    ledger.deliver(events, lambda batch: 200 if batch[0]["event_type"] == "usage" else 503)
    ledger.deliver(events, lambda batch: 500 if batch[0]["event_type"] == "usage" else 422)
    letters = ledger.dead_letters(events).select(F.col("event_id").cast("string").alias("event_id"), F.octet_length("props").alias("letter_bytes"))
    return ledger.settled().join(letters, "event_id", "left").select(
        F.col("event_id").cast("bigint").alias("event_id"), "outcome", "attempt", "status", F.col("letter_bytes").cast("bigint").alias("letter_bytes"))


_DELIVERIES = """SELECT event_id, CASE event_type WHEN 'click' THEN 'sent' ELSE 'dead' END AS outcome, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS attempt,
CASE event_type WHEN 'click' THEN 200 ELSE 422 END AS status, CASE event_type WHEN 'click' THEN NULL ELSE strlen(props) END AS letter_bytes FROM events"""


ENTRIES = {
    "snk_events": (_event_sink, _EVENT_SINK),
    "snk_deliveries": (_deliveries, _DELIVERIES),
    "agg_request_counts": (
        _request_counts, f"WITH {LOG} SELECT upstream, method, status::BIGINT AS status, count(*) AS n FROM log GROUP BY ALL"),
    "agg_scan_counts": (
        _scan_counts, f"{VERDICTS} SELECT 'check' AS scanner, action AS result, count(*) AS n FROM verdicts GROUP BY ALL"),
    "agg_detection_counts": (
        lambda spark, sf: M.detection_counts(_detections(spark, sf)),
        f"{RESOLVED} SELECT category, final_action AS action, count(*) AS n FROM resolved WHERE final_action <> 'allow' GROUP BY ALL"),
    "agg_detection_cube": (
        lambda spark, sf: M.detection_counts(_detections(spark, sf), subtotals=True),
        f"{RESOLVED} SELECT category, final_action AS action, count(*) AS n FROM resolved WHERE final_action <> 'allow' GROUP BY CUBE (category, final_action)"),
    "agg_routing_counts": (
        _routing_counts,
        f"WITH {_route_ctes(True)} SELECT metric_mode AS mode, metric_result AS result, count(*) AS n FROM routed WHERE metric_result IS NOT NULL GROUP BY ALL"),
    "agg_duration_histogram": (_histogram, _histogram_sql()),
    "agg_scan_duration_histogram": (_scan_histogram, _scan_histogram_sql()),
    "agg_latency_percentiles": (_percentiles(), _percentiles_sql()),
    "agg_latency_percentiles_by": (_percentiles(("upstream",), 95), _percentiles_sql("upstream", 95)),
    "agg_prediction_counts": (
        lambda spark, sf: M.prediction_counts(_predictions(spark, sf)),
        f"WITH {KINDS} SELECT count(*) FILTER (kind = 'prediction') AS predictions_total, count(*) FILTER (kind = 'prediction' AND action = 'block') AS predictions_blocked, "
        "count(*) FILTER (kind = 'prediction' AND action <> 'block') AS predictions_allowed, count(*) FILTER (kind = 'error') AS errors_total, "
        "count(*) FILTER (kind = 'model_load') AS model_loads_total, count(*) FILTER (kind = 'model_load' AND NOT success) AS model_load_failures, "
        "count(*) FILTER (kind = 'license_refresh') AS license_refreshes, count(*) FILTER (kind = 'license_refresh' AND NOT success) AS license_failures FROM kinds_log"),
    "agg_predictions_by_category": (
        lambda spark, sf: M.predictions_by_category(_predictions(spark, sf)),
        f"WITH {KINDS} SELECT category, count(*) AS n FROM kinds_log WHERE kind = 'prediction' GROUP BY category"),
    "agg_last_sync": (_last_sync, f"WITH {KINDS} SELECT epoch_us(max(ts)) AS last_sync_us FROM kinds_log WHERE success"),
    "agg_evaluate": (_evaluate, f"{_JUDGED}, c AS (SELECT {_counts('attack', 'predicted')} FROM judged) SELECT {RATES} FROM c"),
    "agg_evaluate_labels": (
        _evaluate_toxic,
        f"WITH c AS (SELECT {_counts('(toxic = 1)', '(quality = 0)')}, round(avg(n_chars), 6) AS mean_latency FROM labels JOIN documents USING (doc_id)) SELECT {RATES}, mean_latency FROM c"),
    "agg_detection_rate_by": (
        lambda spark, sf: V.detection_rate_by(_judged(spark, sf)),
        f"{_JUDGED} SELECT label, count(*) AS n, count(*) FILTER (predicted) AS detected, avg(predicted::INT)::DOUBLE AS rate FROM judged GROUP BY label"),
    "agg_threshold_sweep": (_sweep, _sweep_sql()),
    "agg_compare_versions": (
        _compare,
        _sweep_sql().rsplit(" SELECT ", 1)[0] + f", r AS (SELECT threshold, {RATES} FROM sweep) SELECT printf('t%.2f', threshold) AS version, "
        "round(tpr - lag(tpr) OVER w, 9) AS tpr_change, round(tnr - lag(tnr) OVER w, 9) AS tnr_change, "
        "round(balanced_score - lag(balanced_score) OVER w, 9) AS balanced_score_change, threshold > 0 AS comparable FROM r WINDOW w AS (ORDER BY threshold)"),
    "agg_compare_versions_mix": (
        _compare_mix,
        f"WITH c AS (SELECT doc_id % 4 AS version_order, {_counts('(toxic = 1)', '(quality = 0)')} FROM labels GROUP BY ALL), r AS (SELECT version_order, {RATES} FROM c), "
        "s AS (SELECT *, coalesce(tp + fn = lag(tp + fn) OVER w AND tn + fp = lag(tn + fp) OVER w, false) AS comparable, tpr - lag(tpr) OVER w AS d FROM r WINDOW w AS (ORDER BY version_order)) "
        "SELECT version_order::VARCHAR AS version, CASE WHEN comparable THEN round(d, 9) END AS tpr_change, comparable FROM s"),
    "agg_dominant_action": (
        _dominant,
        f"{RESOLVED}, c AS (SELECT client_id, final_action, count(*) AS k FROM resolved GROUP BY ALL) SELECT client_id, final_action AS dominant_action FROM "
        "(SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY k DESC, final_action) AS rn FROM c) WHERE rn = 1"),
    "str_concurrency": (_concurrency, _CONCURRENCY),
    "str_rate_limit": (_rate_limit, RATE_LIMITED),
    "str_rate_limit_lists": (_rate_limit_lists, _LISTED),
    "snk_prometheus": (_prometheus, _PROMETHEUS),
}
