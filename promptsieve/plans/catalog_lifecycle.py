"""Registered queries: bundles, manifests, licences, stored bundle files.

Bundles are derived from the events: one per user, with a signature per event type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptsieve.operators import lifecycle as L
from promptsieve.operators import metrics as M
from promptsieve.plans.traffic import table
from promptsieve.sources.signatures import read_bundles

NOW = "2024-01-30 06:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def signatures(spark, sf):
    """user_id, ordinal and a signature per (user, event type)."""
    grouped = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(
        "user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return grouped.selectExpr(
        "user_id", "user_id * 10 + length(event_type) as ordinal", "event_type || '-' || (user_id % 7) as id",
        "event_type as category", "case when n % 2 = 0 then 'block' else 'warn' end as action", "last")


_SIGS = """sigs AS (SELECT user_id, user_id * 10 + length(event_type) AS ordinal, event_type || '-' || (user_id % 7) AS id,
  event_type AS category, CASE WHEN n % 2 = 0 THEN 'block' ELSE 'warn' END AS action, last
  FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL))"""


def bundles(spark, sf):
    """One bundle per user: free ones never expire, the others six hours after the user's last
    event. A user has five event types at most, so a bundle is small."""
    item = F.struct("category", "id", "action", "ordinal")
    return signatures(spark, sf).groupBy("user_id").agg(
        F.array_sort(F.collect_list(item)).alias("signatures"), F.max("last").alias("last")
    ).selectExpr(
        "user_id as bundle_id", "'v' || (user_id % 11) as version",
        "case user_id % 3 when 0 then 'free' when 1 then 'pro' else 'enterprise' end as tier",
        "case when user_id % 3 > 0 then last + interval 6 hours end as expires_at", "signatures")


_BUNDLES = _SIGS + f""", bundles AS (SELECT user_id AS bundle_id, 'v' || (user_id % 11) AS version,
  CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS tier,
  CASE WHEN user_id % 3 > 0 THEN max(last) + INTERVAL 6 HOUR END AS expires_at, count(*) AS size FROM sigs GROUP BY user_id),
live AS (SELECT *, expires_at IS NULL OR TIMESTAMP '{NOW}' <= expires_at AS active FROM bundles)"""


def _active(spark, sf):
    return L.active_signatures(bundles(spark, sf), _now()).select(
        "bundle_order", F.col("pos").cast("bigint").alias("pos"), "id", "category")


def _earliest(spark, sf):
    return L.earliest_expiration(bundles(spark, sf), _now()).select(
        F.unix_micros("earliest_expiration").alias("earliest_us"))


def _soon(past: bool):
    def build(spark, sf):
        return L.expiring_soon(bundles(spark, sf), _now(), 6, past).select("bundle_id", F.unix_micros("expires_at").alias("expires_us"))

    return build


def _by_category(spark, sf):
    return L.by_category(signatures(spark, sf), "click").select("user_id", "id", "action")


def _by_id(spark, sf):
    return L.by_id(signatures(spark, sf)).select("id", "user_id", "action", "ordinal")


def manifests(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_type as channel", "event_id as arrival",
        "case when event_id % 11 = 3 then event_id - 40 else event_id end as sequence",
        "case when event_id % 7 = 0 then 'wrong' else '' end as previous_hash",
        "md5(cast(cast(event_id as string) as binary)) as manifest_hash",
        "case when event_id % 13 = 0 then '' else 'signed' end as signature")


_AUDIT = """WITH RECURSIVE m AS (SELECT event_type AS channel, event_id AS arrival, CASE WHEN event_id % 11 = 3 THEN event_id - 40 ELSE event_id END AS seq,
  CASE WHEN event_id % 7 = 0 THEN 'wrong' ELSE '' END AS prev, md5(event_id::VARCHAR) AS hash, event_id % 13 <> 0 AS signed,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
walk AS (SELECT channel, 0::BIGINT AS rn, 0::BIGINT AS seq, '' AS hash, NULL::BIGINT AS arrival, NULL::VARCHAR AS error FROM m WHERE rn = 1
  UNION ALL SELECT channel, rn, CASE WHEN error IS NULL THEN mseq ELSE seq END, CASE WHEN error IS NULL THEN mhash ELSE hash END, arrival, error FROM (
    SELECT w.channel, m.rn, w.seq, w.hash, m.seq AS mseq, m.hash AS mhash, m.arrival,
      CASE WHEN NOT m.signed THEN 'missing signature' WHEN m.seq < w.seq THEN 'sequence rollback'
      WHEN w.hash <> '' AND m.prev <> '' AND m.prev <> w.hash THEN 'previous_hash mismatch' END AS error
    FROM walk w JOIN m ON m.channel = w.channel AND m.rn = w.rn + 1))
SELECT channel, arrival, error IS NULL AS valid, error FROM walk WHERE rn > 0"""


def _hashes(spark, sf):
    m = manifests(spark, sf)
    digest = L.manifest_hash(
        F.array(F.struct(F.col("channel").alias("id"))), F.col("previous_hash"), F.col("sequence"), F.lit("v1"))
    return m.select("arrival", digest.alias("digest"))


def _licenses(spark, sf):
    return bundles(spark, sf).where("expires_at is not null").selectExpr(
        "bundle_id", "expires_at", "case when bundle_id % 4 = 0 then 'here' when bundle_id % 4 = 1 then 'there' else '' end as bound_instance_id")


def _license_status(instance_id):
    def build(spark, sf):
        return L.license_status(_licenses(spark, sf), _now(), instance_id).select("bundle_id", "valid", "reason")

    return build


def _license_sql(instance: str | None) -> str:
    bound = "CASE bundle_id % 4 WHEN 0 THEN 'here' WHEN 1 THEN 'there' ELSE '' END"
    check = (f"WHEN {bound} <> '' THEN 'no instance id'" if instance is None
             else f"WHEN {bound} NOT IN ('', '{instance}') THEN 'bound to other instance'")
    return (f"WITH {_BUNDLES}, l AS (SELECT bundle_id, CASE WHEN NOT active THEN 'expired' {check} ELSE 'valid' END AS reason "
            "FROM live WHERE expires_at IS NOT NULL) SELECT bundle_id, reason = 'valid' AS valid, reason FROM l")


def _files(spark, sf):
    return table(spark, sf, "pages").selectExpr(
        "'/store/' || (page_id % 40) || '/' || page_id || '.yaml' as path", "length(html) as length")


_FILES = f"""{_BUNDLES}, stored AS (SELECT page_id % 40 AS bundle_id, sum(length(html)) AS bytes FROM pages GROUP BY ALL),
joined AS (SELECT s.*, coalesce(NOT active, false) AS gone FROM stored s LEFT JOIN live l USING (bundle_id))"""


def _inventory(spark, sf):
    licenses = _licenses(spark, sf).withColumn("bundle_id", F.col("bundle_id").cast("string"))
    return L.bundle_inventory(_files(spark, sf), licenses, _now())


def _expired(spark, sf):
    licenses = _licenses(spark, sf).withColumn("bundle_id", F.col("bundle_id").cast("string"))
    return L.expired_bundles(_files(spark, sf), licenses, _now())


def _contents(spark, sf):
    """A bundle file per document: two rules and, in some, a section that is no YAML. Names are
    digests of the whole texts; every tenth bundle has no id."""
    rule = lambda n, action: (
        f"'# === {n}.yaml ===\\nsignatures:\\n- id: {n}-' || doc_id || '\\n  name: ' || chr(34) || md5(cast(text as binary)) || chr(34) || "
        f"'\\n  category: ' || lang || '\\n  severity: high\\n  action: {action}\\n  pattern: x\\n'")
    return table(spark, sf, "documents").selectExpr(
        "case when doc_id % 10 = 9 then '' else 'b' || doc_id end as bundle_id", "'v' || (doc_id % 4) as version",
        "case when doc_id % 3 > 0 then 'pro' end as tier",
        f"{rule('A', 'block')} || case when doc_id % 5 = 0 then '# === bad.yaml ===\\nsignatures: [\\n' else '' end || {rule('B', 'warn')} as content",
        "case when doc_id % 2 = 0 then true end as is_encrypted",
        "timestamp_seconds(1704067200 + doc_id) as expires_at", "doc_id % 4 = 0 as licensed")


def _read_bundles(spark, sf):
    contents = _contents(spark, sf)
    licensed = contents.where("licensed and bundle_id <> ''").select("bundle_id", "expires_at")
    read = read_bundles(contents.drop("expires_at", "licensed"), licensed)
    return read.select(
        "bundle_id", "version", "tier", F.unix_seconds("expires_at").alias("expires"), "is_encrypted",
        F.array_join(F.transform("signatures", lambda s: F.concat_ws(":", s["id"], s["name"], s["category"], s["action"])), ",").alias("signatures"))


_READ_BUNDLES = """SELECT 'b' || doc_id AS bundle_id, 'v' || (doc_id % 4) AS version, CASE WHEN doc_id % 3 > 0 THEN 'pro' ELSE 'free' END AS tier,
  CASE WHEN doc_id % 4 = 0 THEN 1704067200 + doc_id END AS expires, doc_id % 2 = 0 AS is_encrypted,
  'A-' || doc_id || ':' || md5(text) || ':' || lang || ':block,B-' || doc_id || ':' || md5(text) || ':' || lang || ':warn' AS signatures
FROM documents WHERE doc_id % 10 <> 9"""


ENTRIES = {
    "src_bundles": (_read_bundles, _READ_BUNDLES),
    "sig_active_signatures": (
        _active,
        f"WITH {_BUNDLES} SELECT user_id AS bundle_order, row_number() OVER (PARTITION BY user_id ORDER BY category) - 1 AS pos, id, category "
        "FROM sigs JOIN live ON bundle_id = user_id WHERE active"),
    "sig_earliest_expiration": (
        _earliest, f"WITH {_BUNDLES} SELECT epoch_us(min(expires_at)) AS earliest_us FROM live WHERE active"),
    "sig_expiring_soon": (
        _soon(False),
        f"WITH {_BUNDLES} SELECT bundle_id, epoch_us(expires_at) AS expires_us FROM live WHERE expires_at > TIMESTAMP '{NOW}' AND expires_at < TIMESTAMP '{NOW}' + INTERVAL 6 HOUR"),
    "sig_licenses_to_renew": (
        _soon(True),
        f"WITH {_BUNDLES} SELECT bundle_id, epoch_us(expires_at) AS expires_us FROM live WHERE expires_at < TIMESTAMP '{NOW}' + INTERVAL 6 HOUR"),
    "sig_bundle_counts": (
        lambda spark, sf: L.bundle_counts(bundles(spark, sf), _now()),
        f"WITH {_BUNDLES} SELECT sum(size)::BIGINT AS total_signatures, (sum(size) FILTER (active))::BIGINT AS active_signatures, max(version) AS version FROM live"),
    "sig_by_category": (_by_category, f"WITH {_SIGS} SELECT user_id, id, action FROM sigs WHERE category = 'click'"),
    "sig_by_id": (
        _by_id, f"WITH {_SIGS} SELECT id, user_id, action, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal DESC) AS rn FROM sigs) WHERE rn = 1"),
    "sig_audit_manifests": (lambda spark, sf: L.audit_manifests(manifests(spark, sf)), _AUDIT),
    "sig_manifest_hash": (
        _hashes,
        "SELECT event_id AS arrival, sha256('{\"bundles\":[{\"id\":\"' || event_type || '\"}],\"previous_hash\":\"' || CASE WHEN event_id % 7 = 0 THEN 'wrong' ELSE '' END "
        "|| '\",\"sequence\":' || CASE WHEN event_id % 11 = 3 THEN event_id - 40 ELSE event_id END || ',\"version\":\"v1\"}') AS digest FROM events"),
    "sig_license_status": (_license_status("here"), _license_sql("here")),
    "sig_license_status_no_instance": (_license_status(None), _license_sql(None)),
    "sig_bundle_inventory": (
        _inventory,
        f"WITH {_FILES} SELECT count(*) AS total_bundles, sum(bytes)::BIGINT AS total_bytes, count(*) FILTER (gone) AS expired_bundles FROM joined"),
    "sig_expired_bundles": (_expired, f"WITH {_FILES} SELECT bundle_id::VARCHAR AS bundle_id FROM joined WHERE gone"),
    "agg_signatures_loaded": (
        lambda spark, sf: M.signatures_loaded(bundles(spark, sf)),
        f"WITH {_BUNDLES} SELECT tier, sum(size)::BIGINT AS signatures FROM bundles GROUP BY tier"),
}
