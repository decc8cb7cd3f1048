"""Registered queries: detectors, verdicts, response scans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.operators import responses as R
from promptsieve.operators.classifier import (
    active_model, classify, classify_batch, naive_bayes_classify, naive_bayes_fit, train_classifier,
)
from promptsieve.operators.evasion import evasion_signals, explode_signals
from promptsieve.operators.fusion import ScanConfig, fuse
from promptsieve.operators.signatures import Rule, RuleSet, best_signature, signature_hits
from promptsieve.plans.catalog_text import B64_COUNT, LETTERS, ROT13, UNHEX, ZW, _count, phrase_sql
from promptsieve.plans.detection import MutatorRegistry, check
from promptsieve.plans.traffic import PROMPTS, prompts, quoted, table, values
from promptsieve.sources.signatures import default_rules
from promptsieve.sources.sinks import public_verdicts, to_json_log

# Leaks that the given documents hold.
LEAK_RULES = RuleSet((
    Rule("LK-001", "Card number", "pii", "high", "block", (r"\b\d{16}\b",), "response"),
    Rule("LK-002", "IPv4 address", "network_data", "low", "log", (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",), "both"),
    Rule("LK-003", "E-mail address", "pii", "medium", "warn", (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",), "response"),
    Rule("LK-004", "Token", "secret", "high", "block", (r'token\s*=\s*"[0-9a-f]{16,}"',), "both"),
    Rule("RQ-001", "Requests only", "pii", "high", "block", (r"the",), "request"),
))

RANK = "CASE {} WHEN 'block' THEN 3 WHEN 'warn' THEN 2 WHEN 'log' THEN 1 ELSE 0 END"


def rules_cte(rules: RuleSet) -> str:
    rows = [
        (i, r.id, r.name, r.category, r.action, p, r.scan_target)
        for i, (p, r) in enumerate(rules.patterns)
    ]
    return values("rules", "ord, id, name, category, action, pattern, target", rows)


def matches_cte(rules: RuleSet, source: str, text: str = "text") -> str:
    """(request_id, ord, found): the matches of each pattern, patterns as constants."""
    parts = [
        f"SELECT request_id, {i} AS ord, regexp_extract_all({text}, {quoted(p)}, 0, 'i') AS found FROM {source}"
        for i, (p, _) in enumerate(rules.patterns)
    ]
    return "matches AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE len(found) > 0)"


_SIGNAL_CTES = f"""
parts AS (SELECT *, {LETTERS} AS letters, {B64_COUNT} AS b64, {_count(K.ZERO_WIDTH)} AS zw,
  {_count(K.CONFUSABLES)} AS conf, regexp_matches(text, '{K.HEX_ESCAPE}') AS hex FROM prompts),
marks AS (SELECT *, length(letters) < length(text) * {K.NOISE_RATIO} AS noisy,
  CASE WHEN zw > 0 THEN {phrase_sql(f"translate(text, {ZW}, '')")} END AS p_zw,
  CASE WHEN hex THEN {phrase_sql(UNHEX)} END AS p_hex,
  CASE WHEN length(text) >= 10 THEN {phrase_sql(ROT13.format('text'))} END AS p_rot1,
  CASE WHEN length(letters) >= 10 THEN {phrase_sql(ROT13.format('letters'))} END AS p_rot2,
  {phrase_sql('letters')} AS p_letters, {phrase_sql('text')} AS p_text FROM parts),
signals AS (
  SELECT request_id, 0 AS i, 'excessive_length' AS heuristic, 'Length ' || length(text) || ' > 50000' AS details FROM marks WHERE length(text) > 50000
  UNION ALL SELECT request_id, 1, 'base64_encoding', 'Found ' || b64 || ' encoded segments' FROM marks WHERE b64 > 0
  UNION ALL SELECT request_id, 2, 'url_encoding', 'Content appears URL encoded' FROM marks WHERE regexp_matches(text, '{K.URL_ESCAPE}')
  UNION ALL SELECT request_id, 3, 'unicode_obfuscation', 'Found ' || conf || ' confusable characters' FROM marks WHERE conf > 0
  UNION ALL SELECT request_id, 4, 'zero_width_chars', 'Found ' || zw || ' zero-width characters' FROM marks WHERE zw > 0
  UNION ALL SELECT request_id, 5, 'zero_width_evasion', 'Hidden: ' || p_zw FROM marks WHERE p_zw IS NOT NULL
  UNION ALL SELECT request_id, 6, 'hex_escapes', 'Text contains \\xNN sequences' FROM marks WHERE hex
  UNION ALL SELECT request_id, 7, 'hex_escape_evasion', 'Hidden: ' || p_hex FROM marks WHERE p_hex IS NOT NULL
  UNION ALL SELECT request_id, 8, 'rot13_evasion', 'Hidden: ' || coalesce(p_rot1, p_rot2) FROM marks WHERE p_rot1 IS NOT NULL OR (noisy AND p_rot2 IS NOT NULL)
  UNION ALL SELECT request_id, 9, 'char_insertion_evasion', 'Hidden: ' || p_letters FROM marks WHERE noisy AND p_letters IS NOT NULL AND p_text IS NULL),
""" + values("kinds", "heuristic, description, confidence", [(n, d, c) for n, (d, c) in K.EVASION_SIGNALS.items()])


def _votes(rules: RuleSet, regex: bool = True, heuristics: bool = True, extra: str = "") -> str:
    parts = []
    if regex:
        parts.append(
            "SELECT request_id, ord AS pos, action, replace(category, '_', '-') AS category, id AS signature_id, "
            "'pattern:' || pattern AS detail, 0.9 AS confidence, len(found) AS times FROM matches JOIN rules USING (ord)")
    if heuristics:
        parts.append(
            "SELECT request_id, 1000 + i AS pos, 'warn' AS action, 'encoding-bypass' AS category, NULL::VARCHAR AS signature_id, "
            "description AS detail, confidence, 1 AS times "
            "FROM signals JOIN kinds USING (heuristic)")
    if extra:
        parts.append(extra)
    ctes = [PROMPTS, rules_cte(rules), matches_cte(rules, "prompts"), _SIGNAL_CTES]
    return ", ".join(ctes) + ", votes AS (" + " UNION ALL ".join(parts) + f"""),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id
  ORDER BY {RANK.format('action')} DESC, confidence DESC, pos) AS rn FROM votes) WHERE rn = 1),
details AS (SELECT request_id, sum(times) AS n_matches, string_agg(repeat(detail || chr(10), times::BIGINT), '' ORDER BY pos) AS matches
  FROM votes GROUP BY request_id),
verdicts AS (SELECT p.request_id, p.client_id, p.label, p.text, coalesce(b.action, 'allow') AS action, b.category,
  b.signature_id, coalesce(b.confidence, 0.0)::DOUBLE AS confidence, b.detail AS details,
  coalesce(d.n_matches, 0)::BIGINT AS n_matches, coalesce(d.matches, '') AS matches
  FROM prompts p LEFT JOIN best b USING (request_id) LEFT JOIN details d USING (request_id))"""


RULES = default_rules()
VERDICTS = "WITH " + _votes(RULES)
_VERDICT_COLUMNS = "request_id, action, category, signature_id, confidence, details, n_matches, matches"


def verdicts(spark, sf, config: ScanConfig = ScanConfig()) -> DataFrame:
    return fuse(prompts(spark, sf), "text", RULES, config)


def _verdict_rows(config: ScanConfig):
    def build(spark, sf):
        return verdicts(spark, sf, config).select(
            "request_id", "action", "category", "signature_id", "confidence", "details",
            F.coalesce(F.size("matches"), F.lit(0)).cast("bigint").alias("n_matches"),
            # Every vote on a line of its own, in order.
            F.coalesce(F.array_join(F.transform("matches", lambda m: F.concat(m, F.lit("\n"))), ""), F.lit("")).alias("matches"))

    return build


def _secret_detector(df: DataFrame) -> DataFrame:
    """A plugged-in detector: its candidate column is fused like the built-in ones."""
    candidate = F.array(F.struct(
        F.lit("block").alias("action"), F.lit("secret").alias("category"), F.lit("X-1").alias("signature_id"),
        F.lit("extra:token").alias("detail"), F.lit(0.95).alias("confidence")))
    return df.withColumn("extra", F.when(F.col("text").rlike('token\\s*=\\s*"'), candidate))


def _hits(spark, sf):
    base = prompts(spark, sf).select("request_id", "text")
    return signature_hits(base, "text", RULES).select(
        "request_id", "signature_id", "category", "action", "matched_text")


def _hit_offsets(spark, sf):
    """Offsets of every hit, and what the text holds there."""
    base = prompts(spark, sf).select("request_id", "text")
    hits = signature_hits(base, "text", RULES).select("request_id", "signature_id", "start", "end", "matched_text")
    return hits.selectExpr("request_id", "signature_id", "cast(start as bigint) as start_at", "cast(`end` as bigint) as end_at", "matched_text")


def _leak_offsets(spark, sf):
    """Offsets of rules that look at word bounds, over the documents."""
    hits = signature_hits(_outputs(spark, sf), "text", LEAK_RULES)
    return hits.selectExpr("request_id", "signature_id", "cast(start as bigint) as start_at", "cast(`end` as bigint) as end_at", "matched_text")


def _leak_offsets_sql() -> str:
    """Each match between two marks, set in one pass over the whole text, so that bounds are seen as they are."""
    marked = " UNION ALL ".join(
        f"SELECT request_id, {i} AS ord, string_split(regexp_replace(text, {quoted(p)}, chr(1) || '\\0' || chr(2), 'gi'), chr(1)) AS parts FROM outputs"
        for i, (p, _) in enumerate(LEAK_RULES.patterns))
    return f"""WITH {_OUTPUTS}, {rules_cte(LEAK_RULES)}, marked AS ({marked}),
pieces AS (SELECT request_id, ord, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM marked WHERE len(parts) > 1),
placed AS (SELECT *, sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY request_id, ord ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS start_at FROM pieces)
SELECT request_id, id AS signature_id, start_at, start_at + strpos(part, chr(2)) - 1 AS end_at, split_part(part, chr(2), 1) AS matched_text
FROM placed JOIN rules USING (ord) WHERE k > 1"""


def _best(spark, sf):
    return best_signature(prompts(spark, sf).select("request_id", "text"), "text", RULES).select(
        "request_id", "action", "category", "signature_id", "confidence")


def _signals(spark, sf):
    base = prompts(spark, sf).select("request_id", "text")
    return explode_signals(evasion_signals(base).drop("text"))


def _check(spark, sf):
    return check(prompts(spark, sf), RULES, keep=("request_id",))


def _check_summary(spark, sf):
    judged = check(prompts(spark, sf), RULES, keep=("request_id",))
    return judged.groupBy("action", "category").agg(
        F.count("*").alias("n"), F.count_if("is_blocked").alias("blocked"),
        F.count_if("requires_attention").alias("attention"))


def _public(spark, sf):
    return public_verdicts(verdicts(spark, sf), RULES, ("request_id",))


def _json_log(spark, sf):
    """Every line carries keys, in a text, a message and a header, which must not be seen."""
    judged = verdicts(spark, sf).where("action <> 'allow'").selectExpr(
        "request_id", "client_id", "action", "category", "concat('Bearer a.b-', request_id, ' and sk-ant-x', request_id, ' of ', client_id) as note",
        "map('Authorization', concat('Basic ', request_id), 'Accept', 'text', 'X-Note', concat('sk-', request_id)) as headers")
    return to_json_log(
        judged, F.lit("WARNING"), F.lit("scanner"), F.concat(F.lit("Detection "), F.col("action"), F.lit(" by sk-"), F.col("request_id")),
        F.timestamp_seconds(F.col("request_id") + 1704067200))


# --- responses: the documents stand for model output ---------------------------------------
def _outputs(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id as request_id", "text")


_OUTPUTS = "outputs AS (SELECT doc_id AS request_id, text FROM documents)"


def _leak_sql(categories=(), select: str = "") -> str:
    kept = LEAK_RULES.for_responses(categories)
    return f"""WITH {_OUTPUTS}, {rules_cte(kept)}, {matches_cte(kept, 'outputs')},
votes AS (SELECT request_id, ord, len(found) AS times, r.* EXCLUDE (ord) FROM matches JOIN rules r USING (ord)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {RANK.format('action')} DESC, ord) AS rn
  FROM votes) WHERE rn = 1),
total AS (SELECT request_id, sum(times)::BIGINT AS hits FROM votes GROUP BY request_id),
scanned AS (SELECT o.request_id, coalesce(t.action = 'block', false) AS blocked, t.category AS response_category,
  t.id AS response_signature_id, 'Detected: ' || t.pattern AS response_details, coalesce(hits, 0) AS hit_count,
  length(o.text) AS scanned_length
  FROM outputs o LEFT JOIN top t USING (request_id) LEFT JOIN total USING (request_id)) {select or 'SELECT * FROM scanned'}"""


def _scan_outputs(categories=()):
    def build(spark, sf):
        return R.scan_responses(_outputs(spark, sf), "text", LEAK_RULES, categories).drop("text").withColumns({
            "hit_count": F.col("hit_count").cast("bigint"), "scanned_length": F.col("scanned_length").cast("bigint")})

    return build


def _response_rules(spark, sf):
    """Which response rules hit anything at all, with the rule's number of matches."""
    base = _outputs(spark, sf)
    hits = signature_hits(base, "text", LEAK_RULES.for_responses(("pii",)))
    return hits.groupBy("signature_id", "action").agg(
        F.count("*").alias("n"), F.countDistinct("request_id").alias("texts"))


def _response_outcome(spark, sf):
    base = _outputs(spark, sf).select("request_id", F.col("text").cast("binary").alias("body"))
    return R.response_outcome(base, "body", LEAK_RULES).select(
        "request_id", "outcome_type", "event_type", "metric_action", F.col("status").cast("bigint").alias("status"))


# Documents cut into lines: each line is a chunk of the document's stream.
def _chunks(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("stream_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line")
    ).select("stream_id", "seq", F.concat(F.lit("data: "), "line", F.lit("\n\n")).alias("chunk"))


_CHUNKS = """chunks AS (SELECT doc_id::VARCHAR AS stream_id, unnest(string_split(text, chr(10))) AS payload,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"""


def _stream_sql(content: str) -> str:
    kept = LEAK_RULES.for_responses()
    return f"""WITH {_CHUNKS}, outputs AS ({content}), {rules_cte(kept)}, {matches_cte(kept, 'outputs')},
votes AS (SELECT request_id, ord, len(found) AS times, r.* EXCLUDE (ord) FROM matches JOIN rules r USING (ord)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {RANK.format('action')} DESC, ord) AS rn
  FROM votes) WHERE rn = 1)
SELECT o.request_id AS stream_id, coalesce(t.action = 'block', false) AS blocked, t.category AS response_category,
  length(o.text) AS scanned_length FROM outputs o LEFT JOIN top t USING (request_id)"""


def _stream(mode: str):
    def build(spark, sf):
        scanned = R.scan_stream_table(_chunks(spark, sf), LEAK_RULES, mode)
        return scanned.select(
            "stream_id", "blocked", "response_category", F.col("scanned_length").cast("bigint").alias("scanned_length"))

    return build


# --- classifier ----------------------------------------------------------------------------
def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "text", F.when(F.col("toxic") == 1, "toxic_content").otherwise("safe").alias("label"))


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _classify(spark, sf):
    """Fitted on the labelled rows outside of a fold; all documents are scored, with or without a label."""
    labelled = _labelled(spark, sf)
    model = train_classifier(labelled.where(~_held_out()), features=1 << 12, max_iter=5)
    data = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        labelled.select("doc_id", "label").distinct(), "doc_id", "left")
    return classify(data, model, threshold=0.5).select(
        "doc_id", "label", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), F.size("ml").cast("bigint").alias("n"),
        F.try_element_at("ml", F.lit(1))["category"].alias("category"))


# DuckDB has no crc32, so the closed-form model is held out by a hash that both have.
_FOLD = "md5(cast(cast(doc_id as {}) as {})) >= 'd'"


def _naive_bayes(spark, sf):
    """All documents, scored by a model of the labelled ones outside the fold."""
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", F.expr(_FOLD.format("string", "binary")))
    labelled = _labelled(spark, sf).withColumn("held_out", F.expr(_FOLD.format("string", "binary")))
    scored = naive_bayes_classify(docs, "doc_id", *naive_bayes_fit(labelled.where("not held_out")))
    return scored.join(docs.select("doc_id", "held_out"), "doc_id").select(
        "doc_id", "held_out", "label", F.round("log_score", 4).alias("log_score"), "best")


_NAIVE_BAYES = f"""WITH docs AS (SELECT doc_id, text, {_FOLD.format("varchar", "varchar")} AS held_out FROM documents),
data AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic_content' ELSE 'safe' END AS label FROM labels JOIN docs USING (doc_id) WHERE NOT held_out),
words AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS token FROM docs),
model AS (SELECT label, token, count(*) AS c FROM words JOIN data USING (doc_id) GROUP BY ALL),
classes AS (SELECT label, count(*) AS docs, (SELECT coalesce(sum(c), 0) FROM model m WHERE m.label = d.label) AS tokens,
  (SELECT count(DISTINCT token) FROM model) AS vocabulary FROM data d GROUP BY label),
sums AS (SELECT w.doc_id, k.label, sum(ln(coalesce(m.c, 0) + 1) - ln(k.tokens + k.vocabulary)) AS s
  FROM words w CROSS JOIN classes k LEFT JOIN model m ON m.label = k.label AND m.token = w.token GROUP BY ALL),
scored AS (SELECT d.doc_id, held_out, k.label, ln(k.docs + 1) + coalesce(s, 0) AS log_score
  FROM docs d CROSS JOIN classes k LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.label = k.label)
SELECT doc_id, held_out, label, round(log_score, 4) AS log_score,
  row_number() OVER (PARTITION BY doc_id ORDER BY round(log_score, 6) DESC, label) = 1 AS best FROM scored"""


def _mutated(spark, sf):
    """Three mutators before a scan: one rewrites, one cannot be planned, one changes nothing."""
    registry = MutatorRegistry()
    registry.register(lambda df: df.withColumn("text", F.replace("text", F.lit("@"), F.lit(" at "))))
    registry.register(lambda df: df.withColumn("text", F.col("no_such_column")))
    registry.register(lambda df: None)
    hits = signature_hits(registry.apply(_outputs(spark, sf)), "text", LEAK_RULES)
    return hits.groupBy("signature_id").agg(F.count("*").alias("n"), F.countDistinct("request_id").alias("texts"))


_MUTATED = (
    f"WITH {rules_cte(LEAK_RULES)}, changed AS (SELECT doc_id AS request_id, replace(text, '@', ' at ') AS text FROM documents), "
    f"{matches_cte(LEAK_RULES, 'changed')} SELECT id AS signature_id, sum(len(found))::BIGINT AS n, count(DISTINCT request_id) AS texts "
    "FROM matches JOIN rules USING (ord) GROUP BY id")


_CLASSES = ("jailbreak", "prompt_injection", "benign")


def _make_linear():
    """Stand-in for a loaded model: a linear layer over the whole vector, with logits out."""

    def predict(batch: np.ndarray) -> np.ndarray:
        i = np.arange(batch.shape[1])
        weights = np.stack([(i * (c + 3)) % 7 - 3.0 for c in range(len(_CLASSES))])
        return batch.astype(np.float64) @ weights.T

    return predict


def _batch_model(spark, sf):
    base = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("request_id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    first = base.first()
    size = len(first["v"]) if first else 0  # the vector length is a property of the model
    scored = classify_batch(
        base, "v", _make_linear, list(_CLASSES), threshold=0.6, model_id="linear",
        input_tensor_shapes=[[size]])
    return scored.select("request_id", F.inline("ml")).select(
        "request_id", "category", F.round("confidence", 6).alias("confidence"))


_BATCH_SQL = "WITH logits AS (SELECT vec_id AS request_id, " + ", ".join(
    f"list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (((i - 1) * {c + 3}) % 7 - 3))) AS z{c}"
    for c in range(3)
) + """ FROM embeddings), scores AS (SELECT *, greatest(z0, z1, z2) AS m, least(z0, z1, z2) < 0 OR greatest(z0, z1, z2) > 1 AS raw FROM logits),
soft AS (SELECT *, exp(z0 - m) + exp(z1 - m) + exp(z2 - m) AS t FROM scores),
long AS (""" + " UNION ALL ".join(
    f"SELECT request_id, '{name.replace('_', '-')}' AS category, CASE WHEN raw THEN exp(z{c} - m) / t ELSE z{c} END AS p FROM soft"
    for c, name in enumerate(_CLASSES) if name != "benign"
) + ") SELECT request_id, category, round(p, 6) AS confidence FROM long WHERE p >= 0.6"


def _model_loads(spark, sf):
    """Events as model loads of a user: the tier by event type, one type without tier."""
    loads = table(spark, sf, "events").selectExpr(
        "user_id as account", "event_id as load_seq", "cast(event_id as string) as model_id",
        "case event_type when 'view' then 'free' when 'click' then 'pro' when 'error' then 'enterprise' "
        "when 'purchase' then 'beta' else null end as tier")
    return active_model(loads, ("account",))


_LOADS_SQL = """WITH loads AS (SELECT user_id AS account, event_id AS load_seq, event_id::VARCHAR AS model_id,
  CASE event_type WHEN 'view' THEN 'free' WHEN 'click' THEN 'pro' WHEN 'error' THEN 'enterprise'
  WHEN 'purchase' THEN 'beta' END AS tier FROM events),
ranked AS (SELECT *, CASE tier WHEN 'free' THEN 0 WHEN 'pro' THEN 1 WHEN 'enterprise' THEN 2 WHEN 'beta' THEN -1 END AS rank FROM loads),
seen AS (SELECT *, max(rank) OVER (PARTITION BY account ORDER BY load_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranked),
applied AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY load_seq DESC) AS rn FROM seen
  WHERE rank IS NULL OR rank >= coalesce(before, -1))
SELECT account, model_id, tier, load_seq FROM applied WHERE rn = 1"""

ENTRIES = {
    "det_signature_hits": (
        _hits,
        f"WITH {PROMPTS}, {rules_cte(RULES)}, {matches_cte(RULES, 'prompts')} SELECT request_id, id AS signature_id, "
        "category, action, unnest(found) AS matched_text FROM matches JOIN rules USING (ord)"),
    "det_hit_offsets": (
        _hit_offsets,
        f"WITH RECURSIVE {PROMPTS}, {rules_cte(RULES)}, {matches_cte(RULES, 'prompts')}, "
        "walk AS (SELECT request_id, ord, 1 AS i, strpos(text, found[1]) - 1 AS start_at, found, text FROM matches JOIN prompts USING (request_id) "
        "UNION ALL SELECT request_id, ord, i + 1, start_at + length(found[i]) + strpos(substr(text, start_at + length(found[i]) + 1), found[i + 1]) - 1, found, text "
        "FROM walk WHERE i < len(found)) "
        "SELECT request_id, id AS signature_id, start_at, start_at + length(found[i]) AS end_at, found[i] AS matched_text FROM walk JOIN rules USING (ord)"),
    "det_leak_offsets": (_leak_offsets, _leak_offsets_sql()),
    "det_best_signature": (
        _best,
        "WITH " + _votes(RULES, heuristics=False)
        + " SELECT request_id, action, category, signature_id, confidence FROM verdicts"),
    "det_evasion_signals": (
        _signals,
        f"WITH {PROMPTS}, {_SIGNAL_CTES} SELECT request_id, heuristic, description, confidence::DOUBLE AS confidence, details "
        "FROM signals JOIN kinds USING (heuristic)"),
    "det_fuse": (_verdict_rows(ScanConfig()), f"{VERDICTS} SELECT {_VERDICT_COLUMNS} FROM verdicts"),
    "det_fuse_regex_only": (
        _verdict_rows(ScanConfig(heuristics=False)),
        f"WITH {_votes(RULES, heuristics=False)} SELECT {_VERDICT_COLUMNS} FROM verdicts"),
    "det_fuse_evasion_only": (
        _verdict_rows(ScanConfig(regex=False)),
        f"WITH {_votes(RULES, regex=False)} SELECT {_VERDICT_COLUMNS} FROM verdicts"),
    "det_fuse_disabled": (
        _verdict_rows(ScanConfig(enabled=False)),
        f"WITH {PROMPTS} SELECT request_id, 'allow' AS action, NULL::VARCHAR AS category, NULL::VARCHAR AS signature_id, "
        "0.0::DOUBLE AS confidence, NULL::VARCHAR AS details, 0::BIGINT AS n_matches, '' AS matches FROM prompts"),
    "det_fuse_extra_detector": (
        _verdict_rows(ScanConfig(extra={"extra": _secret_detector})),
        "WITH " + _votes(RULES, extra=(
            "SELECT request_id, 2000, 'block', 'secret', 'X-1', 'extra:token', 0.95, 1 FROM prompts "
            "WHERE regexp_matches(text, 'token\\s*=\\s*\"')"))
        + f" SELECT {_VERDICT_COLUMNS} FROM verdicts"),
    "det_check": (
        _check,
        f"{VERDICTS} SELECT request_id, v.action, v.category, r.name AS signature_name, confidence, NULL::VARCHAR AS error_type, "
        "v.action <> 'block' AS is_safe, v.action = 'block' AS is_blocked, v.action IN ('warn', 'block') AS requires_attention "
        "FROM verdicts v LEFT JOIN rules r ON r.id = v.signature_id"),
    "det_check_summary": (
        _check_summary,
        f"{VERDICTS} SELECT action, category, count(*) AS n, count(*) FILTER (action = 'block') AS blocked, "
        "count(*) FILTER (action IN ('warn', 'block')) AS attention FROM verdicts GROUP BY ALL"),
    "det_classify": (_classify, None),
    "det_naive_bayes": (_naive_bayes, _NAIVE_BAYES),
    "det_mutators": (_mutated, _MUTATED),
    "det_classify_batch": (_batch_model, _BATCH_SQL),
    "det_active_model": (_model_loads, _LOADS_SQL),
    "snk_public_verdicts": (
        _public,
        f"{VERDICTS} SELECT request_id, v.action, v.category, r.name AS signature_name, confidence "
        "FROM verdicts v LEFT JOIN rules r ON r.id = v.signature_id"),
    "snk_json_log": (
        _json_log,
        f"{VERDICTS} SELECT '{{\"timestamp\":\"' || strftime(TIMESTAMP '2024-01-01' + to_seconds(request_id), '%Y-%m-%dT%H:%M:%S.%f') "
        f"|| '+00:00\",\"level\":\"warning\",\"logger\":\"scanner\",\"message\":\"Detection ' || action || ' by {K.REDACTED}\",\"request_id\":' || request_id "
        "|| ',\"client_id\":\"' || client_id || '\",\"action\":\"' || action || '\",\"category\":\"' || category "
        f"|| '\",\"note\":\"{K.REDACTED} and {K.REDACTED} of ' || client_id || '\",\"headers\":{{\"Authorization\":\"{K.REDACTED}\",\"Accept\":\"text\",\"X-Note\":\"{K.REDACTED}\"}}}}' AS value "
        "FROM verdicts WHERE action <> 'allow'"),
    "rsp_response_rules": (
        _response_rules,
        f"WITH {_OUTPUTS}, {rules_cte(LEAK_RULES.for_responses(('pii',)))}, {matches_cte(LEAK_RULES.for_responses(('pii',)), 'outputs')} "
        "SELECT id AS signature_id, action, sum(len(found))::BIGINT AS n, count(*) AS texts FROM matches JOIN rules USING (ord) GROUP BY ALL"),
    "rsp_scan_responses": (_scan_outputs(), _leak_sql()),
    "rsp_scan_responses_category": (_scan_outputs(("pii",)), _leak_sql(("pii",))),
    "rsp_response_outcome": (
        _response_outcome,
        _leak_sql(select="SELECT request_id, CASE WHEN blocked THEN 'response_blocked' END AS outcome_type, "
                  "CASE WHEN hit_count > 0 THEN 'response_detection' END AS event_type, "
                  "CASE WHEN blocked THEN 'block' WHEN hit_count > 0 THEN 'warn' END AS metric_action, "
                  "CASE WHEN blocked THEN 502 ELSE 200 END::BIGINT AS status FROM scanned")),
    "rsp_stream_passthrough": (
        _stream("passthrough"),
        _stream_sql("SELECT stream_id || '/' || seq AS request_id, payload AS text FROM chunks WHERE payload <> ''"
                    ).replace("SELECT o.request_id AS stream_id", "SELECT split_part(o.request_id, '/', 1) AS stream_id")),
    "rsp_stream_buffered": (
        _stream("buffered"),
        _stream_sql("SELECT stream_id AS request_id, string_agg(payload, '' ORDER BY seq) AS text FROM (SELECT *, "
                    "coalesce(sum(length(payload)) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
                    "FROM chunks WHERE payload <> '') WHERE before < 1024 GROUP BY stream_id")),
    "rsp_stream_full": (
        _stream("full"),
        _stream_sql("SELECT stream_id AS request_id, string_agg(payload, '' ORDER BY seq) AS text FROM chunks GROUP BY stream_id")),
}
