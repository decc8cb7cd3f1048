"""Sources, sinks, lifecycle, metrics, evaluation, streaming."""

import random
import json
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promptsieve.functions.variant import parse_body
from promptsieve.operators import evaluation as V
from promptsieve.operators import lifecycle as L
from promptsieve.operators import metrics as M
from promptsieve.operators.fusion import fuse
from promptsieve.operators.signatures import Rule, RuleSet
from promptsieve.sources import sinks as S
from promptsieve.sources.policy import read_policy
from promptsieve.sources.requests import read_requests
from promptsieve.sources.signatures import read_bundles, read_signature_version, read_signatures
from promptsieve.operators import limits as L_, repeats as R_
from promptsieve.streaming import jobs as J

RULES_YAML = """
signatures:
  - {id: A-1, name: First, severity: high, action: block, category: c_x, patterns: ["foo", "bar"]}
  - {id: A-2, name: Second, severity: low, action: warn, pattern: "baz", scan_target: both}
"""


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="promptsieve-test-")


def write(folder, name, text):
    import pathlib

    path = pathlib.Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_signatures(spark, folder):
    write(folder, "a.yaml", RULES_YAML)
    write(folder, "deep/b.yml", RULES_YAML.replace("A-", "B-"))
    write(folder, "note.txt", "signatures: []")
    write(folder, ".version", "1.2.3\n")
    rows = read_signatures(spark, folder).orderBy("ordinal").collect()
    assert [r.id for r in rows] == ["A-1", "A-2", "B-1", "B-2"]
    assert (rows[0].patterns, rows[1].category, rows[1].scan_target, rows[0].version) == (["foo", "bar"], "unknown", "both", "1.2.3")
    rules = RuleSet.from_dataframe(read_signatures(spark, folder))
    df = spark.createDataFrame([("a foo baz",)], "text string")
    assert fuse(df, "text", rules).first().signature_id == "A-1"
    assert read_signatures(spark, folder + "/missing").count() == 0 and read_signature_version(folder + "/missing") == ""


def test_read_bundles(spark):
    two = f"# === a.yaml ===\n{RULES_YAML}# === bad.yaml ===\n: [\n# === b.yaml ===\n{RULES_YAML}"
    docs = RULES_YAML + "---" + RULES_YAML
    bundles = spark.createDataFrame(
        [("x", "1", "pro", two, True), ("y", "2", None, docs, None), ("", "3", "free", RULES_YAML, None), ("z", "4", "free", "", None)],
        "bundle_id string, version string, tier string, content string, is_encrypted boolean")
    licenses = spark.createDataFrame([("x", datetime(2024, 1, 1))], "bundle_id string, expires_at timestamp")
    got = {r.bundle_id: r for r in read_bundles(bundles, licenses).collect()}
    assert set(got) == {"x", "y", "z"}
    assert [s.id for s in got["x"].signatures] == ["A-1", "A-2", "A-1", "A-2"] and got["x"].expires_at == datetime(2024, 1, 1)
    assert len(got["y"].signatures) == 4 and got["y"].tier == "free" and got["z"].signatures == []


def test_read_policy(spark, folder, monkeypatch):
    monkeypatch.setenv("PS_PORT", "9")
    path = write(folder, "p.yaml", """
server: {port: "${PS_PORT}"}
upstreams: {openai: {url: "https://${PS_HOST:-api.openai.com}", timeout: 30s}, other: {url: u, auth_header: null}}
policy:
  default_action: warn
  categories: {a: {action: block}, b: {sensitivity: 0.9}, c: {threshold: 0.2}}
  allowlists: [{client_id: x, categories: ["*"]}]
routing: {tasks: {chat: {ordered_pool: [m], fallback: [n]}}, downgrades: [{provider: p, from: f, to: t}], dry_run: false}
cache: {ttl_seconds: 99999}
""")
    t = {name: df.collect() for name, df in read_policy(spark, path).items()}
    assert {r.category: (r.action, r.threshold, r.sensitivity) for r in t["category_policy"]} == {
        "a": ("block", 0.8, None), "b": ("block", None, 0.9), "c": ("block", 0.2, None)}
    assert {r.provider: (r.url, r.timeout, r.auth_header) for r in t["upstreams"]} == {
        "openai": ("https://api.openai.com", 30, "Authorization"), "other": ("u", 60, None)}
    settings = {r.name: r.value for r in t["settings"]}
    assert settings["server.port"] == "9" and settings["policy.default_action"] == "warn"
    assert settings["cache.ttl_seconds"] == "3600" and settings["routing.dry_run"] == "false" and settings["scanner.regex"] == "true"
    assert t["downgrades"][0]["from"] == "f" and t["routing_tasks"][0].ordered_pool == ["m"] and t["allowlist"][0].categories == ["*"]


def test_read_requests(spark, folder):
    row = {"request_id": "1", "ts": "2024-01-01T00:00:00", "method": "POST", "path": "/p", "headers": {"X-A": "1", "x-a": "2"}, "remote_addr": "r"}
    write(folder, "log/a.json", "\n".join(json.dumps({**row, "body": b}) for b in ['{"a":1}', "nope", "[1]"]))
    rows = read_requests(spark, folder + "/log", "json").select("headers", F.col("body_json").isNotNull().alias("ok")).collect()
    assert sorted(r.ok for r in rows) == [False, False, True] and rows[0].headers == {"x-a": "2"}


def test_events_sink_and_batches(spark, folder):
    events = spark.createDataFrame([(f"e{i}", datetime(2024, 1, 1), "usage" if i % 2 else "block") for i in range(250)],
                                   "event_id string, ts timestamp, event_type string")
    S.write_events(events, folder + "/out")
    back = spark.read.parquet(folder + "/out")
    assert back.groupBy("kind").count().count() == 2 and back.count() == 250
    rows = events.collect()
    sizes = []
    assert S.send_batches(iter(rows), lambda b: sizes.append(len(b)) or 200) == (250, 0) and sizes == [100, 100, 50]
    assert S.send_batches(iter(rows), lambda b: 422) == (0, 250)
    for status in (429, 408, 503):
        with pytest.raises(S.TransientSendError):
            S.send_batches(iter(rows), lambda b: status)


def test_deliveries_account_for_every_event(spark, folder):
    """A receiver that fails by rule: what is refused is kept, what failed is sent again, nothing twice."""
    from promptsieve.sources.delivery import DeliveryLedger

    rows = [(n, datetime(2024, 1, 1), "usage" if n % 2 else "scan", f"p{n}") for n in range(500)] + [(None, None, "usage", "nameless")]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, event_type string, props string").repartition(3)
    ledger = DeliveryLedger(spark, folder)

    def flaky(batch):
        if any(e["event_id"] % 100 == 7 for e in batch):
            raise OSError("connection lost")
        return 429 if any(e["event_id"] % 100 == 8 for e in batch) else 400 if batch[0]["event_type"] == "usage" else 204

    first = ledger.deliver(events, flaky, 10)
    assert sum(first.values()) == 500 and first["open"] > 0
    second = ledger.deliver(events, lambda batch: 200, 10)
    assert second == {"sent": first["open"]}
    assert ledger.deliver(events, lambda batch: 1 / 0, 10) == {}
    settled = ledger.settled().collect()
    assert sorted(int(r.event_id) for r in settled) == list(range(500))
    letters = ledger.dead_letters(events).collect()
    assert len(letters) == first.get("dead", 0) and all(r.event_type == "usage" and r.refused_with == 400 and r.props == f"p{r.event_id}" for r in letters)
    counts = S.post_events(events, lambda batch: 200 if batch[0]["event_type"] == "usage" else 500, attempts=2).batches().groupBy("outcome").count().collect()
    assert {r.outcome for r in counts} == {"sent", "open"}


def test_stream_sink(spark, folder):
    events = spark.createDataFrame([("e1", datetime(2024, 1, 1), "usage")], "event_id string, ts timestamp, event_type string")
    events.write.parquet(folder + "/in")
    live = spark.readStream.schema(events.schema).parquet(folder + "/in")
    S.write_events(live, folder + "/out", folder + "/cp").awaitTermination(60)
    assert spark.read.parquet(folder + "/out").first().kind == "usage"


def test_prometheus_and_json_log(spark, folder):
    metrics = spark.createDataFrame([("m", "Help", "counter", {"a": 'x"\\\n'}, 3.0), ("g", "G", "gauge", {}, 0.5)],
                                    "name string, help string, type string, labels map<string,string>, value double")
    lines = [r.value for r in S.to_prometheus(metrics).collect()]
    assert lines == ["# HELP g G", "# TYPE g gauge", "g 0.5", "# HELP m Help", "# TYPE m counter", 'm{a="x\\"\\\\\\n"} 3']
    S.write_lines(S.to_prometheus(metrics), folder + "/m")
    df = spark.createDataFrame([(1, None)], "n int, s string")
    line = S.to_json_log(df, F.lit("WARNING"), F.lit("l"), F.lit("m"), F.lit("2024-01-01 00:00:00").cast("timestamp")).first().value
    assert json.loads(line) == {"timestamp": "2024-01-01T00:00:00.000000+00:00", "level": "warning", "logger": "l", "message": "m", "n": 1, "s": None}


def test_bundles_over_time(spark):
    now = datetime(2024, 1, 10)
    sig = lambda n: [("s",)] * n
    rows = [("free", "1", 3, None), ("active", "3", 5, now + timedelta(hours=12)), ("late", "2", 0, now + timedelta(hours=48)), ("old", "9", 7, now - timedelta(hours=1))]
    df = spark.createDataFrame([(b, v, sig(n), e) for b, v, n, e in rows], "bundle_id string, version string, signatures array<struct<id:string>>, expires_at timestamp")
    at = F.lit(now)
    assert tuple(L.bundle_counts(df, at).first()) == (15, 8, "9")
    assert L.active_signatures(df, at).count() == 8
    assert L.expiring_soon(df, at, 24).count() == 1 and L.expiring_soon(df, at, 72).count() == 2 and L.expiring_soon(df, at, 24, past=True).count() == 2
    assert L.earliest_expiration(df, at).first()[0] == now + timedelta(hours=12)


def test_manifest_audit(spark):
    rows = [("c", 1, 5, "", "h1", "s"), ("c", 2, 4, "h1", "h2", "s"), ("c", 3, 6, "h1", "h3", "s"), ("c", 4, 6, "h1", "h4", "s"),
            ("c", 5, 7, "", "h5", ""), ("c", 6, 7, "h3", "h6", "s"), ("d", 1, 0, "zz", "k", "s")]
    df = spark.createDataFrame(rows, "channel string, arrival bigint, sequence bigint, previous_hash string, manifest_hash string, signature string")
    got = {(r.channel, r.arrival): r.error for r in L.audit_manifests(df).collect()}
    assert got == {("c", 1): None, ("c", 2): "sequence rollback", ("c", 3): None, ("c", 4): "previous_hash mismatch",
                   ("c", 5): "missing signature", ("c", 6): None, ("d", 1): None}


def test_manifests_of_one_channel_against_a_fold(spark):
    """Named hashes, right and wrong, rollbacks and missing signatures; the channel is cut into blocks."""
    rng = random.Random(2)
    rows, hashes = [], [""]
    for n in range(600):
        named = rng.choice([None, "", hashes[-1], rng.choice(hashes), "wrong"]) if n % 3 else hashes[-1]
        rows.append(("c", n, n // 2 + rng.choice([0, 0, 1, -3]), named, f"h{n}" if n % 17 else None, "s" if rng.random() < 0.9 else rng.choice(["", None])))
        hashes.append(f"h{n}")
    sequence, digest, want = 0, "", {}
    for _, n, seq, named, own, signature in rows:
        want[n] = ("missing signature" if not signature else "sequence rollback" if seq < sequence
                   else "previous_hash mismatch" if digest and named and named != digest else None)
        if want[n] is None:
            sequence, digest = seq, own
    df = spark.createDataFrame(rows, "channel string, arrival bigint, sequence bigint, previous_hash string, manifest_hash string, signature string")
    for blocks in (1, 37):
        judged = L.audit_manifests(df, blocks).collect()
        assert {r.arrival: r.error for r in judged} == want and len(judged) == 600 and all(r.valid == (r.error is None) for r in judged)
    assert set(want.values()) == {None, "missing signature", "sequence rollback", "previous_hash mismatch"}
    assert L.audit_manifests(df.limit(0)).count() == 0


def test_policy_is_read_through_hadoop(spark, folder):
    """By a URI, and on a file system that is not the default one and that Python does not know."""
    write(folder, "policy.yaml", "policy: {default_action: warn, categories: {pii: {action: log}}}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shelf.link./in", f"file:{folder}")
    for path in (f"{folder}/policy.yaml", f"file:{folder}/policy.yaml", "viewfs://shelf/in/policy.yaml"):
        assert read_policy(spark, path)["category_policy"].first().action == "log"
    with pytest.raises(Exception, match="nothing.yaml"):
        read_policy(spark, f"file:{folder}/nothing.yaml")


def test_policy_snapshots_keep_the_last_good(spark, folder):
    from promptsieve.session import local_table
    from promptsieve.sources.policy import SCHEMAS
    from promptsieve.sources.snapshots import PolicyInForce, PolicySnapshots

    snapshots = PolicySnapshots(spark, folder)
    rows = lambda *r: {"category_policy": local_table(spark, list(r), SCHEMAS["category_policy"])}
    policy = PolicyInForce(snapshots)
    with pytest.raises(ValueError):
        policy.refresh()
    snapshots.publish(1, rows(("pii", "block", 0.5, None)))
    assert policy.refresh().version == 1
    for version, bad in ((2, ("pii", "explode", 0.5, None)), (3, ("pii", "block", 1.5, None)), (4, (None, "block", None, None))):
        snapshots.publish(version, rows(bad))
    snapshots.publish(5, {"category_policy": spark.range(1)})
    with pytest.warns(UserWarning):
        assert policy.refresh().version == 1
    assert PolicyInForce(snapshots).snapshots.last_good() == 1
    with pytest.warns(UserWarning):
        assert PolicyInForce(snapshots).refresh().version == 1
    snapshots.publish(6, rows(("pii", "warn", None, 0.9)) | {"settings": local_table(spark, [("policy.default_action", "log")], SCHEMAS["settings"])})
    now = policy.refresh()
    assert (now.version, now.default_action, now.category_policy.first().action) == (6, "log", "warn")


def test_bundle_files(spark, folder):
    write(folder, "b1/content.yaml", "12345")
    write(folder, "b1/license.json", "{}")
    write(folder, "b2/content.yaml", "123")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    licenses = spark.createDataFrame([("b2", datetime(2020, 1, 1))], "bundle_id string, expires_at timestamp")
    assert tuple(L.bundle_inventory(files, licenses, F.current_timestamp()).first()) == (2, 10, 1)
    assert [r[0] for r in L.expired_bundles(files, licenses, F.current_timestamp()).collect()] == ["b2"]


@pytest.mark.parametrize("n, expected", [(100, (50.0, 90.0, 99.0)), (5, (3.0, 5.0, 5.0)), (50, (25.0, 45.0, 50.0)), (0, (0.0, 0.0, 0.0))])
def test_percentiles(spark, n, expected):
    df = spark.range(n).selectExpr("cast(id + 1 as double) as value", "id as ts")
    row = M.latency_percentiles(df).first()
    assert (row.p50, row.p90, row.p99) == expected


def test_percentiles_keep_the_last(spark):
    df = spark.range(3000).selectExpr("cast(id as double) as value", "id as ts")
    assert M.latency_percentiles(df).first().p50 == 2499.0


def test_evaluation_golden(spark):
    counts = [(True, True, 529), (True, False, 388), (False, True, 43), (False, False, 874)]
    df = spark.createDataFrame(counts, "label boolean, predicted boolean, n int").select(
        "label", "predicted", F.explode(F.sequence(F.lit(1), "n")))
    r = V.evaluate(df).first()
    assert [round(100 * x, 2) for x in (r.tpr, r.tnr, r.precision, r.f1, r.balanced_score)] == [57.69, 95.31, 92.48, 71.05, 76.50]


# --- streaming -------------------------------------------------------------------------------
def as_stream(spark, df, folder, files=1):
    df.repartition(files).write.parquet(folder + "/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def drain(df, name):
    df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_live_stream_scan_keeps_state_across_batches(spark, folder):
    rules = RuleSet((Rule("S", "s", "pii", "high", "block", (r"\d{3}-\d{2}",), "response"),))
    rows = [("a", i, f"data: {c}\n\n") for i, c in enumerate(["12", "3-4", "5 tail", "[DONE]"])] + [("b", 0, "data: clean\n\ndata: [DONE]\n\n")]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, chunk string").coalesce(1)
    live = as_stream(spark, df, folder)
    got = {r.stream_id: (r.blocked, r.scanned_length) for r in drain(J.scan_stream(live, rules, "full", idle_ms=None), "full").collect()}
    assert got == {"a": (True, 11), "b": (False, 5)}
    first = {r.stream_id: r.scanned_length for r in drain(J.scan_stream(live, rules, "buffered", 4, idle_ms=None), "buffered").collect()}
    assert first == {"a": 5, "b": 5}
    assert drain(J.scan_stream(live, rules, "passthrough"), "pass").count() == 4


def test_stream_limits_expire_by_event_time(spark, folder):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    rows = [("1", "a", at(0)), ("2", "a", at(1)), ("3", None, at(1)), ("4", "a", at(5)), ("5", "a", None), ("6", "a", at(7200))]
    live = as_stream(spark, spark.createDataFrame(rows, "event_id string, client string, ts timestamp").coalesce(1), folder)
    got = {r.event_id: r.decision for r in drain(J.rate_limit_stream(live, rate=0.5, burst=1, ordered=False), "limits").collect()}
    assert got == {"1": "allowed", "2": "limited", "3": "allowed", "4": "allowed", "5": None, "6": "allowed"}


def arriving(spark, batches, schema, folder):
    """A stream of the given batches, one after the other."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def test_streams_judge_rows_in_order_and_lose_none(spark, folder):
    """Rows out of order within the delay are judged like a table; late and untimed ones come out with a NULL."""
    start = datetime(2024, 1, 1)
    rng = random.Random(4)
    rows = [(n, rng.choice("abc"), start + timedelta(seconds=7 * n + rng.randint(0, 900))) for n in range(400)]
    batches = [rows[:150], rows[150:300] + [(1000, "a", None)], rows[300:], [(2000, "z", start + timedelta(days=1))],
               [(3000, "a", start), (3001, "new", start)], [(4000, "z", start + timedelta(days=2))]]
    schema = "event_id bigint, client string, ts timestamp"
    table = spark.createDataFrame(rows, schema)
    want = {r.event_id: r.decision for r in L_.rate_limit(table, rate=0.2, burst=3).collect()}
    want |= {1000: None, 3000: None, 3001: None, 2000: "allowed"}
    live = arriving(spark, batches, schema, folder + "/limits")
    got = [(int(r.event_id), r.decision) for r in drain(J.rate_limit_stream(live, rate=0.2, burst=3, delay="1 hour"), "ordered").collect()]
    assert len(got) == len(want) and dict(got) == want and set(want.values()) == {"allowed", "limited", None}
    keyed = [[(str(n), None if n % 50 == 9 else k, t, n % 3 > 0) for n, k, t in b] for b in batches]
    schema = "request_id string, key string, ts timestamp, ok boolean"
    table = spark.createDataFrame([r for b in keyed[:3] for r in b], schema)
    want = {r.request_id: r.is_hit for r in R_.repeat_hits(table, 60, storable=F.col("ok")).collect()}
    want |= {"3000": None, "3001": None, "2000": False}
    live = arriving(spark, keyed, schema, folder + "/repeats")
    got = [(r.request_id, r.is_hit) for r in drain(J.repeat_hits_stream(live, 60, storable="ok"), "in_order").collect()]
    assert len(got) == len(want) and dict(got) == want and set(want.values()) == {True, False, None}


@pytest.mark.parametrize("mode", ["full", "buffered"])
def test_a_pause_of_a_stream_loses_nothing(spark, folder, mode):
    """Chunks come out of order, twice, and after pauses; the last scan of a stream is of all of it."""
    rules = RuleSet((Rule("S", "s", "pii", "high", "block", (r"\d{3}-\d{2}",), "response"),))
    start = datetime(2024, 1, 1)
    texts = {"a": ["x 12", "3-4", "5 y", "tail"], "b": ["no", "thing"], "c": ["late 123", "-45"], "d": ["open end 123-45"]}
    chunk = lambda s, i: (s, i, "data: " + (texts[s] + ["[DONE]"])[i] + "\n\n")
    order = [[("a", 1), ("b", 0), ("c", 0), ("d", 0)], [("a", 1), ("a", 0), ("z", 0)], [("b", 2), ("z", 1)], [("a", 4), ("a", 3), ("a", 2), ("b", 1)],
             [("c", 2), ("z", 2)], [("c", 1), ("z", 3)]]
    texts["z"] = [""] * 9
    batches = [[(*chunk(s, i), start + timedelta(minutes=10 * k)) for s, i in keys] for k, keys in enumerate(order)]
    live = arriving(spark, batches, "stream_id string, seq bigint, chunk string, ts timestamp", folder)
    rows = drain(J.scan_stream(live, rules, mode, ts="ts"), f"pauses_{mode}").collect()
    last = {r.stream_id: r for r in sorted(rows, key=lambda r: r.revision)}
    assert {s: (r.blocked, r.scanned_length) for s, r in last.items()} == {
        s: (s != "b", len("".join(texts[s]))) for s in "abcd"}
    assert max(r.revision for r in rows) > 1


def test_stream_stores_only_good_answers(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [("1", "k", 0, False), ("2", "k", 1, True), ("3", "k", 2, False), ("4", "k", 20, None)]
    rows = [(i, k, start + timedelta(seconds=s), ok) for i, k, s, ok in rows]
    live = as_stream(spark, spark.createDataFrame(rows, "request_id string, key string, ts timestamp, ok boolean").coalesce(1), folder)
    got = {r.request_id: r.is_hit for r in drain(J.repeat_hits_stream(live, 10, storable="ok", ordered=False), "repeats").collect()}
    assert got == {"1": False, "2": False, "3": True, "4": False}


def test_log_lines_hold_no_keys(spark):
    row = [("sk-" + "a" * 40, {"Authorization": "Bearer abcdefghijklmnop", "X-Id": "7"})]
    df = spark.createDataFrame(row, "note string, headers map<string,string>")
    c = lambda s: F.lit(s)
    line = S.to_json_log(df, c("INFO"), c("gw"), F.col("note"), F.lit("2024-01-01").cast("timestamp")).first().value
    assert "sk-aaaa" not in line and "abcdefghijklmnop" not in line and '"X-Id":"7"' in line


def test_bodies_may_begin_with_any_blank(spark):
    df = spark.createDataFrame([('\n{"a": 1}',), ('\t {"a": 1}',), ("[1]",), ("3",), (None,), ("{",)], "body string")
    got = [r.ok for r in df.select(parse_body(F.col("body")).isNotNull().alias("ok")).collect()]
    assert got == [True, True, False, False, False, False]


def test_refreshing_rules(spark, folder):
    versions = iter([RuleSet((Rule("A", "a", patterns=("foo",)),)), RuntimeError("broken"), RuleSet((Rule("B", "b", patterns=("foo",)),))])

    def load():
        nxt = next(versions)
        if isinstance(nxt, Exception):
            raise nxt
        return nxt

    seen = []
    df = spark.createDataFrame([("foo",)] * 2, "text string")
    live = as_stream(spark, df, folder, files=2)
    rules = J.RefreshingRules(load)
    with pytest.warns(UserWarning):
        J.refreshing_scan(live, rules, lambda batch, r: fuse(batch, "text", r),
                          lambda out, i: seen.extend(r.signature_id for r in out.collect()), folder + "/cp").awaitTermination(120)
    assert seen[0] == "A" and rules.rules.rules[0].id in ("A", "B")


def test_on_detection_callback(spark, folder):
    rules = RuleSet((Rule("A", "a", patterns=("foo",)),))
    live = as_stream(spark, spark.createDataFrame([("foo",), ("bar",)], "text string"), folder)
    seen = []
    J.on_detection(fuse(live, "text", rules), lambda batch, i: seen.extend(r.text for r in batch.collect()), folder + "/cp").awaitTermination(120)
    assert seen == ["foo"]
