"""Policy, identity, cost operators against golden values and sequential Python."""

import json
import random
from datetime import datetime, timedelta
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptsieve.functions.variant import parse_body
from promptsieve.operators import identity as I
from promptsieve.operators import limits as L
from promptsieve.operators import policy as P
from promptsieve.operators import repeats as R
from promptsieve.operators import routing as G
from promptsieve.operators import usage as U
from promptsieve.operators.complexity import complexity, downgrade_eligible, prompt_text
from promptsieve.operators.responses import response_outcome, scan_responses, scan_stream_table
from promptsieve.operators.signatures import Rule, RuleSet

LEAKS = RuleSet((
    Rule("PII-001", "ssn", "pii", "high", "block", (r"\d{3}-\d{2}-\d{4}",), "response"),
    Rule("CARD", "card", "pii_card", "high", "warn", (r"\d{16}",), "both"),
    Rule("REQ", "request", "pii", "high", "block", ("the",), "request"),
))


def bodies(spark, values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, body string")


def over_bodies(spark, values, make):
    return [r[0] for r in bodies(spark, values).orderBy("i").select(make(parse_body(F.col("body")))).collect()]


@pytest.mark.parametrize("client, category, confidence, action, expected", [
    ("c", "inj", 0.85, "block", "allow"),          # threshold 0.9
    ("c", "sens", 0.2, "warn", "block"),           # sensitivity 0.9 -> threshold 0.1
    ("c", "sens", 0.05, "warn", "allow"),
    ("star", "inj", 0.99, "block", "allow"),
    ("multi", "b", 0.9, "block", "allow"),         # merged entries
    ("multi", "z", 0.9, "log", "warn"),            # default, stronger than the scan
    ("c", None, 0.9, "block", "warn"),
    ("c", "inj", 0.95, "allow", "allow"),
])
def test_resolve_policy(spark, client, category, confidence, action, expected):
    scans = spark.createDataFrame([(client, category, confidence, action)],
                                  "client_id string, category string, confidence double, action string")
    policy = spark.createDataFrame([("inj", "block", 0.9, None), ("sens", "block", 0.99, 0.9)],
                                   "category string, action string, threshold double, sensitivity double")
    allow = spark.createDataFrame([("star", ["*"]), ("multi", ["a"]), ("multi", ["b"])],
                                  "client_id string, categories array<string>")
    assert P.resolve_policy(scans, policy, allow, "warn").first().final_action == expected


def test_unknown_default_action_is_refused(spark):
    with pytest.raises(ValueError):
        P.resolve_policy(None, None, None, "explode")


@pytest.mark.parametrize("threshold, sensitivity, expected", [
    (0.8, None, 0.8), (None, None, 0.0), (0.8, 0.7, 0.3), (None, 1.5, 0.0), (None, -1.0, 1.0), (None, 0.0, 1.0),
])
def test_effective_threshold(spark, threshold, sensitivity, expected):
    df = spark.createDataFrame([(threshold, sensitivity)], "t double, s double")
    got = df.select(P.effective_threshold(F.col("t"), F.col("s"))).first()[0]
    assert got == pytest.approx(expected)


def test_identity(spark):
    df = spark.sql(
        "select map('x-forwarded-for', '203.0.113.50, 70.41.3.18', 'authorization', 'bearer tok') as h, '10.0.0.1' as r, 'cn' as c")
    who = lambda **kw: df.select(I.client_id(F.col("h"), F.col("r"), F.col("c"), **kw)).first()[0]
    assert who(method="ip", trust_forwarded=True) == "203.0.113.50"
    assert who(method="ip") == "10.0.0.1"
    assert len(who(method="token")) == 32 and who(method="token", hash_token=False) == "tok"
    assert who(method="header") == "unknown"
    assert who(method="header", fallback_header="X-Forwarded-For") == "203.0.113.50"
    assert who(method="mtls") == "cn"
    with pytest.raises(ValueError):
        who(method="nope")


def test_route_by_path(spark):
    up = spark.createDataFrame([("openai", "https://api.openai.com/", "Authorization", 60)],
                               "provider string, url string, auth_header string, timeout int")
    paths = spark.createDataFrame([("/OpenAI/v1/models?limit=10",), ("/x/y",), ("/openai",), ("plain",)], "path string")
    got = {r.path: r.upstream_url for r in I.route_by_path(paths, up).collect()}
    assert got == {"/OpenAI/v1/models?limit=10": "https://api.openai.com/v1/models?limit=10", "/x/y": None,
                   "/openai": "https://api.openai.com/", "plain": None}


def test_prompt_text(spark):
    values = [
        {"system": "S", "prompt": "P", "messages": [{"role": "user", "content": "A"}, "junk",
                                                    {"content": [{"type": "text", "text": "B"}, {"text": 5}, 3]}]},
        {"system": [{"type": "text", "text": "X"}, {"type": "image"}], "messages": "no"},
        "[1]", "broken", {},
    ]
    assert over_bodies(spark, values, prompt_text) == ["S\nP\nA\nB", "X", None, None, ""]


@pytest.mark.parametrize("text, tier, eligible", [
    ("hi", "trivial", True),
    ("Explain why, step by step, this holds", "strong", False),
    ("compare these two architectures", None, False),
    ("design a schema", None, False),
    ("evaluate the trade-off", None, False),
    ("```x```", None, False),
    ("first do this, and then that", None, False),
    ("firstly, then", "trivial", True),
])
def test_complexity(spark, text, tier, eligible):
    row = complexity(spark.createDataFrame([(text,)], "text string")).select(
        "complexity.*", downgrade_eligible().alias("ok")).first()
    assert row.ok is eligible
    assert tier is None or row.tier == tier
    assert tier != "strong" or row.score >= 0.6


def test_capability(spark):
    values = [{"messages": []}, {"tools": []}, {"tools": None}, {"stream": True}, {"stream": False}, {"response_format": {}},
              {"messages": [{"content": [{"type": "text"}]}]}, {"messages": [{"content": [{"type": "image_url"}]}]},
              {"messages": [{"content": [{"type": None}, "x"]}]}, {"messages": [{"content": [{"type": 5}]}]}]
    assert over_bodies(spark, values, G.capability_ok) == [True, False, True, False, True, False, True, False, True, False]


def test_select_route(spark):
    tasks = spark.createDataFrame([("t", ["mini", "mid", "max"], ["max"]), ("nofb", ["a"], [])],
                                  "task string, ordered_pool array<string>, fallback array<string>")
    rows = [("router:t", True), ("router: t ", False), ("router:nofb", False), ("router:zzz", True), ("router:  ", True), ("gpt", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, model string, capable boolean")
    got = [(r.chosen, r.retry_plan, r.route_error) for r in G.select_route(df, tasks).orderBy("i").collect()]
    assert got == [("mini", ["mid", "max"], None), ("max", [], None), (None, None, "no_route"),
                   (None, None, "unknown_router_task"), (None, None, None), (None, None, None)]


def test_served_attempt(spark):
    log = [("a", 0, "m0", 503), ("a", 1, "m1", 200), ("b", 0, "m0", None), ("b", 1, "m1", 500),
           ("c", 0, "m0", 429), ("c", 1, "m1", 200), ("d", 0, "m0", 500), ("d", 9, "m9", 200)]
    df = spark.createDataFrame([(*r, 1) for r in log], "request_id string, attempt int, model string, status int, plan_size int")
    got = {r.request_id: r.model for r in G.served_attempt(df).collect()}
    assert got == {"a": "m1", "b": "m1", "c": "m0", "d": "m0"}


def test_repeatable(spark):
    base = {"temperature": 0, "messages": [{"content": "x"}]}
    values = [base, {"seed": 1}, {"temperature": 0.5}, {**base, "tools": [1]}, {**base, "tools": []}, {**base, "response_format": {"a": 1}},
              {**base, "stream": True}, {"seed": 1, "messages": [{"content": [1]}]}, {"seed": 1, "input": [{"content": []}]},
              {**base, "audio": {"a": 1}}, {**base, "modalities": ["text"]}, {**base, "modalities": ["text", "audio"]}, {"temperature": "0"}, {"temperature": 0.0}]
    assert over_bodies(spark, values, R.is_repeatable) == [
        True, True, False, False, True, False, False, False, False, False, True, False, False, True]


def test_fingerprint(spark):
    values = [{"seed": 1, "model": "a"}, {"model": "a", "seed": 1}, {"seed": 2, "model": "a"}, {"model": "a"}, "x"]
    df = bodies(spark, values).orderBy("i")
    key = R.request_fingerprint(F.lit("ns"), F.lit("p"), F.lit("/v"), F.col("body"))
    keys = [r[0] for r in df.select(key).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] is None and keys[4] is None
    assert df.select(R.request_fingerprint(F.lit(""), F.lit("p"), F.lit("/v"), F.col("body"))).first()[0] is None


def sequential_hits(rows, ttl_ms):
    stored, out = {}, {}
    for key, at, rid, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        hit = key in stored and at - stored[key] < ttl_ms
        out[rid] = hit
        if not hit and ok:
            stored[key] = at
    return out


def test_repeat_hits_against_sequential(spark):
    rng = random.Random(11)
    start = 1_700_000_000_000
    rows = []
    for i in range(3000):  # one hot key with a third of the rows, gaps and equal times
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}"
        at = start + rng.choice([rng.randint(0, 3_600_000), rng.randint(10_000_000, 20_000_000)]) // 500 * 500
        rows.append((key, at, f"r{i:05d}", rng.random() < 0.8))
    df = spark.createDataFrame(rows, "key string, at bigint, request_id string, ok boolean").withColumn("ts", F.timestamp_millis("at"))
    got = {r.request_id: r.is_hit for r in R.repeat_hits(df, ttl=60, storable=F.col("ok")).collect()}
    # Requests of one millisecond are one arrival: those before the store of that instant miss.
    want = sequential_hits(rows, 60_000)
    assert len(got) == len(rows)
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, wrong[:5]


def test_stores_do_not_depend_on_partitions(spark):
    """Chains of every length, with gaps, against a walk; rows in any order and partition."""
    rng = random.Random(9)
    rows = sorted({(f"k{rng.randint(0, 9)}", rng.randint(0, 2) * 400_000 + 97 * rng.randint(0, 900)) for _ in range(900)})
    want, last = [], {}
    for key, at in rows:
        if key not in last or at - last[key] >= 3000:
            last[key] = at
            want.append((key, at, f"r{at}"))
    for parts in (1, 7):
        mixed = spark.createDataFrame([(k, at, f"r{at}") for k, at in rng.sample(rows, len(rows))], "key string, at bigint, rank string")
        more = mixed.union(mixed.withColumn("rank", F.concat("rank", F.lit("-later")))).repartition(parts)
        assert sorted(tuple(r) for r in R.store_times(more, 3).select("key", "at", "rank").collect()) == want


def test_prompt_cache_rewrite(spark):
    rows = [("anthropic", "https://h/v1/messages/", {"system": "S\n", "a": 1}), ("anthropic", "https://h/v1/complete", {"system": "S"}),
            ("openai", "https://h/v1/messages", {"system": "S"}), ("anthropic", "https://h/v1/messages", {"system": "  "}),
            ("anthropic", "https://h/v1/messages", {"system": [1]})]
    df = spark.createDataFrame([(i, p, u, json.dumps(b)) for i, (p, u, b) in enumerate(rows)], "i int, provider string, url string, body string")
    got = R.prompt_cache_rewrite(df).orderBy("i").collect()
    assert [r.prompt_cached for r in got] == [True, False, False, False, False]
    assert json.loads(got[0].outbound_body) == {
        "a": 1, "system": [{"type": "text", "text": "S\n", "cache_control": {"type": "ephemeral"}}]}
    assert got[1].outbound_body == json.dumps(rows[1][2])


def test_billed_tokens(spark):
    usage = lambda **kw: {"usage": kw}
    values = [usage(prompt_tokens=12, completion_tokens=34), usage(input_tokens=7, output_tokens=21, cache_read_input_tokens=500),
              usage(input_tokens=7, output_tokens=21, cache_read_input_tokens=-5), usage(prompt_tokens="12", completion_tokens=1),
              usage(prompt_tokens=True, completion_tokens=1), usage(prompt_tokens=-1, completion_tokens=1), usage(prompt_tokens=0, completion_tokens=0),
              {"usage": 5}, {}, "x", usage(prompt_tokens=1.5, completion_tokens=1), usage(prompt_tokens=5, input_tokens=1, output_tokens=2)]
    got = over_bodies(spark, values, U.billed_tokens)
    assert [None if b is None else tuple(b) for b in got] == [
        (12, 34, 0), (7, 21, 500), (7, 21, 0), None, None, None, (0, 0, 0), None, None, None, None, (1, 2, 0)]


def test_response_scan(spark):
    df = spark.createDataFrame([(0, "Your SSN is 123-45-6789, please verify."), (1, "the 1234567812345678"), (2, "the end"), (3, None)], "i int, t string")
    got = scan_responses(df, "t", LEAKS).orderBy("i").collect()
    assert [(r.blocked, r.response_category, r.response_signature_id) for r in got] == [
        (True, "pii", "PII-001"), (False, "pii_card", "CARD"), (False, None, None), (False, None, None)]
    assert got[0].response_details == r"Detected: \d{3}-\d{2}-\d{4}" and got[2].scanned_length == 7
    raw = spark.createDataFrame([(bytearray(b"\xff\xfe 123-45-6789"),), (bytearray(b"123-45-6789"),)], "body binary")
    assert sorted(r.status for r in response_outcome(raw, "body", LEAKS).collect()) == [200, 502]


def test_repeats_of_a_key_that_never_idles(spark):
    """One key, asked all the time: its stores are a long chain, found without walking it, over many tasks."""
    rng = random.Random(6)
    at, rows = datetime(2024, 1, 1), []
    for n in range(3000):
        at += timedelta(milliseconds=rng.choice([1, 500, 9_000, 20_000]))
        rows.append((f"{n:05d}", "hot", at, rng.random() < 0.8))
    rows += [(f"x{n}", f"k{n}", at, True) for n in range(50)]
    df = spark.createDataFrame(rows, "request_id string, key string, ts timestamp, ok boolean")
    got = {r.request_id: r.is_hit for r in R.repeat_hits(df, ttl=60, storable=F.col("ok")).collect()}
    stored, want, stores = None, {}, 0
    for i, k, t, ok in rows[:3000]:
        want[i] = stored is not None and (t - stored).total_seconds() < 60
        if not want[i] and ok:
            stored, stores = t, stores + 1
    assert {i: h for i, h in got.items() if not i.startswith("x")} == want and stores > 100
    plan = R.store_times(df.select("key", F.unix_millis("ts").alias("at"), F.col("request_id").alias("rank")))._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "ArrowEval" not in plan


def python_stream(chunks, mode, size):
    """Content that is scanned of one stream, as (content, ...) per scan."""
    if mode == "passthrough":
        return [c for c in chunks if c]
    if mode == "full":
        return ["".join(chunks)]
    buffer = ""
    for c in chunks:
        buffer += c
        if len(buffer) >= size:
            break
    return [buffer] if buffer else []


@pytest.mark.parametrize("mode", ["passthrough", "buffered", "full"])
def test_stream_table_against_sequential(spark, mode):
    rng = random.Random(2)
    streams = {f"s{s}": ["".join(rng.choice("ab 1") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 40))] for s in range(30)}
    streams["hot"] = ["xy"] * 900
    rows = [(s, i, f"data: {c}\n\n") for s, cs in streams.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "stream_id string, seq int, chunk string").repartition(7)
    got = scan_stream_table(df, LEAKS, mode, buffer_size=50).collect()
    want = sorted((s, len(t)) for s, cs in streams.items() for t in python_stream(cs, mode, 50))
    assert sorted((r.stream_id, r.scanned_length) for r in got) == want


def test_full_stream_too_large_is_reported(spark):
    df = spark.createDataFrame([("a", 0, "data: " + "x" * 50), ("b", 0, "data: ok")], "stream_id string, seq int, chunk string")
    got = {r.stream_id: (r.error_type, r.scanned_length) for r in scan_stream_table(df, LEAKS, "full", max_bytes=20).collect()}
    assert got == {"a": ("response_too_large", 50), "b": (None, 2)}


def test_rate_limit_against_sequential(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", start + timedelta(milliseconds=rng.choice([rng.randint(0, 3000), rng.randint(60000, 61000)]))) for i in range(2500)]
    df = spark.createDataFrame(rows, "event_id int, client string, ts timestamp")
    got = {r.event_id: r.decision for r in L.rate_limit(df, rate=100, burst=20).collect()}
    state, want = {}, {}
    for i, client, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(client, (20.0, ts))
        tokens = min(20.0, tokens + (ts - last).total_seconds() * 1000 * 100 / 1000)
        ok = tokens + 1e-9 >= 1
        want[i] = "allowed" if ok else "limited"
        state[client] = (tokens - ok, ts)
    assert got == want


def test_rate_limit_splits_a_client_that_never_idles(spark):
    """Two events a second at ten tokens a second: never idle for the two seconds that fill the
    bucket, but full again between most events, so slots are runs of their own."""
    ticks = spark.range(4000).selectExpr("'hot' as client", "id * 500 as at", "1L as n", "id * 500 div 2000 as slot")
    runs = L._runs(ticks, 2000, 10.0)
    assert runs.count() == 1000 and runs.select("run").distinct().count() > 900
    full = L._runs(ticks.withColumn("n", F.lit(6)), 2000, 10.0)  # more than is refilled
    assert full.select("run").distinct().count() == 1


@pytest.mark.parametrize("rate, burst, block_ticks", [(100, 20, 30), (3, 2, 7), (1.5, 3, 1), (0.7, 5, 300)])
def test_overloaded_clients_are_judged_in_blocks(spark, rate, burst, block_ticks):
    """Floods, pauses in which the bucket fills half or whole, and quiet times, in blocks of any length."""
    rng = random.Random(burst)
    rows, at = [], {"hot": 0, "b": 40, "quiet": 7}
    for i in range(3000):
        client = rng.choice(["hot", "hot", "b", "quiet"])
        at[client] += rng.choice([0, 1, 3, 9, 40, 200 if rng.random() < 0.1 else 1, int(burst * 1000 / rate) if rng.random() < 0.02 else 2])
        rows.append((i, client, datetime(1969, 12, 31, 23, 59, 58) + timedelta(milliseconds=at[client])))
    df = spark.createDataFrame(rows, "event_id int, client string, ts timestamp")
    got = {r.event_id: r.decision for r in L.rate_limit(df, rate=rate, burst=burst, block_ticks=block_ticks).collect()}
    state, want = {}, {}
    for i, client, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(client, (Fraction(burst), ts))
        tokens = min(Fraction(burst), tokens + Fraction(str(rate)) * ((ts - last) // timedelta(milliseconds=1)) / 1000)
        want[i] = "allowed" if tokens >= 1 else "limited"
        state[client] = (tokens - (tokens >= 1), ts)
    assert got == want and set(want.values()) == {"allowed", "limited"}


@pytest.mark.parametrize("rate, burst", [(100, 7), (3, 2), (1.5, 40), (0.31, 12), (2000, 3)])
def test_a_level_map_is_what_a_bucket_does_to_every_level(rate, burst):
    rng = random.Random(burst)
    unit, step, full = L._units(rate, burst)
    for _ in range(30):
        levels = L._LevelMap(50, rate, burst)
        ticks, at = [], 50
        for _ in range(rng.randint(1, 60)):
            ticks.append((at, rng.choice([1, 1, 2, burst - 1, burst, 5 * burst])))
            at += rng.choice([1, 2, 7, unit // step + 1, full // step // 3 + 1])
        for t, asked in ticks:
            levels.add(t, asked)
            assert len(levels.pieces) <= 8 * burst + 16
        first, last, *chain = levels.row()
        assert (first, last) == (50, ticks[-1][0])
        for start in {0, full, *(rng.randint(0, full) for _ in range(40)), *chain[0][0], *(max(0, x - 1) for x in chain[0][0])}:
            level, before = start, 50
            for t, asked in ticks:
                level, before = min(full, level + (t - before) * step), t
                level -= min(asked, level // unit) * unit
            assert level == L._level_after(*chain, start)


def test_one_overloaded_client_is_spread_over_tasks(spark):
    """Ten minutes of two events a millisecond at 100 a second: one run, ten blocks."""
    ticks = spark.range(600_000).selectExpr("'hot' as client", "0L as run", "id div 60000 as block", "id as at", "2L as n")
    spread = ticks.repartition(8, "client", "run", "block")
    assert spread.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    got = L._judged(ticks, 100, 200).agg(F.sum("allowed"), F.count("*")).first()
    assert tuple(got) == (200 + 599_999 // 10, 600_000)
    at = ticks.select("client", "at", "n", F.floor(F.col("at") / 2000).alias("slot"))
    runs = L._runs(at, 2000, 100, 200, 20_000).where("slot > 0")
    assert runs.agg(F.countDistinct("run"), F.countDistinct("block"), F.max("parts")).first()[:] == (1, 30, 1)
    assert L._runs(at, 2000, 100, 200, 500).where("slot > 0").agg(F.min("parts"), F.max("block")).first()[:] == (4, 299 * 4)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_bucket_does_not_depend_on_batches(size):
    rng = random.Random(size)
    at = sorted({rng.randint(0, 4000) for _ in range(300)})
    rows = pd.DataFrame({"client": "a", "run": [t // 1000 for t in at], "at": at, "n": [rng.randint(1, 4) for _ in at]})
    parts = [rows.iloc[i:i + size] for i in range(0, len(rows), size)]
    got = pd.concat(L._bucket(iter(parts), 20.0, 5))["allowed"].tolist()
    want, key = [], None
    for r in rows.itertuples():
        if r.run != key:
            key, last, tokens = r.run, r.at, 5.0
        tokens, last = min(5.0, tokens + (r.at - last) * 20 / 1000), r.at
        want.append(min(r.n, int(tokens + 1e-9)))
        tokens -= want[-1]
    assert got == want


def test_concurrency(spark):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a", t(0), t(10)), ("a", t(5), t(7)), ("a", t(10), t(12)), ("b", t(0), t(9000)), ("b", t(8000), t(8001))]
    df = spark.createDataFrame(rows, "client string, started_at timestamp, ended_at timestamp")
    got = {r.client: (r.max_open, r.over_limit) for r in L.concurrency(df, limit=2).collect()}
    assert got == {"a": (2, False), "b": (2, False)}
