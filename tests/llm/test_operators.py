"""Operators of the training-data pipeline against brute-force versions on small fixtures."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptsieve.llm import (components, context_mixing, decontaminate, exact_dedup, packing, pii, quality, secrets,
                             simhash, toxicity, warc)

WORDS = "ember quill stone river cloud amber north field paper iron glass tower lemon cedar onyx raven".split()
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "One two  three\nfour five."), (6, "One two three\tfour five."),
    (7, "x" * 30_000), (8, "ä ö ü ß 日本語 😀 text"), (9, "dup"), (9, "dup"), (None, "without an id"), (None, None),
]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    words = [WORDS[i] + WORDS[j] for i, j in rng.integers(0, len(WORDS), (n, 2))]
    return " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(words))


def corpus() -> list[tuple]:
    rows = list(ODD)
    for i in range(100, 140):
        rows.append((i, prose(i, 30 + 7 * (i % 11))))
    rows += [(200 + i, prose(101, 90).replace("ember", "ember", 1) + (f" tail{i}" if i % 3 else "")) for i in range(12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns with names that operators use inside are there on purpose."""
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in corpus()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, fp string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("capacity", [None, 1])
def test_exact_dedup(docs, capacity):
    groups = collections.defaultdict(list)
    for i, t in corpus():
        groups[normal(t)].append((-len(t or ""), i is None, i or 0))
    want = []
    for i, t in corpus():
        own = groups[normal(t)]
        best = min(own)
        keep = None if best[1] else best[2]
        want.append((i, keep, len(own), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    assert plain(exact_dedup.exact_dedup(docs, capacity).collect()) == plain(want)


def test_exact_dedup_directory_doubles(docs, spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    buckets = exact_dedup.build_directory(keys, 20)
    lows = np.array([b for b, _ in buckets], np.uint64)
    assert len({d for _, d in buckets}) > 1 and lows[0] == 0
    assert sum((1 << 64) >> d for _, d in buckets) == 1 << 64
    hashes = np.array([r.hash for r in keys.collect()], np.int64).view(np.uint64)
    assert np.bincount(np.searchsorted(lows, hashes, "right") - 1).max() <= 20


def test_exact_dedup_compares_bytes_of_colliding_hashes(docs, monkeypatch):
    rows = [{"b": 0, "d": 0, "h": 5, "sha": s, "body": s.encode(), "n": 1, "c": 1, "i": k} for k, s in enumerate(["p", "q", "p"])]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist(rows)
    found = [r for b in exact_dedup._own(iter([batch])) for r in b.to_pylist()]
    assert [(r["chain"], r["text_sha256"], r["keep_id"], r["group_size"]) for r in found] == [(0, "p", 0, 2), (1, "q", 1, 1)]


def test_unique_documents(docs, empty):
    kept = exact_dedup.unique_documents(docs)
    assert kept.columns == docs.columns
    texts = [normal(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t in corpus()})
    assert exact_dedup.unique_documents(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    index = simhash.codeword_index(words)
    near = simhash._near(words, 23)
    assert (near == index[:, None]).any(1).all()
    assert set((near >= 0).sum(1)) <= {1, 6}
    for a in range(23):
        for b in range(a, 23):
            other = simhash._near(words ^ (1 << a) ^ (1 << b if b != a else 0), 23)
            shared = [bool(set(x[x >= 0]) & set(y[y >= 0])) for x, y in zip(near, other)]
            assert all(shared)


def test_simhash_links_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    found = set(base.tolist())
    for f in base.tolist():
        for n in range(1, 7):
            found.add(f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = np.array(sorted(found), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.fingerprint_links(df).collect()}
    signed = fps.view(np.int64).tolist()
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i)
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= simhash.DISTANCE}
    assert got == want and len(want) > 100


def test_simhash_key_rows_are_not_broadcast(spark):
    fps = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    links = simhash.fingerprint_links(fps)
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_near_duplicates(docs, empty):
    rows = corpus()
    fps = [simhash.fingerprint((t or "").encode(), 4) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = collections.defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g] += [] if i is None else [i]
    want = [(i, f"{f:016x}", min(least[g], default=None)) for (i, _), f, g in zip(rows, fps, group)]
    assert plain(simhash.near_duplicates(docs).collect()) == plain(want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_fingerprint_counts_repeated_shingles():
    import xxhash

    text = "A b c d a b c d a b"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k: k + 4]), 42) for k in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 4) == want and simhash.fingerprint(b" \n", 4) == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}


def contaminated(docs, items):
    def words(t):
        t = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(len(b), 13)
            for s in range(len(b) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p: p + n] == b[s: s + n]:
                        hit |= set(range(p, p + n))
                        found.add(item)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, docs, empty):
    rows = corpus()
    rows += [(300, prose(105, 40) + " " + prose(777, 60)), (301, "Tiny ITEM here"), (302, prose(778, 400) + " tiny item " + prose(110, 13))]
    more = docs.unionByName(spark.createDataFrame(rows[len(corpus()):], "doc_id long, text string"), allowMissingColumns=True)
    items = [(1, prose(105, 37)), (2, "tiny item"), (10, prose(110, 13)), (3, None), (4, ""), (2, "tiny item"), (11, "dup"), (12, prose(101, 70))]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, words string")
    got = decontaminate.contamination(more, bench).drop("key")
    assert plain(got.collect()) == plain(contaminated(rows, items))
    clean = decontaminate.clean_documents(more, bench)
    assert clean.columns == more.columns
    want = sum(not r[-1] for r in contaminated(rows, items))
    assert clean.count() == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(more, bench.limit(0)).where("contaminated").count() == 0


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    texts = collections.Counter((i, t or "") for i, t in corpus())
    for (i, t), n in texts.items():
        ids = reference.encode(t, add_special_tokens=False).ids + [1]
        want = np.array(ids, "<u4").tobytes()
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == i and r.doc_tokens == len(ids))
        if i is not None:
            assert len(b"".join(x for _, x in own)) == n * len(want)
            starts = sorted({s for s, _ in own})
            assert b"".join(dict(own)[s] for s in starts) == want
    for _, pieces in _by(rows, "sequence_id"):
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert sum(r.length for r in pieces) <= packing.LIMIT
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(empty, path).count() == 0


def _by(rows, name):
    found = collections.defaultdict(list)
    for r in rows:
        found[r[name]].append(r)
    return found.items()


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "x \ny", "x\n y", "x\n \ny", "it's  <|endoftext|> ok", "", " b  c", "12 3,4\t5"])
def test_encoding_equals_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(path).encode(text), "<u4").tolist() == want


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        position = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 12, 25))])).tolist()
        penalty = rng.choice([0.0, 2.0, 24.0], len(position)).tolist()
        limit = 32
        cost = [0.0] + [math.inf] * (len(position) - 1)
        for i in range(1, len(position)):
            for j in range(i):
                n = position[i] - position[j]
                if n <= limit:
                    pad = packing.OFF_SIZE if n in (limit // 2, limit // 4) and packing.OFF_SIZE < limit - n else limit - n
                    cost[i] = min(cost[i], cost[j] + pad + penalty[i])
        cuts = packing.best_cuts(position, penalty, limit)
        total = 0.0
        for a, b in zip(cuts, cuts[1:]):
            n = position[b] - position[a]
            total += (packing.OFF_SIZE if n in (limit // 2, limit // 4) and packing.OFF_SIZE < limit - n else limit - n) + penalty[b]
        assert total == pytest.approx(cost[-1])


def base_pii(s):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s)
              if 13 <= sum(map(str.isdigit, m[0])) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


PII = [
    "a@b.com.@c.d x@y@z.org", "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (262) 555-3752, +12, +1-2",
    "@x.y a@b a@b. a@-.-", "日本 x@y.de 😀 10.0.0.1", "", "+4930123456789012345678", "1" * 3000, "a" * 3000 + "@", ".".join(["1"] * 40),
]


@pytest.mark.parametrize("text", PII)
def test_pii_base_spans(text):
    base, _ = pii.spans(text)
    assert pii._joined(base) == base_pii(text)


@pytest.mark.parametrize("text, kind, hidden", [
    ("write to john [at] mail [dot] example [dot] com now", "email", "john [at] mail [dot] example [dot] com"),
    ("write jane at mail dot example dot org.", "email", "jane at mail dot example dot org"),
    ("ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ!", "email", "ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ"),
    ("j​ohn@exаmple.com", "email", "j​ohn@exаmple.com"),
    ("call plus one two six two five five five three seven five two ok", "phone", "plus one two six two five five five three seven five two"),
    ("host 10․10․1․2 up", "ip", "10․10․1․2"),
])
def test_pii_disguises_map_back(text, kind, hidden):
    base, added = pii.spans(text)
    assert [text[a:b] for a, b in added[kind] + base[kind] if text[a:b] == hidden] == [hidden]


@pytest.mark.parametrize("text", ["five, ſix", "fıve six", "fİve six", "FIVE ſIX"])
def test_pii_reads_letters_that_only_fold_to_ascii(text):
    call = f"call plus one two six two five five five three seven {text} ok"
    base, added = pii.spans(call)
    assert [call[a:b] for a, b in added["phone"]] == [call[5:-3]]


@pytest.mark.parametrize("text", ["He is at home. The dot is red.", "one of two at a time", "look at the dot here", "три слова"])
def test_pii_leaves_clean_text_alone(text):
    base, added = pii.spans(text)
    assert not any(base.values()) and not any(added.values())


def test_pii_long_texts_take_linear_time():
    """Digit runs and many addresses, plain and disguised, at a size where squares would show."""
    assert not any(pii.detect("7" * 300_000)["ip"])
    text = " ".join(f"u{i}@a.com v{i} [at] b [dot] com" for i in range(20_000))
    base, added = pii.spans(text)
    assert len(base["email"]) == len(added["email"]) == 20_000
    assert all(text[a:b] == f"v{i} [at] b [dot] com" for i, (a, b) in enumerate(added["email"]))


def test_pii_rows(docs, empty):
    got = {(r.doc_id, r.base_sha256) for r in pii.digests(pii.personal_data(docs)).collect()}
    assert got == {(i, hashlib.sha256(base_pii(t or "").encode()).hexdigest()) for i, t in corpus()}
    assert pii.personal_data(empty).count() == 0


def base_secrets(s):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, s) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


SECRETS = [
    "password:token:abcdefg PassWord = \"abcdef\" x", "日本 api_key='abc/def+=' token=secret=abcdefgh", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 10,
    "f" * 24 + " " + "0a" * 11, "token=abc", "", None, "abcdef" * 4 + "g", "secret=" + "d" * 30, "-----BEGIN RSA PRIVATE KEY-----",
]


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(SECRETS)] + [(50, SECRETS[0]), (50, SECRETS[0]), (None, SECRETS[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.base_spans) for r in secrets.secrets(df).collect()]
    assert plain(got) == plain((i, base_secrets(t or "")) for i, t in rows)
    spans = {r.doc_id: r.spans for r in secrets.secrets(df).collect()}
    assert spans[9] == "private_key:0:31"
    assert secrets.secrets(df.limit(0)).count() == 0


def test_secret_ledger_scans_only_what_is_new(spark):
    ledger = secrets.Ledger(spark)
    first = spark.createDataFrame([(1, SECRETS[0]), (2, "clean"), (3, SECRETS[0])], "path long, text string")
    ledger.commit(first, "1")
    assert ledger.scanned().count() == 2 * len(secrets.RULES)
    second = spark.createDataFrame([(1, "clean"), (2, SECRETS[2]), (4, SECRETS[0])], "path long, text string")
    ledger.commit(second, "2")
    assert ledger.scanned().count() == 3 * len(secrets.RULES)
    assert {r.path: r.base_spans for r in ledger.report("2").collect()} == {1: "", 2: base_secrets(SECRETS[2]), 4: base_secrets(SECRETS[0])}
    assert {r.path: r.base_spans for r in ledger.report("1").collect()} == {1: base_secrets(SECRETS[0]), 2: "", 3: base_secrets(SECRETS[0])}
    changed = tuple(secrets.Rule(r.kind, "clean", version="2") if r.kind == "hex" else r for r in secrets.RULES)
    ledger.commit(second, "3", changed)
    assert ledger.scanned().where("rule_version = '2'").count() == 3
    assert {r.path: r.n_hex for r in ledger.report("3", changed).collect()} == {1: 1, 2: 0, 4: 0}


PAGES = [
    (1, "http://www.b.example.com:80/x?q=1#f", "<p>one</p>\r\n\r\n"), (2, "https://a.example.com/", "<p>one</p>\r\n\r\n"),
    (3, None, None), (4, "not a url\n", ""), (5, "http://ü.example/ä b", "ünï"), (6, "http://b.example.com/x", "six"),
    (7, "http://b.example.com/x", "six"), (7, "http://b.example.com/x", "six"), (None, "http://c/", "six"), (8, "http://[bad", "y" * 100_000),
]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, file string")
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        body, keep = (h or "").encode(), best[h or ""]
        want.append((i, len(body), warc.digest_of(body), "response" if i == keep else "revisit", None if i == keep else keep))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captured(df).collect()]
    assert plain(got) == plain(want)
    assert warc.captured(df.limit(0)).count() == 0


def test_warc_records_and_keys():
    record = warc.record_bytes(5, "http://x/ä b", b"a\r\n\r\nb", None, False)
    assert warc.parsed(record) == (5, "http://x/ä b", "response", None, warc.digest_of(b"a\r\n\r\nb"), b"a\r\n\r\nb")
    assert warc.url_key("https://www.Blog.example.com:443/a?b=c#d") == "com,example,blog)/a?b=c"
    assert warc.url_key("http://h:8080") == "h:8080)/" and warc.url_key(None) == ""


def test_lm_base_scores_and_probabilities(docs, empty):
    def tokens(t):
        return (t or "").encode().lower().split() + [b"\n"]

    count = collections.Counter()
    for i, t in corpus():
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for i, t in corpus():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        away = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        want[(i, away, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    rows = context_mixing.scores(docs).collect()
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in rows)
    assert context_mixing.scores(empty).count() == 0
    large = docs.limit(20).withColumn("doc_id", F.when(F.col("doc_id") != 9, F.col("doc_id") + ((1 << 60) + 1)))
    assert {r.doc_id for r in context_mixing.scores(large).collect()} == {r.doc_id for r in large.collect()}


def test_lm_is_a_distribution():
    """The bits' probabilities of all next bytes sum to one, and beginnings are counted exactly."""
    tokens = sorted([b"abcde", b"abcdf", b"abcdx", b"abd", b"zzz"])
    counts = np.array([3.0, 2, 0, 5, 1])
    e = context_mixing.Events(tokens, counts)
    at = int(e.first[tokens.index(b"abcde")]) + 4
    assert e.alike[0, at] == 5 and e.same[7, at] == 3
    model = context_mixing.Model([np.zeros(1 << s, np.float32) for s in context_mixing.SLOTS],
                                 np.tile(np.float32([0.1] * 5 + [0.7, 0.1]), (context_mixing.GATES, 1)),
                                 np.zeros(256 * context_mixing.STEPS), np.zeros(256 * context_mixing.STEPS))
    every = [bytes([c]) for c in range(256)]
    prefix = context_mixing.Events(every, np.zeros(256))
    total = np.zeros(len(prefix.byte))
    for b, node, bit, slots, n0, n1 in prefix.bits():
        z = np.full(len(node), 0.1, np.float32)
        p = model.refine(node, z)
        total += np.log10(np.where(bit == 1, p, 1 - p))
    assert (10 ** total[prefix.first]).sum() == pytest.approx(1, rel=1e-5)


def test_lm_contexts_of_the_text():
    """Counts of the text's own contexts against a walk over it; both forms of the sort."""
    rng = np.random.default_rng(5)
    lengths = np.array([1, 60, 3, 200, 1, 1])
    ids = rng.integers(0, 6, lengths.sum()).astype(np.uint32)
    want = []
    for order in range(context_mixing.ORDERS):
        rows, at = [], 0
        for n in lengths:
            after = collections.defaultdict(collections.Counter)
            for i in range(n):
                if i >= order:
                    c = after[tuple(ids[at + i - order: at + i])]
                    if c:
                        times = c.total()
                        level = sum(times >= x for x in context_mixing.TIMES)
                        ratio = (len(c) - 0.5) / times
                        gate = level * (len(context_mixing.FOLLOWERS) + 1) + sum(ratio > x for x in context_mixing.FOLLOWERS)
                        rows.append((at + i, c[ids[at + i]] / times, gate))
                    c[ids[at + i]] += 1
            at += n
        want.append(rows)
    for numbers in (ids, ids + (1 << 24)):
        got = context_mixing.own_contexts(lengths, numbers)
        assert [[tuple(x) for x in zip(*(c.tolist() for c in g))] for g in got] == want
    assert (context_mixing.unpacked(context_mixing.packed(ids << 7)) == ids << 7).all()


def test_lm_text_mixture_adds_up_to_one():
    """Over all next tokens of a text; learning raises the probability of a repeating text."""
    alone = np.log(np.array([0.1, 0.2, 0.3, 0.25, 0.15]))
    text = [0, 1, 2, 0, 1, 3, 0, 1]
    weight = context_mixing.first_weights()
    total = 0
    for x in range(5):
        ids = np.array([*text, x], np.uint32)
        total += np.exp(context_mixing.mix_in_text(alone[ids], context_mixing.own_contexts(np.array([9]), ids), weight)[-1])
    assert total == pytest.approx(1)
    ids = np.array([0, 1, 2, 3] * 30, np.uint32)
    contexts = context_mixing.own_contexts(np.array([120]), ids)
    before = context_mixing.mix_in_text(alone[ids], contexts, weight).sum()
    for _ in range(5):
        context_mixing.mix_in_text(alone[ids], contexts, weight, learn=True)
    assert context_mixing.mix_in_text(alone[ids], contexts, weight).sum() > before


def test_lm_corpus_contexts_are_exact():
    """Shares of one and two earlier tokens in other texts, with and without the own occurrence."""
    lengths, ids = np.array([4, 4, 3]), np.array([0, 1, 2, 3, 0, 1, 4, 3, 1, 4, 3], np.uint32)
    words = ["a", "b", "c", "\n", "d"]
    keys, later = context_mixing._grams(words, lengths, ids)
    n = collections.Counter(keys.tolist())
    total = np.array([n[k] for k in keys.tolist()])
    pairs, triples = total[:11], np.zeros(11, np.int64)
    triples[later] = total[11:]
    counts = np.bincount(ids)
    one, two = context_mixing.corpus_contexts(lengths, ids, counts, pairs, triples)
    assert dict(zip(one[0].tolist(), one[1].tolist())) == pytest.approx(
        {0: 2 / 3, 1: 1, 2: 1 / 3, 3: 1, 4: 2 / 3, 5: 1, 6: 2 / 3, 7: 1, 8: 1 / 3, 9: 2 / 3, 10: 1})
    assert dict(zip(two[0].tolist(), two[1].tolist())) == pytest.approx({1: 1, 2: 0.5, 3: 1, 5: 1, 6: 0.5, 7: 1, 9: 1, 10: 1})
    one, two = context_mixing.corpus_contexts(lengths, ids, counts, pairs, triples, 1)
    assert dict(zip(one[0].tolist(), one[1].tolist())) == pytest.approx(
        {0: 0.5, 1: 1, 2: 0, 4: 0.5, 5: 1, 6: 0.5, 7: 1, 8: 0, 9: 0.5, 10: 1})
    assert dict(zip(two[0].tolist(), two[1].tolist())) == pytest.approx({1: 1, 2: 0, 5: 1, 6: 0, 7: 1, 10: 1})


def test_lm_learns_word_order_from_other_texts(spark):
    """Held-out texts with the same tokens: those in the order of the training texts score higher."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in WORDS for b in WORDS[:8]]
    after = {w: [words[k] for k in rng.integers(0, len(words), 2)] for w in words}
    rows, shuffled = [], {}
    for i in range(600):
        text = [words[rng.integers(len(words))]]
        while len(text) < 60:
            text.append(after[text[-1]][rng.integers(2)])
        rows.append((i, " ".join(text)))
        if zlib.crc32(str(i).encode()) % 5 == 1:
            while zlib.crc32(str(k := int(rng.integers(1000, 1 << 40))).encode()) % 5 != 1 or k in shuffled.values():
                pass
            shuffled[i] = k
            rows.append((k, " ".join(rng.permutation(text))))
    got = {r.doc_id: r for r in context_mixing.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(shuffled) > 50 and len(got) == len(rows)
    better = sum(got[i].score > got[k].score + 5 for i, k in shuffled.items())
    above = sum(got[i].score > got[i].base_score for i in shuffled)
    assert better > 0.95 * len(shuffled) and above > 0.95 * len(shuffled)


def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 1
        text = prose(i, 60)
        if bad:
            text = ("JUNK!! " * 40 + text[:50]).upper()
        if toxic:
            text += f" you moronic{i % 7} thing"
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("run, column, folds, held", [(quality.quality, "quality", 5, 0), (toxicity.toxicity, "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, run, column, folds, held):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame(ODD, "doc_id long, text string").where("doc_id is null or doc_id < 4").withColumn("doc_id", F.col("doc_id") + 1000)
    rows = {r.doc_id: r for r in run(docs.union(odd), labels).collect()}
    truth = {r.doc_id: r[column] for r in labels.collect()}
    away = [i for i in truth if zlib.crc32(str(i).encode()) % folds == held]
    assert all(rows[i].held_out == (i in away) for i in truth)
    assert np.mean([rows[i].predicted == truth[i] for i in away]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert run(docs.limit(0), labels).count() == 0
    assert {r.score for r in run(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    model = quality.fit(quality.Sparse(np.array([0]), np.zeros(0, np.int32), np.zeros(0, np.float32)), np.zeros((0, 16), np.float32), np.zeros(0))
    size = len(model.linear)
    model.factors = rng.standard_normal((size, 6)).astype(np.float32)
    model.linear = rng.standard_normal(size).astype(np.float32)
    index, value = np.array([3, 70, 900, 5]), rng.standard_normal(4).astype(np.float32)
    x = quality.Sparse(np.array([0, 3, 3, 4]), index.astype(np.int32), value)
    pairs = sum(float(model.factors[index[a]] @ model.factors[index[b]]) * value[a] * value[b] for a in range(3) for b in range(a))
    want = [model.bias + model.linear[index[:3]] @ value[:3] + pairs, model.bias, model.bias + model.linear[5] * value[3]]
    assert model.margins(x)[0] == pytest.approx(want, abs=1e-4)


def test_good_documents_keep_columns(spark):
    docs, labels = labelled(spark)
    kept = quality.good_documents(docs.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & bad) < 5 and len(ids) > 290


def test_counterfactual_penalty_lowers_identity_weights():
    assert toxicity.counterfactuals("Some women sing. Nothing here.") == [("Some women sing", "Some men sing")]
    rng = np.random.default_rng(4)
    rows = [np.unique(np.append(rng.integers(10, 60, 8), 1 if i % 2 else [])).astype(np.int32) for i in range(400)]
    label = np.array([float(i % 2 and rng.random() < 0.8) for i in range(400)])
    a, b = np.array([1], np.int32), np.array([2], np.int32)
    free, held = toxicity.fit(rows, label, []), toxicity.fit(rows, label, [(a, b)] * 50)
    assert abs(held[1] - held[2]) < 0.5 * abs(free[1] - free[2])


def test_counterfactuals_of_letters_that_only_fold_to_ascii():
    """Every letter that IGNORECASE takes for one of a term's."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for letter in sorted(set("".join(toxicity.OTHER))):
        term = next(t for t in toxicity.OTHER if letter in t)
        for c in re.findall(re.escape(letter), every, re.IGNORECASE):
            text = term.replace(letter, c, 1)
            assert toxicity.counterfactuals(text) == [(text, toxicity.OTHER[term])]
    assert toxicity.counterfactuals("The muſlims and gırls") == [("The muſlims and gırls", "The christians and boys")]


@pytest.mark.parametrize("text, hidden", [
    ("j [@] example.com x", "j [@] example.com"), ("to j@example[.]com!", "j@example[.]com"), ("a.b (AT) c ( dot ) de", "a.b (AT) c ( dot ) de"),
    ("x at y at jane at mail dot org", "jane at mail dot org"), ("j@mail dot anything", "j@mail dot anything"),
])
def test_pii_reads_brackets_and_spelled_dots(text, hidden):
    base, added = pii.spans(text)
    assert [text[a:b] for a, b in added["email"]] == [hidden]


@pytest.mark.parametrize("text", ["jane at example.com", "jane AT example.com", "look at this. Dot the i", "he sat at a dot", "at [dot] at"])
def test_pii_bare_at_needs_a_spelled_dot_whatever_else_is_there(text):
    for more in (text, text + " and x [dot] y", "x [.] y " + text):
        base, added = pii.spans(more)
        assert not added["email"] and not base["email"]


def test_pii_long_disguises_take_linear_time():
    import time

    began = time.time()
    for text in ("a dot " * 100_000, "a [dot] b " * 60_000 + "[at]", " " * 300_000 + "dot x", "[" * 100_000 + " dot ", "a at b " * 60_000 + " [at] "):
        base, added = pii.spans(text)
        assert not added["email"]
    chain = "a dot " * 100_000 + "a at b dot com"
    assert pii.spans(chain)[1]["email"] == [(0, len(chain))]
    assert time.time() - began < 20


def clashing(spark):
    """Columns with the names that the stages use inside, and rows without an id or with one id."""
    texts = [(1, "same text here for all of us"), (2, "same text here for all of us"), (2, "x y z"), (None, "same text here for all of us"),
             (None, "another one without an id"), (None, "another one without an id"), (None, "third"), (7, None), (7, ""), (8, prose(7, 90))]
    rows = [(i, t, f"k{n}", f"_{n}", f"sha{n}", n, f"row{n}", n) for n, (i, t) in enumerate(texts)]
    return rows, spark.createDataFrame(
        rows, "doc_id long, text string, key string, _key string, text_sha256 string, fp long, row string, root long")


@pytest.mark.parametrize("stage", ["exact", "near", "benchmark", "quality"])
def test_stages_keep_rows_as_they_are(spark, stage):
    rows, docs = clashing(spark)
    if stage == "exact":
        got = exact_dedup.unique_documents(docs)
    elif stage == "near":
        got = simhash.representatives(docs)
    elif stage == "benchmark":
        got = decontaminate.clean_documents(docs, spark.createDataFrame([(1, prose(7, 40))], "item_id long, text string"))
    else:
        labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (8, 0, 1), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
        got = quality.good_documents(docs, labels)
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    left = [tuple(r) for r in got.collect()]
    assert set(left) <= set(rows) and len(left) == len(set(left))
    if stage == "exact":
        assert collections.Counter(normal(r[1]) for r in left) == collections.Counter({normal(t) for _, t, *_ in rows})
    if stage == "near":
        root = {simhash.fingerprint((t or "").encode(), 4) for _, t, *_ in rows}
        assert len(left) == len(root) and {r[0] for r in left if "same" in (r[1] or "")} == {1}
        assert sorted(r[1] or "" for r in left if r[0] is None) == ["another one without an id", "third"]
    if stage == "benchmark":
        assert len(left) == len(rows) - 1 and all(r[0] != 8 for r in left)


def test_classifiers_with_repeated_and_missing_labels(spark):
    """Extra columns named like the results, repeated ids and labels, and a label that is NULL."""
    docs, labels = labelled(spark)
    more = docs.withColumn("label", F.lit("x")).withColumn("score", F.lit(9)).union(docs.limit(3).withColumn("label", F.lit("y")).withColumn("score", F.lit(1)))
    odd = labels.union(labels.limit(5)).union(spark.createDataFrame([(None, None, None), (1, None, None)], labels.schema))
    for judge in (lambda: quality.quality(more, odd), lambda: toxicity.toxicity(more, odd)):
        got = judge().collect()
        assert len(got) == more.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_secrets_of_long_texts(spark):
    """Many secrets in one text, long credentials, and long runs that patterns could be slow on."""
    import time

    many = "x token=abcdef1 " * 100_000
    long = "https://oauth2:" + "t" * 300 + "@host a://b:c@d -----BEGIN " + "A " * 40 + "PRIVATE KEY-----"
    runs = "a" * 200_000 + " " + "a://" * 50_000 + " password" + " " * 100_000 + "-----BEGIN " + "A" * 100_000 + " @"
    rows = [(1, many, "k"), (2, long, "k"), (3, runs, "k"), (4, many, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    secrets.secrets(docs.where("doc_id = 2")).collect()
    began = time.time()
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert time.time() - began < 20
    assert got[1].n_assign == got[4].n_assign == 100_000 and got[1].base_spans == base_secrets(many)
    assert got[2].spans == f"url_login:0:316,url_login:321:329,private_key:331:{len(long)}"
    assert got[3].spans == base_secrets(runs)


def mixer_by_hand(model, tokens, counts):
    """log10 probability of each token, bit by bit, with beginnings counted by a walk over all tokens."""
    whole = (1 << 64) - 1

    def spread(h):
        for _ in range(2):
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & whole
        return h ^ (h >> 32)

    streams = [t if t == b"\n" else t + b" " for t in tokens]
    bits = ["".join(f"{c:08b}" for c in s) for s in streams]
    for own, stream in zip(bits, streams):
        total = 0.0
        for place, byte in enumerate(stream):
            node = 1
            for b in range(8):
                at = 8 * place + b
                alike = [(other[at], c) for other, c in zip(bits, counts) if other[:at] == own[:at] and len(other) > at]
                n0, n1 = (sum(c for x, c in alike if x == v) if place >= context_mixing.PREFIX else 0 for v in "01")
                gate = sum(n0 + n1 >= x for x in context_mixing.LEVELS) * 64 + min(place, 7) * 8 + b
                weight = model.weight[gate]
                z = weight[-1] + weight[-2] * math.log((n1 + context_mixing.PRIOR) / (n0 + context_mixing.PRIOR))
                context, slot = 0, 0
                for k in range(1, max(context_mixing.BYTES) + 1):
                    context = (context * 257 + (stream[place - k] + 1 if place >= k else 0)) & whole
                    if k in context_mixing.BYTES:
                        h = (spread((context + (k << 60)) & whole) + node * int(context_mixing.NODE)) & whole
                        z += weight[slot] * model.odds[slot][h >> (64 - context_mixing.SLOTS[slot])]
                        slot += 1
                z = min(12.0, max(-12.0, z))
                p = 1 / (1 + math.exp(-z))
                step = node * context_mixing.STEPS + min(context_mixing.STEPS - 1, max(0, round((z + 12) * (context_mixing.STEPS - 1) / 24)))
                p = (p + (model.ones[step] + 2 * p) / (model.total[step] + 2)) / 2
                bit = byte >> (7 - b) & 1
                total += math.log10(min(1 - 1e-6, max(1e-6, p if bit else 1 - p)))
                node = 2 * node + bit
        yield total


def test_lm_mixer_against_a_mixer_by_hand():
    rng = np.random.default_rng(11)
    tokens = sorted({b"\n", b"a", b"abc", b"abcd", b"abcde", b"abcdf", b"abce", b"b" * 12, b"b" * 14, "übel".encode(), "übung".encode(), b"zzz"})
    counts = rng.integers(0, 2000, len(tokens)).astype(float)
    seen = rng.integers(0, 50, 256 * context_mixing.STEPS).astype(float)
    model = context_mixing.Model(
        [rng.normal(0, 1, 1 << s).astype(np.float32) for s in context_mixing.SLOTS],
        rng.normal(0.2, 0.2, (context_mixing.GATES, len(context_mixing.SLOTS) + 2)).astype(np.float32), seen * rng.random(len(seen)), seen)
    assert model.costs(tokens, counts).tolist() == pytest.approx(list(mixer_by_hand(model, tokens, counts)), rel=1e-4)
