"""URL trust, hard negatives and periodic runs against brute-force versions."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from promptsieve.llm import hard_negatives, link_trust, periods, queries


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# Runs

def runs_by_force(words, least=24):
    """(start, end, period): for every period all maximal stretches, each with its least period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        agree = [a == b for a, b in zip(words, words[q:])] + [False]
        begin = None
        for i, same in enumerate(agree):
            if same and begin is None:
                begin = i
            elif not same and begin is not None:
                if i + q - begin >= max(least, 3 * q):
                    found.setdefault((begin, i + q), q)
                begin = None
    return sorted((s, e, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def sequences():
    rng = np.random.default_rng(8)
    yield from ([], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab" * 12), list("ab" * 11 + "a"), list("abc" * 40 + "x" + "abc" * 40))
    yield fibonacci(700)
    yield [str(i.bit_count() % 2) for i in range(512)]
    for size in (1, 2, 3, 30):
        for n in (40, 150, 400):
            yield [f"w{i}" for i in rng.integers(0, size, n)]
    for _ in range(60):
        words = []
        while len(words) < 300:
            unit = [f"w{i}" for i in rng.integers(0, 4, rng.integers(1, 30))]
            words += unit * int(rng.integers(1, 7)) + unit[: rng.integers(0, len(unit))]
            if rng.random() < 0.4:
                words = words * 2
        yield words[:900]


@pytest.mark.parametrize("together", [False, True])
def test_runs_equal_brute_force(together):
    texts = [[w.encode() for w in words] for words in sequences()]
    want = [runs_by_force(words) for words in texts]
    assert sum(map(len, want)) > 100
    groups = [texts] if together else [[t] for t in texts]
    got = []
    for group in groups:
        ids, first = periods.numbered(group)
        runs = periods.runs_of(ids, first)
        for a, b in itertools.pairwise(first.tolist()):
            got.append(sorted((s - a, e - a, q) for s, e, q in runs.tolist() if a <= s < b))
    assert got == want


def test_runs_survive_wrong_hashes(monkeypatch):
    """Hashes that call everything the same lead to the comparison of words."""
    monkeypatch.setattr(periods._Hashes, "same", lambda self, i, p, size: np.ones(len(i), bool))
    words = [b"x"] * 5 + [b"a", b"b", b"c"] * 12 + [b"y"] * 30 + [b"z"]
    ids, first = periods.numbered([words])
    assert sorted(map(tuple, periods.runs_of(ids, first).tolist())) == runs_by_force(words)


def test_grammar_derives_the_text():
    rng = np.random.default_rng(4)
    words = [str(i).encode() for i in np.tile(rng.integers(0, 9, 50), 20)]
    ids, _ = periods.numbered([words])
    rules, at = periods.grammar(ids, 2)
    assert len(at) < len(ids) / 5
    texts = collections.defaultdict(set)
    for rule, start, middle, end in rules.tolist():
        texts[rule].add((tuple(ids[start:middle]), tuple(ids[middle:end])))
    assert all(len(t) == 1 for t in texts.values())


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "Ab ab " * 20), (5, "Ab ab " * 20), (None, "ä " * 30 + "日本語 😀"), (None, None),
       (6, "one\ttwo\x0bthree\n" * 9 + "end"), (7, "x" * 30_000), (8, "p q r " * 30_000), (9, "a a " * 30)]


def digests_by_force(rows, rewrite=None):
    for doc_id, text in rows:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        if rewrite:
            words = rewrite(doc_id, words)
        runs = sorted(runs_by_force(words) if len(words) < 3000 else [(0, len(words), 3)], key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
        dropped = {i for s, e, q in runs for i in range(s + q, e)}
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        figures = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        yield (doc_id, len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_rows(spark):
    docs = spark.createDataFrame([(i, t, 0, "r") for i, t in ODD], "doc_id long, text string, start long, runs string")
    got = periods.digests(periods.periodic_runs(docs)).collect()
    assert plain(got) == plain(digests_by_force(ODD)) and sum(r.n_runs for r in got) == 6
    collapsed = {r.doc_id: r.collapsed for r in periods.periodic_runs(docs).collect()}
    assert collapsed[5] == "Ab ab" and collapsed[6] == "one two three end" and collapsed[8] == "p q r" and collapsed[1] == ""
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(docs, 5)


def test_query_repeats_every_tenth_text(spark):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(40 + i))) for i in range(150)] + [(None, "a b c"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def rewrite(doc_id, words):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 or not words:
            return words
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]

    got = periods.digests(periods.periodic_runs(docs, rewrite=queries.repeating)).collect()
    assert plain(got) == plain(digests_by_force(rows, rewrite)) and sum(r.n_runs for r in got) > 5


# URL trust

PAGES = [
    (1, "https://WWW.Example.COM/en/a?x#y", '<a href="http://good.org/x">'), (2, "http://a.example.com/en/", "<a HREF='//Bad.net/'>"),
    (3, "http://com/x", None), (4, "http://xcom/x", ""), (5, "ftp://a.com", "<img src=https://good.org>"), (6, None, '<a href="http://good.org">'),
    (7, "no scheme", "<a href=http://bad.net>"), (8, "http://bad.net/es/1", '<a href="http://bad.net/es/2"><a href="http://tail.org/">'),
    (9, "http://bad.net/en/1", "x"), (10, "http://good.org/1", '<a href = "https://far.org:80/p">'), (11, "http://far.org:80/1", None),
    (12, "http://shady.org/1", '<a href="http://bad.net/1"><a href="http://bad.net/2"><a href="http://good.org">'),
    (13, "http://deeper.org/1", '<a href="http://shady.org/">'), (14, "http://tail.org/a b\nc", None), (15, "https://b.com/?q=http://x", "<a href=/local>"),
    (15, "https://b.com/?q=http://x", "<a href=/local>"), (None, "http://b.com/#f", None), (16, "://empty/es/", None), (17, "http:///es/", None),
    (18, "http://example.com/en/" + "z" * 50_000, "<p>" * 50_000 + "<a href='http://good.org/'>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "h", "t") for p in PAGES], "page_id long, url string, html string, host string, trust string")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def verdicts_by_force(rows):
    def place(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        return lower(host), re.match(r"[^?#]*", rest[len(host):])[0]

    def rule_of(host, path):
        fit = [(len(h + p), h + p, v) for h, p, v in link_trust.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    links, start = collections.Counter(), {"allow": collections.Counter(), "block": collections.Counter()}
    for _, url, html in rows:
        host, path = place(url)
        verdict = rule_of(host, path)[1]
        if verdict:
            start[verdict][host] += 1
        for target in re.findall(link_trust.LINK, html or ""):
            if host and lower(target) != host:
                links[host, lower(target)] += 1
    flows = {}
    for verdict, arcs in (("allow", links), ("block", {(b, a): n for (a, b), n in links.items()})):
        whole = collections.Counter()
        for (a, _), n in arcs.items():
            whole[a] += n
        total = max(1, sum(start[verdict].values()))
        base = {h: link_trust.UNIT * n // total for h, n in start[verdict].items()}
        state = dict(base)
        for _ in range(link_trust.ROUNDS):
            came = collections.Counter()
            for (a, b), n in arcs.items():
                came[b] += state.get(a, 0) * n // whole[a]
            state = {h: (15 * base.get(h, 0) + 85 * came[h]) // 100 for h in base.keys() | came.keys()}
        flows[verdict] = state
    for page_id, url, _ in rows:
        host, path = place(url)
        rule, verdict = rule_of(host, path)
        yield page_id, host, path, rule, verdict or ("block" if flows["block"].get(host, 0) > flows["allow"].get(host, 0) else "allow")


def test_url_verdicts(spark, pages):
    got = plain(link_trust.verdicts(pages).collect())
    assert got == plain(verdicts_by_force(PAGES))
    verdict = {r[0]: r[4] for r in got}
    assert verdict[9] == verdict[12] == verdict[13] == "block" and verdict[10] == verdict[11] == verdict[14] == "allow"
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert plain(con.execute(link_trust.SQL).fetchall()) == got
    assert link_trust.verdicts(pages.limit(0)).count() == 0


def test_trust_spreads_over_a_ring(spark):
    """A cycle has no end to stop at: all rounds are used, and shares add up to what is left."""
    links = spark.createDataFrame([(f"h{i}", f"h{(i + 1) % 5}", 1 + i) for i in range(5)], "source string, target string, links long")
    start = spark.createDataFrame([("h0", link_trust.UNIT, 0), ("h3", 0, link_trust.UNIT)], "host string, trust long, distrust long")
    state = {r.host: (r.trust, r.distrust) for r in link_trust.propagated(links, start).collect()}
    assert len(state) == 5 and state["h0"][0] > state["h1"][0] > state["h4"][0] and state["h3"][1] > state["h2"][1] > state["h4"][1]
    assert all(abs(sum(column) - link_trust.UNIT) < 1000 for column in zip(*state.values()))


# Hard negatives

def negatives_by_force(rows):
    rows = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, l, v in rows
            if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    for a, label, va in rows:
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in rows if i != a]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for ps, p, _ in [r for r in scored if r[2] == label][:5]:
            inside = [r for r in scored if r[2] != label and 50 * ps <= 100 * r[0] <= 95 * ps][:3]
            for rank, (ns, n, _) in enumerate(inside, 1):
                yield a, p, rank, n, ps, ns


def vectors(seed, n=320, width=9):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 4))
        v = (rng.normal(0, 1, width) + label * 0.7).astype(np.float32)
        rows.append((i, label, v.tolist()))
    rows += [(1000 + k, k % 3, rows[50][2]) for k in range(30)]
    rows += [(2000, None, [1.0] * width), (2001, 1, None), (2050, 1, [1.0, None]), (2100, 1, [float("nan")] * width), (2150, 2, [float("inf")]),
             (2200, 0, [1.0, 2.0]), (2250, 3, []), (None, 0, [0.5] * width), (2300, 2, [0.0] * width), rows[100], rows[7],
             (2350, 1, [-1.5] * width), (2400, 77, [1.0] * width)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 0) for i, l, v in rows], "vec_id long, embedding array<float>, label int, slab int")


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, seed, monkeypatch):
    rows = vectors(seed)
    want = plain(negatives_by_force(rows))
    assert len(want) > 60
    assert plain(hard_negatives.hard_negatives(frame(spark, rows).repartition(5)).collect()) == want
    for name, small in (("SLAB_ROWS", 40), ("BLOCK_ANCHORS", 3), ("TILE", 16), ("WIDTH", 4)):
        monkeypatch.setattr(hard_negatives, name, small)
    assert plain(hard_negatives.hard_negatives(frame(spark, rows)).collect()) == want


def test_query_moves_labels(spark):
    rows = vectors(3)
    moved = [(i, (l + 1) % 10 if i is not None and i % 7 == 0 and l is not None else l, v) for i, l, v in rows]
    got = hard_negatives.hard_negatives(queries.relabelled(frame(spark, rows)))
    assert plain(got.collect()) == plain(negatives_by_force(moved))


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(frame(spark, vectors(1)).limit(0)).count() == 0
    assert hard_negatives.hard_negatives(frame(spark, [(1, 0, [1.0]), (2, 1, [1.0])])).count() == 0
    with pytest.raises(ArithmeticError):
        hard_negatives.hard_negatives(frame(spark, [(50, 0, [1e30])]))


@pytest.mark.parametrize("most, width", [(1, 3), (300, 700), (10**6, 5), (2**28, 40)])
def test_products_are_exact(most, width):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-most, most + 1, (12, width)) for _ in range(2))
    a[0], b[0], b[1] = most, most, -most
    bound = most * most * width
    mods = hard_negatives.moduli(bound)
    got = hard_negatives.products(hard_negatives.remainders(a, mods), hard_negatives.remainders(b, mods), mods)
    assert (got == a @ b.T).all() and np.prod([float(p) for p in mods]) > 2 * bound
