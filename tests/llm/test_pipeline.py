"""The corpus pipeline, each stage against a brute-force version on its own input."""

import collections

import corpus_pipeline
import pytest

from promptsieve.llm import simhash
from tests.llm.test_operators import contaminated, labelled, normal, prose


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark)
    rows = [(r.doc_id, r.text, "en", "s", len(r.text)) for r in docs.collect()]
    rows += [(1000 + i, prose(1, 60) + " " * i, "en", "s", 1) for i in range(5)]
    rows += [(2000, prose(900, 400), "en", "s", 1), (2001, prose(900, 400) + " end.", "en", "s", 1)]
    rows += [(3000, prose(901, 80), "en", "s", 1), (3001, prose(902, 900) + " " + prose(901, 14), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items = [(1, prose(901, 60)), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return folder, items, [df.collect() for df in out], [df.columns for df in out]


def test_stages(stages):
    _, items, (docs, good, exact, near, clean, packed), columns = stages
    assert all(c == columns[0] for c in columns[:-1])
    assert 250 < len(good) < len(docs)
    best = {}
    for r in good:
        rank = (-len(r.text), r.doc_id)
        best[normal(r.text)] = min(best.get(normal(r.text), rank), rank)
    assert {r.doc_id for r in exact} == {i for _, i in best.values()}
    fps = {r.doc_id: simhash.fingerprint(r.text.encode(), 4) for r in exact}
    root = {i: i for i in fps}
    for _ in range(6):
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id for r in near} == set(root.values()) and len(near) < len(exact)
    bad = {i for i, *_, dirty in contaminated([(r.doc_id, r.text) for r in near], items) if dirty}
    assert {r.doc_id for r in clean} == {r.doc_id for r in near} - bad and 3000 in bad and 3001 not in bad
    tokens = collections.Counter()
    for r in packed:
        tokens[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in tokens} == {r.doc_id for r in clean} and all(n == t for (_, t), n in tokens.items())


def test_near_stage_sends_no_key_rows_through_the_driver(spark, stages, monkeypatch):
    folder, _, _, _ = stages
    linked, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: linked.append(links) or components(links))
    corpus_pipeline.near_stage(spark, spark.read.parquet(f"{folder}/exact-dedup"), folder).count()
    assert len(linked) == 1 and "BroadcastHashJoin" not in linked[0]._jdf.queryExecution().executedPlan().toString()


def test_run(spark, stages):
    folder, _, out, _ = stages
    assert corpus_pipeline.run(spark, folder).count() == len(out[-1])
