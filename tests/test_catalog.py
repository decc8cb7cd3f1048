"""Every registered query against its SQL in DuckDB, over whole tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from promptsieve.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 9)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert got == want


def test_entry_and_coverage(spark):
    assert entry.entry(spark).count() > 0
    unchecked = {n for n, (_, sql) in catalog.entries().items() if sql is None}
    assert unchecked <= {"det_classify"}


def test_classifier_scores_every_document(spark, duck):
    rows = entry.queries()["det_classify"](spark, SF_DIR).collect()
    want = duck.sql("select doc_id, case when l.doc_id is null then null when l.toxic = 1 then 'toxic_content' else 'safe' end "
                    "from documents d left join labels l using (doc_id)").fetchall()
    assert sorted(((r.doc_id, r.label) for r in rows), key=repr) == sorted(want, key=repr)
    assert {r.held_out for r in rows} == {True, False} and {r.n for r in rows} <= {0, 1}
