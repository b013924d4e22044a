import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if v != v else round(float(v), 5)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(plain(v) for v in r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = [tuple(plain(row[i]) for i in at) for row in r.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_needs_the_llm_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("corvane.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("corvane.llm") or n == "corpus_pipeline" else real(n, *a))
    assert set(entry.queries()) == set(OWN) and not any(m.startswith("corvane.llm") for m in sys.modules)
