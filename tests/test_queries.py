"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import importlib
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = [importlib.import_module(f"logweir.queries.{m}") for m in ("search", "analytics", "ingest")]
CASES = [(name, m) for m in MODULES for name in m.QUERIES]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 6))
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name,module", CASES, ids=[n for n, _ in CASES])
def test_query(spark, oracle, name, module):
    df = module.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in module.ORACLE:
        assert df.columns
        return
    found = oracle.execute(module.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, found.fetchall())
