"""Every registered query against its DuckDB oracle at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    order = [ocols.index(c) for c in df.columns]
    want = _norm([tuple(r[i] for i in order) for r in res.fetchall()])
    got = _norm([tuple(r) for r in df.collect()])
    assert got == want


def test_every_query_has_rows_or_oracle(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert E.entry(spark).count() > 0
