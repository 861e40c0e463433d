from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusgraph.plans.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows against its SQL."""

    def check(query, sql: str) -> None:
        df = query(spark, DATA)
        got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(df.columns) == sorted(names)
        assert got == sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())

    return check
