"""Queries with SQL equal DuckDB on sf0.001; the others run over all rows."""

import pytest

from tests.conftest import SF_SMALL
from tickerlens.llm.queries import ORACLES, QUERIES
from tools.compare import digest


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(want)
    assert digest(rows, df.columns)[0] == digest(want, cols)[0]


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
