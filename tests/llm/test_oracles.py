"""Corpus queries with SQL give the same rows as DuckDB."""

import pytest

from skyledger.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, (tuple(r[k] for k in order) for r in want.fetchall())))
