"""Every query with SQL gives the same rows as DuckDB."""

import pytest

from skyledger.queries import ORACLES, QUERIES
from tests.conftest import SF


def plain(rows):
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted([tuple(number(v) for v in row) for row in rows], key=lambda row: tuple(map(str, row)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert plain(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == plain(tuple(r[k] for k in order) for r in want.fetchall())
