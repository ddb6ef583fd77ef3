"""Every query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import pytest

from cairn.plans import queries as q
from tests.compare import ordered, rows_of, sql_rows

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", q.NAMES)
def test_query(spark, small, name):
    cols, got = rows_of(q.queries()[name](spark, small))
    if name not in SQL:
        assert cols
        return
    want_cols, want = sql_rows(small, SQL[name])
    assert cols == want_cols
    assert ordered(got) == ordered(want)
