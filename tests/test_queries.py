"""Every registered query of the engine gives the rows of its SQL."""

import pytest
from conftest import plain, rows

from quillstack import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, data, duck, name):
    found = queries.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    got = rows(found, columns)
    if name not in queries.SQL:
        return
    relation = duck.sql(queries.SQL[name])
    assert sorted(relation.columns) == columns
    want = sorted(tuple(plain(v) for v in r) for r in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
