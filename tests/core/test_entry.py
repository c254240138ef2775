import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodevec import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for name in os.listdir(SF):
        found.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return found


def _plain(row):
    return tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v for v in row)


def _sorted(rows):
    return sorted(map(_plain, rows), key=lambda r: str(r))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_agrees_with_its_sql(spark, tables, name):
    frame = core.QUERIES[name](spark, SF)
    asked = tables.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(frame.columns)
    assert _sorted(frame.select(*names).collect()) == _sorted(asked.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
