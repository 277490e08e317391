"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from geoweave import queries, source_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    found = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want
