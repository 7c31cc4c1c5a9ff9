"""Every query with SQL, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from atlaspark.plans import catalog

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.skipif(not TABLES.exists(), reason="driver tables are not there")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    mine = catalog.queries()[name](spark, str(TABLES))
    names = sorted(mine.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == names
    order = [found.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in mine.select(*names).collect()), key=repr) == theirs
