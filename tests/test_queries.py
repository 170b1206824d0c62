"""Every registered query of the library runs at the smallest scale, and agrees with its DuckDB twin."""

from pathlib import Path

import duckdb
import pytest
from verify import bag

from tablewright.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, db, key):
    df = QUERIES[key](spark, SF)
    got = df.collect()
    if key in ORACLE_SQL:
        cur = db.execute(ORACLE_SQL[key])
        names, wanted = [c[0] for c in cur.description], cur.fetchall()
        assert sorted(names) == sorted(df.columns)
        assert bag(df.columns, got) == bag(names, wanted)
