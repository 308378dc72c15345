"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from runnel.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    key = lambda rows: sorted([str(v) for v in r] for r in rows)
    assert key(tuple(r[c] for c in names) for r in df.collect()) == key(want.select(*[f'"{n}"' for n in names]).fetchall())
