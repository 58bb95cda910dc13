"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return made


def _plain(value):
    return round(float(value), 6) if isinstance(value, float) else None if value is None else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    assert sorted(df.columns) == sorted(names) and got == want
