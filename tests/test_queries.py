"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

from drivetrove.plans.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES.split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return db


def canonical(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    answer = duck.execute(ORACLES[name])
    order = [d[0] for d in answer.description]
    assert sorted(order) == columns
    assert got == sorted(tuple(canonical(r[order.index(c)]) for c in columns) for r in answer.fetchall())
