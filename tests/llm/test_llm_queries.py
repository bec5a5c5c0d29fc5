"""Every query of the package runs whole, and equals its SQL where it has one."""

import duckdb
import pytest

from drivetrove.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages", "conversations")
ROWS = {"op4_html_extraction": 50, "op11_warc": 50, "op12_prefix_trie": None, "op13_divergence": None}


def canonical(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    assert ROWS.get(name, 200) in (len(got), None) and got
    if name in ORACLES:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        answer = db.execute(ORACLES[name])
        order = [d[0] for d in answer.description]
        assert sorted(order) == columns
        assert got == sorted(tuple(canonical(r[order.index(c)]) for c in columns) for r in answer.fetchall())
