import duckdb
import pytest

from leadsmith.llm.oracle import SQL
from leadsmith.llm.queries import QUERIES
from tests.oracle_check import TABLES, frame_digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    s = frame_digest(sdf.columns, [tuple(r) for r in sdf.collect()])
    assert s[:3] == frame_digest([c[0] for c in cur.description], cur.fetchall())[:3]
