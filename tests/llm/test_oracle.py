import duckdb
import pytest

from inkstrata.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    found = con.execute(ORACLE[name])
    cols = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted(str([r[i] for i in at]) for r in found.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in QUERIES[name](spark, sf).collect()) == want
